"""Substring dedup, importance resampling with its radix sort, and centroid clustering against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import clustering, importance, radix, substring_dedup

from .test_pairs import UPPER, WORD, docs_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def clash(docs):
    """The same rows with columns whose names the operators use."""
    names = ["prefix", "context", "spans", "kept", "at", "position", "_block", "score", "rank", "weight", "n", "text_hash", "cluster", "distance", "q"]
    return docs.selectExpr("*", *(f"'x' as {n}" for n in names))


# Substring dedup


def removed(texts, n):
    """For each text the words that stay, by windows as tuples."""
    words = [SPACE.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


def passages(seed, n, docs=60, vocabulary=40):
    """Texts of few words with passages of about n words that repeat whole, in part, and with one word changed."""
    rng = np.random.default_rng(seed)
    say = lambda k: [f"w{x}" for x in rng.integers(0, vocabulary, k)]
    shared = [say(int(rng.integers(n - 1, 3 * n))) for _ in range(5)]
    out = []
    for i in range(docs):
        words = say(int(rng.integers(0, 2 * n)))
        for _ in range(int(rng.integers(0, 4))):
            piece = list(shared[int(rng.integers(5))])
            cut = int(rng.integers(0, len(piece)))
            piece = piece[cut:] if i % 3 == 0 else piece[:cut] if i % 3 == 1 else piece
            if piece and i % 4 == 0:
                piece[int(rng.integers(len(piece)))] = "other"
            words += piece + say(int(rng.integers(0, 5)))
        out.append(" ".join(words))
    return out


def check(spark, rows, n, **options):
    found = substring_dedup.drop_repeats(clash(docs_of(spark, rows)), n, **options).collect()
    words, kept = removed([t for _, t in rows], n)
    expected = sorted(((d, len(w), len(w) - len(k), " ".join(k)) for (d, _), w, k in zip(rows, words, kept, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == expected
    by = defaultdict(list)
    for (d, _), w in zip(rows, words, strict=True):
        by[d].append(w)
    for r in found:
        left = [[x for i, x in enumerate(w) if not any(s["from"] <= i < s["until"] for s in r["spans"])] for w in by[r["doc_id"]]]
        assert r["kept"] in [" ".join(w) for w in left] and sum(s["until"] - s["from"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize(("seed", "n", "options"), [(1, 12, {}), (3, 35, {"group": 1}), (5, 8, {"prefix": 1, "group": 3}), (6, 1, {})])
def test_repeated_windows_are_those_of_a_plain_count(spark, seed, n, options):
    check(spark, list(enumerate(passages(seed, max(n, 3)))), n, **options)


def test_hot_prefix_with_many_contexts(spark):
    """One phrase in all texts, with other words around it: its group is split to the last window."""
    rng = np.random.default_rng(0)
    say = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 6, k))
    rows = [(i, f"{say(12)} always the very same phrase here {say(12)}") for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(20)]
    check(spark, rows, 10, group=4, prefix=3)


def test_substring_edges(spark):
    long_ = " ".join(f"x{i}" for i in range(300_000))
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, text), (4, text), (None, f"a {text} b"), (None, None), (5, "same " * 3000), (6, long_ + " " + text), (7, "Ünï cödé wörds zwei drei vier fünf sechs"), (8, "Ünï cödé wörds zwei drei vier fünf sechs"), (9, "ONE two three four five six"), (10, "short")]
    check(spark, rows, 5)
    check(spark, [(1, "a b c d"), (2, "b c d e"), (3, "a b")], 3)
    check(spark, [(1, "lonely words only stand here once")], 3)
    assert substring_dedup.drop_repeats(docs_of(spark, []), 5).count() == 0


def test_anchors_are_found_in_every_window():
    rng = np.random.default_rng(1)
    for length in (34, 35, 36, 400):
        hashes = rng.integers(0, 2**63, length, dtype=np.uint64)
        anchor, low, high, key, context = substring_dedup.anchors(hashes, 35, 8)
        windows = sorted(int(a) - o for a, x, y in zip(anchor, low, high, strict=True) for o in range(int(x), int(y) + 1))
        assert windows == list(range(max(0, length - 34))) and (low >= 0).all() and (high <= 27).all()
        assert len(set(context.tolist())) == len(context) == len(anchor)
    assert len(substring_dedup.anchors(np.ones(50, np.uint64), 35, 8)[0]) == 16  # equal hashes: the leftmost of each window


# Radix sort


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_radix_sort(spark, block):
    rng = np.random.default_rng(block)
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(int(a), int(b), f"r{i}") for i, (a, b) in enumerate(zip(rng.integers(-3, 4, 500), rng.integers(low, high, 500), strict=True))]
    rows += [(low, high, "x"), (high, low, "y"), (0, 0, "same"), (0, 0, "same"), (0, 0, "other")]
    frame = spark.createDataFrame(rows, "a long, b long, name string").repartition(5)
    found = sorted(radix.radix_sort(frame, ["a", "b"], block=block).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(len(rows))) and [(r["a"], r["b"]) for r in found] == sorted((a, b) for a, b, _ in rows)
    assert Counter(map(tuple, (r[:3] for r in found))) == Counter(rows)


def test_radix_sort_edges(spark):
    frame = spark.createDataFrame([(5, "x")] * 40, "a long, name string")
    assert sorted(r["position"] for r in radix.radix_sort(frame, ["a"], block=4).collect()) == list(range(40))
    assert radix.radix_sort(frame.limit(0), ["a"]).count() == 0
    near = spark.createDataFrame([((1 << 62) + i % 3,) for i in range(9)], "a long")
    assert [r["a"] - (1 << 62) for r in sorted(radix.radix_sort(near, ["a"], block=2).collect(), key=lambda r: r["position"])] == [0] * 3 + [1] * 3 + [2] * 3


# Importance resampling


def resampled(rows, target, most, buckets, seed, percent, least):
    def runs(text):
        words = WORD.findall((text or "").translate(UPPER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for d, text in rows:
        n, found = runs(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(found), weight, score, None, n])
    may = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("most", "buckets", "percent", "block"), [(1, 10_000, 10, 1 << 18), (2, 500, 50, 16), (3, 50, 100, 5)])
def test_importance_sample_against_loops(spark, most, buckets, percent, block):
    rng = np.random.default_rng(most)
    say = lambda words, k: " ".join(rng.choice(words, k))
    plain, wanted = [f"Word{i}" for i in range(50)], [f"math{i}" for i in range(20)]
    rows = [(int(i * 37 - 900), say(plain if i % 3 else wanted + plain[:5], int(rng.integers(0, 60))) + "; x!") for i in range(120)]
    rows += [(10_000, None), (10_001, ""), (None, say(wanted, 40)), (5, "Ä-ö ÄÖ " * 30)]
    target = [say(wanted, 30) for _ in range(6)] + [None, ""]
    frame, goal = clash(docs_of(spark, rows)), spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.importance_sample(frame, goal, most, buckets, 2024, percent, 20, block).collect()
    assert sorted(map(tuple, found), key=repr) == resampled(rows, target, most, buckets, 2024, percent, 20)


def test_importance_prefers_what_looks_like_the_target(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)] if i % 5 else [f"m{k}" for k in range(40)], 60))) for i in range(400)]
    goal = spark.createDataFrame([(" ".join(f"m{k}" for k in range(40)),)], "text string")
    drawn = [r["doc_id"] for r in importance.importance_sample(docs_of(spark, rows), goal, percent=15).where("rank is not null").collect()]
    assert len(drawn) == 60 and np.mean([d % 5 == 0 for d in drawn]) > 0.5


def test_importance_edges(spark):
    empty = spark.createDataFrame([], "text string")
    rows = [(1, "word " * 30), (1, "word " * 30), (2, "long " * 200_000), (3, "few words")]
    found = importance.importance_sample(docs_of(spark, rows), empty, percent=100).collect()
    assert sorted(map(tuple, found), key=repr) == resampled(rows, [], 1, 10_000, 2024, 100, 20) and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3]
    assert importance.importance_sample(docs_of(spark, []), empty).count() == 0


# Centroid clustering


def clustered(rows, k, rounds, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        for n, found in of.items():
            centres[n] = [sum(x) // len(found) for x in zip(*found, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in final:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, d, fits(inertia[n]), fits(sum(inertia.values())), digest[n]) for i, d, n in final), key=repr)


def vectors(spark, rows):
    return clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


@pytest.mark.parametrize(("k", "rounds", "seed"), [(7, 3, 2), (1, 2, 0), (200, 1, 5)])
def test_clusters_against_loops(spark, k, rounds, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * 0.4 + rng.normal(size=64) * 0.1]) for i in range(150)]
    rows += [(7, rows[7][1]), (500, [0.0] * 64), (501, [0.0] * 64), (600, None), (601, [1.0] * 63), (602, [1.0] * 65), (603, [float("nan")] * 64), (604, [float("inf")] + [0.0] * 63), (605, [None] + [0.0] * 63), (606, []), (None, [0.25] * 64), (607, [3e5] + [-2e5] * 63)]
    found = clustering.cluster_vectors(vectors(spark, rows).repartition(5), k, rounds, seed).collect()
    assert sorted(map(tuple, found), key=repr) == clustered(rows, k, rounds, seed)


def test_progressive_search_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for scale in (2, 300, 1 << 30):
        x, c = rng.integers(-scale, scale + 1, (300, 64)), rng.integers(-scale, scale + 1, (12, 64))
        c[5], c[9] = c[2], x[0]
        x[1] = (c[3] + c[7]) // 2
        number, distance = clustering.nearest(x, c)
        full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert [(int(n), int(d)) for n, d in zip(number, distance, strict=True)] == [(row.index(min(row)), min(row)) for row in full]


def test_transform_against_its_matrix():
    x = np.random.default_rng(0).integers(-500, 500, (9, 64))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(64)] for i in range(64)])
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    assert (clustering.transform(x) == x @ h[np.argsort(changes)].T).all() and sorted(changes) == list(range(64))


def test_cluster_edges(spark):
    assert clustering.cluster_vectors(vectors(spark, [])).count() == 0
    assert clustering.cluster_vectors(vectors(spark, [(None, [1.0] * 64), (1, [1.0] * 3)])).count() == 0
    one = clustering.cluster_vectors(vectors(spark, [(1, [1.0] * 64)])).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in one] == [(1, 0, 0, 0)]
    huge = [(1, [0.0] * 64), (2, [1e9] * 64), (3, [3e38] * 64)]
    found = {r["vec_id"]: r for r in clustering.cluster_vectors(vectors(spark, huge), k=1, rounds=0).collect()}
    assert set(found) == {1, 2} and sum(r["distance"] is None for r in found.values()) == 1

"""Benchmark decontamination, line dedup and near-dedup against brute force, with their edge cases."""

from __future__ import annotations

import re
from itertools import combinations

import pytest
import regex

from parley.llm.decontaminate import contamination, decontaminate
from parley.llm.graph import components
from parley.llm.line_dedup import drop_duplicate_lines, duplicate_lines, simhashes
from parley.llm.near_dedup import drop_near_duplicates, near_duplicates

from ..compare import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], DOCS)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Connected components


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3), (500, None)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for pair in links for x in pair if None not in pair and pair[0] != pair[1]}
    expected = roots(nodes, [p for p in links if None not in p and p[0] != p[1]])
    assert found == expected


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination


def brute_contamination(texts, items, n=10):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(words) - n + 1)) if words else []:
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in texts:
        words = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if items_ := windows.get(tuple(words[at : at + size])):
                    hit |= set(range(at, at + size))
                    found |= items_
        out[i] = (len(words), len(hit), len(found), tuple(sorted(map(str, found))), bool(hit))
    return out


CLEAN = "nothing of this sentence stands in any test item that we know of today"
ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from here"), (2, "short item"), (3, None), (4, "  ,.; "), (10, "The quick brown fox jumps over the lazy dog and sits down again now")]
TEXTS = [
    (1, "So THE QUICK, brown fox-jumps over the lazy dog and runs away from here! " + CLEAN),
    (2, CLEAN),
    (3, None),
    (4, ""),
    (5, "a short-item, then another short item; shortitem"),
    (6, ("x " * 5000) + ITEMS[0][1] + (" y" * 5000)),
    (7, "the quick brown fox jumps over the lazy dog"),
    (8, ITEMS[0][1] + " " + ITEMS[0][1]),
    (9, "ünïcode wörds ünd émojis 🙂 the quick brown fox jumps over the lazy dog and"),
]


@pytest.mark.parametrize("most", [200_000, 0])
def test_contamination_is_brute_force(spark, most):
    found = contamination(docs_of(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string"), 10, most)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in found.collect()}
    assert got == brute_contamination(TEXTS, ITEMS)


def test_contamination_actions_and_edges(spark):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    docs = docs_of(spark, [*TEXTS, (None, ITEMS[0][1]), (2, CLEAN)])
    assert sorted(r["doc_id"] or 0 for r in decontaminate(docs, items).collect()) == [0, 2, 2, 3, 4, 7]
    spans = {r["doc_id"]: r for r in decontaminate(docs, items, action="span").collect() if r["doc_id"]}
    assert spans[1]["text"].startswith("So! ") and CLEAN in spans[1]["text"] and spans[1]["n_chars"] == len(spans[1]["text"])
    assert spans[5]["text"] == "a, then another; shortitem" and spans[2]["text"] == CLEAN and len(spans) == 9
    assert decontaminate(docs, items.limit(0)).count() == docs.count()
    assert contamination(docs.limit(0), items).count() == 0


# Near duplicates


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_near(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_duplicates_are_brute_force_on_the_test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k, threshold, num, den in ((3, "17/20", 17, 20), (5, "4/5", 4, 5)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, k, threshold).collect()}
        assert got == brute_near(rows, k, num, den)


def test_near_duplicates_edges(spark):
    base = " ".join(f"word{i}" for i in range(100))
    texts = [(5, base), (3, base.upper() + "\n"), (9, base + " tail"), (7, None), (8, "   "), (2, "two words"), (1, "Two  Words"), (4, "other"), (6, " ".join(f"long{i}" for i in range(30_000)))]
    found = {r["doc_id"]: r for r in near_duplicates(docs_of(spark, texts), 5, "4/5").collect()}
    assert {i: r["component_id"] for i, r in found.items()} == {i: v[1] for i, v in brute_near(texts, 5, 4, 5).items()}
    assert found[7]["n_shingles"] == 0 and found[8]["n_shingles"] == 0 and found[7]["kept"]
    odd = docs_of(spark, [(1, base), (1, base), (None, base), (2, base)]).selectExpr("*", "text as words", "1 as component_id", "2L as d1")
    rows = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(odd).collect())
    assert rows == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 3
    assert near_duplicates(odd.limit(0)).count() == 0


# Lines


def within(a, b, most):
    """Whether the edit distance is `most` at least: how far each diagonal gets with 0, 1, ... edits."""
    if abs(len(a) - len(b)) > most:
        return False
    reach = {0: 0}
    for edits in range(most + 1):
        new = {}
        for d in range(-edits, edits + 1):
            starts = [reach[0]] if not edits else [reach[x] + step for x, step in ((d, 1), (d - 1, 0), (d + 1, 1)) if x in reach]
            if not starts:
                continue
            i = min(max(starts), len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            if i == len(a) and i + d == len(b):
                return True
            new[d] = i
        reach = new
    return False


def brute_lines(texts, similarity=0.9):
    """Links by edit similarity alone, of all pairs of lines."""
    lines = [(d, p, regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()) for d, t in texts if d is not None for p, line in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])
    norms = sorted({n for _, _, n in lines}, key=len)
    links = []
    for i, a in enumerate(norms):
        for j in range(i + 1, len(norms)):
            most = int((1 - similarity) * len(norms[j]) + 1e-9)
            if len(norms[j]) - len(a) > most:
                break
            if within(a, norms[j], most):
                links.append((i, j))
    root = roots(range(len(norms)), links)
    number = {n: i for i, n in enumerate(norms)}
    first, out = {}, {}
    for d, p, n in lines:
        key = root[number[n]]
        if key in first and first[key] != (d, p):
            out.setdefault(d, set()).add(p)
        first.setdefault(key, (d, p))
    return {d: sorted(x) for d, x in out.items()}


LONG = "this is a rather long line with many words that will be repeated elsewhere in almost the same wording by several other documents number"
LINES = [
    (1, f"{LONG} one\nunique first line\n---\n---\n\n"),
    (2, f"another thing\n{LONG} two\nUnique, FIRST line!"),
    (3, f"{LONG} one"),
    (4, None),
    (5, ""),
    (6, "same\nsame\nsame"),
    (7, "unique first lines"),
    (8, "\n".join(f"line {i} of a very long text" for i in range(500))),
]


def test_duplicate_lines_are_brute_force(spark):
    got = {r["doc_id"]: r["dropped"] for r in duplicate_lines(docs_of(spark, LINES)).collect()}
    expected = brute_lines(LINES)
    # Document 8 has 500 lines that differ in a number: the classes they are compared with find nearly all of them.
    many, all_ = set(got.pop(8)), set(expected.pop(8))
    assert many <= all_ and len(many) >= 0.95 * len(all_) and len(all_) == 499
    assert got == expected
    assert got[3] == [0] and got[6] == [1, 2] and got[2] == [1, 2]


def test_duplicate_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    short = [(d, t) for d, t in texts if len(t or "") < 1500][:120]
    got = {r["doc_id"]: r["dropped"] for r in duplicate_lines(docs_of(spark, short)).collect()}
    assert got == brute_lines(short)


def test_simhash_is_the_majority_of_word_bits(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "one two three"), (2, "solo")], "id long, norm string")
    hashes = {r["w"]: r["h"] for r in rows.select(F.explode(F.split("norm", " ")).alias("w")).select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r["id"]: r["sim"] & (2**64 - 1) for r in simhashes(rows).collect()}
    weight = {w: len(w) for w in ("one", "two", "three")}
    assert got[1] == sum(1 << i for i in range(64) if 2 * sum(weight[w] for w in weight if hashes[w] >> i & 1) > sum(weight.values()))
    assert got[2] == hashes["solo"] & (2**64 - 1)


def test_recall_of_edited_lines(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts, edits = [], 300
    for i in range(edits):
        line = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        other = list(line)
        for _ in range(max(1, len(line) // 20)):
            at = rng.randrange(len(other))
            kind = rng.randrange(3)
            other[at : at + 1] = [] if kind == 0 else [rng.choice(words)] if kind == 1 else [other[at], rng.choice(words)]
        texts += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    expected = brute_lines(texts)
    got = {r["doc_id"] for r in duplicate_lines(docs_of(spark, texts)).collect()}
    assert len(expected) > 200 and got <= set(expected) and len(got) >= 0.97 * len(expected)


def test_long_lines_and_clashing_names(spark):
    line = " ".join(f"word{i * 7919 % 10007}" for i in range(3000))
    texts = [(1, line), (2, line.replace("word7919 ", "")), (3, " ".join(f"other{i}" for i in range(3000)))]
    docs = docs_of(spark, texts).selectExpr("*", "1 as _dropped", "2 as _doc", "3 as dropped", "4 as id", "5 as k1")
    left = drop_duplicate_lines(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_dropping_lines(spark):
    docs = docs_of(spark, [*LINES, (None, "same"), (3, f"{LONG} one")]).withColumnRenamed("lang", "norm").selectExpr("*", "1 as dropped", "2 as pos")
    left = drop_duplicate_lines(docs)
    rows = {r["doc_id"]: r for r in left.collect()}
    assert left.columns == docs.columns and 3 not in rows and None in rows and {4, 5, 8} <= set(rows)
    assert rows[6]["text"] == "same" and rows[6]["n_chars"] == 4 and rows[1]["text"] == LINES[0][1]
    assert drop_duplicate_lines(docs.limit(0)).count() == 0


def test_lines_that_differ_at_one_place_are_brute_force_by_edit_similarity_alone(spark):
    import random

    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines, copies = [], []
    for i in range(60):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(2 + i % 30)]
        line = " ".join(words)
        at = rng.randrange(len(words))
        allowed = int(0.1 * len(line) + 1e-9)
        changed = words[at] if len(words[at]) < allowed else ""
        kinds = [[*words[:at], words[at][:-1] + ("x" if words[at][-1] != "x" else "y"), *words[at + 1 :]]]
        if changed:
            kinds += [[*words[:at], *words[at + 1 :]], [*words[:at], changed[::-1] + "q", *words[at + 1 :]]]
        if allowed:
            lines.append(line)
            copies.append(" ".join(kinds[i % len(kinds)]))
    texts = [*((i, x) for i, x in enumerate(lines)), *((1000 + i, x) for i, x in enumerate(copies)), (2000, "far away from all the others")]
    every = lines + copies
    links = [(a, b) for a, b in combinations(range(len(every)), 2) if within(every[a], every[b], int(0.1 * max(len(every[a]), len(every[b])) + 1e-9))]
    root = roots(range(len(every)), links)
    ids = [i for i, _ in texts]
    expected = {2000} | {ids[x] for x in range(len(every)) if root[x] == x}
    assert len(expected) == len(lines) + 1
    assert {r["doc_id"] for r in drop_duplicate_lines(docs_of(spark, texts)).collect()} == expected

"""Toxicity, language identification, top-k, token counts and license scans: brute force, held-out accuracy, edges."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import language_id, licenses, token_counts, topk, toxicity
from parley.llm.queries import oracle_sql, queries

from ..compare import DATA, assert_same, connection
from .test_pairs import UPPER, WORD, docs_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"pipeline"}))
def test_query_equals_sql(spark, name):
    assert_same(queries()[name](spark, DATA), oracle_sql()[name], connection())


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    up, down = score[label == 1], score[label == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a, b in product(up, down)])


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    score, label = [r["score"] for r in rows], [r["toxic"] for r in rows]
    assert all(0 <= s <= 1 for s in score) and auc(score, label) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_toxicity_edges(spark):
    docs = docs_of(spark, [(i, f"plain text number {i} about the weather") for i in range(60)] + [(100, None), (101, ""), (None, "text"), (101, ""), (102, "slow " * 20_000)])
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 65 and {r["score"] for r in none} == {0.5}
    one = toxicity.toxicity(docs, spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int")).collect()
    assert {r["score"] for r in one} == {0.0}
    odd = spark.createDataFrame([(i, int(i % 2), "x") for i in range(60)] + [(0, None, ""), (1, 1, ""), (999, 1, ""), (None, 1, "")], "doc_id long, toxic int, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs.selectExpr("*", "'x' as toxic", "1 as score"), odd).collect()}
    assert found[100]["score"] == found[101]["score"] and found[None]["held_out"] and 0 <= found[102]["score"] <= 1
    assert toxicity.toxicity(docs.limit(0), odd).count() == 0


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(docs.limit(5).select("doc_id", "text")).union(spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "zzqx " * 3000)], "doc_id long, text string"))
    whole, parts = (sorted(map(tuple, toxicity.toxicity(docs, labels, most_entries=n).collect())) for n in (10**6, 2000))
    # Sums depend on what texts share a batch, in the last digits.
    whole, parts = ([(i, h, round(x, 9), p) for i, h, x, p in rows] for rows in (whole, parts))
    assert whole == parts and len({r[2] for r in whole}) > 50


def test_log_ratios_are_kneser_ney(spark):
    texts = [("you are a bad bad thing", 1), ("a good day to all of you", 0), ("bad days are good days", 0)]
    counts = toxicity.expression_counts(spark.createDataFrame(texts, "text string, toxic int")).toPandas()
    assert counts["t"].sum() == len(texts[0][0]) and counts["o"].sum() == sum(len(t) for t, x in texts if not x)
    bits, discount, rows = toxicity.BITS, toxicity.DISCOUNT, counts.to_dict("records")
    tables, longer = {}, {r["code"] for r in rows}
    for size in range(4, 0, -1):
        tables[size] = Counter(c & ((1 << bits * size) - 1) for c in longer)
        longer = set(tables[size])

    def backoff(size, suffix):
        if not size:
            return 1 / (1 << bits)
        same = {s: n for s, n in tables[size].items() if s >> bits == suffix >> bits}
        total = sum(same.values())
        return max(same.get(suffix, 0) - discount, 0) / total + discount * len(same) / total * backoff(size - 1, suffix & ((1 << bits * (size - 1)) - 1))

    def log_p(code, c):
        same = {r["code"]: r[c] for r in rows if r["code"] >> bits == code >> bits and r[c]}
        p, total = backoff(4, code & ((1 << bits * 4) - 1)), sum(same.values())
        return np.log(max(same.get(code, 0) - discount, 0) / total + discount * len(same) / total * p if total else p)

    found = {r["code"]: r["llr"] for r in toxicity.log_ratios(spark.createDataFrame(counts)).collect()}
    assert {c for c in found if c >= 0} == {r["code"] for r in rows}
    assert {c: v for c, v in found.items() if c >= 0} == pytest.approx({r["code"]: log_p(r["code"], "t") - log_p(r["code"], "o") for r in rows})


# Languages


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.identify_languages(docs).withColumnRenamed("doc_id", "id").join(docs, docs.doc_id == language_id.F.col("id")).where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_language_edges(spark):
    some = [(i, "the weather is good and the day is long" if i % 2 else "das Wetter ist gut und der Tag ist lang", "en" if i % 2 else "de") for i in range(80)]
    rows = [*some, (100, None, "en"), (101, "", "en"), (102, "123 !?", "de"), (None, "the day", "en"), (103, "the " * 30_000, None), (1, some[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as held_out")
    found = language_id.identify_languages(docs).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 86 and [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[103]["lang_pred"] == "en" and by[None]["held_out"]
    assert all(by[i]["lang_pred"] == lang and 0.5 < by[i]["score"] <= 1 for i, _, lang in some)
    kept = language_id.accepted(docs, 0.5)
    assert kept.columns == docs.columns and kept.count() == 83
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(docs.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()} == {"und"}


# Search


def test_top_k_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(300 + i, [1.0] * 8) for i in range(40)] + [(50, None), (400, [float("nan")] * 8), (450, [None] * 8), (None, [1.0] * 8), (500, [2.0] * 4), (301, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank", "3 as q").repartition(7)
    queries_ = vectors.where("vec_id % 50 = 0")
    q = {(i, tuple(np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int))) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any()}
    pad = lambda v: np.array([*v, *[0] * (8 - len(v))])
    expected = {}
    for i, v in q:
        if i % 50 == 0:
            scores = {(-int(pad(v) @ pad(w)), j) for j, w in q if j != i}
            expected[i] = [(j, -s) for s, j in sorted(scores)[:5]]
    for block in (4096, 2):
        got = {}
        for r in sorted(topk.top_k(vectors, queries_, 5, block=block).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == expected
    assert topk.top_k(vectors.limit(0), queries_).count() == 0 and topk.top_k(vectors, queries_.limit(0)).count() == 0
    few = vectors.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


# Tokens

ODD = ["", "don't you're we've I'll he'd it's I'm 'tis rock'n'roll", "a  b   c \n\n d\t\te  ", "   ", "\n", "tab\tend\t", "naïve ñandú 漢字 かな 🙂🙂 Ⅷ ½ ٣", "x" * 9000, "12345 1,234.50 a1b2", "<|endoftext|>", "say <|endoftext|> twice <|endoftext|><|endoftext|> end", "it''s 's s' 'RE 're", " nb  em　x", "é combining", "!!! ??? --- ...", " 'll", "a" + " " * 5000 + "b"]


def test_token_counts_are_the_library_s(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (None, "x y"), (3, "   ")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows += [(1000 + r["doc_id"], r["text"]) for r in docs.collect()]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = sorted((i or -1, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    frame = docs_of(spark, rows).selectExpr("*", "1 as n_bytes", "2 as word", "3 as n_tokens")
    for frequent in (50_000, 3):
        found = token_counts.token_counts(frame, VOCABULARY, frequent=frequent).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in found) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in found)
    assert token_counts.token_counts(frame.limit(0), VOCABULARY).count() == 0


# Licenses


def brute_base(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def pattern(template):
    """A template as a pattern over words, each followed by a blank, and its first mandatory words."""
    out = ""
    for maybe, most, plain in re.findall(r"\[\[(.*?)\]\]|<<(\d+)>>|((?:(?!\[\[|<<).)+)", template):
        words = "".join(re.escape(w) + " " for w in WORD.findall((maybe or plain).translate(UPPER)))
        out += rf"(?:\S+ ){{0,{most}}}" if most else f"(?:{words})?" if maybe else words
    return re.compile(r"(?:^|(?<= ))" + out)


NOTICES = [
    "Copyright (c) 2020 Some One. All rights reserved.",
    "copyright one two three four five six seven eight nine all rights reserved",
    "This work is licensed under CC BY 4.0. It is licensed under the CC BY-SA 4.0 International License",
    "released under the terms of the MIT License; Licensed under the GNU General Public License, version 3",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not",
    "licensed under the terms of the GNU General Public License, version 3 or (at your option) any later version",
    "GENERAL PUBLIC LICENSE cc-by cc by all rights, reserved",
    "all rights", "", None, "ALL RIGHTS RESERVED " * 3000,
]


def body(name, holder="THE AUTHOR", maybe=True):
    """The wording of a license with its optional parts, or without, and a holder in its free places."""
    text = re.sub(r"\[\[(.*?)\]\]", r"\1" if maybe else "", licenses.TEMPLATES[name])
    return re.sub(r"<<\d+>>", holder, text)


BODIES = [n for n in licenses.TEMPLATES if n.endswith("-text")]
NOTICES += [f"{'word ' * 50}\n{body(n, holder, maybe)}\n\nmore" for n in BODIES for holder, maybe in (("THE AUTHOR", True), ("", False), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", True))]
NOTICES += [body("mit-text").replace("MERCHANTABILITY", "MERCHANTIBILITY"), body("mit-text").lower() + " x " * 9000, body("bsd-3-clause-text", "one of the twelve or more words that no free place of it has room for at all")]


def test_licenses_are_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(-i - 1, t) for i, t in enumerate(NOTICES)] + [(r["doc_id"], r["text"]) for r in docs]
    compiled = {label: pattern(t) for label, t in licenses.TEMPLATES.items()}
    found = licenses.license_scan(docs_of(spark, rows).selectExpr("*", "1 as labels", "2 as n_words")).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        base = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        words = "".join(w + " " for w in WORD.findall((texts[r["doc_id"]] or "").translate(UPPER)))
        own = {label for label, p in compiled.items() if p.search(words)}
        assert r["labels"] == ",".join(sorted((own | set(base[4].split(","))) - {""})), texts[r["doc_id"]][:200]
        assert r["score"] == (1.0 if own - set(base[4].split(",")) else 0.5 if base[1] else 0.0)


def test_whole_licenses():
    match = lambda text: {label for label, p in ((x, pattern(t)) for x, t in licenses.TEMPLATES.items()) if p.search("".join(w + " " for w in WORD.findall(text.translate(UPPER))))}
    for name in BODIES:
        assert name in match(body(name)) and name in match(body(name, "", False))
    assert "bsd-3-clause-text" not in match(body("bsd-2-clause-text")) and "mit-text" not in match(body("mit-text").replace("NONINFRINGEMENT", "INFRINGEMENT"))


def test_equal_hashes_are_not_equal_words(monkeypatch):
    """With all hashes equal every place is a candidate, and only the words decide."""
    import pyarrow as pa

    from parley.llm import arrays

    plain = arrays.Words

    class Same(plain):
        def __init__(self, *args):
            super().__init__(*args)
            self.hashes = np.zeros_like(self.hashes)

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some other cc by words, under the MIT License", "nothing of the kind stands here"])], names=["doc_id", "text"])
    expected = next(licenses._scan(licenses.PHRASES, licenses.TEMPLATES)(iter([batch]))).to_pylist()
    monkeypatch.setattr(arrays, "Words", Same)
    assert next(licenses._scan(licenses.PHRASES, licenses.TEMPLATES)(iter([batch]))).to_pylist() == expected
    assert expected[0]["labels"] == "cc-by,mit" and expected[1]["labels"] == ""


def test_license_edges(spark):
    docs = docs_of(spark, [(None, NOTICES[0]), (1, NOTICES[0]), (1, NOTICES[0])])
    assert [r["labels"] for r in licenses.license_scan(docs).collect()] == ["copyright-notice,reserved"] * 3
    assert licenses.license_scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.compile_template("[[only optional]] <<3>>")


def test_held_out_texts_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    F = language_id.F
    held = language_id.held_out("doc_id")
    other = docs.withColumn("text", F.when(held | F.col("lang").isNull(), F.lit("qqq xxx jjj " * 50)).otherwise(F.col("text")))
    one, two = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(x).where("not held_out").join(docs.where("lang is not null").select("doc_id"), "doc_id", "left_semi").collect()} for x in (docs, other))
    assert one == two and len(one) > 100


def test_ftrl_is_brute_force():
    import math

    rows = [("aa bb", 0), ("cc dd", 1), ("aa dd", 0), ("cc bb", 1)] * 3
    idf = language_id.np.ones(language_id.FEATURES)
    model = language_id.Ftrl(2)
    z, n = ({}, {}), ({}, {})

    def weight(k, i):
        zi, ni = z[k].get(i, 0.0), n[k].get(i, 0.0)
        return 0.0 if abs(zi) <= model.l1 else -(zi - math.copysign(model.l1, zi)) / ((model.beta + math.sqrt(ni)) / model.alpha + model.l2)

    for text, label in rows:
        at, value = language_id.vector(text, idf)
        model.learn(at, value, label)
        logits = [sum(weight(k, i) * x for i, x in zip(at.tolist(), value.tolist(), strict=True)) for k in range(2)]
        top = max(logits)
        e = [math.exp(x - top) for x in logits]
        for k in range(2):
            old = {i: weight(k, i) for i in at.tolist()}
            for i, x in zip(at.tolist(), value.tolist(), strict=True):
                g = (e[k] / sum(e) - (k == label)) * x
                before = n[k].get(i, 0.0)
                z[k][i] = z[k].get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / model.alpha * old[i]
                n[k][i] = before + g * g
    weights = model.weights()
    for k in range(2):
        for i in n[k]:
            assert abs(float(weights[i, k]) - weight(k, i)) < 1e-6


def test_hashes_of_pretokens():
    import pyarrow as pa

    texts = ["It's a  test, isn't it? " + "x" * 70 + " 12 34é\n\n ok", "", "y"]
    data, offsets = token_counts.arrays.text_bytes(pa.array(texts, pa.large_string()))
    text, starts, hashes, checks, heads = token_counts.pretokens(data, offsets)
    bounds = [*starts.tolist(), len(text)]
    again = token_counts.hashes_of([text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
    assert (hashes == again[0]).all() and (checks == again[1]).all() and heads.tolist()[-1] == len(starts)

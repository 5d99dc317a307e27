"""Benchmark decontamination with DataFrame functions only.

The hash set of benchmark windows reaches every task as a constant of the scan, so the corpus is read once and only
windows whose hash is in the set leave the scan. Each of these is then verified by its wording, in a join with the
windows themselves. A benchmark with more than `most_broadcast` windows is no constant any more: then the document
windows are shuffled and joined with it instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alnum_words, unused

#: Windows up to which the set is sent to every task: some MB.
MOST_BROADCAST = 200_000


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """benchmark(item_id, text, ...) -> (gram, size, items): each distinct window of n consecutive words, as text, with
    the ids of the items that have it. An item of fewer words, but not none, is one window."""
    words = benchmark.select(F.col("item_id").alias("item"), alnum_words(F.col("text").cast("string")).alias("words")).where("size(words) > 0")
    each = words.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(words) - {n} + 1, 1)), i -> slice(words, i, {n}))")).alias("w"))
    return each.groupBy(F.array_join("w", " ").alias("gram")).agg(F.first(F.size("w")).alias("size"), F.collect_set("item").alias("items"))


def _window(size: int):
    return lambda i: F.struct((i - 1).alias("start"), F.lit(size).alias("size"), F.array_join(F.slice("words", i, size), " ").alias("gram"))


def _hits(docs: DataFrame, windows: DataFrame, most_broadcast: int) -> DataFrame:
    """docs(doc, words) -> doc, n_words, spans, items; spans are (start, size) of verified windows, in words from 0."""
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]
    few = windows.count() <= most_broadcast
    found = F.array().cast("array<struct<start:int,size:int,gram:string>>")
    for size in sizes:
        places = F.expr(f"if(size(words) >= {size}, sequence(1, size(words) - {size} + 1), cast(array() as array<int>))")
        if few:
            hashed = windows.where(F.col("size") == size).select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
            known = ",".join(f"{r['h']}L" if r["h"] > -(2**63) else f"bigint('{r['h']}')" for r in hashed.collect())
            places = F.expr(f"filter(if(size(words) >= {size}, sequence(1, size(words) - {size} + 1), cast(array() as array<int>)), i -> xxhash64(slice(words, i, {size})) in ({known}))")
        found = F.concat(found, F.transform(places, _window(size)))
    candidates = docs.select("doc", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    each = candidates.select("doc", "n_words", F.explode_outer("found").alias("f")).select("doc", "n_words", "f.*")
    wanted = windows.select("gram", "items")
    verified = each.join(F.broadcast(wanted) if few else wanted, "gram", "left")
    return verified.groupBy("doc", "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("start", "size")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> one row per input row: doc_id, n_words, n_hit, n_items,
    items (sorted as text), spans (start word and number of words of each occurrence), contaminated.

    Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased. A word inside any occurrence of a
    benchmark window is hit, and counts once however many windows cover it. Null and empty texts have no words and no
    hits; so has every text if the benchmark is empty. Rows that share a doc_id are judged one by one, a null doc_id
    like any other. Further columns of either table are ignored, whatever their names.
    """
    rows = docs.select(
        F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id")).alias("doc"),
        alnum_words(F.col("text").cast("string")).alias("words"),
    )
    hits = _hits(rows, benchmark_windows(benchmark, n), most_broadcast)
    # Windows come in order of their start: each adds what reaches beyond the words covered so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["end"], s["start"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
        ),
    )["n"]
    return hits.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"),
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "document") -> DataFrame:
    """The rows of docs with benchmark wording removed, with the columns of docs.

    action="document" drops every document with a hit; action="span" keeps it and cuts the hit words with the
    characters before them out of its text (n_chars, if there is one, follows). Rows that share a doc_id share the fate
    of the one that is hit. Edge cases are those of contamination().
    """
    spans = unused("spans", docs)
    found = contamination(docs, benchmark, n).where("contaminated and doc_id is not null").groupBy("doc_id").agg(F.first("spans").alias(spans))
    if action == "document":
        return docs.join(found, "doc_id", "left_anti").select(docs.columns)
    kept = F.filter(
        F.regexp_extract_all("text", F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)),
        lambda piece, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["size"])),
    )
    cut = docs.join(found, "doc_id", "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, "")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(docs.columns)

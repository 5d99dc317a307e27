"""Importance resampling: documents are drawn by how much their words look like a target's rather than the corpus's.

Words and word runs fall into a fixed number of buckets, so both language models are arrays of that many counts, summed
task by task; a document's weight is the mean of its features' log ratios, read from one array. Gumbel noise, fixed by a
hash of the document's id, turns the highest scores into a draw without replacement with probabilities by weight. Ranks
come from a distributed radix sort over (score, doc_id).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .radix import BLOCK, radix_sort
from .shared import cut, small_batches

#: Arrow's splitter breaks at ASCII white space; these become spaces first.
_TO_SPACE = np.where(arrays.ALNUM_WORD[np.arange(256)], arrays.LOWER[np.arange(256)], np.uint8(32)).astype(np.uint8)


def feature_buckets(column: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the bucket of every feature, how many features each text has, how many words each text has.

    Each different word or run of a batch is hashed once.
    """
    data, offsets = arrays.text_bytes(column)
    spaced = _TO_SPACE[data]
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(spaced))
    split = pc.ascii_split_whitespace(text)
    words, parent = split.flatten(), pc.list_parent_indices(split)
    filled = pc.greater(pc.binary_length(words), 0)
    words, parent = words.filter(filled), parent.filter(filled).to_numpy()
    n_words = np.bincount(parent, minlength=len(text)).astype(np.int64)
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    found, owner = [], []
    for size in range(1, most + 1):
        n = max(0, len(ids) - size + 1)
        whole = np.flatnonzero(parent[:n] == parent[size - 1 :]) if n else np.zeros(0, np.int64)
        if size == 1:
            table = np.array([zlib.crc32(w.encode()) % buckets for w in known], np.int64)
            found.append(table[ids] if len(ids) else ids)
        else:
            runs, back = np.unique(np.stack([ids[whole + j] for j in range(size)], axis=1), axis=0, return_inverse=True) if len(whole) else (np.zeros((0, size), np.int64), whole)
            table = np.array([zlib.crc32(" ".join(known[j] for j in run).encode()) % buckets for run in runs], np.int64)
            found.append(table[back.reshape(-1)] if len(whole) else whole)
        owner.append(parent[whole])
    bucket, of = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.bincount(of, minlength=len(text)).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, column: str, most: int, buckets: int) -> np.ndarray:
    """How often each bucket is met in all texts: one array a task, added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in arrays.slices(batches):
            total += np.bincount(feature_buckets(batch.column(0), most, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    parts = texts.select(F.col(column).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's over the source's smoothed share) of each bucket."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, most: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            bucket, n, n_words = feature_buckets(batch.column(1), most, len(gain))
            ends = np.cumsum(n)
            running = np.concatenate([[0], np.cumsum(gain[bucket])])
            total = running[ends] - running[ends - n]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n_words), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])

    return weigh


def importance_sample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...), target(text, ...) -> one row per row of docs: doc_id, n_features, weight, score, rank.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; features are all runs of 1 to `most` words.
    weight is the floored mean gain of a document's features, 0 without any; score adds its Gumbel noise. Of the N
    documents with at least least_words words, the percent of N (floored) with the highest scores are drawn and ranked
    1, 2, 3 ..., ties to the smaller doc_id; rank is null for the others.

    Null and empty texts have no words. A null doc_id has no noise: its score is null, and it is neither counted in N nor
    drawn. Rows that share a doc_id are documents of their own; if they tie they are ranked in any order. An empty target
    leaves the source's rarity alone to decide. An empty table gives no row. Other columns are ignored, whatever their
    names.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, "text", most, buckets), bucket_counts(target, "text", most, buckets))
    weighed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_weigh(gain, most), "doc_id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise))
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ranked = radix_sort(scored.where(may).withColumn("_worst", -F.col("score")), ["_worst", "doc_id"], block=block)
    drawn = scored.where(may).count() * percent // 100
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).union(scored.where(~may).select(*columns, F.lit(None).cast("long")))

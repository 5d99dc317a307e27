"""MinHash near-duplicates: circulant MinHash signatures, banding, exact Jaccard verification, components.

Two permutations make the whole signature: the first one scatters a shingle over 2**22 places, the second one is a
table over these places, shifted circularly by one for each further coordinate. All coordinates of a shingle are thus
one contiguous run of the table, and a signature is the minimum of such runs.

Candidates come from equal bands. Each candidate pair is either linked already (by other links) or confirmed on the
full shingle sets; no candidate is capped away:

1. texts with equal shingle sets become one class, so copies never meet in a pair;
2. in each bucket the smallest id is compared with all others, which links most of a large group in linear work;
3. pairs of a bucket that are still in different components are compared too. Sketches of one bit a coordinate drop
   those whose similarity is more than four standard errors under the threshold before any set is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .graph import components
from .shared import cut, small_batches

COORDINATES = 1024
BANDS = 48
PLACES_BITS = 22
_WORDS64 = COORDINATES // 64
_table: dict[int, np.ndarray] = {}

SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>, words binary"


def band_rows(threshold: Fraction, bands: int = BANDS, miss: float = 3e-5) -> int:
    """The most rows a band may have so that a pair at the threshold is missed with probability `miss` at most."""
    rows = 1
    while (rows + 1) * bands <= COORDINATES and (1 - float(threshold) ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def _runs(seed: int) -> np.ndarray:
    """Row i: the second permutation's values at places i, i+1, ... (circular), one for each coordinate."""
    if seed not in _table:
        places = np.random.default_rng(seed).permutation(1 << PLACES_BITS).astype(np.int32)
        _table[seed] = sliding_window_view(np.concatenate([places, places[: COORDINATES - 1]]), COORDINATES)
    return _table[seed]


def signature(shingles: np.ndarray, seed: int = 7) -> np.ndarray:
    """All coordinates of the circulant signature of a set of shingle hashes (not empty)."""
    runs = _runs(seed)
    at = (arrays.mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
    low = runs[at[:128]].min(axis=0)
    for i in range(128, len(at), 128):
        np.minimum(low, runs[at[i : i + 128]].min(axis=0), out=low)
    return low


def _sign(k: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        spread = arrays._ORDER[np.arange(rows) & 63] * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(1))
        number = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in arrays.slices(batches):
            data, offsets = arrays.text_bytes(batch.column(1))
            words = arrays.Words(data, offsets, arrays.SPACE_WORD)
            n, d1, d2, bands, sketches, packed = [], [], [], [], [], []
            for i, found in enumerate(words.shingles(k)):
                n.append(len(found))
                if not len(found):
                    d1.append(0), d2.append(0), bands.append(None), sketches.append(None), packed.append(None)
                    continue
                d1.append(int(arrays.mix(found).sum().view(np.int64)))
                d2.append(int(arrays.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                low = signature(found).astype(np.uint64)
                keys = arrays.mix((low[: rows * BANDS].reshape(BANDS, rows) * spread).sum(axis=1) + number)
                bands.append(keys.view(np.int64))
                sketches.append(np.packbits((low & np.uint64(1)).astype(bool)).view(np.int64))
                packed.append(pack.compress(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().lower().split())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch", "words"],
            )

    return sign


def _set(packed: bytes, k: int) -> set:
    words = zstandard.ZstdDecompressor().decompress(packed).split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def _confirm(k: int, num: int, den: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if a[i] != last:
                    last, mine = a[i], _set(x.as_py(), k)
                other = _set(y.as_py(), k)
                least, most = sorted((len(mine), len(other)))
                both = len(mine & other) if den * least >= num * most else 0
                if den * both >= num * (least + most - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, k: int = 5, threshold: str = "4/5") -> DataFrame:
    """docs(doc_id, text, ...) -> one row per input row: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a text's set holds its distinct k-word shingles,
    all its words as one shingle if it has fewer. Rows whose sets have Jaccard similarity >= threshold (a fraction, as
    text) are linked; component_id is the smallest doc_id reachable and kept marks the row that has it.

    Null and empty texts have no shingles and are linked with nothing. A null doc_id takes no part in links: its
    component_id is null and it is kept. Rows that share a doc_id are one node and all come back. Other columns are
    ignored, whatever their names. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    bound = Fraction(threshold)
    num, den = bound.numerator, bound.denominator
    signed = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign(k, band_rows(bound)), SIGNED))
    with_set = signed.where("n_shingles > 0 and doc_id is not null")
    classes = with_set.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    heads = with_set.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    bands = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    members = cut(bands.join(buckets, "key"))
    texts = cut(heads.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "words", "bands", *(F.col("sketch")[i].alias(f"s{i}") for i in range(_WORDS64))))

    def verified(pairs: DataFrame) -> DataFrame:
        words = texts.select("doc_id", "words")
        one, two = (words.select(F.col("doc_id").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
        both = pairs.distinct().join(two, "b").join(one, "a")
        return cut(both.select("a", "b", "words_a", "words_b").mapInArrow(_confirm(k, num, den), "a long, b long"))

    links = verified(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    joined = components(links)
    placed = members.select("key", "id").join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    open_ = placed.join(mixed, "key").join(texts.drop("words").withColumnRenamed("doc_id", "id"), "id")
    p = (1 + float(bound)) / 2
    most = int(COORDINATES * (1 - p + 4 * sqrt(p * (1 - p) / COORDINATES)))
    apart = " + ".join(f"bit_count(l.s{i} ^ r.s{i})" for i in range(_WORDS64))
    rest = open_.alias("l").join(open_.alias("r"), F.expr(f"l.key = r.key and l.component < r.component and {apart} <= {most} and array_intersect(l.bands, r.bands)[0] = l.key"))
    more = verified(rest.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")))
    # What is linked already counts as one node, so this round joins whole components.
    final = components(joined.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more)).withColumnRenamed("id", "rep")

    of_class = classes.join(final, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: str = "4/5") -> DataFrame:
    """The rows of docs that stay, one of each group, with the columns of docs. Rows that share a doc_id stay or go together."""
    gone = near_duplicates(docs, k, threshold).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

"""Exact top-k inner products by a three-phase uniform threshold.

Components are dealt into two slices. Phase one gathers from every task the vectors with the best partial scores of the
first slice, with their totals; the k-th best total of a query is a safe cutoff: the final k all reach it. Phase two
broadcasts the cutoffs and collects the sufficient entries: by the partial score and a bound of the rest (the product of
both lengths in the second slice) a vector can still reach the cutoff. Phase three resolves the rest of these scores
exactly; most pairs are never scored in full. Both passes keep k entries a query and task, so equal vectors in any
number cost nothing beyond their scan. Queries go in blocks of bounded size, each broadcast and compared with all
vectors in two scans, strip by strip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block (8 bytes a component, in every worker), and queries and vectors that are scored together.
BLOCK, STRIP, CHUNK = 32_768, 2048, 1024
#: Share of pairs beyond which a strip is scored in full at once rather than pair by pair.
MANY = 0.1
#: Every integer up to here is a double.
_EXACT = 2**53


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q: floor(256 * x) of each component. Rows that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("q")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; missing components count as 0, those beyond the width belong to no query and are cut."""
    rows = [np.asarray(x, np.float64)[:width] for x in column.to_pylist()]
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by doubles where no sum can leave their range of whole numbers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of each row of a with the same row of b."""
    if a.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query, ties to the smaller vector id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[new], vec[new], score[new]
    head = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(head, np.arange(len(query)), 0))
    return query[rank < k], vec[rank < k], score[rank < k]


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, never too small."""
    return np.sqrt((rows * rows).sum(axis=1)) * (1 + 1e-9)


def _scan(block, k: int, cutoffs=None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = block.value
        half = -(-queries.shape[1] // 2)
        lengths = _lengths(queries[:, half:])
        cut = cutoffs.value if cutoffs is not None else None
        strips = [slice(at, at + STRIP) for at in range(0, len(ids), STRIP)]
        kept = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in strips]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                vec = piece.column(0).to_numpy(zero_copy_only=False)
                data = _matrix(piece.column(1), queries.shape[1])
                beyond = _lengths(data[:, half:])
                for number, strip in enumerate(strips):
                    asked = queries[strip]
                    partial = _product(asked[:, :half], data[:, :half])
                    own = ids[strip, None] == vec[None, :]
                    if cut is None:
                        n = min(k, len(vec))
                        cols = np.argpartition(-np.where(own, np.iinfo(np.int64).min // 2, partial), n - 1, axis=1)[:, :n].ravel()
                        q = np.repeat(np.arange(len(asked)), n)
                        sound = ~own[q, cols]
                        q, cols = q[sound], cols[sound]
                    else:
                        q, cols = np.nonzero((partial + lengths[strip, None] * beyond[None, :] + 1 >= cut[strip, None]) & ~own)
                    if len(q) > MANY * partial.size:
                        total = partial[q, cols] + _product(asked[:, half:], data[:, half:])[q, cols]
                    else:
                        total = partial[q, cols] + _dots(asked[q, half:], data[cols, half:])
                    if cut is not None:
                        enough = total >= cut[strip][q]
                        q, cols, total = q[enough], cols[enough], total[enough]
                    kept[number] = _best(*(np.concatenate(x) for x in zip(kept[number], (q, vec[cols], total), strict=True)), k)
        for strip, (q, vec, score) in zip(strips, kept, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(ids[strip][q], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return scan


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> query_id, rank from 1, vec_id, score: for each query the k vectors
    with the largest integer inner product of floor(256 * x), all of them if there are fewer, ties to the smaller id.

    A query's own id is no candidate for it. Vectors that are null, or hold null or non-finite components, take no part
    on either side, nor do rows without an id; missing components of a shorter vector count as 0. Rows that repeat an
    id count once for a score. Further columns are ignored; an empty table on either side gives no row.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    data = quantised(vectors)
    asked = quantised(queries).dropDuplicates(["vec_id"])
    schema = "query_id long, vec_id long, score long"
    # Blocks are ranges of the queries' ids, each of about `block` queries; no more than one is on the driver.
    n = asked.count()
    pieces = -(-n // block)
    bounds = [None, *asked.approxQuantile("vec_id", [i / pieces for i in range(1, pieces)], 0.1 / pieces), None] if pieces > 1 else [None, None]
    found = spark.createDataFrame([], schema)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        piece = asked.where((F.lit(low).isNull() | (F.col("vec_id") > F.lit(low))) & (F.lit(high).isNull() | (F.col("vec_id") <= F.lit(high))))
        rows = piece.orderBy("vec_id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows.column("vec_id").to_numpy()
        width = max(len(x) for x in rows.column("q"))
        shared = spark.sparkContext.broadcast((ids, _matrix(rows.column("q"), width)))
        local = data.mapInArrow(_scan(shared, k), schema).distinct()
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        tops = local.withColumn("rank", F.row_number().over(by_score)).where(f"rank <= {k}").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("cut"))
        lowest = {r["query_id"]: r["cut"] for r in tops.where(f"n = {k}").collect()}
        floor = np.iinfo(np.int64).min // 4
        cutoffs = spark.sparkContext.broadcast(np.array([lowest.get(i, floor) for i in ids.tolist()]))
        found = found.union(data.mapInArrow(_scan(shared, k, cutoffs), schema))
    # A row that is repeated in other tasks comes from each of them.
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")

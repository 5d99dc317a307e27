"""Connected components of links between ids, as DataFrame joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Links up to which a round's minima are sent to every task, 16 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 300_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (id, component): each linked id with the smallest id reachable from it, itself included.

    Large-star and small-star steps in turn: each replaces a node's links by links to its smallest neighbour, until
    every link leads straight to the smallest id of its component. Minima are combined before they are shuffled, so a
    node with very many neighbours is no single task's work; its join rows are split by adaptive execution. Null ids
    and links of an id with itself are left out; repeated links count once. No link at all gives no row.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .where("u < v")
        .distinct()
    )
    state = _state(edges)
    for _ in range(most_rounds):
        sent = F.broadcast if state[0] <= MOST_BROADCAST else lambda df: df
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(sent(least), "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        low = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.withColumnRenamed("v", "x").join(sent(low), "x")
        edges = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("x").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("u < v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)

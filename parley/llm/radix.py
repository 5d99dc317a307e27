"""A distributed least-significant-digit radix sort: stable counting-sort passes, each one count and one exchange.

Rows hold a position 0, 1, 2 ... and lie in blocks of equal size by it. A pass counts each block's digits, turns the
counts into the position at which each block's run of each digit begins (all smaller digits first, then the same digit
of earlier blocks), and sends every row to its new position. Blocks are equal by construction, so no key, however
frequent, makes a large task; equal digits keep their order, so after the last digit rows are sorted by the whole key.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Bits of a digit.
DIGIT = 11
#: Rows of a block: what one task places at a time, in arrays of a few columns.
BLOCK = 1 << 18


def numbered(rows: DataFrame, position: str) -> DataFrame:
    """rows, cut from their lineage, with positions 0, 1, 2 ... in any order. The driver holds one count a partition."""
    rows = cut(rows)
    place = F.monotonically_increasing_id()
    counts = sorted(rows.groupBy(F.spark_partition_id().alias("p")).count().collect())
    starts, at = {}, 0
    for p, n in counts:
        starts[p] = at
        at += n
    if not starts:
        return rows.withColumn(position, F.lit(None).cast("long"))
    # The id of a row is its partition shifted by 33 bits, plus its place there.
    begin = F.element_at(F.lit([starts.get(p, 0) for p in range(max(starts) + 1)]).cast("array<long>"), F.spark_partition_id() + 1)
    return rows.withColumn(position, begin + place.bitwiseAND(F.lit((1 << 33) - 1)))


def _digit(key: str, shift: int) -> Column:
    return F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def _place(columns: list[str], position: str, block: int):
    """Rows of one block, with the starts of its runs -> the rows with their new positions."""

    def place(rows: pa.Table, starts: pa.Table) -> pa.Table:
        at = rows.column(position).to_numpy() % block
        digit = rows.column("_digit").to_numpy()
        in_order = np.argsort(at, kind="stable")
        by_digit = in_order[np.argsort(digit[in_order], kind="stable")]
        found, first, count = np.unique(digit[by_digit], return_index=True, return_counts=True)
        begin = np.zeros(1 << DIGIT, np.int64)
        begin[starts.column("_digit").to_numpy()] = starts.column("_start").to_numpy()
        new = np.empty(len(at), np.int64)
        new[by_digit] = np.repeat(begin[found] - first, count) + np.arange(len(at))
        return rows.select(columns).append_column(position, pa.array(new))

    return place


def radix_sort(rows: DataFrame, keys: list[str], position: str = "position", block: int = BLOCK) -> DataFrame:
    """rows with their place (0, 1, 2 ...) in the ascending order of the long columns `keys`, the first one weighing most.

    Keys are not null. Rows with equal keys get neighbouring places in any order. There are as many passes as the keys' ranges
    have digits. Each pass cuts the lineage, so a lost executor costs one pass at most. No row in, no row out.
    """
    columns = rows.columns
    of = {k: f"_{k}_bits" for k in keys}
    table = numbered(rows, position)
    range_ = table.agg(*(f(F.col(k).cast("long")) for k in keys for f in (F.min, F.max))).first()
    # Counted from the smallest key, numbers need few digits; over too wide a range, the sign is flipped instead. Either way
    # the order of the bits as an unsigned number is that of the key.
    bits = {}
    for i, k in enumerate(keys):
        low, high = range_[2 * i] or 0, range_[2 * i + 1] or 0
        narrow = high - low < 1 << 63
        table = table.withColumn(of[k], F.col(k).cast("long") - F.lit(low).cast("long") if narrow else F.col(k).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
        bits[k] = (high - low).bit_length() if narrow else 64
    carried = [*columns, *of.values()]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*carried, position).schema)
    for key in reversed(keys):
        for shift in range(0, bits[key], DIGIT):
            dealt = table.withColumns({"_block": F.floor(F.col(position) / block), "_digit": _digit(of[key], shift)})
            counts = cut(dealt.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n")))
            total, smaller = 0, [0] * (1 << DIGIT)
            for digit, n in sorted(counts.groupBy("_digit").agg(F.sum("_n")).collect()):  # one row a digit value
                smaller[digit] = total
                total += n
            earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
            starts = counts.select("_block", "_digit", (F.element_at(F.lit(smaller).cast("array<long>"), F.col("_digit") + 1) + earlier).alias("_start"))
            table = cut(dealt.groupBy("_block").cogroup(starts.groupBy("_block")).applyInArrow(_place(carried, position, block), fields))
    return table.select(*columns, position)

"""Sliding windows over turns, and sequence operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def plan_windows(turns: DataFrame, window: int, hop: int, least: int) -> DataFrame:
    """Turns (call_id, turn, speaker, start_ms, end_ms) -> call_id, turn, speaker, widx, w_start, w_end.

    A turn shorter than `least` gives none, one up to `window` itself; longer ones give a window every `hop` and, if
    `least` is left over, one that ends with the turn. widx numbers the windows of a call.
    """
    dur = F.col("end_ms") - F.col("start_ms")
    last = F.floor((dur - window) / hop).cast("long")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda i: F.struct((F.col("start_ms") + i * hop).alias("s"), (F.col("start_ms") + i * hop + window).alias("e")))
    tail = F.array(F.struct((F.col("end_ms") - window).alias("s"), F.col("end_ms").alias("e")))
    one = F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    found = F.when(dur <= window, one).when((dur - window) % hop >= least, F.concat(steps, tail)).otherwise(steps)
    each = turns.where(dur >= least).select("call_id", "turn", "speaker", F.explode(found).alias("w")).select("call_id", "turn", "speaker", F.col("w.s").alias("w_start"), F.col("w.e").alias("w_end"))
    number = F.row_number().over(Window.partitionBy("call_id").orderBy("turn", "w_start", "w_end")) - 1
    return each.select("call_id", "turn", "speaker", number.cast("long").alias("widx"), "w_start", "w_end")


def plan_embedding_windows(segments: DataFrame, window: int, hop: int, least: int) -> DataFrame:
    """Segments (call_id, turn, start_ms, end_ms) -> call_id, turn, e_start, e_end: a window every `hop` while `least` is
    left of the segment, cut at its end."""
    count = F.floor((F.col("end_ms") - F.col("start_ms") - least) / hop).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("i")
    each = segments.where(F.col("end_ms") - F.col("start_ms") >= least).select("call_id", "turn", "start_ms", "end_ms", starts)
    begin = F.col("start_ms") + F.col("i") * hop
    return each.select("call_id", "turn", begin.alias("e_start"), F.least(begin + window, F.col("end_ms")).alias("e_end"))


def smooth(value: Column | str, order: WindowSpec, whole: WindowSpec, k: int) -> Column:
    """Centred moving average of k rows that skips nulls; a series of n < k rows gets n. Even widths lean to the past.

    order: the series' partition and order; whole: the same partition without order.
    """
    column = F.col(value) if isinstance(value, str) else value
    n = F.count(F.lit(1)).over(whole)
    out = F.avg(column).over(order.rowsBetween(-(k // 2), k - 1 - k // 2))
    for shorter in range(1, k):
        out = F.when(n == shorter, F.avg(column).over(order.rowsBetween(-(shorter // 2), shorter - 1 - shorter // 2))).otherwise(out)
    return out


def smooth_all(df: DataFrame, keys: list[str], order: str, values: list[str], k: int) -> DataFrame:
    """df with each of the values (never null) replaced by its smooth() of k rows: one frame for all series of k rows or
    more, and the whole series as a list for the shorter ones only."""
    by, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(whole), "_i": F.row_number().over(by)})
    series = F.collect_list(F.when(F.col("_n") < k, F.struct(*values))).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wide = {f"_w{i}": F.avg(v).over(by.rowsBetween(-(k // 2), k - 1 - k // 2)) for i, v in enumerate(values)}
    rows = rows.withColumns({"_series": series, **wide})
    first = F.greatest(F.lit(1), F.col("_i") - F.floor(F.col("_n") / 2))
    last = F.least(F.col("_n"), F.col("_i") + F.col("_n") - 1 - F.floor(F.col("_n") / 2))
    part = F.slice("_series", first.cast("int"), (last - first + 1).cast("int"))

    def short(v: str) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x[v]) / F.size(part)

    out = rows.withColumns({v: F.when(F.col("_n") < k, short(v)).otherwise(F.col(f"_w{i}")) for i, v in enumerate(values)})
    return out.drop("_n", "_i", "_series", *wide)


def runs(df: DataFrame, keys: list[str], order: str, mask: str) -> DataFrame:
    """df with _run: a number that is the same for neighbouring rows (by order) that have the same mask."""
    by = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_run", F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, mask).orderBy(order)))


def median_smoothing(flag: str, order: WindowSpec, k: int = 3) -> Column:
    """Majority of k neighbouring 0/1 flags; beyond the ends the first and last flag are repeated."""
    first = F.first(flag).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(flag).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    votes = F.col(flag)
    for j in range(1, k // 2 + 1):
        votes = votes + F.coalesce(F.lag(flag, j).over(order), first) + F.coalesce(F.lead(flag, j).over(order), last)
    return (votes * 2 > k).cast("int")


def mean_shift(value: str, order: WindowSpec, width: int) -> Column:
    """Mean of the `width` rows from here on less that of the `width` rows before; 0 where either is not whole."""
    ahead = F.avg(value).over(order.rowsBetween(0, width - 1))
    behind = F.avg(value).over(order.rowsBetween(-width, -1))
    whole = (F.count(F.lit(1)).over(order.rowsBetween(0, width - 1)) == width) & (F.count(F.lit(1)).over(order.rowsBetween(-width, -1)) == width)
    return F.when(whole, ahead - behind).otherwise(0.0)


def rise_and_fall(value: str, order: WindowSpec, back: int) -> tuple[Column, Column]:
    """Rise over the least, and fall under the greatest value of this row and the `back` rows before it."""
    past = order.rowsBetween(-back, 0)
    return F.col(value) - F.min(value).over(past), F.max(value).over(past) - F.col(value)


def ema_with_carry(df: DataFrame, keys: list[str], order: str, value: str, enough: str, alpha: float) -> DataFrame:
    """Per key: (order, ema). The first row with enough starts it; a row without repeats it, or is skipped at the start.

    A fold over the ordered rows of one key, in the JVM; a key's rows must fit one task (a call's timeline does).
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(enough).alias("ok"))))
    start = F.struct(F.lit(None).cast("double").alias("ema"), F.array().cast("array<struct<o:double,ema:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ema = F.when(x["ok"], F.when(acc["ema"].isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * acc["ema"])).otherwise(acc["ema"])
        point = F.struct(x["o"].cast("double").alias("o"), ema.alias("ema"))
        return F.struct(ema.alias("ema"), F.when(ema.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(point))).alias("out"))

    folded = df.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.aggregate("rows", start, step)["out"].alias("out"))
    return folded.select(*keys, F.explode("out").alias("x")).select(*keys, F.col("x.o").alias(order), F.col("x.ema").alias("ema"))


def debounce(df: DataFrame, keys: list[str], time: str, value: str, separation: float) -> DataFrame:
    """Per key the rows (time, value) that stay: largest values first (ties to the earlier), each at least `separation`
    from all that stay already. A fold over a key's candidates in the JVM."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(time).cast("double").alias("t"))))
    start = F.array().cast("array<struct<v:double,t:double>>")
    kept = F.aggregate("rows", start, lambda acc, x: F.when(F.forall(acc, lambda y: F.abs(y["t"] - x["t"]) >= separation), F.concat(acc, F.array(x))).otherwise(acc))
    return df.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.explode(kept).alias("x")).select(*keys, F.col("x.t").alias(time), (-F.col("x.v")).alias(value))


def sessionise(df: DataFrame, keys: list[str], order: str, gap: Column) -> DataFrame:
    """df with session: a number that grows where `gap` (a condition on a row and its lag) holds."""
    return df.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(Window.partitionBy(*keys).orderBy(order))).drop("_new")

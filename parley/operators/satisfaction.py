"""The satisfaction engine: components of a cell series, score, timeline, confidence, per-speaker metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, FRUSTRATION, LABELS, TENSION, VALENCE

COMPONENTS = ["signal", "final_state", "trend", "persistence", "stability", "text", "prosody"]


def clip(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null counts as the lower one."""
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def dot(p: Column, weights: dict[str, float]) -> Column:
    """Sum of weight times probability over the labels; labels without a weight count 0."""
    total = F.lit(0.0)
    for i, label in enumerate(LABELS):
        if weights.get(label):
            total = total + p[i] * float(weights[label])
    return total


def valence(cells: DataFrame) -> DataFrame:
    """cells with v, the valence, and a, the weight of a cell by intensity and confidence."""
    intensity = 1 - F.col("p")[LABELS.index("neutral")]
    return cells.withColumn("v", dot(F.col("p"), VALENCE)).withColumn("a", (1 + 0.5 * intensity) * (0.5 + 0.5 * F.col("conf")))


def smoothed(series: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """series with `name`: `value` (never null) averaged over k cells around; over all n, shifted alike, if n < k."""
    order = Window.partitionBy(*keys).orderBy("t")
    whole = Window.partitionBy(*keys)
    n, place = F.count(F.lit(1)).over(whole), F.row_number().over(order)
    rows = series.withColumn("_n", n).withColumn("_i", place)
    rows = rows.withColumn("_short", F.collect_list(F.when(F.col("_n") < k, F.col(value))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    half = F.floor(F.col("_n") / 2)
    first = F.greatest(F.lit(1), F.col("_i") - half)
    last = F.least(F.col("_n"), F.col("_i") + F.col("_n") - 1 - half)
    part = F.slice("_short", first.cast("int"), (last - first + 1).cast("int"))
    short = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    wide = F.avg(value).over(order.rowsBetween(-(k // 2), k - 1 - k // 2))
    return rows.withColumn(name, F.when(F.col("_n") < k, short).otherwise(wide)).drop("_short")


def components(cells: DataFrame, keys: list[str], final: tuple[float, float, float] = (0.2, 30, 300), trend_factor: float = 1.0) -> DataFrame:
    """cells(keys, t, p, conf, tension, text_score) -> one row per key with n, the seven components (text and prosody
    null without three cells), B (raw stability) and the score.

    All cells of a key are one call's seconds; the work is windows over them and one aggregation.
    """
    order, whole = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    s = smoothed(valence(cells), keys, "v", 30, "vs")
    s = s.withColumn("_t0", F.min("t").over(whole)).withColumn("_t1", F.max("t").over(whole))
    s = s.withColumn("_span", F.col("_t1") - F.col("_t0") + 1)
    s = s.withColumn("_tn", (F.col("t") - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1e-6)))
    s = s.withColumn("_late", F.col("t") >= F.col("_t1") - clip(final[0] * F.col("_span"), final[1], final[2]))
    s = s.withColumn("_tail", F.col("_i") > F.col("_n") - 10).withColumn("_jump", F.abs(F.col("v") - F.lag("v").over(order)) > 0.5)
    s = s.withColumn("_sign", F.when(F.col("vs") > 0.25, 1).when(F.col("vs") < -0.25, -1).otherwise(0))
    s = s.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_sign").orderBy("t")))
    s = s.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_sign", "_run")))

    def ratio(where: Column) -> Column:
        return F.sum(F.when(where, F.col("a") * F.col("v"))) / F.sum(F.when(where, F.col("a")))

    def share(sign: int) -> Column:
        return F.count_if((F.col("_sign") == sign) & (F.col("_length") >= 10)) / F.count(F.lit(1))

    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("a") * F.col("v")) / F.sum("a")).alias("signal"),
        F.when(F.count_if("_late") >= 3, ratio(F.col("_late"))).otherwise(ratio(F.col("_tail"))).alias("final_state"),
        F.when((F.count(F.lit(1)) >= 6) & (F.max("_span") > 20), F.regr_slope("vs", "_tn")).otherwise(0.0).alias("slope"),
        (share(1) - share(-1)).alias("lean"),
        clip(1 - F.stddev_pop("vs") / 0.5 - F.coalesce(F.avg(F.col("_jump").cast("double")), F.lit(0.0)), 0, 1).alias("B"),
        F.when(F.count("text_score") >= 3, clip(1.5 * F.avg("text_score"), -1, 1)).alias("text"),
        F.when(F.count("tension") >= 3, clip(-2 * (F.avg("tension") - 0.5), -1, 1)).alias("prosody"),
    )
    g = g.withColumn("trend", clip(1.5 * F.col("slope"), -1, 1) * trend_factor).withColumn("persistence", clip(1.5 * F.col("lean"), -1, 1))
    g = g.withColumn("stability", (2 * F.col("B") - 1) * (0.5 + 0.5 * clip(2 * F.col("signal"), -1, 1)))
    return g.withColumn("score", score()).select(*keys, "n", *COMPONENTS, "B", "score")


def score(weights: dict[str, float] | None = None, scale: float | None = None) -> Column:
    """The 0-100 score of the component columns; those that are null drop out of both sums."""
    settings = DEFAULTS["satisfaction"]
    weights, scale = weights or settings["weights"], scale or settings["scale"]
    top = sum((F.coalesce(F.col(c) * float(w), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), abs(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return clip(50 + 50 * clip(scale * top / bottom, -1, 1), 0, 100)


def contributions(found: DataFrame) -> DataFrame:
    """components() as one row per component that is present: component, value, points (not clipped)."""
    weights, scale = DEFAULTS["satisfaction"]["weights"], DEFAULTS["satisfaction"]["scale"]
    bottom = sum((F.when(F.col(c).isNotNull(), abs(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("value"), (50 * scale * w * F.col(c) / bottom).alias("points")) for c, w in weights.items()))
    return found.withColumn("_c", F.explode(each)).where("_c.value is not null").select("call_id", "speaker", "_c.*")


def _slice_scores(t: np.ndarray, v: np.ndarray, a: np.ndarray, text: np.ndarray, tension: np.ndarray, first: np.ndarray, last: np.ndarray, final: tuple[float, float, float], trend_factor: float, width: int = 0) -> np.ndarray:
    """The score of components() for many slices of series at once: cells first to last (excluded) each, nan for slices
    without a cell. All slices are rows of one matrix, as long as the longest of them or `width`."""
    settings = DEFAULTS["satisfaction"]
    n = last - first
    at = np.arange(width or max(1, int(n.max(initial=0))))
    inside = at < n[:, None]
    cell = np.where(inside, first[:, None] + at, 0)
    rows = len(n)
    v, a, t = (np.where(inside, x[cell], 0.0) for x in (v, a, t))

    k = np.minimum(30, n)[:, None]
    low, high = np.maximum(0, at - k // 2), np.minimum(n[:, None], at + k - k // 2)
    sums = np.concatenate([np.zeros((rows, 1)), np.cumsum(v, axis=1)], axis=1)
    line = np.arange(rows)[:, None]
    vs = np.where(inside, (sums[line, np.where(inside, high, 0)] - sums[line, np.where(inside, low, 0)]) / np.maximum(np.where(inside, high - low, 1), 1), 0.0)

    t0, t1 = t[:, :1], t[line, np.maximum(n - 1, 0)[:, None]]
    span = t1 - t0 + 1
    late = inside & (t >= t1 - np.clip(final[0] * span, final[1], final[2]))
    late = np.where((late.sum(axis=1) >= 3)[:, None], late, inside & (at >= n[:, None] - 10))
    with np.errstate(divide="ignore", invalid="ignore"):
        signal = (a * v).sum(axis=1) / a.sum(axis=1)
        final_state = (a * v * late).sum(axis=1) / (a * late).sum(axis=1)
        tn = np.where(inside, (t - t0) / np.maximum(t1 - t0, 1e-6), 0.0)
        dt = np.where(inside, tn - tn.sum(axis=1, keepdims=True) / n[:, None], 0.0)
        mean = vs.sum(axis=1, keepdims=True) / n[:, None]
        dv = np.where(inside, vs - mean, 0.0)
        slope = np.where((n >= 6) & (span[:, 0] > 20), (dt * dv).sum(axis=1) / (dt * dt).sum(axis=1), 0.0)
        spread = np.sqrt((dv * dv).sum(axis=1) / n)
        jumps = np.where(n > 1, (inside[:, 1:] & (np.abs(np.diff(v, axis=1)) > 0.5)).sum(axis=1) / (n - 1), 0.0)

        sign = np.where(inside, np.where(vs > 0.25, 1, np.where(vs < -0.25, -1, 0)), 9)
        change = np.concatenate([np.ones((rows, 1), bool), sign[:, 1:] != sign[:, :-1]], axis=1)
        begin = np.maximum.accumulate(np.where(change, at, 0), axis=1)
        ends = np.concatenate([change[:, 1:], np.ones((rows, 1), bool)], axis=1)
        until = np.minimum.accumulate(np.where(ends, at, len(at))[:, ::-1], axis=1)[:, ::-1]
        lean = (np.where(until - begin + 1 >= 10, sign, 0) * inside).sum(axis=1) / n

        def mean_of(x: np.ndarray) -> np.ndarray:
            known = inside & ~np.isnan(x[cell])
            count = known.sum(axis=1)
            return np.where(count >= 3, np.where(known, x[cell], 0.0).sum(axis=1) / count, np.nan)

        steady = np.clip(1 - spread / 0.5 - jumps, 0, 1)
        parts = {
            "signal": signal, "final_state": final_state, "trend": np.clip(1.5 * slope, -1, 1) * trend_factor, "persistence": np.clip(1.5 * lean, -1, 1),
            "stability": (2 * steady - 1) * (0.5 + 0.5 * np.clip(2 * signal, -1, 1)), "text": np.clip(1.5 * mean_of(text), -1, 1), "prosody": np.clip(-2 * (mean_of(tension) - 0.5), -1, 1),
        }
        top = sum(np.where(np.isnan(parts[c]), 0.0, w * parts[c]) for c, w in settings["weights"].items())
        bottom = sum(np.where(np.isnan(parts[c]), 0.0, abs(w)) for c, w in settings["weights"].items())
        score = np.clip(50 + 50 * np.clip(settings["scale"] * top / bottom, -1, 1), 0, 100)
    return np.where(n > 0, score, np.nan)


def timeline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The satisfaction over time: keys, t, score. Every ten seconds the last sixty are scored (trend counts half) and
    smoothed exponentially; a step with fewer than three cells repeats the value before, and there is none before the
    first step with three.

    Each cell is shuffled once. A key is one speaker of one call, 43,200 cells at most. A task takes many keys together:
    their slices of equal length are rows of one matrix.
    """
    rows = valence(cells).select(*keys, "t", "cell", "v", "a", F.col("text_score").cast("double"), F.col("tension").cast("double"))
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(_lines(keys), f"{fields}, t double, score double")


#: Cells whose timelines a task works out together, keys uncut, and slices that are rows of one matrix.
_CELLS_AT_ONCE, _SLICES = 100_000, 1024


def _lines(keys: list[str]):
    """Cells in the order of keys and time -> the timelines of their keys."""
    step, window, alpha = (DEFAULTS["satisfaction"]["timeline"][x] for x in ("step", "window", "ema"))

    def begins_of(rows: pa.Table) -> np.ndarray:
        """The rows where another key begins than that of the row before."""
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in keys:
            codes = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def lines(rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        t, v, a, text, tension, cell = (rows.column(c).to_numpy().astype(float) for c in ("t", "v", "a", "text_score", "tension", "cell"))
        firsts, lasts, durations, parts = [], [], [], {}
        so_far = 0
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(t)], strict=True):
            duration = cell[begin:end].max() + 1.0
            steps = np.arange(math.ceil((duration + step) / step)) * step
            first, last = begin + np.searchsorted(t[begin:end], steps - window, "left"), begin + np.searchsorted(t[begin:end], steps + 1e-6, "right")
            for i in range(0, len(steps), _SLICES):
                width = max(1, int((last - first)[i : i + _SLICES].max()))
                parts.setdefault(width, []).append(np.arange(so_far + i, so_far + min(i + _SLICES, len(steps))))
            so_far += len(steps)
            firsts.append(first), lasts.append(last), durations.append(duration)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        scores = np.empty(so_far)
        for width, found in parts.items():
            found = np.concatenate(found)
            for i in range(0, len(found), _SLICES):
                some = found[i : i + _SLICES]
                scores[some] = _slice_scores(t, v, a, text, tension, first[some], last[some], (0.4, 5, window), 0.5, width)
        of, times, values = [], [], []
        each, n = iter(scores.tolist()), iter((last - first).tolist())
        for begin, duration, steps in zip(begins.tolist(), durations, map(len, firsts), strict=True):
            ema, before = None, len(times)
            for k in range(steps):
                score = next(each)
                if next(n) >= 3:
                    ema = score if ema is None else alpha * score + (1 - alpha) * ema
                if ema is not None:
                    times.append(min(k * step, duration)), values.append(ema)
            of += [begin] * (len(times) - before)
        columns = [rows.column(k).combine_chunks().take(pa.array(of, pa.int64())) for k in keys]
        return pa.RecordBatch.from_arrays([*columns, pa.array(times, pa.float64()), pa.array(values, pa.float64())], names=[*keys, "t", "score"])

    def timelines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _CELLS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            begins = begins_of(rows)
            whole = int(begins[-1])  # the last key may go on
            if whole:
                yield lines(rows.slice(0, whole), begins[:-1])
            held = rows.slice(whole).to_batches()
            size = rows.num_rows - whole
        if size:
            rows = pa.Table.from_batches(held)
            yield lines(rows, begins_of(rows))

    return timelines


def initial_and_final(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the first and last minute, their difference and the trend label (six points up or down)."""
    whole = Window.partitionBy(*keys)
    s = cells.withColumn("_t0", F.min("t").over(whole)).withColumn("_t1", F.max("t").over(whole))
    parts = []
    for name, where in (("initial", "t >= _t0 - 1 and t < _t0 + 60"), ("final", "t >= _t1 - 60 and t < _t1 + 1")):
        found = components(s.where(where).drop("_t0", "_t1"), keys, final=(0.4, 5, 60), trend_factor=0.5)
        parts.append(found.select(*keys, F.when(F.col("n") >= 3, F.col("score")).alias(name)))
    both = parts[0].join(parts[1], keys, "full").withColumn("delta", F.coalesce(F.col("final") - F.col("initial"), F.lit(0.0)))
    turn = DEFAULTS["satisfaction"]["trend_delta"]
    return both.withColumn("trend", F.when(F.col("delta") > turn, "improving").when(F.col("delta") < -turn, "declining").otherwise("stable"))


def confidence(cells: DataFrame, keys: list[str], audio_quality: float | None = None, mismatch: bool = False) -> DataFrame:
    """The engine's own confidence from 0 to 1: model, coverage, audio quality, text and agreement, weighted. Agreement of
    audio and text is 0.5 where no cell has one; a language that doesn't match costs less if half of the cells have one."""
    w = DEFAULTS["satisfaction"]["confidence"]
    seconds = F.count(F.lit(1))
    cover = F.when(seconds < 20, 0.2 * seconds / 20).otherwise(0.4 + 0.6 * F.least(F.lit(1.0), (seconds - 20) / 160))
    model = clip((F.avg("conf") - 0.3) / 0.5, 0, 1)
    quality = F.lit(0.7 if audio_quality is None else min(max(audio_quality / 100, 0), 1))
    total = w["model"] * model + w["coverage"] * cover + w["audio_quality"] * quality + w["text"] * (F.count("text_score") / seconds) + w["agreement"] * F.when(F.count("agreement") > 0, clip(F.avg("agreement"), 0, 1)).otherwise(0.5)
    penalty = F.when(F.count("agreement") / seconds >= 0.5, 0.85).otherwise(0.6) if mismatch else F.lit(1.0)
    return cells.groupBy(*keys).agg(F.round(clip(total / sum(w.values()) * penalty, 0, 1), 3).alias("confidence"))


def frustration_index() -> Column:
    """Audio, prosody and text frustration of a cell; what is missing leaves both sums."""
    audio = clip(dot(F.col("p"), FRUSTRATION), 0, 1)
    top = audio + F.coalesce(0.35 * clip(2 * (F.col("tension") - 0.5), 0, 1), F.lit(0.0)) + F.coalesce(0.5 * F.col("text_frust"), F.lit(0.0))
    return top / (1.0 + F.when(F.col("tension").isNotNull(), 0.35).otherwise(0.0) + F.when(F.col("text_frust").isNotNull(), 0.5).otherwise(0.0))


def tension_index() -> Column:
    audio = clip(dot(F.col("p"), TENSION), 0, 1)
    return (audio + F.coalesce(0.35 * F.col("tension"), F.lit(0.0))) / (1.0 + F.when(F.col("tension").isNotNull(), 0.35).otherwise(0.0))


def final_score(mode: str = "rules", model: Column | None = None, alpha: float = 0.5, calibration: dict | None = None) -> Column:
    """The score of components() by mode: by rules, by a model's prediction (clipped to 0-100), or hybrid, alpha of it by
    the model. Without a prediction the rules decide. A calibration that is enabled maps it to a * score + b, clipped."""
    if mode not in ("rules", "model", "hybrid"):
        raise ValueError("mode must be rules, model or hybrid")
    out = F.col("score")
    if mode != "rules" and model is not None:
        part = 1.0 if mode == "model" else alpha
        out = F.when(model.isNotNull(), part * clip(model, 0, 100) + (1 - part) * out).otherwise(out)
    calibration = DEFAULTS["calibration"] if calibration is None else calibration
    if calibration.get("enabled"):
        out = clip(calibration["a"] * out + calibration["b"], 0, 100)
    return out


def speaker_metrics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: dominant, initial and final emotion; mean frustration, tension, positive and negative shares; stability;
    mean_probabilities by label; analyzed_s, and the share of cells with an agreement; mean agreement (null without
    one) and model confidence."""
    order, back = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys).orderBy(F.desc("t"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    s = cells.withColumn("_i", F.row_number().over(order)).withColumn("_j", F.row_number().over(back)).withColumn("_n", n)
    first = F.col("_i") <= F.lit(30)
    last = F.col("_j") <= F.greatest(F.lit(3), F.least(F.lit(60), F.floor(0.2 * F.col("_n"))))

    def mean(where: Column | None) -> Column:
        return F.array(*(F.avg(F.col("p")[i] if where is None else F.when(where, F.col("p")[i])) for i in range(len(LABELS))))

    names = F.array(*map(F.lit, LABELS))
    argmax = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    found = s.groupBy(*keys).agg(
        argmax(mean(None)).alias("dominant"),
        argmax(mean(first)).alias("initial_emotion"),
        argmax(mean(last)).alias("final_emotion"),
        F.avg(frustration_index()).alias("frustration"),
        F.avg(tension_index()).alias("tension"),
        F.avg(F.col("p")[0]).alias("positive"),
        F.avg(F.col("p")[2] + F.col("p")[3] + F.col("p")[4] + F.col("p")[5]).alias("negative"),
        mean(None).alias("mean_probabilities"),
        F.count(F.lit(1)).alias("analyzed_s"),
        (F.count("agreement") / F.count(F.lit(1))).alias("text_coverage"),
        F.avg("agreement").alias("agreement"),
        F.avg("conf").alias("model_confidence"),
    )
    return found.join(components(cells, keys).select(*keys, F.col("B").alias("stability")), keys)


#: The labels of the feature vector in its fixed order.
FEATURE_LABELS = sorted(LABELS)


def call_features(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per key `features`, 39 numbers: each label's mean probability, that of the first and of the last third of the
    cells, and their change; five components; mean text score (0 without any), tension (0.5 without any), frustration
    and tension index; the largest frustration; log(1 + cells)."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    s = cells.withColumn("_n", n).withColumn("_i", i).withColumn("_third", F.greatest(F.lit(1), F.floor(F.col("_n") / 3)))
    first, last = F.col("_i") <= F.col("_third"), F.col("_i") > F.col("_n") - F.col("_third")
    p = [F.col("p")[LABELS.index(x)] for x in FEATURE_LABELS]
    before, after = ([F.avg(F.when(where, x)) for x in p] for where in (first, last))
    frustration = frustration_index()
    rest = [F.coalesce(F.avg("text_score"), F.lit(0.0)), F.coalesce(F.avg("tension"), F.lit(0.5)), F.avg(frustration), F.avg(tension_index()), F.max(frustration), F.log1p(F.count(F.lit(1)).cast("double"))]
    found = s.groupBy(*keys).agg(F.array(*map(F.avg, p), *before, *after, *(b - a for a, b in zip(before, after, strict=True))).alias("_p"), F.array(*rest).alias("_rest"))
    parts = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in ("signal", "final_state", "trend", "persistence", "stability")))
    return found.join(components(cells, keys).select(*keys, parts.alias("_c")), keys).select(*keys, F.concat("_p", "_c", "_rest").alias("features"))

"""Critical events of a call: peaks, shifts, moves of the timeline, endings, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, LABELS, VALENCE
from ..sources.tables import written
from .joins import asof_interpolate, nearest
from .satisfaction import components, dot, frustration_index, tension_index
from .series import hot_runs, peaks
from .windows import debounce, mean_shift, rise_and_fall, smooth_all

_E = DEFAULTS["events"]
KEYS = ["call_id", "speaker"]
COLUMNS = [*KEYS, "t", "t_end", "type", "severity", "confidence"]
#: Cells over which indices are smoothed, and seconds between events of the timeline.
SMOOTH, APART = 10, 120.0


def indices(cells: DataFrame) -> DataFrame:
    """cells (at least five a speaker) with frustration, tension, anger, positive and local confidence, smoothed, and v.

    Written to the shared folder, as every kind of event begins with it."""
    c = cells.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).where("_n >= 5").drop("_n")
    values = {"frustration": frustration_index(), "tension_i": tension_index(), "anger": F.col("p")[LABELS.index("angry")], "positive": F.col("p")[LABELS.index("happy")], "local": F.col("conf")}
    c = c.withColumns(values).withColumn("v", dot(F.col("p"), VALENCE)).select(*KEYS, "t", "v", *values)
    return written(smooth_all(c, KEYS, "t", list(values), SMOOTH))


def emotion_peaks(found: DataFrame) -> DataFrame:
    """indices() -> frustration_peak, anger_peak and positive_peak events."""
    out = None
    for kind, height in (("frustration", _E["frustration"]), ("anger", _E["anger"]), ("positive", _E["positive"])):
        top = debounce(peaks(found, KEYS, "t", kind, height, int(_E["separation"]), 0.08), KEYS, "t", kind, _E["separation"])
        rows = top.join(found.select(*KEYS, "t", "local"), [*KEYS, "t"])
        rows = rows.select(*KEYS, "t", F.col("t").alias("t_end"), F.lit(f"{kind}_peak").alias("type"), F.col(kind).alias("severity"), (0.5 * F.col(kind) + 0.5 * F.col("local")).alias("confidence"))
        out = rows if out is None else out.union(rows)
    return out


def shifts(found: DataFrame, width: int = 30) -> DataFrame:
    """indices() -> emotional_shift events: the mean valence of the next `width` cells differs from that of the last."""
    order = Window.partitionBy(*KEYS).orderBy("t")
    # Series of fewer than 2 * width + 1 cells are too short for a shift.
    long = F.count(F.lit(1)).over(Window.partitionBy(*KEYS)) > 2 * width
    moved = found.withColumn("_long", long).where("_long").drop("_long").withColumn("d", F.abs(mean_shift("v", order, width)))
    top = debounce(peaks(moved, KEYS, "t", "d", _E["shift"], int(_E["separation"])), KEYS, "t", "d", _E["separation"])
    size = F.least(F.lit(1.0), F.col("d"))
    return top.join(found.select(*KEYS, "t", "local"), [*KEYS, "t"]).select(*KEYS, "t", F.col("t").alias("t_end"), F.lit("emotional_shift").alias("type"), size.alias("severity"), (0.5 * size + 0.5 * F.col("local")).alias("confidence"))


def timeline_moves(timeline: DataFrame, found: DataFrame, back: int = 12, jump_rows: int = 3) -> DataFrame:
    """timeline(keys, t, score) -> recovery, deterioration and satisfaction_jump events; no jump within a minute of one of
    the others."""
    order = Window.partitionBy(*KEYS).orderBy("t")
    rise, fall = rise_and_fall("score", order, back)
    moved = timeline.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).where("_n >= 4")
    moved = moved.withColumns({"recovery": rise, "deterioration": fall, "satisfaction_jump": F.abs(F.col("score") - F.lag("score", jump_rows).over(order))})
    each = moved.select(*KEYS, "t", F.stack(F.lit(3), *(x for k in ("recovery", "deterioration", "satisfaction_jump") for x in (F.lit(k), F.col(k)))).alias("type", "dv"))
    least = F.when(F.col("type") == "satisfaction_jump", _E["jump"]).otherwise(_E["recovery"])
    kept = debounce(each.where(F.col("dv") >= least), [*KEYS, "type"], "t", "dv", APART)
    # A minute of jumps meets three minutes of the others at most, by an equi join on minutes.
    minute = F.floor(F.col("t") / 60)
    others = kept.where("type <> 'satisfaction_jump'").select(*KEYS, F.col("t").alias("o"), F.explode(F.sequence(minute - 1, minute + 1)).alias("m"))
    lone = kept.where("type = 'satisfaction_jump'").withColumn("m", minute)
    close = lone.join(others, [*KEYS, "m"]).where("abs(t - o) < 60").select(*KEYS, "t").distinct()
    rows = kept.where("type <> 'satisfaction_jump'").unionByName(lone.drop("m").join(close, [*KEYS, "t"], "left_anti"))
    near = nearest(rows, found.select(*KEYS, "t", "local"), KEYS, "t", "local")
    return near.select(*KEYS, "t", F.col("t").alias("t_end"), "type", F.least(F.lit(1.0), F.col("dv") / 50).alias("severity"), (0.4 + 0.5 * F.col("local")).alias("confidence"))


def endings(cells: DataFrame) -> DataFrame:
    """positive_ending and negative_ending events, from the final state of each speaker."""
    span = cells.groupBy(*KEYS).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    both = components(cells, KEYS).where("n >= 5").select(*KEYS, F.col("final_state").alias("f")).where(F.abs("f") >= _E["ending"]).join(span, KEYS)
    length = F.least(F.greatest(0.2 * (F.col("t1") - F.col("t0")), F.lit(30.0)), F.lit(300.0))
    size = F.least(F.lit(1.0), F.abs("f"))
    return both.select(*KEYS, F.greatest(F.col("t0"), F.col("t1") - length).alias("t"), F.col("t1").alias("t_end"), F.when(F.col("f") > 0, "positive_ending").otherwise("negative_ending").alias("type"), size.alias("severity"), (0.4 + 0.5 * size).alias("confidence"))


def conflicts(found: DataFrame, overlaps: DataFrame, step: int = 2, near: float = 6) -> DataFrame:
    """possible_conflict events: both speakers of a call are tense at once, on a grid of `step` seconds, for six seconds
    at least; overlapping speech in it adds a tenth."""
    least = _E["conflict"]
    ends = found.groupBy(*KEYS).agg(F.max("t").alias("t1"))
    calls = ends.groupBy("call_id").agg(F.max("t1").alias("last"), F.count(F.lit(1)).alias("n")).where("n = 2")
    order = Window.partitionBy(*KEYS).orderBy("t")
    # Between two cells of a speaker values are linear, and points of the grid beyond the first and last cell count 0: a
    # cell and the next one say which points between them are tense, and no others are made.
    next_ = F.lead(F.struct("t", F.col("tension_i").alias("x"))).over(order)
    pieces = found.select(*KEYS, F.col("t").alias("t0"), F.col("tension_i").alias("x0"), next_.alias("next")).select(*KEYS, "t0", "x0", F.col("next.t").alias("t1"), F.col("next.x").alias("x1"))
    pieces = pieces.where(F.greatest("x0", "x1") >= least - 1e-6)
    # The point of the next cell is that cell's own; the last cell has its own only. Of a gap its two ends are near a cell.
    first, last = F.ceil(F.col("t0") / step), F.coalesce(F.ceil(F.col("t1") / step) - 1, F.floor(F.col("t0") / step))
    pieces = pieces.withColumns({"first": F.greatest(first, F.lit(0)), "last": last}).where("first <= last")
    pieces = pieces.withColumn("until", F.least(F.col("last"), F.floor((F.col("t0") + near) / step) + 1))
    pieces = pieces.withColumn("again", F.greatest(F.col("until") + 1, F.ceil((F.col("t1") - near) / step) - 1))
    near_it = F.concat(F.sequence("first", "until"), F.when(F.col("again") <= F.col("last"), F.sequence("again", "last")).otherwise(F.array().cast("array<bigint>")))
    points = pieces.withColumn("g", F.explode(near_it)).withColumn("t", (F.col("g") * step).cast("double"))
    x = F.coalesce(F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")), "x0")
    points = points.withColumns({"x": x, "away": F.least(F.col("t") - F.col("t0"), F.col("t1") - F.col("t"))}).where((F.col("x") >= least) & (F.col("away") <= near))
    tense = points.groupBy("call_id", "t").agg(F.min("x").alias("v"), F.count(F.lit(1)).alias("both")).where("both = 2")
    both = tense.join(calls, "call_id").where("t < last").select("call_id", "t", "v")
    runs = hot_runs(both, ["call_id"], "t", "v", step, near)
    spoken = runs.join(overlaps.select("call_id", (F.col("at_ms") / 1000).alias("a"), ((F.col("at_ms") + F.col("overlap_ms")) / 1000).alias("b")), "call_id").where("b > first_s and a < last_s")
    shared = spoken.groupBy("call_id", "first_s").agg(F.sum(F.least("b", "last_s") - F.greatest("a", "first_s")).alias("o"))
    out = runs.join(shared, ["call_id", "first_s"], "left")
    severity = F.least(F.lit(1.0), F.col("v") + F.when(F.col("o") > 1, 0.1).otherwise(0.0))
    return out.select("call_id", F.lit(None).cast("string").alias("speaker"), F.col("first_s").alias("t"), F.col("last_s").alias("t_end"), F.lit("possible_conflict").alias("type"), severity.alias("severity"), (0.4 + 0.4 * F.col("v")).alias("confidence"))


#: What each kind of event says, and the kinds whose evidence is frustration rather than strong feeling.
DESCRIPTIONS = {
    "frustration_peak": "frustration is at its height",
    "anger_peak": "anger is at its height",
    "positive_peak": "good mood is at its height",
    "emotional_shift": "the mood of the next half minute differs from that of the last",
    "recovery": "satisfaction has risen",
    "deterioration": "satisfaction has fallen",
    "satisfaction_jump": "satisfaction changes at once",
    "positive_ending": "the speaker ends in a good mood",
    "negative_ending": "the speaker ends in a bad mood",
    "possible_conflict": "both speakers are tense at once",
}
_BY_FRUSTRATION = ["frustration_peak", "anger_peak", "possible_conflict"]


def evidence(events: DataFrame, utterances: DataFrame, near: float = 20.0, most: int = 2, least: float = 0.05) -> DataFrame:
    """events(call_id, speaker, t, type, ...) with `evidence`: up to `most` utterances of the speaker (of either one if
    the event has none) whose middle is at most `near` seconds away or that contain t, by frustration for some kinds and
    by the size of their text score for the others, the largest first; those up to `least` are left out.

    utterances: call_id, speaker, turn, text, start_ms, end_ms, text_score, text_frust. Both sides meet by call and minute.
    """
    rows = events.withColumn("_event", F.struct(*(c for c in ("speaker", "t", "type") if c in events.columns)))
    u = utterances.withColumn("_c", (F.col("start_ms") + F.col("end_ms")) / 2000.0)
    first = F.floor(F.least(F.col("start_ms") / 1000.0, F.col("_c") - near) / 60)
    last = F.floor(F.greatest(F.col("end_ms") / 1000.0, F.col("_c") + near) / 60)
    u = u.select("call_id", F.col("speaker").alias("_who"), "turn", "text", "start_ms", "end_ms", "text_score", "text_frust", "_c", F.explode(F.sequence(first, last)).alias("_m"))
    met = rows.select("call_id", "_event", F.floor(F.col("t") / 60).alias("_m")).join(u, ["call_id", "_m"])
    t = F.col("_event.t")
    inside = (F.abs(F.col("_c") - t) <= near) | t.between(F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0)
    met = met.where(inside & (F.col("_event.speaker").isNull() | (F.col("_event.speaker") == F.col("_who"))))
    weight = F.when(F.col("_event.type").isin(_BY_FRUSTRATION), F.col("text_frust")).otherwise(F.abs("text_score"))
    met = met.withColumn("_w", F.coalesce(weight, F.lit(0.0))).where(F.col("_w") > least)
    place = F.row_number().over(Window.partitionBy("call_id", "_event").orderBy(F.desc("_w"), "start_ms", "turn"))
    best = met.withColumn("_place", place).where(F.col("_place") <= most)
    one = F.struct(F.col("_place").alias("place"), F.substring("text", 1, 180).alias("text"), F.round(F.col("start_ms") / 1000, 2).alias("start"), F.round(F.col("end_ms") / 1000, 2).alias("end"), F.col("_w").alias("weight"))
    lists = best.groupBy(F.col("call_id").alias("_call"), F.col("_event").alias("_of")).agg(F.array_sort(F.collect_list(one)).alias("_found"))
    out = rows.join(lists, (F.col("call_id") == F.col("_call")) & F.col("_event").eqNullSafe(F.col("_of")), "left")
    return out.select(*events.columns, F.coalesce("_found", F.array().cast(lists.schema["_found"].dataType)).alias("evidence"))


def critical_events(cells: DataFrame, timeline: DataFrame, overlaps: DataFrame, utterances: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """All events that are confident enough, with the emotion of the nearest cell, the satisfaction at their time, a
    description, and the evidence of the utterances if these are given. Cells and timeline are written to the shared folder
    first, as each kind of event reads them; stored says that they are read from files already."""
    if not stored:
        cells, timeline = written(cells), written(timeline)
    found = indices(cells)
    every = [emotion_peaks(found), shifts(found), timeline_moves(timeline, found), endings(cells), conflicts(found, overlaps)]
    rows = every[0].select(COLUMNS)
    for more in every[1:]:
        rows = rows.union(more.select(COLUMNS))
    rows = rows.where(F.col("confidence") >= _E["min_confidence"])
    emotion = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("p", F.array_max("p")).cast("int"))
    rows = nearest(rows, cells.select(*KEYS, "t", emotion.alias("emotion")), KEYS, "t", "emotion")
    out = asof_interpolate(rows, timeline.withColumnRenamed("score", "satisfaction"), KEYS, "t", "satisfaction").select(*COLUMNS, "emotion", F.round("satisfaction", 1).alias("satisfaction"))
    out = out.withColumn("description", F.create_map(*(F.lit(x) for pair in DESCRIPTIONS.items() for x in pair))[F.col("type")])
    return out if utterances is None else evidence(written(out), utterances)

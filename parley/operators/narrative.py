"""What is told of a call in words: cautious sentences, for readers of Spanish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of emotions, directions, kinds of events and levels of confidence, and the closing remark.
EMOTIONS = {"angry": "enojo", "disgust": "disgusto", "fear": "miedo", "happy": "alegría", "neutral": "neutralidad", "sad": "tristeza", "surprise": "sorpresa"}
TRENDS = {"improving": "positiva", "declining": "negativa", "stable": "estable"}
EVENTS = {
    "frustration_peak": "frustración elevada", "anger_peak": "pico de enojo", "positive_peak": "pico de emoción positiva", "emotional_shift": "cambio emocional importante", "recovery": "recuperación emocional",
    "deterioration": "deterioro emocional", "satisfaction_jump": "cambio brusco de satisfacción", "possible_conflict": "posible conflicto", "positive_ending": "final positivo", "negative_ending": "final negativo",
}
CLOSING = "Estos resultados son estimaciones de un modelo y no constituyen una afirmación definitiva sobre el estado de los participantes; se recomienda revisión humana de los momentos críticos."
#: Kinds of events that are named.
NAMED = 4


def _named(names: dict[str, str], key: Column, unknown: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key), unknown)


def emotion_name(label: Column) -> Column:
    return _named(EMOTIONS, F.coalesce(label, F.lit("")), F.when(F.coalesce(label, F.lit("")) == "", "sin dato").otherwise(label))


def confidence_word(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "alta").when(confidence >= 0.5, "moderada").otherwise("baja")


def whole(x: Column, signed: bool = False) -> Column:
    """A number without decimals, half to even, with its sign if asked."""
    digits = F.bround(F.abs(x), 0).cast("long").cast("string")
    return F.concat(F.when(x < 0, "-").otherwise("+" if signed else ""), digits)


def executive_summary(speakers: DataFrame, interaction: DataFrame, events: DataFrame) -> DataFrame:
    """call_id, summary: one row for each call of speakers.

    speakers: call_id, speaker, initial_emotion, final_emotion, score, confidence, trend, and name, if there is one; they
    are told of in the order of their labels. interaction: call_id, initial, final, variation; told of calls with more than
    one speaker. events: call_id, t, type; the most frequent kinds are named, those of equal number by their first time.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("call_id"))
    who = F.when(n == 1, "la persona").otherwise(F.coalesce("name", "speaker") if "name" in speakers.columns else F.col("speaker"))
    told = F.concat(
        F.lit("Durante la llamada, "), who, F.lit(" presentó una evolución emocional desde "), emotion_name(F.col("initial_emotion")), F.lit(" como señal inicial predominante hacia "), emotion_name(F.col("final_emotion")),
        F.lit(" en el tramo final; el modelo estima una satisfacción de "), whole(F.col("score")), F.lit("/100 (confianza "), confidence_word(F.col("confidence")), F.lit(") y una tendencia "), _named(TRENDS, F.col("trend"), F.col("trend")), F.lit("."),
    )
    each = speakers.select("call_id", n.alias("n"), F.struct("speaker", told.alias("told")).alias("x"))
    calls = each.groupBy("call_id").agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["told"]), " ").alias("_speakers"))
    moved = F.concat(F.lit("A nivel de interacción, la satisfacción estimada pasó de "), whole(F.col("initial")), F.lit(" a "), whole(F.col("final")), F.lit(" (variación "), whole(F.col("variation"), signed=True), F.lit(")."))
    moves = interaction.where("initial is not null and final is not null").select("call_id", moved.alias("_moved"))
    kinds = events.groupBy("call_id", "type").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("first"))
    kind = F.struct((-F.col("k")).alias("k"), "first", F.concat(_named(EVENTS, F.col("type"), F.col("type")), F.lit(" ("), F.col("k").cast("string"), F.lit(")")).alias("told"))
    listed = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(kind)), 1, NAMED), lambda x: x["told"]), ", ")
    marked = kinds.groupBy("call_id").agg(F.concat(F.lit("Se detectaron "), F.sum("k").cast("string"), F.lit(" momentos destacados: "), listed, F.lit(".")).alias("_events"))
    met = calls.join(moves, "call_id", "left").join(marked, "call_id", "left")
    return met.select("call_id", F.concat_ws(" ", "_speakers", F.when(F.col("n") > 1, F.col("_moved")), "_events", F.lit(CLOSING)).alias("summary"))

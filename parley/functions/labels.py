"""Names of scores, confidences, errors and emotions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The highest whole score of each interpretation.
INTERPRETATIONS = {"very_low": 20, "low": 40, "neutral": 60, "good": 80, "high": 100}
#: Other names of the emotion labels.
ALIASES = {"ang": "angry", "anger": "angry", "hap": "happy", "happiness": "happy", "joy": "happy", "neu": "neutral", "sadness": "sad", "fearful": "fear", "disgusted": "disgust", "surprised": "surprise", "others": "other"}


def interpretation(score: Column) -> Column:
    """Key of a score from 0 to 100, rounded half to even; unknown beyond."""
    whole = F.bround(score, 0)
    out = F.when(whole.isNull() | (whole < 0), "unknown")
    for key, most in INTERPRETATIONS.items():
        out = out.when(whole <= most, key)
    return out.otherwise("unknown")


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def error_message(status: Column, code: Column) -> Column:
    """What a user is told: null unless the status is ERROR; the code's third part, if it has three, else a general
    message by its beginning."""
    parts = F.split(F.coalesce(code, F.lit("")), ":", 3)
    general = F.when(code.startswith("audio_processing"), "The audio could not be processed.").otherwise("The analysis could not be finished.")
    return F.when(status == "ERROR", F.when(F.size(parts) == 3, parts[2]).otherwise(general))


def slug(label: Column) -> Column:
    return F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[a-z_][a-z0-9_]*$")


def emotion(label: Column) -> Column:
    """The label's usual name."""
    plain = slug(label)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[plain], plain)

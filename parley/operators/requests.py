"""Searches over labelled samples, and checks of what is asked for: a row for each request, with all that is wrong in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of numbers, of lengths, and of a page's size, by field.
RANGES = {"satisfaction": (0, 100), "csat": (0, 100), "nps": (0, 10), "page": (1, None), "page_size": (1, 200)}
LENGTHS = {"password": (8, 128), "name": (2, 200)}
SPLITS = ["train", "validation", "test"]


def sample_filters(samples: DataFrame, split: str | None = None, emotion: str | None = None, with_issues: bool | None = None) -> DataFrame:
    """samples(split, emotion, issues) that have the split and the emotion, and issues or none; what is None doesn't matter.
    A null list of issues is an empty one. Conditions on split and emotion reach the scan."""
    if split is not None:
        samples = samples.where(F.col("split") == split)
    if emotion is not None:
        samples = samples.where(F.col("emotion") == emotion)
    if with_issues is not None:
        some = F.coalesce(F.size("issues"), F.lit(0)) > 0
        samples = samples.where(some if with_issues else ~some)
    return samples


def range_error(field: str, value: Column, least: float | None, most: float | None) -> Column:
    """field.low or field.high, null if the value is null or within its bounds; NaN is out of any."""
    low = F.lit(False) if least is None else value < least
    high = F.lit(False) if most is None else (value > most) | F.isnan(value.cast("double"))
    return F.when(low, f"{field}.low").when(high, f"{field}.high")


def split_errors(shares: dict[str, Column]) -> list[Column]:
    """Of the three shares: negative ones, no train or validation, a sum that isn't positive. Missing shares count 0."""
    known = {s: F.coalesce(shares.get(s, F.lit(0.0)), F.lit(0.0)) for s in SPLITS}
    total = known["train"] + known["validation"] + known["test"]
    return [
        F.when(F.least(*known.values()) < 0, "split.negative"),
        F.when((known["train"] <= 0) | (known["validation"] <= 0), "split.empty"),
        F.when(~(total > 0) | F.isnan(total), "split.sum"),
    ]


def request_errors(requests: DataFrame, required: list[str] | None = None) -> Column:
    """All errors of a row, in a fixed order, as an array: of those fields in RANGES and LENGTHS that the table has, of
    `required` fields that are null or blank (field.missing), of the shares if it has train and validation."""
    has = set(requests.columns)
    found = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"{c}.missing") for c in required or []]
    found += [range_error(c, F.col(c), *b) for c, b in RANGES.items() if c in has]
    found += [range_error(f"{c}.length", F.length(c), *b) for c, b in LENGTHS.items() if c in has]
    if {"train", "validation"} <= has:
        found += split_errors({s: F.col(s).cast("double") for s in SPLITS if s in has})
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def checked(requests: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that can be used, refused rows with errors)."""
    marked = requests.withColumn("errors", request_errors(requests, required))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)

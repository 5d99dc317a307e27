"""Plug-in points: what can be exchanged in an analysis, by name. A task builds a plug-in once and keeps it.

A plug-in is made by a factory of a configuration. Registering happens where a module is imported; tasks import the module
too, so `needs` names modules that a worker must import before it can build one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .functions import text as tf


class EmotionModel(Protocol):
    def predict(self, texts_or_samples: list[Any]) -> list[list[float]]: ...


class TextAnalyzer(Protocol):
    def analyze(self, clean: str | None) -> tuple: ...


class PIIDetector(Protocol):
    def spans(self, text: str) -> list[tuple[str, int, int]]: ...


class Diarizer(Protocol):
    def voices(self, features: np.ndarray) -> np.ndarray: ...


class Transcriber(Protocol):
    def words(self, samples: np.ndarray, rate: int) -> list[tuple[float, float, str, float]]: ...


class VoiceDetector(Protocol):
    def segments(self, samples: np.ndarray, rate: int) -> list[tuple[float, float]]: ...


class Storage(Protocol):
    def open(self, path: str) -> Any: ...


KINDS: dict[str, type] = {"emotion_model": EmotionModel, "text_analyzer": TextAnalyzer, "pii_detector": PIIDetector, "diarizer": Diarizer, "transcriber": Transcriber, "voice_detector": VoiceDetector, "storage": Storage}
_METHODS = {"emotion_model": "predict", "text_analyzer": "analyze", "pii_detector": "spans", "diarizer": "voices", "transcriber": "words", "voice_detector": "segments", "storage": "open"}
_factories: dict[tuple[str, str], Callable[[dict], Any]] = {}
_built: dict[tuple[str, str, str], Any] = {}


def register(kind: str, name: str, factory: Callable[[dict], Any]) -> None:
    """Offer a plug-in; a later one of the same name replaces an earlier one, built ones of it are forgotten."""
    if kind not in KINDS:
        raise ValueError(f"no such plug-in point: {kind}; there are {', '.join(KINDS)}")
    _factories[kind, name] = factory
    for key in [k for k in _built if k[:2] == (kind, name)]:
        del _built[key]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _factories if k == kind)


def build(kind: str, name: str, config: dict | None = None) -> Any:
    """The plug-in of that name and configuration, built at the first call in a process."""
    if (kind, name) not in _factories:
        raise ValueError(f"no {kind} is named {name}; there are {', '.join(names(kind)) or 'none'}")
    key = (kind, name, json.dumps(config or {}, sort_keys=True))
    if key not in _built:
        made = _factories[kind, name](config or {})
        if not callable(getattr(made, _METHODS[kind], None)):
            raise TypeError(f"{name} is no {kind}: it lacks {_METHODS[kind]}()")
        _built[key] = made
    return _built[key]


def apply(rows: DataFrame, kind: str, name: str, columns: list[str], keep: list[str], schema: str, call: Callable[[Any, tuple], list[tuple]], config: dict | None = None, needs: list[str] | None = None) -> DataFrame:
    """rows -> keep and schema: for each row, call(plug-in, its columns) gives the rows that come of it, any number."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    produced = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for module in needs or []:
            import_module(module)
        plug = build(kind, name, config)
        for batch in batches:
            out = [(*(row[len(columns) :]), *found) for row in batch.itertuples(index=False, name=None) for found in call(plug, row[: len(columns)])]
            if out:
                yield pd.DataFrame(out, columns=[*keep, *produced])

    # A column may be asked for and kept, so each has a name of its own on the way.
    asked = rows.select(*(rows[c].alias(f"a{i}") for i, c in enumerate(columns)), *(rows[c].alias(f"k{i}") for i, c in enumerate(keep)))
    return asked.mapInPandas(each, f"{fields}, {schema}" if fields else schema)


class _Lexicon:
    def __init__(self, config: dict):
        self.sign = config.get("sign", "reference")

    def analyze(self, clean: str | None) -> tuple:
        return tf.lexicon_signals(clean, self.sign)


class _Rules:
    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return tf.pii_spans(text)


class _Energy:
    """Frames of 30 ms above a level and above the quietest tenth, joined over short pauses."""

    def __init__(self, config: dict):
        self.level, self.pause, self.least = config.get("threshold_db", -42.0), config.get("pause", 0.3), config.get("least", 0.25)

    def segments(self, samples: np.ndarray, rate: int) -> list[tuple[float, float]]:
        size = int(0.03 * rate)
        n = len(samples) // size
        if not n:
            return []
        db = 10 * np.log10(np.mean(np.asarray(samples[: n * size], float).reshape(n, size) ** 2, axis=1) + 1e-10)
        active = np.diff((db > max(self.level, np.percentile(db, 10) + 10)).astype(np.int8), prepend=0, append=0)
        out: list[list[float]] = []
        for a, b in zip(0.03 * np.flatnonzero(active == 1), 0.03 * np.flatnonzero(active == -1), strict=True):
            if out and a - out[-1][1] <= self.pause + 1e-9:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(float(a), float(b)) for a, b in out if b - a >= self.least - 1e-9]


class _Cepstral:
    def voices(self, features: np.ndarray) -> np.ndarray:
        from .operators.diarization import median_of_five, two_means

        rows = (features - features.mean(axis=0)) / (features.std(axis=0) + 1e-6)
        return median_of_five(two_means(rows))


class _Files:
    def open(self, path: str) -> Any:
        from .sources.blocks import opened

        return opened(path)


register("text_analyzer", "lexicon", _Lexicon)
register("pii_detector", "rules", lambda config: _Rules())
register("voice_detector", "energy", _Energy)
register("diarizer", "cepstral", lambda config: _Cepstral())
register("storage", "files", lambda config: _Files())

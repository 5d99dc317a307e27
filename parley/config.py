"""Defaults of the engine, merging of overrides, and validation."""

from __future__ import annotations

import copy
from typing import Any

#: Emotion labels with their valence, and the parts of frustration and tension they carry.
LABELS = ["happy", "neutral", "angry", "sad", "fear", "disgust", "surprise"]
VALENCE = {"happy": 1.0, "neutral": 0.2, "angry": -1.0, "sad": -0.6, "fear": -0.5, "disgust": -0.9, "surprise": 0.1, "other": 0.0}
FRUSTRATION = {"angry": 1.0, "disgust": 0.7, "sad": 0.25, "fear": 0.15}
TENSION = {"angry": 1.0, "fear": 0.6, "disgust": 0.4, "surprise": 0.2}

DEFAULTS: dict[str, Any] = {
    "segmentation": {"window": 5.0, "hop": 2.5, "min_window": 1.0, "min_turn": 0.6, "merge_gap": 0.8},
    "interaction": {"min_overlap": 0.3, "long_silence": 4.0, "pause": 1.0},
    "vad": {"threshold_db": -42.0, "min_speech": 0.25, "min_silence": 0.3, "block": 300.0, "frame_ms": 30},
    "channels": {"max_correlation": 0.55, "max_overlap": 0.30, "min_active": 0.03},
    "quality": {"weights": {"snr": 0.35, "clipping": 0.15, "level": 0.15, "speech": 0.20, "bandwidth": 0.15}, "low": 60.0},
    "analysis_quality": {"weights": {"audio": 0.20, "speech": 0.10, "segments": 0.10, "model": 0.25, "diarization": 0.20, "transcription": 0.15}, "low": 60.0, "mismatch": 0.8},
    "diarization": {"minor": 0.05, "match": 0.55, "sim": 0.72, "gap": 0.25, "share": 0.08, "window": 3.0, "hop": 1.5},
    "transcription": {"block": 600.0, "preferred": "es", "min_language_confidence": 0.60},
    "fusion": {"match": [0.7, 0.3], "mismatch": [0.35, 0.65], "temperature_mismatch": 7.5, "audio": 1.0, "prosody": 0.35, "text": 0.5},
    "satisfaction": {
        "weights": {"signal": 1.0, "final_state": 1.2, "trend": 1.0, "persistence": 1.0, "stability": 0.3, "text": 0.4, "prosody": 0.25},
        "scale": 1.6,
        "timeline": {"step": 10.0, "window": 60.0, "ema": 0.35},
        "confidence": {"model": 0.35, "coverage": 0.25, "audio_quality": 0.15, "text": 0.10, "agreement": 0.15},
        "trend_delta": 6.0,
    },
    "events": {"separation": 45.0, "frustration": 0.55, "anger": 0.60, "positive": 0.60, "shift": 0.45, "jump": 15.0, "recovery": 15.0, "conflict": 0.45, "ending": 0.20, "min_confidence": 0.35},
    "calibration": {"enabled": False, "min_samples": 30, "a": 1.0, "b": 0.0},
    "training": {"validation": 0.15, "test": 0.15, "patience": 3, "imbalance": 0.5},
}


def deep_merge(base: dict, override: dict) -> dict:
    """base with the values of override; dictionaries are merged, all else is replaced. Neither is changed."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def difference(base: dict, changed: dict) -> dict:
    """The smallest override that turns base into changed (values that changed lacks stay as they are)."""
    out = {}
    for key, value in changed.items():
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            if inner := difference(base[key], value):
                out[key] = inner
        elif key not in base or base[key] != value:
            out[key] = copy.deepcopy(value)
    return out


def validate(config: dict) -> list[str]:
    """What is wrong with a configuration; nothing if it can be used."""
    wrong = []
    cut = config["segmentation"]
    if not 0.5 <= cut["window"] <= 30:
        wrong.append("segmentation.window must be from 0.5 to 30")
    if not 0.1 <= cut["hop"] <= cut["window"]:
        wrong.append("segmentation.hop must be from 0.1 to the window")
    if config["satisfaction"]["scale"] <= 0:
        wrong.append("satisfaction.scale must be positive")
    if config.get("mode", "rules") not in ("rules", "model", "hybrid"):
        wrong.append("mode must be rules, model or hybrid")
    if config.get("sample_rate", 16000) not in (8000, 16000, 22050, 32000, 44100, 48000):
        wrong.append("sample_rate is not supported")
    for name, (low, high) in config.get("ranges", {}).items():
        if low > high:
            wrong.append(f"ranges.{name}: the minimum is above the maximum")
    return wrong

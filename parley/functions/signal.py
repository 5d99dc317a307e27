"""Short-time spectra in numpy: mel filters, cepstral coefficients, their slopes, centroids; resampling and stretching.

Conventions are those that are usual for speech: periodic Hann windows, frames centred by zero padding, Slaney's mel
scale with filters of equal area, an orthonormal cosine transform.
"""

from __future__ import annotations

import functools

import numpy as np


def frames_of(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """Frames (n, size) of a signal, every `hop` samples; with centred, the i-th one has sample i * hop in its middle."""
    x = np.pad(np.asarray(x, float), size // 2) if centred else np.asarray(x, float)
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def spectrum(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Magnitudes (frames, size // 2 + 1); a block of frames at a time, so that a long signal needs no more."""
    frames, window = frames_of(x, size, hop), hann(size)
    parts = [np.abs(np.fft.rfft(frames[i : i + 4096] * window)) for i in range(0, len(frames), 4096)]
    return np.concatenate(parts) if parts else np.zeros((0, size // 2 + 1))


def hz_to_mel(hz: np.ndarray | float) -> np.ndarray:
    """Linear up to 1000 Hz (15 mel there), then 27 mel for each factor 6.4."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def mel_to_hz(mel: np.ndarray | float) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@functools.cache
def mel_filters(rate: int, size: int, mels: int) -> np.ndarray:
    """(mels, size // 2 + 1): triangles between neighbours of mels + 2 points, equally far apart in mel, of area 1 in Hz."""
    points = mel_to_hz(np.linspace(0, hz_to_mel(rate / 2), mels + 2))
    bins = np.arange(size // 2 + 1) * rate / size
    up = (bins[None, :] - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - bins[None, :]) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (points[2:] - points[:-2]))[:, None]


@functools.cache
def cosine_transform(size: int, kept: int) -> np.ndarray:
    """(kept, size): the first rows of the orthonormal cosine transform of the second kind."""
    k, i = np.arange(kept)[:, None], np.arange(size)[None, :]
    rows = np.sqrt(2 / size) * np.cos(np.pi * k * (2 * i + 1) / (2 * size))
    rows[0] /= np.sqrt(2)
    return rows


def mfcc(magnitudes: np.ndarray, rate: int, kept: int = 24, mels: int = 40) -> np.ndarray:
    """(frames, kept) cepstral coefficients of magnitudes (frames, bins); levels end 80 dB under the loudest one."""
    if not len(magnitudes):
        return np.zeros((0, kept))
    size = 2 * (magnitudes.shape[1] - 1)
    db = 10 * np.log10(np.maximum(magnitudes**2 @ mel_filters(rate, size, mels).T, 1e-10))
    return np.maximum(db, db.max() - 80) @ cosine_transform(mels, kept).T


def slopes(rows: np.ndarray, width: int = 9) -> np.ndarray:
    """The slope of the line fitted to each row and its neighbours; at both ends that of the last whole neighbourhood."""
    half = width // 2
    if len(rows) < width:
        return np.zeros_like(rows)
    weights = np.arange(-half, half + 1)
    inner = sum(w * rows[half + w : len(rows) - half + w] for w in weights) / (weights**2).sum()
    return np.concatenate([np.repeat(inner[:1], half, axis=0), inner, np.repeat(inner[-1:], half, axis=0)])


def centroid(magnitudes: np.ndarray, rate: int) -> np.ndarray:
    """The mean frequency of each frame, weighted by magnitude; 0 in silence."""
    bins = np.linspace(0, rate / 2, magnitudes.shape[1])
    total = magnitudes.sum(axis=1)
    return np.where(total > 0, magnitudes @ bins / np.maximum(total, 1e-30), 0)


@functools.lru_cache(8)
def _kernels(cut: float, taps: int, steps: int = 1024) -> np.ndarray:
    """(steps + 1, taps) weights of a windowed sinc, for positions between two samples in equal steps."""
    half = taps // 2
    distance = np.arange(steps + 1)[:, None] / steps - np.arange(-half + 1, half + 1)[None, :]
    return cut * np.sinc(cut * distance) * np.where(np.abs(distance) <= half, 0.5 + 0.5 * np.cos(np.pi * distance / half), 0)


def resample(x: np.ndarray, factor: float, taps: int = 32) -> np.ndarray:
    """The signal with round(len * factor) samples, by a windowed sinc; frequencies that the new rate can't hold are cut."""
    x = np.asarray(x, float)
    n = int(round(len(x) * factor))
    if not n or not len(x):
        return np.zeros(0)
    cut = min(1.0, factor)
    half = int(np.ceil(taps / 2 / cut))
    kernels = _kernels(cut, 2 * half)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, half), 2 * half)[1:]
    out = np.empty(n)
    # Few at a time, so that what is gathered stays in the processor's cache.
    for a in range(0, n, 1 << 10):
        at = np.arange(a, min(n, a + (1 << 10))) / factor
        base = np.minimum(np.floor(at).astype(int), len(x) - 1)
        step = np.round((at - base) * (len(kernels) - 1)).astype(int).clip(0, len(kernels) - 1)
        out[a : a + len(at)] = np.einsum("ij,ij->i", windows[base], kernels[step])
    return out


def stretch(x: np.ndarray, factor: float, rate: int) -> np.ndarray:
    """The signal `factor` times as long at the same pitch: overlapping pieces are laid out anew, each one moved to where
    it goes on best from the one before."""
    x = np.asarray(x, float)
    n = int(round(len(x) * factor))
    size = min(int(0.04 * rate) // 2 * 2, len(x) // 2 * 2)
    if size < 8 or n < size:
        return resample(x, factor)
    hop, reach = size // 2, size // 4
    window = hann(size)
    out, weight = np.zeros(n + size), np.zeros(n + size)
    padded = np.pad(x, (reach, size + hop + reach))
    sums = np.cumsum(np.append(0, padded**2))
    energies = np.maximum(sums[size:] - sums[:-size], 0)
    follows = None
    for at in range(0, n, hop):
        ideal = min(int(at / factor), len(x) - 1)
        begin = ideal + reach
        if follows is not None:
            around = padded[ideal : ideal + 2 * reach + size]
            match = np.correlate(around, follows, "valid")
            begin = ideal + int(np.argmax(match / np.sqrt(energies[ideal : ideal + len(match)] + 1e-9)))
        out[at : at + size] += padded[begin : begin + size] * window
        weight[at : at + size] += window
        follows = padded[begin + hop : begin + hop + size]
        if len(follows) < size:
            follows = np.pad(follows, (0, size - len(follows)))
    return out[:n] / np.maximum(weight[:n], 1e-3)


def shift_pitch(x: np.ndarray, semitones: float, rate: int) -> np.ndarray:
    """The signal with its frequencies changed by `semitones` and its length kept."""
    factor = 2 ** (semitones / 12)
    out = resample(stretch(x, factor, rate), 1 / factor)
    return out[: len(x)] if len(out) >= len(x) else np.pad(out, (0, len(x) - len(out)))

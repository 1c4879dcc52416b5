"""Signal math on arrays of samples: windows, filter bank, cepstral coefficients, left-to-right alignment. Numpy inside tasks, a row a segment of bounded length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_inverse(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))


def filter_bank(n_fft: int, rate: float, bins: int = 24) -> np.ndarray:
    """(bins, n_fft / 2) weights of triangles that are equally wide in mel."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bins + 2) / 2595) - 1)
    hz = (np.arange(n_fft // 2) + 1) * rate / n_fft
    up = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    return np.clip(np.minimum(up, down), 0, None)


def deltas(x: np.ndarray, half: int = 2) -> np.ndarray:
    """Rate of change along the first axis; edges repeat."""
    p = np.pad(x, ((half, half), (0, 0)), mode="edge")
    n = len(x)
    return sum(r * (p[half + r : half + r + n] - p[half - r : half - r + n]) for r in range(1, half + 1)) / (2 * sum(r * r for r in range(1, half + 1)))


def mfcc_frames(samples: np.ndarray, rate: float, size: int = 400, shift: int = 160, bins: int = 24, coefficients: int = 12) -> np.ndarray:
    """(frames, 3 * (coefficients + 1)): cepstra with C0 last, their changes and the changes of these; no rows without a whole frame."""
    n = 0 if len(samples) < size else 1 + (len(samples) - size) // shift
    if not n:
        return np.zeros((0, 3 * (coefficients + 1)))
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), size)[::shift][:n].copy()
    x[:, 1:] -= 0.97 * x[:, :-1].copy()
    x[:, 0] *= 1 - 0.97
    n_fft = 1 << int(np.ceil(np.log2(size)))
    power = np.abs(np.fft.rfft(x * hamming(size), n_fft))[:, : n_fft // 2]
    logs = np.log(np.maximum(power @ filter_bank(n_fft, rate, bins).T, 1.0))
    k = np.arange(1, coefficients + 1)[:, None]
    dct = np.sqrt(2 / bins) * np.cos(np.pi * k / bins * (np.arange(bins) + 0.5))
    static = np.hstack([logs @ dct.T, np.sqrt(2 / bins) * logs.sum(1, keepdims=True)])
    return np.hstack([static, d := deltas(static), deltas(d)])


def mfcc(samples: Column, rate: float, size: int = 400, shift: int = 160) -> Column:
    """array<array<double>> of frames."""
    return F.pandas_udf(lambda s: pd.Series([mfcc_frames(np.array([] if x is None else x, float), rate, size, shift).tolist() for x in s], dtype=object), "array<array<double>>")(samples)


def log_normal(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log-density of a diagonal Gaussian for rows of ``x``."""
    return -0.5 * (np.log(2 * np.pi * var).sum() + ((x - mean) ** 2 / var).sum(-1))

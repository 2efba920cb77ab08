"""Sampled signals: windows of recordings, and the lag at which one repeats another."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def best_lag(new: np.ndarray, old: np.ndarray, most: int, least_likeness: float = 0.5) -> int | None:
    """By how many samples ``new`` comes later than ``old``, by the peak of their correlation; None for silence or other sounds."""
    n = min(len(new), len(old))
    if n == 0:
        return None
    x, y = (np.asarray(v[:n], np.float64) - np.mean(v[:n]) for v in (new, old))
    scale = np.sqrt((x**2).sum() * (y**2).sum())
    if scale < 1e-9:
        return None
    whole = np.fft.irfft(np.fft.rfft(x, 2 * n) * np.fft.rfft(y, 2 * n).conj(), 2 * n)
    most = min(most, n - 1)
    order = np.r_[0 : most + 1, -most:0] if most else np.array([0])
    k = order[whole[order].argmax()]
    return int(k) if whole[k] / scale >= least_likeness else None


def lag(new: Column, old: Column, most: int, least_likeness: float = 0.5) -> Column:
    """``best_lag`` of two array columns."""

    @F.pandas_udf("int")
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_lag(x, y, most, least_likeness) for x, y in zip(a, b)], dtype="Int32")

    return find(new, old)


def wave_window(raw: bytes, start: float, seconds: float, rate: int = 16_000) -> np.ndarray:
    """A window of a PCM recording of 16 bits, channels averaged, at ``rate`` samples a second, from -1 to 1; shorter where the recording ends."""
    with wave.open(io.BytesIO(raw)) as sound:
        if sound.getsampwidth() != 2:
            raise ValueError("only recordings of 16 bits")
        own, channels = sound.getframerate(), sound.getnchannels()
        sound.setpos(min(round(start * own), sound.getnframes()))
        frames = np.frombuffer(sound.readframes(round(seconds * own)), "<i2").reshape(-1, channels).mean(1) / 32768
    if own == rate or not len(frames):
        return frames.astype(np.float32)
    at = np.arange(round(len(frames) * rate / own)) * own / rate
    return np.interp(at, np.arange(len(frames)), frames).astype(np.float32)


def samples(raw: Column, start: Column, seconds: Column, rate: int = 16_000) -> Column:
    """``wave_window`` of binary columns; null where a recording can't be read."""

    @F.pandas_udf("array<float>")
    def of(recordings: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(recording: bytes | None, a: float, n: float) -> np.ndarray | None:
            try:
                return None if recording is None else wave_window(bytes(recording), a, n, rate)
            except (wave.Error, EOFError, ValueError):
                return None

        return pd.Series([one(*x) for x in zip(recordings, starts, lengths)])

    return of(raw, start, seconds)

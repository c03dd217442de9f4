"""Signal features of mono samples, a clip per row: frames, energy, spectra, pitch. Numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, WIN, HOP, FFT, MELS, CEPSTRA = 16_000, 640, 320, 512, 26, 13


def frames(x: np.ndarray, win: int = WIN, hop: int = HOP) -> np.ndarray:
    """Windows of 40 ms every 20 ms; a shorter clip is padded to one."""
    x = np.asarray(x, float)
    if len(x) < win:
        x = np.pad(x, (0, win - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, win)[::hop]


def log_energy(f: np.ndarray) -> np.ndarray:
    return 10 * np.log10((f**2).mean(1) + 1e-12)


def zero_crossings(f: np.ndarray) -> np.ndarray:
    """Share of neighbours of other sign; zero counts as positive."""
    return np.diff(f >= 0, axis=1).mean(1)


def mel_bank(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles on the mel scale from 0 to half the rate, mels x (fft / 2 + 1)."""
    to, back = lambda hz: 2595 * np.log10(1 + hz / 700), lambda mel: 700 * (10 ** (mel / 2595) - 1)
    edges = np.floor((fft + 1) * back(np.linspace(0, to(rate / 2), mels + 2)) / rate)
    bins, low, mid, high = np.arange(fft // 2 + 1), edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up, down = (bins - low) / np.maximum(mid - low, 1), (high - bins) / np.maximum(high - mid, 1)
    return np.clip(np.minimum(up, down), 0, None)


def log_mel(f: np.ndarray) -> np.ndarray:
    """Log energies of the mel bands of windowed, pre-emphasised frames."""
    f = np.concatenate([f[:, :1], f[:, 1:] - 0.97 * f[:, :-1]], axis=1) * np.hamming(f.shape[1])
    power = np.abs(np.fft.rfft(f, FFT, axis=1)) ** 2 / FFT  # of the first FFT samples of longer frames
    return np.log(power @ mel_bank().T + 1e-10)


def mfcc(f: np.ndarray, cepstra: int = CEPSTRA) -> np.ndarray:
    """Orthonormal cosine transform of the log mel energies."""
    x = log_mel(f)
    n = x.shape[1]
    basis = np.cos(np.pi / n * (np.arange(n) + 0.5)[:, None] * np.arange(cepstra)) * np.sqrt(2 / n)
    basis[:, 0] /= np.sqrt(2)
    return x @ basis


def pitch(f: np.ndarray, rate: int = RATE, low: float = 60, high: float = 400, threshold: float = 0.15) -> np.ndarray:
    """Fundamental frequency of each frame by the cumulative mean normalised difference, 0 where none is clear."""
    most, least, half = int(rate / low), int(rate / high), f.shape[1] // 2
    lags = np.arange(1, min(most, half) + 1)
    d = np.stack([((f[:, :half] - f[:, k : k + half]) ** 2).sum(1) for k in lags], axis=1)
    d = d * lags / np.maximum(np.cumsum(d, axis=1), 1e-12)
    d[:, : least - 1] = 1
    under = d < threshold
    first = np.where(under.any(1), under.argmax(1), d.argmin(1))
    for i, k in enumerate(first):  # down to the bottom of that dip
        while k + 1 < d.shape[1] and d[i, k + 1] < d[i, k]:
            k += 1
        first[i] = k
    voiced = d[np.arange(len(d)), first] < threshold
    return np.where(voiced, rate / lags[first], 0.0)


def features(x: np.ndarray) -> np.ndarray:
    """A row per frame: cepstra, their first differences (0 in the first frame), energy, zero crossings, pitch, voiced."""
    f = frames(x)
    c, p = mfcc(f), pitch(f)
    return np.column_stack([c, np.diff(c, axis=0, prepend=c[:1]), log_energy(f), zero_crossings(f), p, p > 0])


def context(x: np.ndarray, last: int = 20) -> np.ndarray:
    """Mean, population deviation and greatest value of each feature over the last 400 ms."""
    m = features(x)[-last:]
    return np.concatenate([m.mean(0), m.std(0), m.max(0)])


def snr(x: np.ndarray) -> float:
    """Ninetieth less tenth percentile of the frame energies, 0 for fewer than four frames."""
    e = log_energy(frames(x))
    return float(np.percentile(e, 90) - np.percentile(e, 10)) if len(e) >= 4 else 0.0


def mixture(one: np.ndarray, two: np.ndarray, at: int, gain: float) -> np.ndarray:
    """Two speakers on one channel: the second from sample `at` on, scaled."""
    out = np.zeros(max(len(one), at + len(two)))
    out[: len(one)] += one
    out[at : at + len(two)] += gain * np.asarray(two)
    return out


def clip_features(clips: DataFrame, seconds: float = 8.0) -> DataFrame:
    """(id, samples) -> (id, frames, snr_db, f0, voiced, context, log_mel): log_mel is the mean over the last seconds."""

    @F.pandas_udf("frames long, snr_db double, f0 double, voiced double, context array<double>, log_mel array<double>")
    def run(samples: pd.Series) -> pd.DataFrame:
        out = []
        for s in samples:
            x = np.asarray([] if s is None else s, float)
            f = frames(x)
            p = pitch(f)
            mel = log_mel(frames(x[-int(seconds * RATE) :])).mean(0)
            out.append((len(f), snr(x), float(np.median(p[p > 0])) if (p > 0).any() else 0.0, float((p > 0).mean()), context(x).tolist(), mel.tolist()))
        return pd.DataFrame(out, columns=["frames", "snr_db", "f0", "voiced", "context", "log_mel"])

    return clips.select("id", run("samples").alias("_f")).select("id", "_f.*")


def boosted(rows: DataFrame, label: str, inputs: str, **how):
    """Gradient-boosted trees on an array column, fitted by Spark; returns the model, whose input is the vector column `features`."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol=label, featuresCol="features", seed=7, **how).fit(as_vectors(rows, inputs))


def as_vectors(rows: DataFrame, inputs: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(F.col(inputs).cast("array<double>")))

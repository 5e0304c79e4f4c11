"""Log filterbank features: frames are slices of a signal's chunks, one FFT and one product a strip of frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import CHUNK, chunked, energy_norm, frame_starts

#: Frames that are transformed at once.
STRIP = 300


def filterbank_matrix(table: DataFrame, bins: int, channels: int) -> np.ndarray:
    """The weights of ``mel_filterbank`` as a matrix; its size is a parameter."""
    out = np.zeros((bins, channels))
    for b, c, w in table.collect():
        out[b, c] = w
    return out


def emphasised(frames: np.ndarray, preemphasis: float | None, zero_mean: bool) -> np.ndarray:
    """Frames less their mean, if ``zero_mean``, then pre-emphasised; the first sample is its own predecessor."""
    x = np.asarray(frames, float)
    if zero_mean:
        x = x - x.mean(1, keepdims=True)
    return x if preemphasis is None else x - preemphasis * np.concatenate((x[:, :1], x[:, :-1]), 1)


def log_channels(frames: np.ndarray, bank: np.ndarray, power: float = 2.0) -> np.ndarray:
    """Logs of the channels' energies of windowed frames, at least 0."""
    f = np.fft.rfft(frames, 2 * (len(bank) - 1))
    p = f.real**2 + f.imag**2
    return np.log(np.maximum(1.0, (p if power == 2 else p ** (0.5 * power)) @ bank))


def strip_channels(frames: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """``log_channels`` of a strip of at most ``STRIP`` frames, always as a product of the same shape.

    So a frame at one place of a strip has the same channels to the last bit, however many follow it.
    """
    whole = np.zeros((STRIP, frames.shape[1]))
    whole[: len(frames)] = frames
    return log_channels(whole, bank)[: len(frames)]


class Noise:
    """Uniform noise in [-1, 1) of one seeded stream, from any place on.

    The generator's state is kept every ``SPACING`` draws (2.5 kB each), so a place is reached by fewer
    draws than that; the kept states come from one pass up to the last place that is needed.
    """

    SPACING = 1 << 20

    def __init__(self, seed: int, upto: int):
        stream = np.random.RandomState(seed)
        self.states = [stream.get_state()]
        for _ in range(upto // self.SPACING):
            stream.random_sample(self.SPACING)
            self.states.append(stream.get_state())

    def take(self, first: int, n: int) -> np.ndarray:
        stream = np.random.RandomState(0)
        stream.set_state(self.states[first // self.SPACING])
        stream.random_sample(first % self.SPACING)
        return stream.random_sample(n) * 2 - 1


def dither(df: DataFrame, level: float = 8.0, seed: int = 3) -> DataFrame:
    """Adds uniform noise in ``[-level, level)`` to ``rec, n, x``: from the recording's own seeded stream."""

    def noisy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        noise = np.random.RandomState(seed).rand(len(pdf)) * 2 - 1
        return pdf.assign(x=pdf.x + level * noise)

    return df.select("rec", "n", "x").groupBy("rec").applyInPandas(noisy, f"rec {dict(df.dtypes)['rec']}, n {dict(df.dtypes)['n']}, x double")


def log_filterbank(signal: DataFrame, window: np.ndarray, overlap: int, bank: np.ndarray, power: float = 2.0, preemphasis: float | None = 0.97, zero_mean: bool = False, energy: str | None = None, raw_energy: bool = True, normalise_energy: bool = True, scale: float = 0.1, silence_db: float = 50.0, chunk: int = CHUNK) -> DataFrame:
    """``rec, frame, feat``: logs of filterbank outputs, at least 0, of frames every ``len(window) - overlap``.

    ``power`` 2 is the power spectrum, 1 the magnitude.  ``energy`` ``first`` or ``last`` adds the log
    energy, from before windowing if ``raw_energy``.
    """
    size = len(window)
    if len(bank) != 2 ** math.ceil(math.log2(size)) // 2 + 1:
        raise ValueError("the filterbank has a row per bin of the transform, whose length is the next power of two")
    kind, shift, chunk = dict(signal.dtypes)["rec"], size - overlap, max(chunk, 4 * (size - 1))

    def features(batches):
        for batch in batches:
            for rec, first, x in zip(*(batch.column(c) for c in ("rec", "first", "x")), strict=True):
                x, first = x.values.to_numpy(zero_copy_only=False), first.as_py()
                starts = frame_starts(first, len(x), size, shift, chunk)
                if not len(starts):
                    continue
                views = np.lib.stride_tricks.sliding_window_view(x, size)[starts.start : starts[-1] + 1 : shift]
                for at in range(0, len(views), STRIP):
                    raw = emphasised(views[at : at + STRIP], None, zero_mean)
                    cut = emphasised(raw, preemphasis, False) * window
                    loud = raw if raw_energy else cut
                    e = np.log((loud * loud).sum(1)) if energy else np.zeros(len(cut))
                    out = log_channels(cut, bank, power)
                    n = len(out)
                    feat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                    number = (first + starts.start) // shift + at + np.arange(n)
                    yield pa.RecordBatch.from_arrays([pa.array([rec.as_py()] * n, rec.type), pa.array(number), feat, pa.array(e)], ["rec", "frame", "feat", "energy"])

    got = chunked(signal.select("rec", "n", "x"), size - 1, chunk).mapInArrow(features, f"rec {kind}, frame bigint, feat array<double>, energy double")
    if not energy:
        return got.select("rec", "frame", "feat")
    if normalise_energy:
        got = energy_norm(got, scale, silence_db)
    one = F.array("energy")
    return got.select("rec", "frame", (F.concat(one, "feat") if energy == "first" else F.concat("feat", one)).alias("feat"))

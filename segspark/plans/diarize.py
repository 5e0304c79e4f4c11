"""End-to-end plans: audio to embeddings, and embeddings to speaker segments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.operators import kernels as K
from segspark.operators import linkage, models, segments, vectors
from segspark.operators.embedding import embed_windows
from segspark.operators.fbank import STRIP, Noise, emphasised, filterbank_matrix, strip_channels
from segspark.operators.sequence import mel_filterbank, window_means
from segspark.scratch import Tables
from segspark.sources import text
from segspark.sources.wav import CHUNK

#: Channels, lowest frequency, and highest per sampling rate.
CHANNELS, LOW, HIGH = 64, 20.0, {8000: 3700.0, 16000: 7600.0}
#: Frames left and right of the floating mean.
LEFT, RIGHT = 150, 149


#: Frames of a segment that one task gives, a multiple of the floating mean's width.
UNIT = 20 * (LEFT + RIGHT + 1)


def floating_mean(x: np.ndarray, left: int = LEFT, right: int = RIGHT, variance: bool = False) -> np.ndarray:
    """Rows less the mean of a window that keeps its size at both ends (and over its root mean square)."""
    n = len(x)
    x = x - window_means(x, 0, n, 0, n, left, right)
    return x / np.sqrt(window_means(x * x, 0, n, 0, n, left, right)) if variance else x


def segment_features(x: np.ndarray, at: int, s: int, e: int, rate: int, bank: np.ndarray, begin: int, end: int, total: int) -> np.ndarray:
    """Normalised log filterbank features of frames ``begin .. end - 1`` of ``total`` of the voice segment ``s .. e - 1``.

    The segment is mirrored at both ends.  ``x`` are samples from ``at`` on that hold what the frames and
    the floating mean around them need; ``begin`` is a multiple of ``UNIT``'s blocks.
    """
    size, overlap = rate // 40, rate * 3 // 200
    shift, n = size - overlap, e - s
    pre, width = min(overlap // 2, n), LEFT + RIGHT + 1
    low, high = max(0, begin - width), min(total, end + width)
    p = np.arange(low * shift, (high - 1) * shift + size)
    place = np.where(p < pre, pre - 1 - p, np.where(p < pre + n, p - pre, 2 * n - 1 + pre - p))
    frames = np.lib.stride_tricks.sliding_window_view(x[s - at + place], size)[::shift]
    window = (0.5 - 0.5 * np.cos(np.linspace(0, 2 * np.pi, size))) ** 0.85
    logs = np.concatenate([strip_channels(emphasised(frames[i : i + STRIP], 0.97, zero_mean=True) * window, bank) for i in range(0, len(frames), STRIP)])
    return (logs[begin - low : end - low] - window_means(logs, low, total, begin, end, LEFT, RIGHT)).astype(np.float32)


def in_chunks(audio: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rec, samplerate, total, first, x`` of whole recordings ``rec, samplerate, x``; chunks stay as they are."""
    if "first" in audio.columns:
        return audio
    rows = audio.select("rec", "samplerate", F.size("x").cast("bigint").alias("total"), "x", F.explode(F.sequence(F.lit(0), F.greatest(F.size("x") - 1, F.lit(0)), F.lit(chunk))).alias("first"))
    return rows.select("rec", "samplerate", "total", F.col("first").cast("bigint").alias("first"), F.slice("x", F.col("first") + 1, F.lit(chunk)).alias("x"))


def rates_of(chunks: DataFrame) -> DataFrame:
    """``rec, samplerate, total`` of chunked recordings."""
    return chunks.where("first = 0").select("rec", "samplerate", "total")


def feature_units(vad: DataFrame, rates: DataFrame, unit: int) -> DataFrame:
    """``rec, segnum, rate, s, e, frames, a, b, low, high``: frames ``a .. b - 1`` of a segment, and the samples they need."""
    rows = vad.join(rates, "rec").withColumns({"rate": F.col("samplerate").cast("bigint"), "s": F.expr("cast(start * samplerate as bigint)"), "e": F.least(F.expr("cast(end * samplerate as bigint)"), "total")})
    rows = rows.withColumn("n", F.col("e") - F.col("s")).where(F.col("n") > 0.01 * F.col("rate"))
    rows = rows.withColumns({"size": F.expr("rate div 40"), "overlap": F.expr("rate * 3 div 200")}).withColumn("shift", F.col("size") - F.col("overlap"))
    padded = F.expr("least(overlap div 2, n) + n + least(size div 2, n)")
    rows = rows.withColumn("frames", ((padded - F.col("size")) / F.col("shift")).cast("bigint") + 1).where(padded >= F.col("size"))
    rows = rows.withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1, F.lit(unit).cast("bigint")))).withColumn("b", F.least(F.col("a") + unit, F.col("frames")))
    width = LEFT + RIGHT + 1
    low = F.greatest(F.col("s"), F.col("s") + (F.col("a") - width) * F.col("shift") - 2 * F.col("size"))
    high = F.least(F.col("e"), F.col("s") + (F.col("b") + width) * F.col("shift") + 2 * F.col("size"))
    return rows.select("rec", "segnum", "rate", "s", "e", "frames", "a", "b", low.alias("low"), high.alias("high"))


def audio_features(audio: DataFrame, vad: DataFrame, dither: float = 8.0, seed: int = 3, unit: int = UNIT, chunk: int = CHUNK) -> DataFrame:
    """``rec, segnum, frame, feat`` of the voice segments ``rec, segnum, start, end``.

    ``audio`` holds whole recordings ``rec, samplerate, x``, or their chunks of ``chunk`` samples as
    ``wav.read_chunks`` gives them.  A task makes up to ``unit`` frames from the chunks that hold their samples
    and those of the floating mean around them; dither is that of the recording's own seeded stream, taken
    up where the samples begin.  So segments and recordings may have any length, and the features do not
    depend on how they are cut.  Segments of at most 10 ms are left out.
    """
    if unit % (LEFT + RIGHT + 1):
        raise ValueError("a unit is a multiple of the floating mean's width")
    spark = audio.sparkSession
    chunks = in_chunks(audio, chunk)
    units = feature_units(vad, rates_of(chunks), unit)
    last = units.agg(F.max("high")).first()[0] or 0
    noise = spark.sparkContext.broadcast(Noise(seed, last))  # 2.5 kB a minute of the longest recording
    banks = {r: filterbank_matrix(mel_filterbank(spark, 512 if r == 16000 else 256, r, CHANNELS, LOW, HIGH[r], htk_bug=False), (512 if r == 16000 else 256) // 2 + 1, CHANNELS) for r in HIGH}

    wanted = units.withColumn("at", F.explode(F.sequence(F.expr(f"low div {chunk}"), F.expr(f"(high - 1) div {chunk}"))))
    pieces = wanted.join(chunks.select("rec", "first", "x", F.expr(f"first div {chunk}").alias("at")), ["rec", "at"])
    begin, end = F.greatest("low", "first"), F.least("high", F.col("first") + F.size("x"))
    cut = pieces.withColumn("x", F.slice("x", (begin - F.col("first") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))).drop("at")

    def features(table: pa.Table) -> pa.Table:
        table = table.sort_by("first").combine_chunks()
        one = {c: table.column(c)[0].as_py() for c in ("rate", "s", "e", "frames", "a", "b", "low", "high")}
        x = table.column("x").chunk(0).flatten().to_numpy()
        if len(x) != one["high"] - one["low"]:
            raise ValueError(f"samples of {table.column('rec')[0]} are missing")
        x = np.trunc(x * 32768) + dither * noise.value.take(one["low"], len(x))
        f = segment_features(x, one["low"], one["s"], one["e"], one["rate"], banks[one["rate"]], one["a"], one["b"], one["frames"]).astype(float)
        first = pa.array(np.zeros(len(f), np.int64))
        feat = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel()))
        return pa.table({"rec": table.column("rec").take(first), "segnum": table.column("segnum").take(first), "frame": pa.array(np.arange(one["a"], one["b"])), "feat": feat})

    kind = dict(cut.dtypes)
    return cut.groupBy("rec", "segnum", "a").applyInArrow(features, f"rec {kind['rec']}, segnum {kind['segnum']}, frame bigint, feat array<double>")


def extract(audio: DataFrame, vad: DataFrame, size: int = 144, jump: int = 24, model: str = "pooling", path: str = "") -> DataFrame:
    """``rec, idx, key, start, end, xvec``: embeddings of all windows, in order of time.

    Windows are cut by the rate of each recording.
    """
    rates = rates_of(in_chunks(audio)).select("rec", "samplerate")
    windows = segments.embedding_windows(vad.join(rates, "rec"), rate="samplerate", size=size, jump=jump)
    found = embed_windows(audio_features(audio, vad), windows, model, path)
    rows = windows.join(found.select("rec", "key", "xvec"), ["rec", "key"])
    return rows.select("rec", ((F.col("segnum").cast("bigint") * 100000000) + F.col("first")).alias("idx"), "key", "start", "end", "xvec")


@dataclass(frozen=True)
class Settings:
    """Clustering parameters; the defaults are the published ones for wide-band meetings."""

    threshold: float = -0.015
    lda_dim: int = 128
    fa: float = 0.4
    fb: float = 17.0
    loop: float = 0.9
    smoothing: float = 5.0
    rounds: int = 40
    epsilon: float = 1e-6
    init: str = "AHC+VB"

    def __post_init__(self):
        if not 0 <= self.loop <= 1:
            raise ValueError("the loop probability lies in 0 .. 1")
        if self.init not in ("AHC", "AHC+VB") and not self.init.startswith("random_"):
            raise ValueError(f"unknown initialisation {self.init!r}")


def diarize(xvectors: DataFrame, transform: vectors.Transform, plda: vectors.Plda, settings: Settings = Settings(), limit: int = linkage.LIMIT) -> DataFrame:
    """``rec, idx, key, label, second`` of ``rec, idx, key, xvec``: clusters per recording.

    A recording of up to ``limit`` vectors is one grouped kernel that holds the whole chain, so vectors cross to
    Python once; longer ones go through the operators, each of which parts a recording.
    """
    model, c = plda.diagonalised(), settings
    mean1, lda, mean2 = np.array(transform.mean1), np.array(transform.lda), np.array(transform.mean2)
    mu, tr, psi = np.array(model.mu), np.array(model.tr), np.array(model.psi)
    kind = dict(xvectors.dtypes)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        x = unit(unit(np.stack(pdf.xvec.to_list()) - mean1) @ lda - mean2)
        labels, second = np.zeros(len(x), int), [None] * len(x)
        if c.init.startswith("AHC"):
            sim = x @ x.T
            least = K.calibration(sim)[0] + c.threshold if len(x) > 1 else 0.0
            labels = K.average_linkage(sim, least)
            start = K.soft_start(np.unique(labels, return_inverse=True)[1], c.smoothing)
        else:
            start = K.dirichlet_start(len(x), int(c.init.split("_")[1]))
        if c.init != "AHC":
            y = ((x - mu) @ tr.T)[:, : c.lda_dim]
            gamma = K.vb_hmm(y, psi[: c.lda_dim], start, start.shape[1], c.loop, c.fa, c.fb, c.rounds, c.epsilon).gamma
            order = np.argsort(-gamma, axis=1, kind="stable")
            labels = order[:, 0]
            if gamma.shape[1] > 1:
                second = order[:, 1].tolist()
        return pd.DataFrame({"rec": pdf.rec.to_numpy(), "idx": pdf.idx.to_numpy(), "key": pdf.key.to_numpy(), "label": labels, "second": pd.array(second, "Int64")})

    rows = xvectors.select("rec", "idx", "key", "xvec")
    schema = f"rec {kind['rec']}, idx {kind['idx']}, key string, label bigint, second bigint"
    sizes = rows.groupBy("rec").agg(F.count(F.lit(1)).alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) <= limit:
        return rows.groupBy("rec").applyInPandas(fit, schema)
    long = sizes.where(F.col("size") > limit).select("rec")
    short = rows.join(long, "rec", "left_anti").groupBy("rec").applyInPandas(fit, schema)

    def transformed(batches):
        for pdf in batches:
            if len(pdf):
                x = unit(unit(np.stack(pdf.xvec.to_list()) - mean1) @ lda - mean2)
                yield pd.DataFrame({"rec": pdf.rec, "idx": pdf.idx, "key": pdf.key, "xvec": list(x), "v": list(((x - mu) @ tr.T)[:, : c.lda_dim])})

    ready = rows.join(long, "rec", "left_semi").mapInPandas(transformed, f"rec {kind['rec']}, idx {kind['idx']}, key string, xvec array<double>, v array<double>")
    ready = Tables(xvectors.sparkSession, "diarize").save(ready, "transformed")
    if c.init.startswith("AHC"):
        labels = models.cluster(ready, c.threshold, calibrated=True, limit=limit)
    else:
        labels = ready.select("rec", "idx", F.lit(0).cast("bigint").alias("label"))
    labelled = ready.join(labels, ["rec", "idx"])
    if c.init == "AHC":
        found = labelled.select("rec", "idx", "key", "label", F.lit(None).cast("bigint").alias("second"))
    else:
        start = {} if c.init.startswith("AHC") else {"seed": 0, "speakers": int(c.init.split("_")[1])}
        got = models.vb_cluster(labelled, psi[: c.lda_dim].tolist(), c.loop, c.fa, c.fb, c.rounds, c.epsilon, c.smoothing, limit=min(limit, models.VB_LIMIT), **start)
        found = ready.select("rec", "idx", "key").join(got.select("rec", "idx", "label", "second"), ["rec", "idx"])
    return short.unionByName(found)


def speaker_segments(labels: DataFrame, timings: DataFrame, second: bool = False) -> DataFrame:
    """``rec, run, start, end, label`` from window labels and times."""
    column = "second" if second else "label"
    rows = labels.where(F.col(column).isNotNull()).select("rec", "idx", "key", F.col(column).alias("label"))
    return segments.merge_adjacent(segments.labels_with_times(rows, timings.select("rec", "key", "start", "end")), order=["idx"])


def write_results(labels: DataFrame, timings: DataFrame, path: str, second: bool = False) -> None:
    """Speaker segments as text per recording, and with ``second`` those of second-best labels beside them."""
    text.write_rttm(speaker_segments(labels, timings), path)
    if second:
        text.write_rttm(speaker_segments(labels, timings, True), path.rstrip("/") + "2nd")

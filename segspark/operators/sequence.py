"""Signal and frame-sequence operators on long tables.

A signal is ``rec, n, x`` with ``n`` from 0; a feature table is ``rec, frame, d, x``.  A chunked signal is
``rec, first, x``: arrays of consecutive samples that reach a halo into the next chunk, so frames are slices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples of a chunk without its halo.
CHUNK = 1 << 16


def lengths(signal: DataFrame, *keys: str) -> DataFrame:
    return signal.groupBy(*(keys or ("rec",))).agg((F.max("n") + 1).alias("size"))


def runs_of(batches, keys: tuple[str, ...]):
    """Runs of equal keys in batches sorted by them, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and any(held[0].column(k)[0] != batch.column(k)[a] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def chunked(signal: DataFrame, halo: int, size: int = CHUNK) -> DataFrame:
    """``rec, first, x``: samples ``first .. first + size + halo - 1`` of ``rec, n, x``, fewer at a signal's end.

    ``first`` are the multiples of ``size``.  Only a halo's samples are sent twice, and a task holds one
    chunk, however long the signal.  A signal with a gap raises; null samples stay null.
    """
    size = max(size, 4 * halo)
    own = F.floor(F.col("n") / size).cast("bigint")
    shared = (F.pmod("n", F.lit(size)) < halo) & (F.col("n") >= size)
    rows = signal.select("rec", F.col("n").cast("bigint").alias("n"), F.col("x").cast("double").alias("x"), F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))).alias("chunk"))
    rows = rows.repartition("rec", "chunk").sortWithinPartitions("rec", "chunk", "n")

    def gather(batches):
        for table in runs_of(batches, ("rec", "chunk")):
            n = table.column("n").to_numpy()
            if n[-1] - n[0] != len(n) - 1 or (n[1:] <= n[:-1]).any() or n[0] % size:
                raise ValueError(f"the samples of {table.column('rec')[0]} are not numbered 0, 1, 2, ...")
            x = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), table.column("x").chunk(0))
            yield pa.RecordBatch.from_arrays([table.column("rec").chunk(0).slice(0, 1), pa.array(n[:1]), x], ["rec", "first", "x"])

    return rows.mapInArrow(gather, f"rec {dict(signal.dtypes)['rec']}, first bigint, x array<double>")


def frame_starts(first: int, samples: int, window: int, shift: int, size: int) -> range:
    """Places in a chunk where its own frames start: those that start in the chunk and end in its samples."""
    begin = -first % shift
    return range(begin, min(size, samples - window + 1), shift)


def framing(signal: DataFrame, window: int, shift: int = 1, size: int = CHUNK) -> DataFrame:
    """``rec, frame, k, x``: frames of ``window`` samples every ``shift``; the rest is dropped.

    Frames are slices of the signal's chunks: a frame belongs to the chunk in which it starts.
    """
    size = max(size, 4 * (window - 1))
    last = F.least(F.lit(size - 1), F.size("x") - window)
    begin = F.pmod(-F.col("first"), F.lit(shift)).cast("int")
    rows = chunked(signal, window - 1, size).where(last >= begin).select("rec", "first", "x", F.explode(F.sequence(begin, last, F.lit(shift))).alias("at"))
    rows = rows.select("rec", ((F.col("first") + F.col("at")) / shift).cast("bigint").alias("frame"), F.slice("x", F.col("at") + 1, F.lit(window)).alias("x"))
    return rows.select("rec", "frame", F.posexplode("x").alias("k", "x"))


def mirror_pad(signal: DataFrame, left: int, right: int) -> DataFrame:
    """``rec, n, x`` with the first ``left`` samples reversed in front and the last ``right`` reversed behind.

    A signal shorter than a pad is padded by what it has.
    """
    rows = signal.join(lengths(signal), "rec")
    pre, post = F.least(F.lit(left), F.col("size")), F.least(F.lit(right), F.col("size"))
    n, none = F.col("n"), F.lit(None).cast("bigint")
    places = F.array(
        (pre + n).cast("bigint"),
        F.when(n < pre, pre - 1 - n).otherwise(none).cast("bigint"),
        F.when(n >= F.col("size") - post, pre + F.col("size") + F.col("size") - 1 - n).otherwise(none).cast("bigint"),
    )
    return rows.select("rec", F.explode(places).alias("at"), "x").where("at is not null").select("rec", F.col("at").alias("n"), "x")


def preemphasis(signal: DataFrame, coef: float = 0.97, keys: tuple[str, ...] = ("rec",), at: str = "n") -> DataFrame:
    """``x - coef * previous``; the first sample is its own previous one."""
    w = Window.partitionBy(*keys).orderBy(at)
    return signal.withColumn("x", F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x")) * coef)


def pcm_scale(x: Column) -> Column:
    """Samples in [-1, 1] as 16-bit integers, cut toward zero."""
    return (x * 32768).cast("bigint")


def window_means(x: np.ndarray, first: int, total: int, begin: int, end: int, left: int, right: int) -> np.ndarray:
    """Means around rows ``begin .. end - 1`` of ``total``, given the rows ``x`` from ``first`` on.

    A window keeps its size at both ends.  Its sum is the rest of one block of that size and the head of the
    next, blocks counted from row 0, so it is the same to the last bit whichever rows around are given;
    ``first`` is the start of a block.
    """
    size = min(total, left + right + 1)
    start = np.clip(np.arange(begin, end) - left, 0, total - size) - first
    blocks = np.zeros((-(-len(x) // size), size, x.shape[1]))
    blocks.reshape(-1, x.shape[1])[: len(x)] = x
    head = np.cumsum(blocks, 1).reshape(-1, x.shape[1])
    rest = np.cumsum(blocks[:, ::-1], 1)[:, ::-1].reshape(-1, x.shape[1])
    whole = (start % size == 0)[:, None]
    return (rest[start] + np.where(whole, 0.0, head[start + size - 1])) / size


def floating_norm(features: DataFrame, left: int = 150, right: int = 149, variance: bool = False, chunk: int = 1 << 14) -> DataFrame:
    """Mean (and variance) normalisation over a window that keeps its size at both ends.

    A sequence ``rec, d`` is cut into chunks of about ``chunk`` frames that know a window's width (``variance``:
    two) of frames on both sides, so one exchange serves both passes, a long sequence is many tasks, and the cost
    does not depend on the window's size.  With ``variance`` a second pass divides the centred values by their
    root mean square over the same window.  Frames are 0, 1, ...; a null value adds nothing to sums and stays null.
    """
    width = left + right + 1
    chunk, halo = max(1, chunk // width) * width, (2 if variance else 1) * width
    kind = dict(features.dtypes)
    frame = F.col("frame").cast("bigint")
    at = F.expr(f"sequence(greatest(frame - {halo}, 0) div {chunk}, (frame + {halo}) div {chunk})")
    rows = features.select("rec", frame.alias("frame"), "d", F.col("x").cast("double").alias("x")).withColumn("chunk", F.explode(at))
    rows = rows.repartition("rec", "d", "chunk").sortWithinPartitions("rec", "d", "chunk", "frame")

    def norm(batches):
        for table in runs_of(batches, ("rec", "d", "chunk")):
            f, part = table.column("frame").to_numpy(), table.column("chunk")[0].as_py()
            begin, end = part * chunk, min((part + 1) * chunk, int(f[-1]) + 1)
            if end <= begin:  # a halo without frames of its own
                continue
            if f[-1] - f[0] != len(f) - 1 or (f[1:] <= f[:-1]).any():
                raise ValueError(f"the frames of {table.column('rec')[0]} are not numbered 0, 1, 2, ...")
            # where the halo is cut short the sequence ends; elsewhere its end is out of reach
            first, total = int(f[0]), int(f[-1]) + 1
            x = table.column("x").to_numpy()
            void = np.isnan(x) if table.column("x").null_count else None
            x = np.where(void, 0.0, x) if void is not None else x
            x = x.reshape(-1, 1)
            low, high = max(begin - width, 0), min(end + width, total)
            if variance:
                x = x[low - first : high - first] - window_means(x, first, total, low, high, left, right)
                if void is not None:
                    x[void[low - first : high - first]] = 0.0
                out = x[begin - low : end - low] / np.sqrt(window_means(x * x, low, total, begin, end, left, right))
            else:
                out = x[begin - first : end - first] - window_means(x, first, total, begin, end, left, right)
            own = table.slice(begin - first, end - begin)
            mask = void[begin - first : end - first] if void is not None else None
            yield pa.RecordBatch.from_arrays([*(own.column(c).combine_chunks() for c in ("rec", "frame", "d")), pa.array(out.ravel(), mask=mask)], ["rec", "frame", "d", "x"])

    out = rows.mapInArrow(norm, f"rec {kind['rec']}, frame bigint, d {kind['d']}, x double")
    return out.select("rec", F.col("frame").cast(kind["frame"]).alias("frame"), "d", "x")


def mel(x: Column) -> Column:
    return 1127.0 * F.log(1.0 + x / 700.0)


def mel_inverse(x: Column) -> Column:
    return (F.exp(x / 1127.0) - 1.0) * 700.0


def povey_window(spark: SparkSession, size: int) -> DataFrame:
    """``n, w``."""
    n = F.col("id")
    return spark.range(size).select(n.cast("int").alias("n"), F.pow(0.5 - 0.5 * F.cos(2 * math.pi * n / (size - 1)), F.lit(0.85)).alias("w"))


def hamming_window(spark: SparkSession, size: int) -> DataFrame:
    n = F.col("id")
    return spark.range(size).select(n.cast("int").alias("n"), (0.54 - 0.46 * F.cos(2 * math.pi * n / (size - 1))).alias("w"))


def flat_window(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(size).select(F.col("id").cast("int").alias("n"), F.lit(1.0).alias("w"))


def mel_filterbank(spark: SparkSession, nfft: int, rate: float, channels: int, low: float = 0.0, high: float | None = None, warp=mel, unwarp=mel_inverse, htk_bug: bool = True) -> DataFrame:
    """``bin, chan, w``: triangular filters, equally spaced on the warped scale; only non-zero weights.

    ``warp`` and ``unwarp`` are functions of columns.  With ``htk_bug`` the bin of the lowest edge is left
    out where the low frequency lies above it.
    """
    high = high or 0.5 * rate
    one = spark.range(1)
    lo, hi = warp(F.lit(float(low))), warp(F.lit(float(high)))
    edges = one.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(channels + 1)), lambda i: lo + (hi - lo) * i / F.lit(float(channels + 1)))).alias("e", "c"))
    edges = edges.withColumn("at", F.floor(unwarp(F.col("c")) / rate * nfft) + 1)
    bins = spark.range(nfft // 2 + 1).select(F.col("id").cast("int").alias("bin"), warp(F.col("id") * rate / nfft).alias("f"))
    left = edges.select((F.col("e")).alias("chan"), F.col("c").alias("c0"), F.col("at").alias("a0"))
    mid = edges.select((F.col("e") - 1).alias("chan"), F.col("c").alias("c1"), F.col("at").alias("a1"))
    right = edges.select((F.col("e") - 2).alias("chan"), F.col("c").alias("c2"), F.col("at").alias("a2"))
    tri = left.join(mid, "chan").join(right, "chan")
    rising = (F.col("bin") >= F.col("a0")) & (F.col("bin") < F.col("a1"))
    falling = (F.col("bin") >= F.col("a1")) & (F.col("bin") < F.col("a2"))
    w = F.when(rising, (F.col("c0") - F.col("f")) / (F.col("c0") - F.col("c1"))).when(falling, (F.col("c2") - F.col("f")) / (F.col("c2") - F.col("c1")))
    # a few dozen filters and at most a few hundred bins: the size is a parameter, not data
    out = F.broadcast(tri).join(bins, (F.col("bin") >= F.col("a0")) & (F.col("bin") < F.col("a2"))).select("bin", "chan", "a0", w.alias("w")).where("w is not null")
    if htk_bug and low > 0:
        first = F.min("a0").over(Window.partitionBy())
        out = out.withColumn("f0", first).where(~((F.lit(low / rate * nfft + 0.5) > F.col("f0")) & (F.col("bin") == F.col("f0"))))
    return out.select("bin", "chan", "w")


def frame_energy(frames: DataFrame) -> DataFrame:
    """``rec, frame, energy``: log of the sum of squares; a silent frame gives null."""
    s = F.sum(F.col("x") * F.col("x"))
    return frames.groupBy("rec", "frame").agg(F.when(s > 0, F.log(s)).alias("energy"))


def energy_norm(energies: DataFrame, scale: float = 0.1, silence_db: float = 50.0) -> DataFrame:
    """Energies relative to the recording's greatest, floored at silence."""
    floor = -math.log(10 ** (silence_db / 10.0)) * scale + 1.0
    top = F.max("energy").over(Window.partitionBy("rec"))
    return energies.withColumn("energy", F.greatest((F.col("energy") - top) * scale + 1.0, F.lit(floor)))

"""Queries over signals and feature sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from segspark.operators import fbank as B
from segspark.operators import sequence as Q

from . import tables as T
from .segment_queries import registry

QUERIES, ORACLES, query = registry()

WINDOW, SHIFT = 16, 8
FRAMES = f"""fm AS (SELECT sg.rec, f.frame, (n - f.frame * {SHIFT})::INT AS k, x FROM sg JOIN sz USING (rec),
  LATERAL (SELECT unnest(range(greatest(0, ceil((n - {WINDOW - 1}) / {float(SHIFT)})::BIGINT), least(n // {SHIFT}, (size - {WINDOW}) // {SHIFT}) + 1)) AS frame) f WHERE size >= {WINDOW})"""


@query(f"WITH {T.SIGNAL} SELECT rec, n, trunc(x * 32768)::BIGINT AS pcm FROM sg")
def pcm_scale(spark, sf_dir):
    return T.signal(spark, sf_dir).select("rec", "n", Q.pcm_scale(F.col("x")).alias("pcm"))


@query(f"WITH {T.SIGNAL}, {FRAMES} SELECT rec, frame, k, x FROM fm")
def framing(spark, sf_dir):
    return Q.framing(T.signal(spark, sf_dir), WINDOW, SHIFT)


@query(f"WITH {T.SIGNAL} SELECT rec, n, round(x - coalesce(lag(x) OVER (PARTITION BY rec ORDER BY n), x) * 0.97::DOUBLE, 8) AS x FROM sg")
def preemphasis(spark, sf_dir):
    return Q.preemphasis(T.signal(spark, sf_dir)).withColumn("x", F.round("x", 8))


@query(f"""WITH {T.SIGNAL} SELECT rec, (n + 20)::BIGINT AS n, x FROM sg
UNION ALL SELECT rec, (19 - n)::BIGINT, x FROM sg WHERE n < 20
UNION ALL SELECT rec, (20 + size + size - 1 - n)::BIGINT, x FROM sg JOIN sz USING (rec) WHERE n >= size - 30""")
def mirror_pad(spark, sf_dir):
    return Q.mirror_pad(T.signal(spark, sf_dir), 20, 30)


CMVN = f"""{T.SIGNAL},
f0 AS MATERIALIZED (SELECT rec, n AS frame, x, least(size, 300) AS w, greatest(least(n - 150, size - least(size, 300)), 0) AS ws FROM sg JOIN sz USING (rec)),
p0 AS MATERIALIZED (SELECT rec, frame, sum(x) OVER (PARTITION BY rec ORDER BY frame ROWS UNBOUNDED PRECEDING) AS c FROM f0),
c1 AS MATERIALIZED (SELECT f0.rec, f0.frame, f0.w, f0.ws, f0.x - (hi.c - coalesce(lo.c, 0)) / f0.w AS x FROM f0
  JOIN p0 hi ON hi.rec = f0.rec AND hi.frame = f0.ws + f0.w - 1 LEFT JOIN p0 lo ON lo.rec = f0.rec AND lo.frame = f0.ws - 1)"""


#: Means of decimals over 2**n rows end in a 5; shifted, none of them is a tie of rounding.
OFF_TIES = 1.3e-9


def _features(spark, sf_dir):
    return T.signal(spark, sf_dir).select("rec", F.col("n").alias("frame"), F.lit(0).alias("d"), "x")


@query(f"WITH {CMVN} SELECT rec, frame, round(x + {OFF_TIES!r}::DOUBLE, 8) AS x FROM c1")
def cmvn_mean(spark, sf_dir):
    return Q.floating_norm(_features(spark, sf_dir)).select("rec", "frame", F.round(F.col("x") + OFF_TIES, 8).alias("x"))


@query(f"""WITH {CMVN}, p1 AS MATERIALIZED (SELECT rec, frame, sum(x * x) OVER (PARTITION BY rec ORDER BY frame ROWS UNBOUNDED PRECEDING) AS c FROM c1)
SELECT c1.rec, c1.frame, round(c1.x / sqrt((hi.c - coalesce(lo.c, 0)) / c1.w), 6) AS x FROM c1
JOIN p1 hi ON hi.rec = c1.rec AND hi.frame = c1.ws + c1.w - 1 LEFT JOIN p1 lo ON lo.rec = c1.rec AND lo.frame = c1.ws - 1""")
def cmvn_meanvar(spark, sf_dir):
    return Q.floating_norm(_features(spark, sf_dir), variance=True).select("rec", "frame", F.round("x", 6).alias("x"))


ENERGY = f"{T.SIGNAL}, {FRAMES}, en AS (SELECT rec, frame, ln(sum(x * x)) AS energy FROM fm GROUP BY rec, frame HAVING sum(x * x) > 0)"


@query(f"WITH {ENERGY} SELECT rec, frame, round(energy, 6) AS energy FROM en")
def frame_energy(spark, sf_dir):
    return Q.frame_energy(Q.framing(T.signal(spark, sf_dir), WINDOW, SHIFT)).withColumn("energy", F.round("energy", 6))


@query(f"WITH {ENERGY} SELECT rec, frame, round(greatest((energy - max(energy) OVER (PARTITION BY rec)) * 0.1::DOUBLE + 1, 1 - ln(pow(10::DOUBLE, 5)) * 0.1::DOUBLE), 6) AS energy FROM en")
def energy_norm(spark, sf_dir):
    return Q.energy_norm(Q.frame_energy(Q.framing(T.signal(spark, sf_dir), WINDOW, SHIFT))).withColumn("energy", F.round("energy", 6))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS hz, round(1127.0::DOUBLE * ln(1 + l_extendedprice / 700.0::DOUBLE), 4) AS mel,
  round((exp(1127.0::DOUBLE * ln(1 + l_extendedprice / 700.0::DOUBLE) / 1127.0::DOUBLE) - 1) * 700, 4) AS inverse FROM lineitem""")
def mel_scale(spark, sf_dir):
    """Prices as frequencies, to the warped scale and back."""
    hz = F.col("l_extendedprice")
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", hz.alias("hz"), F.round(Q.mel(hz), 4).alias("mel"), F.round(Q.mel_inverse(Q.mel(hz)), 4).alias("inverse"))


def windowed_sql(weight: str) -> str:
    return f"WITH {T.SIGNAL}, {FRAMES} SELECT rec, frame, k, round(x * {weight}, 8) + 0::DOUBLE AS x FROM fm"


def _windowed(spark, sf_dir, window):
    """Frames of the signal under a window, whose size is a parameter; a zero has no sign."""
    frames = Q.framing(T.signal(spark, sf_dir), WINDOW, SHIFT)
    return frames.join(F.broadcast(window), F.col("k") == F.col("n")).select("rec", "frame", "k", (F.round(F.col("x") * F.col("w"), 8) + F.lit(0.0)).alias("x"))


@query(windowed_sql(f"pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / {WINDOW - 1}), 0.85::DOUBLE)"))
def povey_window(spark, sf_dir):
    return _windowed(spark, sf_dir, Q.povey_window(spark, WINDOW))


@query(windowed_sql(f"(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / {WINDOW - 1}))"))
def hamming_window(spark, sf_dir):
    return _windowed(spark, sf_dir, Q.hamming_window(spark, WINDOW))


def bank_sql(nfft: int, rate: int, channels: int, low: float, high: float, name: str = "bk") -> str:
    mel = lambda x: f"1127.0::DOUBLE * ln(1 + ({x}) / 700.0::DOUBLE)"
    return f"""{name}_e AS (SELECT e, {mel(f'{low}::DOUBLE')} + ({mel(f'{high}::DOUBLE')} - {mel(f'{low}::DOUBLE')}) * e / {channels + 1} AS c FROM (SELECT unnest(range(0, {channels + 2})) AS e)),
{name}_a AS (SELECT e, c, floor((exp(c / 1127.0::DOUBLE) - 1) * 700 / {rate} * {nfft})::BIGINT + 1 AS a FROM {name}_e),
{name} AS (SELECT bin::INT AS bin, l.e::INT AS chan, CASE WHEN bin >= l.a AND bin < m.a THEN (l.c - f) / (l.c - m.c) ELSE (r.c - f) / (r.c - m.c) END AS w
  FROM (SELECT bin, {mel(f'bin * {rate}::DOUBLE / {nfft}')} AS f FROM (SELECT unnest(range(0, {nfft // 2 + 1})) AS bin)) b, {name}_a l JOIN {name}_a m ON m.e = l.e + 1 JOIN {name}_a r ON r.e = l.e + 2
  WHERE bin >= l.a AND bin < r.a)"""


@query(f"WITH {T.SIGNAL}, {FRAMES}, {bank_sql(16, 16000, 4, 20.0, 7600.0)} SELECT rec, frame, chan, round(sum(x * x * w), 6) AS e FROM fm JOIN bk ON bk.bin = fm.k GROUP BY rec, frame, chan")
def mel_fbank(spark, sf_dir):
    """The filters' sums over the squares of each frame's first samples, taken for bins."""
    bank = Q.mel_filterbank(spark, 16, 16000, 4, 20.0, 7600.0, htk_bug=False)
    frames = Q.framing(T.signal(spark, sf_dir), WINDOW, SHIFT)
    sums = frames.join(F.broadcast(bank), F.col("k") == F.col("bin")).groupBy("rec", "frame", "chan").agg(F.sum(F.col("x") * F.col("x") * F.col("w")).alias("e"))
    return sums.withColumn("e", F.round("e", 6))


def fbank_sql(zero_mean: bool) -> str:
    centred = "x - avg(x) OVER (PARTITION BY rec, frame)" if zero_mean else "x"
    return f"""WITH {T.SIGNAL}, {FRAMES.replace('x FROM sg JOIN', 'trunc(x * 32768)::DOUBLE AS x FROM sg JOIN')}, {bank_sql(16, 16000, 4, 20.0, 7600.0)},
zm AS (SELECT rec, frame, k, {centred} AS x FROM fm),
pe AS (SELECT rec, frame, k, (x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY rec, frame ORDER BY k), x)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / 15)) AS x FROM zm),
ft AS (SELECT rec, frame, b AS bin, pow(sum(x * cos(2 * pi() * k * b / 16)), 2) + pow(sum(x * sin(2 * pi() * k * b / 16)), 2) AS p FROM pe, (SELECT unnest(range(0, 9)) AS b) GROUP BY rec, frame, b)
SELECT rec, frame, chan, round(ln(greatest(1, sum(p * w))), 5) AS v FROM ft JOIN bk USING (bin) GROUP BY rec, frame, chan"""


def _fbank(spark, sf_dir, zero_mean):
    pcm = T.signal(spark, sf_dir).withColumn("x", Q.pcm_scale(F.col("x")).cast("double"))
    bank = B.filterbank_matrix(Q.mel_filterbank(spark, 16, 16000, 4, 20.0, 7600.0, htk_bug=False), 9, 4)
    out = B.log_filterbank(pcm, np.hamming(WINDOW), WINDOW - SHIFT, bank, zero_mean=zero_mean)
    return out.select("rec", "frame", F.posexplode("feat").alias("chan", "v")).withColumn("v", F.round("v", 5))


@query(fbank_sql(False))
def fbank(spark, sf_dir):
    return _fbank(spark, sf_dir, False)


@query(fbank_sql(True))
def fbank_zero_mean(spark, sf_dir):
    return _fbank(spark, sf_dir, True)

"""Embedding operators: scoring, projection and statistics on vectors of a recording."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import arrays as A

from .kernels import plda_ratio


@dataclass(frozen=True)
class Transform:
    """Centring, projection to discriminants, centring again: ``mean1[D], lda[D][K], mean2[K]``."""

    mean1: Sequence[float]
    lda: Sequence[Sequence[float]]
    mean2: Sequence[float]

    def columns(self) -> list[list[float]]:
        return [list(c) for c in zip(*self.lda, strict=True)]


@dataclass(frozen=True)
class Plda:
    """``mu[D], tr[D][D], psi[D]``: within-class covariance is the identity after ``tr (x - mu)``."""

    mu: Sequence[float]
    tr: Sequence[Sequence[float]]
    psi: Sequence[float]

    def diagonalised(self) -> Plda:
        """The same model with across-class variances in descending order."""
        order = sorted(range(len(self.psi)), key=lambda i: -self.psi[i])
        return Plda(self.mu, [self.tr[i] for i in order], [self.psi[i] for i in order])


def without_nan(df: DataFrame, vector: str = "xvec") -> DataFrame:
    return df.where(~F.coalesce(A.has_nan(F.col(vector)), F.lit(False)))


def transform_vectors(v: Column, t: Transform) -> Column:
    """Unit length of ``ldaT unit(v - mean1) - mean2``."""
    unit = A.l2_norm(A.minus(A.as_doubles(v), A.constant(t.mean1)))
    return A.l2_norm(A.minus(A.matvec(t.columns(), unit), A.constant(t.mean2)))


def plda_project(v: Column, plda: Plda, dims: int) -> Column:
    """The first ``dims`` coordinates of ``tr (v - mu)``."""
    return A.matvec(list(plda.tr)[:dims], A.minus(A.as_doubles(v), A.constant(plda.mu)))


def plda_length_norm(v: Column, psi: Sequence[float]) -> Column:
    """Scaled so that its energy under the total variances ``psi + 1`` is the dimension."""
    inverse = A.constant([1.0 / (p + 1.0) for p in psi])
    energy = lambda u: A.dot(F.transform(u, lambda x: x * x), inverse)
    return A.let(v, lambda u: A.let(F.sqrt(F.lit(float(len(psi))) / energy(u)), lambda k: A.scaled(u, k)))


def blocked_pairs(df: DataFrame, product: Callable[[np.ndarray, np.ndarray], np.ndarray], score: str, rec: str, idx: str, vector: str, block: int) -> DataFrame:
    """``rec, i, j, score``: ``product`` of every pair of a recording's vectors, both triangles and the diagonal.

    A recording's rows are dealt into blocks of ``block``, block pairs are tasks of their own, and each is
    one call with two matrices; no task sees more than two blocks however long the recording.
    """
    rows = df.select(F.col(rec).alias("rec"), F.col(idx).alias("idx"), A.as_doubles(vector).alias("v"))
    n = rows.groupBy("rec").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(n, "rec").withColumn("own", F.pmod(F.xxhash64("idx"), "blocks").cast("int"))
    tiles = rows.withColumn("t", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.when(x == F.col("own"), F.array(F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(0).alias("side")), F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))))))))
    kind = dict(rows.dtypes)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side != 1], pdf[pdf.side != 0]
        s = product(np.stack(a.v.to_list()), np.stack(b.v.to_list()))
        return pd.DataFrame({"rec": pdf.rec.iloc[0], "i": np.repeat(a.idx.to_numpy(), len(b)), "j": np.tile(b.idx.to_numpy(), len(a)), score: s.ravel()})

    flat = tiles.select("rec", "idx", "v", F.col("t.i").alias("bi"), F.col("t.j").alias("bj"), F.col("t.side").alias("side"))
    return flat.groupBy("rec", "bi", "bj").applyInPandas(tile, f"rec {kind['rec']}, i {kind['idx']}, j {kind['idx']}, {score} double")


def cosine_pairs(df: DataFrame, rec: str = "rec", idx: str = "idx", vector: str = "xvec", block: int = 512) -> DataFrame:
    """``rec, i, j, s``: cosine of every pair of a recording, in blocks."""

    def cosines(x, y):
        x, y = (m / (np.sqrt((m * m).sum(1, keepdims=True)) + 1e-32) for m in (x, y))
        return x @ y.T

    return blocked_pairs(df, cosines, "s", rec, idx, vector, block)


def plda_pairs(df: DataFrame, across: Sequence[float], rec: str = "rec", idx: str = "idx", vector: str = "v", block: int = 512) -> DataFrame:
    """``rec, i, j, llr``: log-likelihood ratio that two projected vectors share a class, in blocks."""
    variances = np.asarray(across, float)
    return blocked_pairs(df, lambda e, t: plda_ratio(e, t, variances), "llr", rec, idx, vector, block)


def elements(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Long form ``keys, d, x``."""
    return df.select(*keys, F.posexplode(A.as_doubles(vector)).alias("d", "x"))


def covariance(df: DataFrame, rec: str = "rec", vector: str = "xvec") -> DataFrame:
    """``rec, i, j, c``: population covariance of a recording's vectors.

    Every batch of rows gives, per recording in it, one product of centred vectors with its mean and
    count; these are added by the rule for joined samples.  So ``D * D`` values a batch and recording
    move, not a vector.
    """
    rows = df.select(F.col(rec).alias("rec"), A.as_doubles(vector).alias("v")).where("v is not null")
    kind = dict(rows.dtypes)["rec"]

    def products(batches):
        for pdf in batches:
            for key, own in pdf.groupby("rec", dropna=False, sort=False):
                x = np.stack(own.v.to_list()).astype(float)
                mean = x.mean(0)
                x = x - mean
                yield pd.DataFrame({"rec": [key] * len(mean), "i": np.arange(len(mean), dtype=np.int32), "n": len(x), "mi": mean, "m": [mean] * len(mean), "p": list(x.T @ x)})

    parts = rows.mapInPandas(products, f"rec {kind}, i int, n bigint, mi double, m array<double>, p array<double>")
    long = parts.select("rec", "i", "n", "mi", F.posexplode(F.arrays_zip("m", "p")).alias("j", "z")).select("rec", "i", "j", "n", "mi", F.col("z.m").alias("mj"), F.col("z.p").alias("p"))
    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("mi") * F.col("mj")) - F.sum(F.col("n") * F.col("mi")) * F.sum(F.col("n") * F.col("mj")) / n
    return long.groupBy("rec", "i", "j").agg(((F.sum("p") + between) / n).alias("c"))


def pca_dimension(energies: DataFrame, target: float, rec: str = "rec", energy: str = "energy") -> DataFrame:
    """``rec, pca_dim``: components whose cumulative energy share is at most ``target``, plus two, at most all."""
    down = Window.partitionBy(rec).orderBy(F.desc(energy)).rowsBetween(Window.unboundedPreceding, 0)
    share = energies.withColumn("share", F.sum(energy).over(down) / F.sum(energy).over(Window.partitionBy(rec)))
    return share.groupBy(rec).agg(F.least(F.sum((F.col("share") <= target).cast("int")) + 2, F.count(F.lit(1))).cast("int").alias("pca_dim"))


def mean_std_pool(df: DataFrame, rec: str = "rec", vector: str = "feat") -> DataFrame:
    """``rec, d, mean, std`` over time; the variance has a floor of 1e-10."""
    long = elements(df, vector, rec)
    return long.groupBy(rec, "d").agg(F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x") + 1e-10).alias("std"))

"""Variational HMM of recordings that are too long for one task.

A recording is a row per piece of ``CHUNK`` vectors.  A round is four steps, for all recordings at once: sums of
the pieces' statistics give the speakers; each piece gives the log probabilities of passing through it from any
speaker to any; these are chained per recording, a matrix a piece; and each piece is smoothed between what
comes before and behind it.  A recording leaves when its bound stops rising.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.scratch import Tables

from . import kernels as K
from .linkage import matrix

#: Vectors of a piece.
CHUNK = 4096


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, float).tobytes()


def held(cell, *shape: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), float).reshape(shape)


def pieces_of(rows: DataFrame, smoothing: float, seed: int | None, concentration: float) -> DataFrame:
    """``rec, part, n, s, idx, x, gamma`` of ``rows (rec, idx, place, v, code, speakers)``."""
    kind = dict(rows.dtypes)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        n, s, part = len(table), table.column("speakers")[0].as_py(), table.column("part")[0].as_py()
        if seed is None:
            gamma = K.soft_start(np.append(table.column("code").to_numpy(), s - 1), smoothing)[:n]
        else:
            gamma = K.dirichlet_start(n, s, concentration, [seed, part])
        idx = table.column("idx").chunk(0)
        return pa.table({"rec": table.column("rec").slice(0, 1), "part": pa.array([part]), "n": pa.array([n]), "s": pa.array([s]), "idx": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), idx), "x": pa.array([packed(matrix(table.column("v")))], pa.binary()), "gamma": pa.array([packed(gamma)], pa.binary())})

    keyed = rows.withColumn("part", F.floor(F.col("place") / CHUNK).cast("bigint"))
    return keyed.groupBy("rec", "part").applyInArrow(pack, f"rec {kind['rec']}, part bigint, n bigint, s bigint, idx array<{kind['idx']}>, x binary, gamma binary")


def by_row(df: DataFrame, make, schema: str, names: list[str]) -> DataFrame:
    """``make(row)`` of every row of ``df``, a dictionary of cells, to a list of values."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                values = make({c: batch.column(c)[i] for c in batch.schema.names})
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v]) for v in values], names)

    return df.mapInArrow(run, schema)


def long_vb(rows: DataFrame, phi, loop: float, fa: float, fb: float, rounds: int, epsilon: float, smoothing: float, seed: int | None, concentration: float = 1.0) -> DataFrame:
    """``rec, idx, gamma, pi, objective, rounds, label, second`` of ``rows (rec, idx, place, v, code, speakers)``.

    ``place`` counts from 0; ``code`` numbers a row's label among the recording's ``speakers``.  With a seed
    every piece draws its start from the seed and its own number.
    """
    tables = Tables(rows.sparkSession, "vb")
    kind = dict(rows.dtypes)
    rec = f"rec {kind['rec']}"
    pieces = tables.save(pieces_of(rows, smoothing, seed, concentration), "pieces-0")
    variances = np.asarray(phi, float)
    dim, width = len(variances), f"{rec}, part bigint, n bigint, s bigint, idx array<{kind['idx']}>, x binary, gamma binary"
    state = pieces.groupBy("rec").agg(F.max("s").alias("s"))
    state = state.select("rec", "s", F.expr("transform(sequence(1, s), i -> 1d / s)").alias("pi"), F.lit(None).cast("double").alias("bound"), F.lit(0).alias("rounds"))
    state = tables.save(state, "state-0")
    done = []

    def sums(r):
        n, s = r["n"].as_py(), r["s"].as_py()
        gamma, frames = held(r["gamma"], n, s), K.Frames.of(held(r["x"], n, dim), variances)
        return [pa.array([r["rec"].as_py()], r["rec"].type), s, packed(gamma.sum(0)), packed(gamma.T @ frames.scaled)]

    def believed(table: pa.Table) -> pa.Table:
        s = table.column("s")[0].as_py()
        occupied = sum(held(c, s) for c in table.column("occupied"))
        first = sum(held(c, s, dim) for c in table.column("first"))
        speakers = K.Speakers.of(occupied, first, variances, fa / fb)
        return pa.table({"rec": table.column("rec").slice(0, 1), "mean": pa.array([packed(speakers.mean)], pa.binary()), "variance": pa.array([packed(speakers.variance)], pa.binary()), "prior": pa.array([fb * speakers.divergence()])})

    def likelihood(r):
        n, s = r["n"].as_py(), r["s"].as_py()
        speakers = K.Speakers(held(r["mean"], s, dim), held(r["variance"], s, dim))
        return fa * speakers.expected(K.Frames.of(held(r["x"], n, dim), variances))

    def passage(r):
        chain = K.Chain(loop, np.array(r["pi"].as_py()))
        ll = likelihood(r)
        through = chain.through(ll)
        begun = chain.forward(ll, np.log(chain.weights + K.LOG_FLOOR))
        return [pa.array([r["rec"].as_py()], r["rec"].type), r["part"].as_py(), packed(through), packed(np.log(np.maximum(begun[0][-1], 1e-300)) + begun[1][-1])]

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        pi = np.array(table.column("pi")[0].as_py())
        s, chain = len(pi), K.Chain(loop, pi)
        through = [held(c, s, s) for c in table.column("through")]
        ahead = [held(table.column("begun")[0], s)]
        for m in through[1:]:
            ahead.append(K.lse(ahead[-1][:, None] + m, 0))
        behind = [np.zeros(s)]
        for m in through[:0:-1]:
            behind.append(K.lse(m + behind[-1][None, :], 1))
        enter = [np.log(pi + K.LOG_FLOOR), *(chain.step(a) for a in ahead[:-1])]
        n = len(table)
        return pa.table({"rec": table.column("rec"), "part": table.column("part"), "enter": pa.array([packed(e) for e in enter], pa.binary()), "leave": pa.array([packed(b) for b in behind[::-1]], pa.binary()), "total": pa.array([float(K.lse(ahead[-1], 0))] * n)})

    def smoothed(r):
        s, part = r["s"].as_py(), r["part"].as_py()
        chain = K.Chain(loop, np.array(r["pi"].as_py()))
        gamma, draws = chain.smoothed(likelihood(r), held(r["enter"], s), held(r["leave"], s), part == 0)
        keep = [pa.array([r["rec"].as_py()], r["rec"].type), part, r["n"].as_py(), s, pa.array([r["idx"].as_py()], r["idx"].type), pa.array([r["x"].as_buffer().to_pybytes()], pa.binary()), pa.array([packed(gamma)], pa.binary())]
        return [*keep, pa.array([draws.tolist()], pa.list_(pa.float64()))]

    for turn in range(rounds):
        parts = by_row(pieces.select("rec", "n", "s", "x", "gamma"), sums, f"{rec}, s bigint, occupied binary, first binary", ["rec", "s", "occupied", "first"])
        speakers = parts.groupBy("rec").applyInArrow(believed, f"{rec}, mean binary, variance binary, prior double")
        speakers = tables.save(speakers.join(state.select("rec", "pi"), "rec"), f"speakers-{turn}")
        ready = pieces.join(speakers, "rec")
        gone = by_row(ready.select("rec", "part", "n", "s", "x", "mean", "variance", "pi"), passage, f"{rec}, part bigint, through binary, begun binary", ["rec", "part", "through", "begun"])
        ends = gone.join(speakers.select("rec", "pi"), "rec").groupBy("rec").applyInArrow(chained, f"{rec}, part bigint, enter binary, leave binary, total double")
        ends = tables.save(ends, f"ends-{turn}")
        names = ["rec", "part", "n", "s", "idx", "x", "gamma", "draws"]
        went = tables.save(by_row(ready.drop("gamma").join(ends, ["rec", "part"]), smoothed, f"{width}, draws array<double>", names), f"went-{turn}")
        drawn = went.select("rec", F.posexplode("draws").alias("k", "u")).groupBy("rec", "k").agg(F.sum("u").alias("u"))
        drawn = drawn.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "u"))), lambda x: x["u"]).alias("u"))  # a number a speaker
        bound = ends.groupBy("rec").agg(F.first("total").alias("total")).join(speakers.select("rec", "prior"), "rec").select("rec", (F.col("total") - F.col("prior")).alias("now"))
        whole = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
        state = state.join(drawn, "rec").join(bound, "rec").select("rec", "s", F.transform("u", lambda x: x / whole).alias("pi"), F.col("now").alias("bound"), (F.col("rounds") + 1).alias("rounds"), (F.col("rounds") > 0) & (F.col("now") - F.col("bound") < epsilon))
        state = tables.save(state.toDF("rec", "s", "pi", "bound", "rounds", "stops"), f"state-{turn + 1}")
        last = turn == rounds - 1
        stops = state if last else state.where("stops")
        if last or not stops.isEmpty():
            done.append(went.drop("draws").join(stops.select("rec", "pi", "bound", "rounds"), "rec"))
        state = state.where("not coalesce(stops, false)").drop("stops")
        pieces = went.drop("draws").join(state.select("rec"), "rec", "left_semi")
        if last or state.isEmpty():
            break
        tables.drop(f"ends-{turn}", f"speakers-{turn}")

    def unpacked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n, s = batch.column("n")[i].as_py(), batch.column("s")[i].as_py()
                gamma = held(batch.column("gamma")[i], n, s)
                order = np.argsort(-gamma, axis=1, kind="stable")
                second = pa.array(order[:, 1]) if s > 1 else pa.nulls(n, pa.int64())
                again = pa.array(np.zeros(n, np.int64))
                one = lambda c: batch.column(c).slice(i, 1).take(again)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [one("rec"), batch.column("idx")[i].values, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * s), pa.array(gamma.ravel())), one("pi"), one("bound"), one("rounds").cast(pa.int64()), pa.array(order[:, 0]), second],
                    ["rec", "idx", "gamma", "pi", "objective", "rounds", "label", "second"],
                )

    every = done[0]
    for one in done[1:]:
        every = every.unionByName(one)
    return every.mapInArrow(unpacked, f"{rec}, idx {kind['idx']}, gamma array<double>, pi array<double>, objective double, rounds bigint, label bigint, second bigint")

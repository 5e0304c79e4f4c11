"""Model fits: a recording is a group, a group is one Arrow-backed kernel call.

The global calibration is a loop of aggregations instead, as it covers all pairs of all recordings; filters work on
many recordings in one call.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import arrays as A
from segspark.scratch import Tables

from . import kernels as K
from . import linkage, longchain
from .linkage import matrix
from .vectors import Plda, blocked_pairs, covariance


#: Rows up to which a recording's variational fit is one task.
VB_LIMIT = 1 << 14
#: Numbers in the largest array of a step of the filters that run side by side.
HMM_CELLS = 1 << 21
#: What the filters can give of every row, beside the recording's total.
HMM_VALUES = ("forward", "backward", "posterior")


def calibrate(scores: DataFrame, column: str = "s", rounds: int = 20) -> dict[str, float]:
    """Two-Gaussian calibration over a whole column: one aggregation a round, a few numbers a partition.

    Returns threshold, weights, means and variance, and under ``e_`` slope and offset of the log odds in
    the last expectation step.  Null scores are left out.  Scores that do not vary have their common
    value as threshold and both means, variance 0 and no slope; without scores all that is 0.
    """
    s = scores.select(F.col(column).cast("double").alias("s")).where("s is not null").persist()
    try:
        count, mean, var = s.agg(F.count("s"), F.avg("s"), F.var_pop("s")).first()
        if not count or var <= K.TINY * mean**2:
            level = mean if count else 0.0
            return {"threshold": level, "w0": 0.5, "w1": 0.5, "m0": level, "m1": level, "var": 0.0, "e_slope": 0.0, "e_offset": 0.0}
        std = math.sqrt(var)
        line, x = K.Boundary(2 / std, -2 * mean / std), F.col("s")
        masses = (0.5 * count, 0.5 * (mean - std) * count, 0.0), (0.5 * count, 0.5 * (mean + std) * count, 0.0)
        for _ in range(rounds):
            used = line
            upper = 1 / (1 + F.exp(-(F.lit(line.slope) * x + line.offset)))
            sums = s.agg(*(F.sum(g * w) for g in (1 - upper, upper) for w in (F.lit(1.0), x, x * x))).first()
            better = K.Boundary.of(sums[:3], sums[3:])
            if better is None:
                break
            masses, line = (tuple(sums[:3]), tuple(sums[3:])), better
    finally:
        s.unpersist()
    means = [c[1] / c[0] for c in masses]
    spread = (means[1] - means[0]) / line.slope
    return {"threshold": line.threshold, "w0": masses[0][0] / count, "w1": masses[1][0] / count, "m0": means[0], "m1": means[1], "var": spread, "e_slope": used.slope, "e_offset": used.offset}


def calibrated_ratio(x, fit: dict[str, float]):
    """Log-likelihood ratio of a score under the last expectation step, greater mean over lesser."""
    odds = x * fit["e_slope"] + fit["e_offset"]
    return odds if fit["m1"] >= fit["m0"] else -odds


def thresholds(df: DataFrame, rounds: int = 20, rec: str = "rec", idx: str = "idx", vector: str = "xvec", block: int = linkage.BLOCK) -> DataFrame:
    """``rec, threshold``: the two-Gaussian threshold of all cosines of each recording, both triangles and the diagonal.

    All recordings are fitted in one aggregation a round; a task holds two blocks of vectors, never the scores.
    Scores that do not vary have their common value as threshold.
    """
    tables = Tables(df.sparkSession, "thresholds")
    rows = df.select(F.col(rec).alias("rec"), F.col(idx).alias("idx"), _unit(F.col(vector).cast("array<double>")).alias("v"))
    placed = tables.save(linkage.numbered(tables, rows, "rec", "idx"), "placed")
    return linkage.long_thresholds(tables, placed, rounds, block)


def _unit(v):
    return A.let(v, lambda v: A.let(A.norm(v) + F.lit(1e-32), lambda n: F.transform(v, lambda x: x / n)))


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("idx", kind="stable")


def cluster(df: DataFrame, threshold: float, calibrated: bool = False, rec: str = "rec", idx: str = "idx", vector: str = "xvec", limit: int = linkage.LIMIT, block: int = linkage.BLOCK) -> DataFrame:
    """``rec, idx, label``: average-linkage clusters of a recording by cosine similarity.

    Clusters merge while their mean similarity is at least ``threshold`` (plus the recording's own
    two-Gaussian threshold if ``calibrated``).  A label is the place of the cluster's first row; one row
    alone has label 0.  A recording of up to ``limit`` rows is one task with a matrix; a longer one is merged
    in rounds over blocks of ``block`` rows, see ``linkage``.
    """
    rows = df.select(F.col(rec).alias("rec"), F.col(idx).alias("idx"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        x = np.stack(pdf.v.to_list())
        x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-32)
        sim = x @ x.T
        least = threshold + (K.calibration(sim)[0] if calibrated and len(x) > 1 else 0.0)
        return pd.DataFrame({"rec": pdf.rec, "idx": pdf.idx, "label": K.average_linkage(sim, least)})

    schema = f"rec {kind['rec']}, idx {kind['idx']}, label bigint"
    sizes = rows.groupBy("rec").agg(F.count(F.lit(1)).alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) <= limit:
        return rows.groupBy("rec").applyInPandas(fit, schema)
    tables = Tables(df.sparkSession, "linkage")
    long = sizes.where(F.col("size") > limit).select("rec")
    short = rows.join(long, "rec", "left_anti").groupBy("rec").applyInPandas(fit, schema)
    placed = tables.save(linkage.numbered(tables, rows.join(long, "rec", "left_semi").withColumn("v", _unit(F.col("v"))), "rec", "idx"), "placed")
    least = F.lit(float(threshold))
    ready = placed.withColumn("least", least)
    if calibrated:
        ready = placed.join(linkage.long_thresholds(tables, placed, block=block), "rec").withColumn("least", F.col("threshold") + least).drop("threshold")
    labels = linkage.long_linkage(tables, ready.select("rec", "place", "v", "least"), limit, block)
    return short.unionByName(placed.select("rec", "idx", "place").join(labels, ["rec", "place"]).select("rec", "idx", "label"))


def soft_labels(label, classes: int, smoothing: float = 5.0):
    """Responsibilities of a hard label column among ``classes``: a softmax of ``smoothing`` at the label."""
    high = math.exp(smoothing) / (math.exp(smoothing) + classes - 1)
    low = 1.0 / (math.exp(smoothing) + classes - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, F.lit(high)).otherwise(F.lit(low)))


def vb_cluster(df: DataFrame, phi: list[float], loop: float = 0.9, fa: float = 1.0, fb: float = 1.0, rounds: int = 10, epsilon: float = 1e-4, smoothing: float = 5.0, rec: str = "rec", idx: str = "idx", vector: str = "v", label: str = "label", seed: int | None = None, speakers: int = 10, limit: int = VB_LIMIT) -> DataFrame:
    """``rec, idx, gamma, pi, objective, rounds, label, second``: variational HMM per recording.

    Starts from softened labels; with ``seed`` from random responsibilities of ``speakers`` instead.
    Labels are columns of ``gamma``, ties to the lower one; ``second`` is null for one speaker.  A recording of up
    to ``limit`` rows is one task; a longer one is fitted in pieces, see ``longchain``, which with a seed draw
    their starts each on its own.
    """
    init = F.col(label) if seed is None else F.lit(0)
    rows = df.select(F.col(rec).alias("rec"), F.col(idx).alias("idx"), F.col(vector).cast("array<double>").alias("v"), init.cast("bigint").alias("label"))
    kind = dict(rows.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        x = np.stack(pdf.v.to_list())
        start = K.soft_start(np.unique(pdf.label.to_numpy(), return_inverse=True)[1], smoothing) if seed is None else None
        got = K.vb_hmm(x, phi, start, speakers if start is None else start.shape[1], loop, fa, fb, rounds, epsilon, seed=seed or 0)
        order = np.argsort(-got.gamma, axis=1, kind="stable")
        second = order[:, 1].tolist() if order.shape[1] > 1 else [None] * len(x)
        return pd.DataFrame({"rec": pdf.rec.to_numpy(), "idx": pdf.idx.to_numpy(), "gamma": list(got.gamma), "pi": [got.weights] * len(x), "objective": got.bounds[-1], "rounds": len(got.bounds), "label": order[:, 0], "second": pd.array(second, "Int64")})

    schema = f"rec {kind['rec']}, idx {kind['idx']}, gamma array<double>, pi array<double>, objective double, rounds bigint, label bigint, second bigint"
    sizes = rows.groupBy("rec").agg(F.count(F.lit(1)).alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) <= limit:
        return rows.groupBy("rec").applyInPandas(fit, schema)
    long = sizes.where(F.col("size") > limit).select("rec")
    short = rows.join(long, "rec", "left_anti").groupBy("rec").applyInPandas(fit, schema)
    placed = linkage.numbered(Tables(df.sparkSession, "vb-rows"), rows.join(long, "rec", "left_semi"), "rec", "idx")
    if seed is None:
        names = placed.select("rec", "label").distinct()
        of_rec = Window.partitionBy("rec")
        names = names.select("rec", "label", (F.row_number().over(of_rec.orderBy("label")) - 1).cast("bigint").alias("code"), F.count(F.lit(1)).over(of_rec).alias("speakers"))
        placed = placed.join(names, ["rec", "label"])
    else:
        placed = placed.withColumns({"code": F.lit(0).cast("bigint"), "speakers": F.lit(speakers).cast("bigint")})
    fitted = longchain.long_vb(placed.select("rec", "idx", "place", "v", "code", "speakers"), phi, loop, fa, fb, rounds, epsilon, smoothing, seed)
    return short.unionByName(fitted)


def _abreast(batches, rows: int):
    """Tables of whole groups and the places where these begin, from sorted batches with a 1 in ``place`` where a group begins.

    A table has up to ``rows`` rows, more only where one group has.
    """
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if len(held) < rows:
                continue
        if held is None:
            return
        cuts = np.flatnonzero(held.column("place").to_numpy() == 1)
        if batch is None:
            cuts = np.append(cuts, len(held))
        begin = 0
        while begin < len(cuts) - 1 and (batch is None or len(held) - cuts[begin] >= rows):
            end = max(int(np.searchsorted(cuts, cuts[begin] + rows, "right")) - 1, begin + 1)
            yield held.slice(cuts[begin], cuts[end] - cuts[begin]).combine_chunks(), cuts[begin:end] - cuts[begin]
            begin = end
        held = held.slice(cuts[begin])


def hmm(df: DataFrame, transition: list[list[float]], initial: list[float], rec: str = "rec", idx: str = "idx", vector: str = "ll", chunk: int = 4096, values: tuple[str, ...] = HMM_VALUES) -> DataFrame:
    """``rec, idx, forward, backward, posterior, total`` from log output probabilities per state; of the first three those in ``values``.

    ``idx`` are whole numbers in order of time.  A recording is cut every ``chunk`` of them: each piece gives
    the log probabilities of passing through it from any state to any, these small matrices are chained
    per recording, and each piece runs again between what comes before and after it.  A task goes through sorted
    pieces and works on many side by side, as many as its arrays may hold (``HMM_CELLS``); so no task holds more than
    that or one piece, however many or long the recordings, but for a matrix a piece of a recording.
    """
    rows = df.select(F.col(rec).alias("rec"), F.col(idx).alias("idx"), F.col(vector).cast("array<double>").alias("v"), F.floor(F.col(idx) / chunk).cast("long").alias("part"))
    rows = rows.repartition("rec", "part")
    kind = dict(rows.dtypes)
    lt, li = np.log(np.array(transition, float) + K.LOG_FLOOR), np.log(np.array(initial, float) + K.LOG_FLOOR)
    n = len(li)
    values = [v for v in HMM_VALUES if v in values]
    wide = max(1, HMM_CELLS // (n * n * (n + 1)))

    def placed(df: DataFrame, group: list[str], order: str) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(order))).sortWithinPartitions(*group, order)

    def read(column, *shape: int) -> np.ndarray:
        """Cells of lists, a list a row, with the rows as the last axis."""
        if column.null_count or (pc.list_value_length(column).to_numpy() != math.prod(shape)).any():
            raise ValueError("a row must have one log probability per state")
        return np.ascontiguousarray(np.moveaxis(matrix(column).reshape(len(column), *shape), 0, -1))

    def lists(x: np.ndarray) -> pa.Array:
        flat = x.reshape(-1, x.shape[-1]).T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

    def laid(table: pa.Table, starts: np.ndarray):
        """The pieces side by side, their rows' log probabilities, and the steps to their rows."""
        side = K.Abreast.of(starts, len(table))
        ll = side.laid(read(table.column("v"), n))
        return side, ll[:, : len(starts)], lambda span: lt[:, :, None] + ll[:, span]

    def passage(batches):
        first = np.concatenate((lt, li[None]))[:, :, None]
        for table, starts in _abreast(batches, wide):
            side, head, step = laid(table, starts)
            end = np.empty((n + 1, n, len(starts)))
            for _, a in side.forward(first + head, step):
                end[..., side.groups[: a.shape[-1]]] = a
            begins = table.take(starts)
            yield from pa.table({"rec": begins.column("rec"), "part": begins.column("part"), "through": lists(end[:n]), "begun": lists(end[n])}).to_batches()

    def chain(batches):
        for table, starts in _abreast(batches, wide):
            side = K.Abreast.of(starts, len(table))
            through, begun = side.laid(read(table.column("through"), n, n)), side.laid(read(table.column("begun"), n))
            ahead, behind = np.empty_like(begun), np.empty_like(begun)
            for span, a in side.forward(begun[:, : len(starts)], lambda span: through[:, :, span]):
                ahead[:, span] = a
            for span, b in side.backward(np.zeros((n, len(starts))), lambda span: through[:, :, span]):
                behind[:, span] = b
            ahead, behind = ahead[:, side.at], behind[:, side.at]
            enter = np.roll(K.lse(ahead[:, None] + lt[:, :, None], 0), 1, -1)
            enter[:, starts] = li[:, None]
            sizes = np.diff(np.append(starts, len(table)))
            total = np.repeat(K.lse(ahead[:, starts + sizes - 1], 0), sizes)
            yield from pa.table({"rec": table.column("rec"), "part": table.column("part"), "enter": lists(enter), "leave": lists(behind), "total": total}).to_batches()

    def fit(batches):
        for table, starts in _abreast(batches, wide):
            side, head, step = laid(table, starts)
            begins = table.take(starts)
            enter, leave = read(begins.column("enter"), n), read(begins.column("leave"), n)
            whole = np.repeat(begins.column("total").to_numpy(), np.diff(np.append(starts, len(table))))
            made = {}
            if values != ["backward"]:
                made["forward"] = np.empty((n, len(table)))
                for span, a in side.forward(enter[:, side.groups] + head, step):
                    made["forward"][:, span] = a
            if values != ["forward"]:
                made["backward"] = np.empty((n, len(table)))
                for span, b in side.backward(leave, step):
                    made["backward"][:, span] = b
            made = {v: x[:, side.at] for v, x in made.items()}
            if "posterior" in values:
                made["posterior"] = np.exp(made["forward"] + made["backward"] - whole)
            yield from pa.table({"rec": table.column("rec"), "idx": table.column("idx"), **{v: lists(made[v]) for v in values}, "total": whole}).to_batches()

    pieces = placed(rows, ["rec", "part"], "idx").mapInArrow(passage, f"rec {kind['rec']}, part long, through array<double>, begun array<double>")
    ends = placed(pieces, ["rec"], "part").mapInArrow(chain, f"rec {kind['rec']}, part long, enter array<double>, leave array<double>, total double")
    between = placed(rows.join(ends, ["rec", "part"]), ["rec", "part"], "idx")
    between = between.withColumns({c: F.when(F.col("place") == 1, F.col(c)) for c in ("enter", "leave", "total")})  # read of a piece's first row only
    return between.mapInArrow(fit, f"rec {kind['rec']}, idx {kind['idx']}, {''.join(f'{v} array<double>, ' for v in values)}total double")


def plda_dense_pairs(df: DataFrame, plda: Plda, target: float = 0.1, dims: int | None = None, rec: str = "rec", idx: str = "idx", vector: str = "xvec", block: int = 512) -> DataFrame:
    """``rec, i, j, llr``: PLDA scores of all pairs after the recording's own principal components.

    Two steps: a model per recording from its covariance, which batches of rows add up to (a group is
    ``D * D`` numbers), then factors of each vector under its model, multiplied in blocks.  So no task holds a
    recording.  ``target`` is the share of energy that the components may hold less two of them.
    """
    rows = df.select(F.col(rec).alias("rec"), F.col(idx).alias("idx"), F.col(vector).cast("array<double>").alias("v"))
    kind, mu = dict(rows.dtypes), np.asarray(plda.mu, float)
    size = len(mu)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((size, size))
        c[pdf.i.to_numpy(), pdf.j.to_numpy()] = pdf.c.to_numpy()
        model = K.DenseModel.of(c, plda.tr, plda.psi, target, dims)
        return pd.DataFrame({"rec": pdf.rec.iloc[:1], "projection": [model.projection.ravel()], "across": [model.across]})

    def factors(batches):
        for pdf in batches:
            for key, own in pdf.groupby("rec", sort=False):
                across = np.asarray(own.across.iloc[0])
                model = K.DenseModel(np.asarray(own.projection.iloc[0]).reshape(size, -1), across)
                left, right = K.plda_factors(model.projected(np.stack(own.v.to_list()) - mu), across)
                yield pd.DataFrame({"rec": [key] * len(own), "idx": own.idx.to_numpy(), "v": list(np.concatenate((left, right), 1))})

    models = covariance(rows, vector="v").groupBy("rec").applyInPandas(fit, f"rec {kind['rec']}, projection array<double>, across array<double>")
    made = rows.join(models, "rec").mapInPandas(factors, f"rec {kind['rec']}, idx {kind['idx']}, v array<double>")
    return blocked_pairs(made, lambda a, b: a[:, : a.shape[1] // 2] @ b[:, b.shape[1] // 2 :].T, "llr", "rec", "idx", "v", block)


def frame_errors(df: DataFrame, expected: bool = True, entropy: bool = False, rec: str = "rec", ref: str = "ref", gamma: str = "gamma") -> DataFrame:
    """``rec, error``: frame error rate under the best one-to-one map.

    Costs are summed by Spark per reference and state, so a group of the assignment is a small matrix.
    """
    g = F.col("g")
    rows = df.select(F.col(rec).alias("rec"), F.col(ref).alias("ref"), F.posexplode(gamma).alias("k", "g"), F.array_max(gamma).alias("top"), (F.array_position(gamma, F.array_max(gamma)) - 1).alias("best"))
    q = g if expected else (F.col("k") == F.col("best")).cast("double")
    value = -F.log(q + F.lit(5e-324)) if entropy else -q
    cells = rows.groupBy("rec", "ref", "k").agg(F.sum(value).alias("cost"), F.count(F.lit(1)).alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="ref", columns="k", values="cost", fill_value=0.0)
        frames = pdf[pdf.k == pdf.k.min()].n.sum()
        return pd.DataFrame({"rec": [pdf.rec.iloc[0]], "error": [K.table_error(m.to_numpy(), int(frames), entropy)]})

    return cells.groupBy("rec").applyInPandas(solve, f"rec {dict(cells.dtypes)['rec']}, error double")

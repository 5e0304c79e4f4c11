"""Average linkage and calibration of recordings that are too long for a similarity matrix.

The mean cosine of two clusters is the product of their vector sums over the product of their sizes, so a
cluster is one row: its size and its sum.  Average linkage is reducible (a merged cluster is never nearer
to a third one than the nearer of its parts was), hence

* pairs of mutually nearest clusters may be merged all at once, a round, and the tree is that of merging the
  best pair of all one by one;
* only clusters that were merged, or whose nearest was, look for their nearest again;
* a cluster without a partner at the threshold is finished and leaves the search.

The nearest are found by row maxima of block products: a task holds two blocks.  Once a recording has at
most ``limit`` open clusters, one task finishes it with a matrix of these.

Equal vectors are one cluster from the start (no pair can be nearer).  Of equal pairs the one whose places
have the greater hash comes first, so ties do not line up into a round each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.scratch import Tables

from . import kernels as K

#: Rows of a block, and rows of a block that meet the other block at once.
BLOCK, STRIP = 4096, 512
#: Open clusters up to which one task finishes a recording.
LIMIT = 4096


def matrix(column) -> np.ndarray:
    """Rows of an array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of places, the same both ways round."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    h = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def in_blocks(rows: DataFrame, against: DataFrame, block: int) -> DataFrame:
    """Block pairs of two tables with ``rec``: rows with ``bi, bj, side``; side 0 are ``rows``, side 1 ``against``."""
    count = lambda df, name: df.groupBy("rec").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = count(rows, "na").join(count(against, "nb"), "rec")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("c"), n).cast("int")
    left = rows.join(sizes, "rec").withColumns({"bi": dealt("na"), "bj": spread("nb"), "side": F.lit(0)})
    right = against.join(sizes, "rec").withColumns({"bi": spread("na"), "bj": dealt("nb"), "side": F.lit(1)})
    return left.drop("na", "nb").unionByName(right.drop("na", "nb"))


def nearest(rows: DataFrame, against: DataFrame, block: int) -> DataFrame:
    """``rec, c, nn, sim`` of every row of ``rows (rec, c, n, s)`` that has another row in its recording."""
    kind = dict(rows.dtypes)["rec"]

    def tile(table: pa.Table) -> pa.Table:
        side, c = table.column("side").to_numpy(), table.column("c").to_numpy()
        x = matrix(table.column("s")) / table.column("n").to_numpy()[:, None]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for at in range(0, len(a), STRIP):
            some = a[at : at + STRIP]
            s = x[some] @ x[b].T
            own = np.flatnonzero(np.isin(c[some], c[b]))
            s[own] = np.where(c[some[own]][:, None] == c[b], -np.inf, s[own])
            top = s.max(1)
            row, col = np.nonzero(s == np.where(np.isfinite(top), top, np.nan)[:, None])
            tie = mixed(c[some][row], c[b][col])
            order = np.lexsort((-tie, row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            out.append((c[some][row[first]], top[row[first]], tie[first], c[b][col[first]]))
        c, sim, tie, nn = (np.concatenate(p) if out else np.zeros(0, np.int64) for p in (zip(*out, strict=True) if out else [()] * 4))
        rec = table.column("rec").slice(0, 1).take(pa.array(np.zeros(len(c), np.int64)))
        return pa.table({"rec": rec, "c": pa.array(c, pa.int64()), "sim": pa.array(sim, pa.float64()), "tie": pa.array(tie, pa.int64()), "nn": pa.array(nn, pa.int64())})

    found = in_blocks(rows, against, block).groupBy("rec", "bi", "bj").applyInArrow(tile, f"rec {kind}, c long, sim double, tie long, nn long")
    best = found.groupBy("rec", "c").agg(F.max(F.struct("sim", "tie", "nn")).alias("best"))
    return best.select("rec", "c", F.col("best.nn").alias("nn"), F.col("best.sim").alias("sim"))


def mutual(state: DataFrame) -> DataFrame:
    """``rec, lo, hi``: pairs of ``state (rec, c, nn, sim)`` that are the best pair of both their members.

    The best pair of a recording always is one, whatever the rounding, so every round merges.
    """
    tie = F.xxhash64("lo", "hi")
    pairs = state.select("rec", F.least("c", "nn").alias("lo"), F.greatest("c", "nn").alias("hi"), "sim").groupBy("rec", "lo", "hi").agg(F.max("sim").alias("sim")).withColumn("tie", tie)
    ends = pairs.select("rec", "lo", "hi", F.struct("sim", "tie", "lo", "hi").alias("pair"), F.explode(F.array("lo", "hi")).alias("end"))
    best = ends.groupBy("rec", "end").agg(F.max("pair").alias("pair"))
    return best.groupBy("rec", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def finished(state: DataFrame) -> DataFrame:
    """``rec, x, y``: clusters ``x`` that end in cluster ``y``, of recordings whose open clusters fit one task."""
    kind = dict(state.dtypes)["rec"]

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("c")
        c, n, s = table.column("c").to_numpy(), table.column("n").to_numpy().astype(float), matrix(table.column("s"))
        root = c[K.average_linkage(s @ s.T, table.column("least")[0].as_py(), n)]
        went = np.flatnonzero(root != c)
        return pa.table({"rec": table.column("rec").take(pa.array(went)), "x": pa.array(c[went]), "y": pa.array(root[went])})

    return state.select("rec", "c", "n", "s", "least").groupBy("rec").applyInArrow(fit, f"rec {kind}, x long, y long")


def roots(tables: Tables, links: DataFrame) -> DataFrame:
    """``rec, x, y`` with ``y`` the last of the chain that begins with ``x``, by doubling."""
    now, turn = tables.save(links, "links-0"), 0
    while True:
        on = now.select("rec", F.col("x").alias("y"), F.col("y").alias("z"))
        turn += 1
        step = tables.save(now.join(on, ["rec", "y"], "left").select("rec", "x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), f"links-{turn}")
        tables.drop(f"links-{turn - 1}")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def merged_links(units: DataFrame, links: list[DataFrame]) -> DataFrame:
    every = units.where("false").select("rec", F.col("c").alias("x"), F.col("c").alias("y"))
    for one in links:
        every = every.unionByName(one)
    return every


def long_linkage(tables: Tables, rows: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``rec, place, label`` of ``rows (rec, place, v, least)``: unit vectors, places from 0, and the recording's threshold."""
    lone = (F.col("least") > 1) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("own", F.when(lone, F.col("place")))
    units = rows.groupBy("rec", "v", "own").agg(F.min("place").alias("c"), F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    units = tables.save(units, "units")
    known = {"nn": F.lit(None).cast("long"), "sim": F.lit(None).cast("double")}
    state = units.select("rec", "c", "n", F.expr("transform(v, x -> x * n)").alias("s"), "least").withColumns(known)
    state, links, turn = tables.save(state, "state-0"), [], 0
    while True:
        counts = state.groupBy("rec").agg(F.count(F.lit(1)).alias("open"))
        least, most = counts.agg(F.min("open"), F.max("open")).first()
        if least is not None and least <= limit:
            links.append(tables.save(finished(state.join(counts.where(F.col("open") <= limit), "rec", "left_semi")), f"finished-{turn}"))
            state = state.join(counts.where(F.col("open") > limit), "rec", "left_semi")
        if most is None or most <= limit:
            break
        near = nearest(state.where("nn is null").select("rec", "c", "n", "s"), state.select("rec", "c", "n", "s"), block)
        near = near.withColumnsRenamed({"nn": "nn2", "sim": "sim2"})
        whole = state.join(near, ["rec", "c"], "left").withColumns({"nn": F.coalesce("nn", "nn2"), "sim": F.coalesce("sim", "sim2")}).drop("nn2", "sim2")
        whole = tables.save(whole.where("sim >= least"), f"whole-{turn}")
        merged = tables.save(mutual(whole), f"merged-{turn}")
        links.append(merged.select("rec", F.col("hi").alias("x"), F.col("lo").alias("y")))
        part = lambda end: whole.select("rec", F.col("c").alias(end), F.col("n").alias(f"n_{end}"), F.col("s").alias(f"s_{end}"), *(["least"] if end == "lo" else []))  # noqa: E731, B023
        joined = merged.join(part("lo"), ["rec", "lo"]).join(part("hi"), ["rec", "hi"])
        joined = joined.select("rec", F.col("lo").alias("c"), (F.col("n_lo") + F.col("n_hi")).alias("n"), F.zip_with("s_lo", "s_hi", lambda x, y: x + y).alias("s"), "least").withColumns(known)
        gone = merged.select("rec", F.explode(F.array("lo", "hi")).alias("c"))
        stay = whole.join(gone, ["rec", "c"], "left_anti").join(gone.select("rec", F.col("c").alias("nn"), F.lit(True).alias("stale")), ["rec", "nn"], "left")
        stay = stay.select("rec", "c", "n", "s", "least", F.when(F.col("stale").isNull(), F.col("nn")).alias("nn"), F.when(F.col("stale").isNull(), F.col("sim")).alias("sim"))
        turn += 1
        state = tables.save(joined.unionByName(stay), f"state-{turn}")
        tables.drop(f"state-{turn - 1}", f"whole-{turn - 1}")
    every = merged_links(units, links)
    ends = roots(tables, every).select("rec", F.col("x").alias("c"), F.col("y").alias("end"))
    label = units.select("rec", "v", "own", "c").join(ends, ["rec", "c"], "left").select(F.col("rec").alias("r"), F.col("v").alias("w"), F.col("own").alias("o"), F.coalesce("end", "c").alias("label"))
    same = F.col("rec").eqNullSafe(F.col("r")) & (F.col("v") == F.col("w")) & F.col("own").eqNullSafe(F.col("o"))
    return rows.join(label, same).select("rec", "place", "label")


def long_thresholds(tables: Tables, rows: DataFrame, rounds: int = 20, block: int = BLOCK) -> DataFrame:
    """``rec, threshold``: the two-Gaussian threshold of all cosines of each recording of ``rows (rec, place, v)``.

    Block products are made anew in every round and only six sums a tile leave it; tiles above the diagonal
    count twice.  All recordings advance together, one aggregation a round.
    """
    kind = dict(rows.dtypes)["rec"]
    own = rows.select("rec", F.col("place").alias("c"), "v")
    pairs = in_blocks(own, own, block).where("bi <= bj")

    def packed(table: pa.Table) -> pa.Table:
        side, x = table.column("side").to_numpy(), matrix(table.column("v"))
        one = lambda name: table.column(name).slice(0, 1)
        return pa.table({"rec": one("rec"), "twice": pa.array([table.column("bi")[0].as_py() != table.column("bj")[0].as_py()]), "dim": pa.array([x.shape[1]], pa.int32()), "a": pa.array([x[side == 0].tobytes()], pa.binary()), "b": pa.array([x[side == 1].tobytes()], pa.binary())})

    tiles = tables.save(pairs.groupBy("rec", "bi", "bj").applyInArrow(packed, f"rec {kind}, twice boolean, dim int, a binary, b binary"), "tiles")

    def sums(lines: DataFrame) -> DataFrame:
        """Mass, sum and sum of squares below and above each recording's line; without a line all is below."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    dim, slope, offset, weight = (batch.column(n)[i].as_py() for n in ("dim", "slope", "offset", "twice"))
                    a, b = (np.frombuffer(batch.column(n)[i].as_buffer(), float).reshape(-1, dim) for n in ("a", "b"))
                    got = np.zeros(6)
                    for at in range(0, len(a), STRIP):
                        s = a[at : at + STRIP] @ b.T
                        upper = np.exp(-np.logaddexp(0, -(slope * s + offset))) if slope is not None else np.zeros_like(s)
                        for k, g in enumerate((1 - upper, upper)):
                            got[3 * k : 3 * k + 3] += g.sum(), (g * s).sum(), (g * s * s).sum()
                    yield pa.RecordBatch.from_arrays([batch.column("rec").slice(i, 1), *(pa.array([x * (2 if weight else 1)]) for x in got)], ["rec", *(f"m{k}" for k in range(6))])

        part = tiles.join(lines, "rec").select("rec", "twice", "dim", "a", "b", "slope", "offset").mapInArrow(run, f"rec {kind}, " + ", ".join(f"m{k} double" for k in range(6)))
        return part.groupBy("rec").agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(6)))

    flat = F.lit(None).cast("double")
    first = sums(tiles.select("rec").distinct().select("rec", flat.alias("slope"), flat.alias("offset")))
    mean, var = F.col("m1") / F.col("m0"), F.col("m2") / F.col("m0") - (F.col("m1") / F.col("m0")) ** 2
    first = first.select("rec", mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"))
    moves = F.col("var") > K.TINY * F.col("mean") ** 2
    lines = tables.save(first.select("rec", "mean", F.when(moves, 2 / F.sqrt("var")).alias("slope"), F.when(moves, -2 * F.col("mean") / F.sqrt("var")).alias("offset")), "lines-0")
    for turn in range(rounds):
        got = sums(lines.where("slope is not null"))
        low, high = F.col("m1") / F.col("m0"), F.col("m4") / F.col("m3")
        total = F.col("m0") + F.col("m3")
        spread = (F.col("m2") + F.col("m5")) / total - (F.col("m0") * low * low + F.col("m3") * high * high) / total
        fine = (F.col("m0") > 0) & (F.col("m3") > 0)
        step = got.withColumns({"low": F.when(fine, low), "high": F.when(fine, high), "spread": F.when(fine, spread)})
        fine = (F.col("spread") > K.TINY * (F.col("low") ** 2 + F.col("high") ** 2)) & (F.col("high") != F.col("low"))
        slope = (F.col("high") - F.col("low")) / F.col("spread")
        step = step.select("rec", F.when(fine, slope).alias("slope2"), F.when(fine, F.log(F.col("m3") / F.col("m0")) - slope * (F.col("low") + F.col("high")) / 2).alias("offset2"))
        lines = tables.save(lines.join(step, "rec", "left").select("rec", "mean", F.coalesce("slope2", "slope").alias("slope"), F.coalesce("offset2", "offset").alias("offset")), f"lines-{turn + 1}")
        tables.drop(f"lines-{turn}")
    return lines.select("rec", F.coalesce(-F.col("offset") / F.col("slope"), F.col("mean")).alias("threshold"))


def numbered(tables: Tables, df: DataFrame, rec: str, order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place in its recording by ``order``, from 0, numbered by ranges: no recording is one sort."""
    cut = tables.save(df.repartitionByRange(rec, order).withColumn("range_", F.spark_partition_id()), f"ranges-{name}")
    span = Window.partitionBy(rec).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(rec, "range_").agg(F.count(F.lit(1)).alias("m_")).select(rec, "range_", F.coalesce(F.sum("m_").over(span), F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy(rec, "range_").orderBy(order)) - 1
    return cut.join(before, [rec, "range_"]).withColumn(name, F.col("before_") + inside).drop("range_", "before_")

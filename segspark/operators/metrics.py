"""Segmentation quality: interval error rate, and frame-based Jaccard, B-cubed, tau and entropy scores.

All of them start from one sweep over a recording's boundaries in order of time, which adds up how long
(or for how many frames) each combination of reference and system speakers is active.  The state of the
sweep is who speaks now, so neither segments nor frames are expanded, and what leaves it is a row per
combination; the metrics are small aggregations of these rows.  A recording is swept by ranges of time, each
of which is told who is open where it begins.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.scratch import Tables

from .kernels import assignment

#: Collar in seconds and whether overlapped reference speech is left out.
PROTOCOLS = {"forgiving": (0.25, True), "fair": (0.25, False), "full": (0.0, False)}
#: Segments from which on a recording is swept by ranges, and how many.
LONG, RANGES = 1 << 16, 64
#: Side of a row that only says where the next range begins.
END = 9


def boundaries(ref: DataFrame, hyp: DataFrame, collar: float | int) -> DataFrame:
    """``rec, t, side, spk, by``: by how much a speaker's open segments (side 2: collars) change at a time."""
    cols = ["rec", "start", "end", "spk"]
    sides = [x.select(*cols, F.lit(k).alias("side")) for k, x in enumerate((ref, hyp))]
    edges = [x.where("end > start").select("rec", "side", "spk", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("by")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("by")))).alias("e")) for x in sides]
    if collar:
        near = sides[0].select("rec", F.lit(2).alias("side"), "spk", F.explode(F.array("start", "end")).alias("b")).select("rec", "side", F.lit(None).cast(dict(ref.dtypes)["spk"]).alias("spk"), F.explode(F.array(F.struct((F.col("b") - collar).alias("t"), F.lit(1).alias("by")), F.struct((F.col("b") + collar).alias("t"), F.lit(-1).alias("by")))).alias("e"))
        edges.append(near)
    rows = edges[0].unionByName(edges[1])
    for more in edges[2:]:
        rows = rows.unionByName(more)
    return rows.groupBy("rec", F.col("e.t").alias("t"), "side", "spk").agg(F.sum("e.by").cast("int").alias("by"))


def carried(rows: DataFrame) -> DataFrame:
    """What ranges of ``rows (rec, range, t, side, spk, by)`` need from the others of their recording, as rows.

    Rows without time open what is open where the range begins; a row of side ``END`` has the time at which
    the next range begins.  Only recordings in more than one range have any, and of these only net changes by
    range and speaker come together.
    """
    kind = dict(rows.dtypes)
    own = Window.partitionBy("rec")
    spans = rows.groupBy("rec", "range").agg(F.min("t").alias("t")).withColumn("n", F.count(F.lit(1)).over(own)).where("n > 1")
    stops = spans.withColumn("t", F.lead("t").over(own.orderBy("range"))).where("t is not null")
    stops = stops.select("rec", "range", "t", F.lit(END).alias("side"), F.lit(None).cast(kind["spk"]).alias("spk"), F.lit(0).alias("by"))
    net = rows.groupBy("rec", "range", "side", "spk").agg(F.sum("by").cast("int").alias("by")).join(spans.select("rec", "range"), ["rec", "range"])

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, out = Counter(), []
        for at, of in pdf.sort_values("range").groupby("range", sort=False):
            out += [(pdf.rec.iloc[0], at, side, spk, n) for (side, spk), n in counts.items() if n]
            for side, spk, by in zip(of.side.tolist(), of.spk, of.by.tolist(), strict=True):
                counts[side, spk] += by
        return pd.DataFrame(out, columns=["rec", "range", "side", "spk", "by"])

    opens = net.groupBy("rec").applyInPandas(opened, f"rec {kind['rec']}, range int, side int, spk {kind['spk']}, by int")
    return stops.unionByName(opens.withColumn("t", F.lit(None).cast(kind["t"])))


def combinations(ref: DataFrame, hyp: DataFrame, collar: float | int = 0, step: float | int | None = None, ranges: int = RANGES, long: int = LONG) -> DataFrame:
    """``rec, refs, hyps, d``: time in which exactly these speakers are active, outside all collars.

    Boundaries of equal time are added first.  A recording of more than ``long`` segments is cut into up to
    ``ranges`` ranges of time by quantiles of its boundaries: each is a task that begins with the speakers that are
    open by then.  Segments without length count for nothing but their
    collar.  With ``step``, ``d`` is the number of frames whose middle lies in that time, from frame 0 to the
    last one in which anybody speaks.  The result is a written table, so that the sweep runs once however
    often it is used.
    """
    tables = Tables(ref.sparkSession, "combinations")
    rows = boundaries(ref, hyp, collar)
    sizes = ref.select("rec").unionByName(hyp.select("rec")).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    parted = (sizes.agg(F.max("n")).first()[0] or 0) > long
    if parted:
        cuts = rows.join(sizes.where(F.col("n") > long).select("rec"), "rec", "left_semi").groupBy("rec").agg(F.percentile_approx("t", [k / ranges for k in range(1, ranges)]).alias("cuts"))
        rows = rows.join(cuts, "rec", "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("t"))), F.lit(0))).drop("cuts")
        rows = tables.save(rows.withColumn("range", F.greatest("range", F.lit(0))), "ranges")
    else:
        rows = rows.withColumn("range", F.lit(0))
    kind = dict(rows.dtypes)
    value = "bigint" if step is not None else kind["t"]

    def frame(t) -> int:
        return max(math.ceil((t - step / 2) / step), 0)

    def sweep(batches):
        key, last, near, top = None, None, 0, 0
        counts, active, found = (Counter(), Counter()), [(), ()], Counter()

        def close():
            got = [(key[0], list(a), list(b), n, top) for (a, b), n in found.items()]
            found.clear()
            return pd.DataFrame(got, columns=["rec", "refs", "hyps", "d", "top"])

        for pdf in batches:
            for rec, at, void, t, side, spk, by in zip(pdf.rec, pdf.range.tolist(), pdf.void.tolist(), pdf.t.tolist(), pdf.side.tolist(), pdf.spk, pdf.by.tolist(), strict=True):
                if key is None or (rec, at) != key:
                    if found:
                        yield close()
                    key, last, near, top = (rec, at), None, 0, 0
                    counts, active = (Counter(), Counter()), [(), ()]
                if not void and t != last:
                    if last is not None:
                        here = (active[0], active[1])
                        if step is None:
                            if not near:
                                found[here] += t - last
                        elif here != ((), ()):
                            size = frame(t) - frame(last)
                            if size:
                                found[here] += size
                                top = frame(t)
                    last = t
                if side == 2:
                    near += by
                elif side != END:
                    before = counts[side][spk]
                    counts[side][spk] = before + by
                    if (before > 0) != (before + by > 0):
                        active[side] = tuple(sorted(k for k, n in counts[side].items() if n > 0))
        if found:
            yield close()

    # a missing time is told by a flag: whole numbers would become fractions in pandas
    void = F.col("t").isNull()
    rows = (rows.unionByName(carried(rows)) if parted else rows).withColumns({"void": void, "t": F.coalesce("t", F.lit(0).cast(kind["t"]))})
    ordered = rows.repartition("rec", "range").sortWithinPartitions("rec", "range", F.desc("void"), "t", "side").select("rec", "range", "void", "t", "side", "spk", "by")
    got = ordered.mapInPandas(sweep, f"rec {kind['rec']}, refs array<{kind['spk']}>, hyps array<{kind['spk']}>, d {value}, top bigint")
    got = got.groupBy("rec", "refs", "hyps").agg(F.sum("d").cast(value).alias("d"), F.max("top").alias("top")).where("d > 0")
    got = tables.save(got, "cells")
    if step is None:
        return got.drop("top")
    none = F.array().cast(f"array<{kind['spk']}>")
    silence = got.groupBy("rec").agg((F.max("top") - F.sum("d")).alias("d")).where("d > 0").select("rec", none.alias("refs"), none.alias("hyps"), "d")
    return got.drop("top").unionByName(silence)


def speaker_map(overlap: DataFrame, least: bool = False, value: str = "w") -> DataFrame:
    """``rec, ref, hyp``: one-to-one map of greatest (``least``: smallest) total ``value`` per recording.

    ``overlap`` has a row per recording and speaker pair, so a group is speakers times speakers.
    """
    kind = dict(overlap.dtypes)

    def solved(rec, rows):
        refs, hyps = ({k: i for i, k in enumerate(sorted({r[c] for r in rows}))} for c in (0, 1))
        c = np.full((len(refs), len(hyps)), 1.0 if least else 0.0)
        for ref, hyp, w in rows:
            c[refs[ref], hyps[hyp]] = w
        pairs = zip(*assignment(c if least else -c), strict=True)
        names = list(refs), list(hyps)
        return [(rec, names[0][i], names[1][j]) for i, j in pairs]

    def solve(batches):
        rec, held = None, []
        for pdf in batches:
            out = []
            for own, *row in zip(pdf.rec, pdf.ref, pdf.hyp, pdf[value].tolist(), strict=True):
                if held and own != rec:
                    out += solved(rec, held)
                    held = []
                rec = own
                held.append(row)
            yield pd.DataFrame(out, columns=["rec", "ref", "hyp"])
        if held:
            yield pd.DataFrame(solved(rec, held), columns=["rec", "ref", "hyp"])

    ordered = overlap.select("rec", "ref", "hyp", value).repartition("rec").sortWithinPartitions("rec")
    return ordered.mapInPandas(solve, f"rec {kind['rec']}, ref {kind['ref']}, hyp {kind['hyp']}")


def interval_error(ref: DataFrame, hyp: DataFrame, collar: float | int = 0.25, skip_overlap: bool = False) -> DataFrame:
    """``rec, scored, miss, false_alarm, confusion, error`` from ``rec, start, end, spk`` of both sides.

    Time within ``collar`` of a reference boundary is not scored, nor, with ``skip_overlap``, time with two
    reference speakers.  Times may be integers (exact) or seconds.  A recording without scored speech has
    a null error.
    """
    cells = combinations(ref, hyp, collar)
    if skip_overlap:
        cells = cells.where(F.size("refs") < 2)
    both = cells.select("rec", F.explode("refs").alias("ref"), "hyps", "d").select("rec", "ref", F.explode("hyps").alias("hyp"), "d")
    links = speaker_map(both.groupBy("rec", "ref", "hyp").agg(F.sum("d").cast("double").alias("w")))
    links = links.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("ref", "hyp"))).alias("links"))  # a pair a speaker
    right = F.size(F.filter("refs", lambda r: F.coalesce(F.array_contains("hyps", F.element_at("links", r)), F.lit(False))))
    rows = cells.join(links, "rec", "left").select("rec", "d", F.size("refs").alias("nr"), F.size("hyps").alias("nh"), F.when(F.col("links").isNull(), 0).otherwise(right).alias("n_right"))
    d, nr, nh = F.col("d"), F.col("nr"), F.col("nh")
    out = rows.groupBy("rec").agg(
        F.sum(d * nr).alias("scored"),
        F.sum(d * F.greatest(nr - nh, F.lit(0))).alias("miss"),
        F.sum(d * F.greatest(nh - nr, F.lit(0))).alias("false_alarm"),
        F.sum(d * (F.least(nr, nh) - F.col("n_right"))).alias("confusion"),
    )
    return out.withColumn("error", F.try_divide((F.col("miss") + F.col("false_alarm") + F.col("confusion")).cast("double"), F.col("scored").cast("double")))


def jaccard_error(ref: DataFrame, hyp: DataFrame, step: float | int = 0.01) -> DataFrame:
    """``rec, jer``: mean over reference speakers of one less the Jaccard index under the best map."""
    cells = combinations(ref, hyp, step=step)
    r = cells.select("rec", F.explode("refs").alias("ref"), "hyps", "d")
    nr = r.groupBy("rec", "ref").agg(F.sum("d").alias("nr"))
    nh = cells.select("rec", F.explode("hyps").alias("hyp"), "d").groupBy("rec", "hyp").agg(F.sum("d").alias("nh"))
    o = r.select("rec", "ref", F.explode("hyps").alias("hyp"), "d").groupBy("rec", "ref", "hyp").agg(F.sum("d").alias("o"))
    cost = o.join(nr, ["rec", "ref"]).join(nh, ["rec", "hyp"]).withColumn("w", 1 - F.col("o") / (F.col("nr") + F.col("nh") - F.col("o")))
    best = speaker_map(cost.select("rec", "ref", "hyp", "w"), least=True).join(cost.select("rec", "ref", "hyp", "w"), ["rec", "ref", "hyp"])
    return nr.join(best, ["rec", "ref"], "left").groupBy("rec").agg(F.avg(F.coalesce("w", F.lit(1.0))).alias("jer"))


def contingency(ref: DataFrame, hyp: DataFrame, step: float | int = 0.01) -> DataFrame:
    """``rec, a, b, p``: shares of frames by reference class and system class, a class being an array of speakers in order.

    Frames run from 0 to the last one in which anybody speaks.
    """
    cells = combinations(ref, hyp, step=step)
    rows = cells.select("rec", F.col("refs").alias("a"), F.col("hyps").alias("b"), F.col("d").alias("n"))
    return rows.select("rec", "a", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("rec"))).alias("p"))


def _margins(table: DataFrame) -> DataFrame:
    return table.withColumn("pa", F.sum("p").over(Window.partitionBy("rec", "a"))).withColumn("pb", F.sum("p").over(Window.partitionBy("rec", "b")))


def b_cubed(table: DataFrame) -> DataFrame:
    """``rec, precision, recall, f1`` from ``contingency``."""
    p = F.col("p")
    got = _margins(table).groupBy("rec").agg(F.sum(p * p / F.col("pb")).alias("precision"), F.sum(p * p / F.col("pa")).alias("recall"))
    return got.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def tau(table: DataFrame) -> DataFrame:
    """``rec, tau_ref_sys, tau_sys_ref``: Goodman-Kruskal tau both ways; null for a single class."""
    p = F.col("p")
    m = _margins(table)
    got = m.groupBy("rec").agg(F.sum(p * p / F.col("pa")).alias("by_ref"), F.sum(p * p / F.col("pb")).alias("by_sys"), F.sum(p * F.col("pa")).alias("sq_ref"), F.sum(p * F.col("pb")).alias("sq_sys"))
    return got.select("rec", F.try_divide(F.col("by_ref") - F.col("sq_sys"), 1 - F.col("sq_sys")).alias("tau_ref_sys"), F.try_divide(F.col("by_sys") - F.col("sq_ref"), 1 - F.col("sq_ref")).alias("tau_sys_ref"))


def entropies(table: DataFrame) -> DataFrame:
    """``rec, h_ref_sys, h_sys_ref, mi, nmi`` in bits."""
    p = F.col("p")
    got = _margins(table).groupBy("rec").agg(
        F.sum(-p * F.log2(p / F.col("pb"))).alias("h_ref_sys"),
        F.sum(-p * F.log2(p / F.col("pa"))).alias("h_sys_ref"),
        F.sum(p * F.log2(p / (F.col("pa") * F.col("pb")))).alias("mi"),
        F.sum(-p * F.log2("pa")).alias("h_ref"),
        F.sum(-p * F.log2("pb")).alias("h_sys"),
    )
    return got.select("rec", "h_ref_sys", "h_sys_ref", "mi", F.try_divide(F.col("mi"), F.sqrt(F.col("h_ref") * F.col("h_sys"))).alias("nmi"))


def score(ref: DataFrame, hyp: DataFrame, protocol: str = "forgiving") -> DataFrame:
    """Interval error of the recordings that have a reference, under a named protocol."""
    collar, skip = PROTOCOLS[protocol]
    return interval_error(ref, hyp.join(ref.select("rec").distinct(), "rec", "left_semi"), collar, skip)



"""Interval operators on labelled time segments.

A segment table has a recording column, ordering columns, ``start``, ``end`` and ``label``.  Order is
part of the data: every operator names the columns that give it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.scratch import Tables

#: Absolute and relative tolerance with which two times count as equal.
ABS_TOL, REL_TOL = 1e-8, 1e-5


def close_seconds(a: Column, b: Column) -> Column:
    """``|a - b| <= ABS_TOL + REL_TOL * |b|`` in seconds; the tolerance grows with ``b``."""
    return F.abs(a - b) <= F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(b)


def close_micros(a: Column, b: Column) -> Column:
    """The same test, exact, on integer microseconds (``ABS_TOL`` seconds is a hundredth of one)."""
    return F.abs(a - b) * 100000 <= F.abs(b) + 1000


#: Rows of a recording from which on its order is worked on by ranges.
LONG = 1 << 20


def longest(df: DataFrame, rec: str) -> int:
    """Rows of the longest recording."""
    return df.groupBy(rec).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def spare(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Ordered:
    """Rows in order within a recording, for looks at neighbours and running sums.

    ``part`` is None where a recording is one window; else it names the column of ranges, in order, that a long
    recording was dealt in: looks and sums are taken within a range, and what comes from the ranges before and
    behind is carried in, a row a range.
    """

    rows: DataFrame
    rec: str
    order: tuple[str, ...]
    part: str | None = None

    @staticmethod
    def of(df: DataFrame, rec: str, order: list[str], long: int, tag: str) -> Ordered:
        if longest(df, rec) <= long:
            return Ordered(df, rec, tuple(order))
        (part,) = spare(df, "range")
        cut = df.repartitionByRange(rec, *order).withColumn(part, F.spark_partition_id())
        return Ordered(Tables(df.sparkSession, tag).save(cut, "ranges"), rec, tuple(order), part)

    @property
    def window(self):
        return Window.partitionBy(self.rec, *([self.part] if self.part else [])).orderBy(*self.order)

    def across(self, value: Column) -> DataFrame:
        """``rec, range, value`` of the ranges, and the window over them in order."""
        return self.rows.groupBy(self.rec, self.part).agg(value.alias("value")), Window.partitionBy(self.rec).orderBy(self.part)

    def told(self, rows: DataFrame, ranges: DataFrame) -> DataFrame:
        """Rows with what their range is told; a null recording is one like others."""
        far = ranges.withColumnsRenamed({self.rec: "rec_far", self.part: "part_far"})
        return rows.join(far, F.col(self.rec).eqNullSafe(F.col("rec_far")) & (F.col(self.part) == F.col("part_far"))).drop("rec_far", "part_far")

    def with_neighbour(self, name: str, value: Column, behind: bool = False) -> Ordered:
        """Adds ``value`` of the row ahead, or behind; null where there is none, so give a struct to tell that from a null."""
        look = F.lead if behind else F.lag
        near = look(value).over(self.window)
        if not self.part:
            return replace(self, rows=self.rows.withColumn(name, near))
        at = F.struct(*self.order)
        ends, ranges = self.across((F.min_by if behind else F.max_by)(value, at))
        ends = ends.withColumn("value", look("value").over(ranges)).withColumnRenamed("value", name + "_far")
        rows = self.told(self.rows.withColumn(name, near), ends)
        return replace(self, rows=rows.withColumn(name, F.coalesce(name, name + "_far")).drop(name + "_far"))

    def with_running(self, name: str, value: Column) -> Ordered:
        """Adds the sum of ``value`` up to and with each row."""
        own = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.part:
            return replace(self, rows=self.rows.withColumn(name, own))
        sums, ranges = self.across(F.sum(value))
        sums = sums.withColumn(name + "_far", F.coalesce(F.sum("value").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("value")
        rows = self.told(self.rows.withColumn(name, own), sums)
        return replace(self, rows=rows.withColumn(name, F.col(name) + F.col(name + "_far")).drop(name + "_far"))


def merge_adjacent(df: DataFrame, rec: str = "rec", order: list[str] | None = None, label: str = "label", close: Callable[[Column, Column], Column] = close_seconds, doubled: bool = False, long: int = LONG) -> DataFrame:
    """Merges neighbouring or overlapping segments of one label and splits other overlaps at their middle.

    Returns ``rec, run, start, end, label``.  A run goes from its first row's start to its *last* row's
    end; where a run starts before the one ahead of it ends, both get the middle, computed from the
    values before any such change.  Gaps stay.  With ``doubled`` all times are multiplied by two, which
    keeps integer times exact.  One sort per recording serves both window passes; recordings of more than
    ``long`` rows are sorted by ranges.
    """
    order = order or ["start"]
    ahead, opens, run = spare(df, "ahead", "opens", "run")
    rows = Ordered.of(df, rec, order, long, "merge").with_neighbour(ahead, F.struct(F.col("end").alias("end"), F.col(label).alias("label")))
    before = F.col(ahead)
    touch = close(before["end"], F.col("start")) | (before["end"] > F.col("start"))
    goes_on = touch & before["label"].eqNullSafe(F.col(label))
    rows = replace(rows, rows=rows.rows.withColumn(opens, F.coalesce(before.isNull() | ~goes_on, F.lit(True)).cast("int"))).with_running(run, F.col(opens))
    at = F.struct(*order)
    runs = rows.rows.groupBy(rec, (F.col(run) - 1).alias("run")).agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.min_by(label, at).alias(label))
    runs = (Ordered.of(runs, rec, ["run"], long, "runs") if rows.part else Ordered(runs, rec, ("run",))).with_neighbour("before", F.col("end")).with_neighbour("after", F.col("start"), behind=True).rows
    before, after = F.col("before"), F.col("after")
    over, under = F.col("start") < before, after < F.col("end")
    if doubled:  # integers stay integers
        start, end, kind = F.when(over, before + F.col("start")).otherwise(F.col("start") * 2), F.when(under, F.col("end") + after).otherwise(F.col("end") * 2), "bigint"
    else:
        start, end, kind = F.when(over, (before + F.col("start")) / 2).otherwise(F.col("start")), F.when(under, (F.col("end") + after) / 2).otherwise(F.col("end")), "double"
    return runs.select(rec, "run", start.cast(kind).alias("start"), end.cast(kind).alias("end"), label)


def last_run_of_each(df: DataFrame, order: list[str], rec: str = "rec", long: int = LONG) -> DataFrame:
    """Rows grouped by consecutive equal ``rec`` in file order; where one comes again its last run stays.

    Runs of one recording are told apart without ordering the whole file in one task: rows of a
    recording are in one run while nothing lies between them, that is while file position less rank
    within the recording stays the same.  Recordings of more than ``long`` rows are ranked by ranges.
    """
    rank, last = spare(df, "rank", "last")
    rows = Ordered.of(df, rec, order, long, "runs").with_running(rank, F.lit(1))
    keyed = rows.rows.withColumn(rank, F.col(order[0]) - F.col(rank))
    if not rows.part:
        keyed = keyed.withColumn(last, F.max(rank).over(Window.partitionBy(rec)))
        return keyed.where(F.col(rank) == F.col(last)).select(*df.columns)
    tops = keyed.groupBy(F.col(rec).alias(last + "_rec")).agg(F.max(rank).alias(last))
    kept = keyed.join(tops, F.col(rec).eqNullSafe(F.col(last + "_rec")) & (F.col(rank) == F.col(last)), "left_semi")
    return kept.select(*df.columns)


def frame_labels(df: DataFrame, rec: str = "rec", label: str = "label", length: int = 0, rate: float = 100.0) -> DataFrame:
    """``rec, frame, label``: one row per frame, null where no segment is.

    Frame bounds are times times ``rate``, halves to even.  ``length`` 0: up to the last segment's end;
    positive: exactly that long; negative: at least that long.  Segments must not overlap.
    """
    lo, hi = F.rint(F.col("start") * rate).cast("bigint"), F.rint(F.col("end") * rate).cast("bigint")
    seg = df.select(rec, lo.alias("lo"), hi.alias("hi"), label)
    ends = seg.groupBy(rec).agg(F.max("hi").alias("stop"))
    stop = F.lit(length) if length > 0 else F.greatest("stop", F.lit(-length))
    spine = ends.select(rec, stop.cast("bigint").alias("stop")).where("stop > 0").select(rec, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stop") - 1)).alias("frame"))
    filled = seg.where("hi > lo").select(rec, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("frame"), label)
    return spine.join(filled, [rec, "frame"], "left")


def embedding_windows(vad: DataFrame, rec: str = "rec", segnum: str = "segnum", start: str = "start", end: str = "end", rate: int | str = 16000, size: int = 144, jump: int = 24) -> DataFrame:
    """Sliding windows of ``size`` frames every ``jump`` over voice segments, and each segment's tail.

    Returns ``rec, segnum, first, last, key, start, end``; frames are 10 ms, times in seconds to
    three decimals.  Segments of at most 10 ms are skipped; a tail needs ten frames.  ``rate`` is a number
    or, where recordings differ, a column of ``vad``.
    """
    if rate not in (8000, 16000) and not isinstance(rate, str):
        raise ValueError(f"sampling rate must be 8000 or 16000, not {rate}")
    hertz = F.col(rate).cast("bigint") if isinstance(rate, str) else F.lit(rate).cast("bigint")
    seg = vad.select(F.col(rec).alias("rec"), F.col(segnum).alias("segnum"), F.col(start).alias("from"), F.col(end).alias("to"), hertz.alias("rate"))
    s, e = ((F.col(c) * F.col("rate")).cast("bigint") for c in ("from", "to"))
    seg = seg.select("rec", "segnum", "rate", s.alias("s"), e.alias("e")).withColumn("n", F.col("e") - F.col("s"))
    seg = seg.where(F.col("n") > 0.01 * F.col("rate"))
    frames = F.expr("floor((n + (rate * 3 div 200) div 2 + (rate div 40) div 2 - rate div 40) / (rate div 40 - rate * 3 div 200)) + 1")
    seg = seg.withColumn("frames", frames.cast("bigint"))
    full = F.when(F.col("frames") > size, F.ceil((F.col("frames") - size) / jump)).otherwise(0).cast("bigint")
    seg = seg.withColumn("full", full)
    # windows 0 .. full - 1 have full size; window `full` is the tail
    w = seg.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
    w = w.withColumn("first", F.col("k") * jump).withColumn("tail", F.col("k") == F.col("full"))
    w = w.withColumn("last", F.when(F.col("tail"), F.col("frames")).otherwise(F.col("first") + size))
    w = w.where(~F.col("tail") | (F.col("last") - F.col("first") >= 10))
    # whole milliseconds in integers, halves up; a frame is ten of them
    millis = lambda samples: F.expr(f"({samples} * 1000 + rate div 2) div rate")
    began = (millis("s") + F.col("first") * 10) / 1000.0
    ended = F.when(F.col("tail"), millis("e") / 1000.0).otherwise((millis("s") + (F.col("first") + size) * 10) / 1000.0)
    key = F.format_string("%s_%04d-%08d-%08d", F.col("rec").cast("string"), "segnum", "first", "last")
    return w.select("rec", "segnum", "first", "last", key.alias("key"), began.alias("start"), ended.alias("end"))


def recording_of(key: Column) -> Column:
    """The part of a window key before its last underscore."""
    return F.regexp_extract(key, r"^(.*)_[^_]*$", 1)


def labels_with_times(labels: DataFrame, timings: DataFrame, rec: str = "rec", key: str = "key") -> DataFrame:
    """Equi-join of labels and times on recording and key; a label without a time raises."""
    joined = labels.join(timings, [rec, key], "left")
    return joined.withColumn("start", F.when(F.col("start").isNotNull(), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("no time for "), F.col(key))).cast("double")))


def second_labels(df: DataFrame, second: str = "second", **kw) -> DataFrame:
    """``merge_adjacent`` of each segment's second-best label."""
    return merge_adjacent(df.drop("label").withColumnRenamed(second, "label"), **kw)

"""Order within a recording by ranges: equal to one window, whatever hangs over from range to range."""

import random

import pytest
from pyspark.sql import functions as F

from segspark.operators import segments as S

from .test_segments import merge_slow

SCHEMA = "rec string, idx int, start double, end double, label string, ahead string, opens int, run int, rank int"


def rows_of(seed):
    r = random.Random(seed)
    out = []
    for rec, n in (("hot", 300), ("b", 9), ("c", 1)):
        raw = sorted((float(r.randrange(2 * n)), r.randrange(1, 6), r.choice("ab")) for _ in range(n))
        if rec == "hot":  # a run that goes over many ranges
            raw = sorted([*raw, *((600.0 + k, 1, "a") for k in range(120))])
        out += [(rec, i, s, s + d, x, "x", 1, 2, 3) for i, (s, d, x) in enumerate(raw)]
    return out


@pytest.mark.parametrize("long", [1 << 20, 20, 0])
def test_merge_by_ranges(spark, long):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = S.merge_adjacent(df, order=["idx"], long=long).collect()
    for rec in ("hot", "b", "c"):
        own = sorted((q for q in got if q.rec == rec), key=lambda q: q.run)
        assert [q.run for q in own] == list(range(len(own)))
        assert [[q.start, q.end, q.label] for q in own] == merge_slow([r[2:5] for r in rows if r[0] == rec])


@pytest.mark.parametrize("long", [1 << 20, 0])
def test_last_run_by_ranges(spark, long):
    r = random.Random(4)
    file, at = [], 0
    while len(file) < 400:
        rec = r.choice(["hot", "hot", "b", None])
        n = r.randrange(1, 9)
        file += [(rec, i) for i in range(at, at + n)]
        at += n
    want = []
    for rec in {x for x, _ in file}:
        own = [i for x, i in file if x == rec]
        want += [(str(rec), i) for k, i in enumerate(own) if own[k:] == list(range(i, own[-1] + 1))]
    df = spark.createDataFrame([(*x, 7) for x in file], "rec string, idx int, rank int").repartition(4)
    got = S.last_run_of_each(df, ["idx"], long=long)
    assert got.columns == ["rec", "idx", "rank"] and sorted((str(q.rec), q.idx) for q in got.collect()) == sorted(want)


def test_null_labels_and_ends(spark):
    """A null label is a label; a row whose time is null opens a run."""
    rows = [("r", 0, 0.0, 1.0, None), ("r", 1, 1.0, 2.0, None), ("r", 2, 2.0, None, None), ("r", 3, 2.5, 3.0, None)]
    df = spark.createDataFrame(rows, "rec string, idx int, start double, end double, label string")
    for long in (1 << 20, 0):
        assert [(q.run, q.start, q.label) for q in S.merge_adjacent(df, order=["idx"], long=long).orderBy("run").collect()] == [(0, 0.0, None), (1, 2.5, None)]
    assert S.merge_adjacent(df.where("idx < 0")).count() == 0
    assert df.select(F.lit(1)).count() == 4

"""The sweep by ranges of time against a walk over all elementary intervals."""

import math
import random
from collections import Counter

import pytest

from segspark.operators import metrics as E

SCHEMA = "rec string, start long, end long, spk string"


def crowd(seed, recs=("x", "y", "z"), span=400):
    r = random.Random(seed)
    rows = [(rec, s, s + r.randrange(0, 40), r.choice("abc")) for rec in recs for s in sorted(r.randrange(span) for _ in range(60 if rec == "x" else 7))]
    return [*rows, ("x", 0, span, "d"), ("x", 5, 5, "a")]  # one speaker open throughout, one segment without length


def by_hand(ref, hyp, collar, step):
    out = Counter()
    for rec in {r[0] for r in ref + hyp}:
        own = [[r for r in rows if r[0] == rec] for rows in (ref, hyp)]
        near = [(b - collar, b + collar) for _, s, e, _ in own[0] for b in (s, e)] if collar else []
        ts = sorted({t for rows in own for _, s, e, _ in rows if e > s for t in (s, e)} | {t for pair in near for t in pair})
        active = lambda rows, t: tuple(sorted({k for _, s, e, k in rows if s <= t < e}))
        if step is None:
            for t, u in zip(ts, ts[1:]):
                if not any(a <= t and u <= b for a, b in near):
                    out[rec, active(own[0], t), active(own[1], t)] += u - t
        else:
            frames = [(active(own[0], f * step + step // 2), active(own[1], f * step + step // 2)) for f in range(math.ceil(max(ts) / step) + 1)]
            while frames and frames[-1] == ((), ()):
                frames.pop()
            for f in frames:
                out[rec, *f] += 1
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("ranges", [2, 5, 40])
@pytest.mark.parametrize("collar,step", [(0, None), (3, None), (0, 4)])
def test_ranges(spark, ranges, collar, step):
    ref, hyp = crowd(1), [(rec, s + 2, e + 2, f"h{k}") for rec, s, e, k in crowd(2)]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = E.combinations(df(ref), df(hyp), collar, step, ranges, long=0 if ranges > 2 else 30)
    assert {(r.rec, tuple(r.refs), tuple(r.hyps)): r.d for r in got.collect()} == by_hand(ref, hyp, collar, step)


def test_one_sweep(spark):
    """Every metric reads the swept table, so its plan names no boundary."""
    ref, hyp = (spark.createDataFrame(crowd(k), SCHEMA) for k in (1, 2))
    for df in (E.interval_error(ref, hyp, 3), E.jaccard_error(ref, hyp, 4), E.b_cubed(E.contingency(ref, hyp, 4))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "side" not in plan and "void" not in plan


def test_classes_are_sets(spark):
    """Speakers "a" and "b" together are another class than a speaker "a+b"."""
    ref = spark.createDataFrame([("r", 0, 100, "a"), ("r", 0, 100, "b"), ("r", 100, 200, "a+b")], SCHEMA)
    hyp = spark.createDataFrame([("r", 0, 100, "s"), ("r", 100, 200, "t")], SCHEMA)
    got = E.b_cubed(E.contingency(ref, hyp, 10)).first()
    assert (got.precision, got.recall) == (1.0, 1.0)


def test_seconds_and_nothing(spark):
    kind = "rec string, start double, end double, spk string"
    ref, hyp = spark.createDataFrame([("r", 0.0, 1.5, "a")], kind), spark.createDataFrame([], kind)
    assert {(tuple(r.refs), r.d) for r in E.combinations(ref, hyp, ranges=3, long=0).collect()} == {(("a",), 1.5)}
    assert E.combinations(hyp, hyp).count() == 0 and E.combinations(hyp, hyp, step=0.01).count() == 0

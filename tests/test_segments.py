"""Interval operators: golden rows, properties and brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segspark.operators import metrics as E
from segspark.operators import segments as S
from segspark.sources import text as X


def merge_slow(rows):
    """Row by row, on lists of ``[start, end, label]``."""
    out = []
    for i, (s, e, x) in enumerate(rows):
        if i:
            pe, px = rows[i - 1][1], rows[i - 1][2]
            if px == x and (pe > s or abs(pe - s) <= 1e-8 + 1e-5 * abs(s)):
                out[-1][1] = e
                continue
        out.append([s, e, x])
    was = [list(r) for r in out]
    for k in range(len(out) - 1):
        if was[k + 1][0] < was[k][1]:
            out[k][1] = out[k + 1][0] = (was[k][1] + was[k + 1][0]) / 2
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12), st.sampled_from("ab")), min_size=1, max_size=25))
def test_merge_adjacent(spark, raw):
    rows = [(float(s), float(s + d), x) for s, d, x in sorted(raw)]
    df = spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "rec string, idx int, start double, end double, label string")
    got = S.merge_adjacent(df, order=["idx"]).orderBy("run").collect()
    assert [[r.start, r.end, r.label] for r in got] == merge_slow(rows)


def test_merge_is_idempotent(spark):
    """Rows without overlaps or mergeable neighbours stay as they are; a real gap keeps equal labels apart."""
    rows = [("r", 0, 0.0, 7.56, 1), ("r", 1, 7.56, 13.56, 9), ("r", 2, 13.56, 20.28, 1), ("r", 3, 20.28, 21.96, 7), ("r", 4, 21.96, 25.15, 1), ("r", 5, 25.52, 34.49, 1)]
    df = spark.createDataFrame(rows, "rec string, idx int, start double, end double, label int")
    once = S.merge_adjacent(df, order=["idx"])
    assert [(r.start, r.end, r.label) for r in once.orderBy("run").collect()] == [r[2:] for r in rows]


def test_windows_golden(spark):
    """Voice segments and windows of a 16 kHz recording, among them tails and single short windows."""
    vad = spark.createDataFrame([("M", 0, 0.0, 25.15), ("M", 1, 25.52, 34.49), ("M", 2, 35.9, 37.45), ("M", 3, 38.0, 38.005), ("M", 4, 40.0, 40.33)], "rec string, segnum int, start double, end double")
    got = {r.key: (r.start, r.end) for r in S.embedding_windows(vad).collect()}
    assert got["M_0000-00000000-00000144"] == (0.0, 1.44)
    assert got["M_0000-00000096-00000240"] == (0.96, 2.4)
    tail = [k for k in got if k.startswith("M_0000") and got[k][1] == 25.15]
    assert len(tail) == 1 and 121 <= int(tail[0][-8:]) - int(tail[0].split("-")[1]) <= 144
    assert got["M_0002-00000024-00000155"] == (36.14, 37.45)
    assert not any(k.startswith("M_0003") for k in got)  # 5 ms
    assert got["M_0004-00000000-00000033"] == (40.0, 40.33)
    with pytest.raises(ValueError):
        S.embedding_windows(vad, rate=44100)


def frames_slow(rows, length, rate):
    out = []
    for s, e, x in rows:
        lo, hi = int(np.rint(s * rate)), int(np.rint(e * rate))
        out += [None] * (lo - len(out)) + [x] * (hi - lo)
    if length:
        out += [None] * (abs(length) - len(out))
    return out[:length] if length > 0 else out


@pytest.mark.parametrize("length", [0, 7, 40, -3, -40])
def test_frame_labels(spark, length):
    rows = [(0.25, 1.0, "a"), (1.0, 1.35, "b"), (2.05, 2.6, "a")]
    df = spark.createDataFrame([("r", *r) for r in rows], "rec string, start double, end double, label string")
    got = [r.label for r in S.frame_labels(df, length=length, rate=10.0).orderBy("frame").collect()]
    assert got == frames_slow(rows, length, 10.0)


def test_last_run_wins(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")], "idx long, rec string")
    got = sorted(tuple(r) for r in S.last_run_of_each(df, ["idx"]).select("rec", "idx").collect())
    assert got == [("a", 3), ("b", 5), ("c", 4)]


def test_missing_time_raises(spark):
    labels = spark.createDataFrame([("r", "k1", 0), ("r", "k2", 1)], "rec string, key string, label int")
    times = spark.createDataFrame([("r", "k1", 0.0, 1.0)], "rec string, key string, start double, end double")
    with pytest.raises(Exception, match="no time for k2"):
        S.labels_with_times(labels, times).collect()


def test_interval_error(spark):
    """Ten seconds of two speakers: one second missed, one false, two confused."""
    ref = spark.createDataFrame([("r", 0.0, 5.0, "a"), ("r", 5.0, 10.0, "b"), ("r", 4.0, 5.0, "b")], "rec string, start double, end double, spk string")
    hyp = spark.createDataFrame([("r", 0.0, 7.0, "x"), ("r", 7.0, 11.0, "y")], "rec string, start double, end double, spk string")
    full = E.interval_error(ref, hyp, 0.0).first()
    assert (full.scored, full.miss, full.false_alarm, full.confusion) == (11.0, 1.0, 1.0, 2.0)
    assert np.isclose(full.error, 4 / 11)
    alone = E.interval_error(ref, hyp, 0.25, True).first()
    assert alone.miss == 0 and np.isclose(alone.scored, 3.5 + 4.5)
    same = E.interval_error(ref, ref, 0.25).first()
    assert same.error == 0


def test_frame_metrics(spark):
    ref = spark.createDataFrame([("r", 0.0, 1.0, "a"), ("r", 1.0, 2.0, "b")], "rec string, start double, end double, spk string")
    hyp = spark.createDataFrame([("r", 0.0, 2.0, "x")], "rec string, start double, end double, spk string")
    t = E.contingency(ref, hyp, 0.01)
    b = E.b_cubed(t).first()
    assert np.isclose(b.precision, 0.5) and np.isclose(b.recall, 1.0)
    e = E.entropies(t).first()
    assert np.isclose(e.h_ref_sys, 1) and np.isclose(e.h_sys_ref, 0) and np.isclose(e.mi, 0)
    assert np.isclose(E.jaccard_error(ref, hyp, 0.01).first().jer, (0.5 + 1) / 2)
    perfect = E.tau(E.contingency(ref, ref, 0.01)).first()
    assert np.isclose(perfect.tau_ref_sys, 1) and np.isclose(perfect.tau_sys_ref, 1)


def test_score_needs_reference(spark):
    ref = spark.createDataFrame([("r", 0.0, 5.0, "a")], "rec string, start double, end double, spk string")
    hyp = spark.createDataFrame([("r", 0.0, 5.0, "x"), ("s", 0.0, 5.0, "x")], "rec string, start double, end double, spk string")
    assert [r.rec for r in E.score(ref, hyp).collect()] == ["r"]


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "a.lab").write_text("0.000 25.150 sp\n25.520 34.490 sp\n")
    (tmp_path / "list.txt").write_text("# recordings\na b\n\nc\n")
    assert sorted(r.rec for r in X.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in X.read_vad(spark, str(tmp_path / "a.lab")).orderBy("segnum").collect()] == [("a", 0, 0.0, 25.15), ("a", 1, 25.52, 34.49)]
    df = spark.createDataFrame([("m", 0.0, 7.56, 0), ("m", 7.56, 13.56, 8)], "rec string, start double, end double, label int")
    X.write_rttm(df, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()]
    assert sorted(lines)[0] == "SPEAKER m 1 0.000000 7.560000 <NA> <NA> 1 <NA> <NA>"
    back = X.read_rttm(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.rec, r.chan, r.start, r.dur, r.spk) for r in back] == [("m", 1, 0.0, 7.56, "1"), ("m", 1, 7.56, 6.0, "9")]
    (tmp_path / "t.seg").write_text("m_0000-00000000-00000144 m 0.0 1.44\n")
    t = X.read_timings(spark, str(tmp_path / "t.seg")).first()
    assert (t.idx, t.rec, t.start, t.end) == (0, "m", 0.0, 1.44)
    line = spark.range(1).select(X.timing_line(F.lit("k"), F.lit("m"), F.lit(0.0), F.lit(1.44)).alias("v")).first().v
    assert line == "k m 0.0 1.44"


def test_part_lists(spark):
    """Two disjoint parts make up the whole."""
    whole, one = spark.range(10), spark.range(4)
    two = whole.exceptAll(one)
    assert one.intersect(two).count() == 0 and one.union(two).exceptAll(whole).count() == 0

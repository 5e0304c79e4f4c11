"""Average linkage and calibration in rounds over blocks against the kernels with a matrix."""

import numpy as np
import pytest

from segspark.operators import kernels as K
from segspark.operators import linkage as L
from segspark.operators import models as M
from segspark.scratch import Tables

SCHEMA = "rec string, idx long, xvec array<double>, c long, n int"


def frame(spark, parts):
    return spark.createDataFrame([(rec, i * 3 - 100, v.tolist(), 1, 2) for rec, x in parts.items() for i, v in enumerate(x)], SCHEMA).repartition(5)


def unit(x):
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-32)


def crowd(r, n, dim=8, centres=9, width=0.35):
    return r.normal(size=(centres, dim))[r.integers(0, centres, n)] + r.normal(size=(n, dim)) * width


def labels(got):
    out = {}
    for row in got.collect():
        out.setdefault(row.rec, {})[row.idx] = row.label
    return {rec: [x for _, x in sorted(of.items())] for rec, of in out.items()}


@pytest.mark.parametrize("calibrated,least", [(False, 0.3), (True, -0.015), (False, 1.5)])
def test_rounds_equal_matrix(spark, calibrated, least):
    r = np.random.default_rng(3)
    parts = {"long": crowd(r, 150), "longer": crowd(r, 260), "short": crowd(r, 20), "one": crowd(r, 1)}
    parts["longer"][100:220] = parts["longer"][7]  # equal vectors
    want = {}
    for rec, x in parts.items():
        sim = unit(x) @ unit(x).T
        want[rec] = K.average_linkage(sim, least + (K.calibration(sim)[0] if calibrated and len(x) > 1 else 0.0)).tolist()
    got = labels(M.cluster(frame(spark, parts), least, calibrated, limit=70, block=80))
    assert got == want
    if 0 < least < 1:
        assert 1 < len(set(got["long"])) < 150


def test_chains_and_zeros(spark):
    """Points on an arc merge in few pairs a round; zero vectors are no one's copies."""
    angle = np.cumsum(np.linspace(0.01, 0.05, 40))
    parts = {"arc": np.stack((np.cos(angle), np.sin(angle)), 1), "zero": np.concatenate((np.zeros((30, 2)), np.eye(2)))}
    want = {rec: K.average_linkage(unit(x) @ unit(x).T, 0.9).tolist() for rec, x in parts.items()}
    assert labels(M.cluster(frame(spark, parts), 0.9, limit=30, block=16)) == want


def test_long_thresholds(spark):
    r = np.random.default_rng(5)
    parts = {"a": crowd(r, 300), "b": crowd(r, 75, dim=8), "same": np.ones((40, 8))}
    rows = spark.createDataFrame([(rec, i, v.tolist()) for rec, x in parts.items() for i, v in enumerate(unit(x))], "rec string, place long, v array<double>")
    got = dict(map(tuple, L.long_thresholds(Tables(spark, "t"), rows, block=32).collect()))
    for rec, x in parts.items():
        assert got[rec] == pytest.approx(K.calibration(unit(x) @ unit(x).T)[0], rel=1e-9)


def test_average_linkage_of_clusters():
    """Starting from clusters with their sums is going on from where a linkage stood."""
    r = np.random.default_rng(6)
    x = unit(crowd(r, 80))
    sim = x @ x.T
    high = K.average_linkage(sim, 0.8)
    c, back, n = np.unique(high, return_inverse=True, return_counts=True)
    s = np.zeros((len(c), x.shape[1]))
    np.add.at(s, back, x)
    assert (c[K.average_linkage(s @ s.T, 0.2, n)][back] == K.average_linkage(sim, 0.2)).all() and len(c) < 80


def test_empty(spark):
    assert M.cluster(frame(spark, {}), 0.3).count() == 0


def test_fifty_thousand_windows(spark):
    """A matrix of these would take 20 GB; tiles take a few."""
    r = np.random.default_rng(7)
    centres = unit(r.normal(size=(40, 16)))
    who = r.integers(0, 40, 50000)
    x = centres[who] + r.normal(size=(50000, 16)) * 0.03
    import pyarrow as pa

    rows = spark.createDataFrame(pa.table({"rec": pa.array(np.zeros(50000, np.int64)), "idx": pa.array(np.arange(50000)), "xvec": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 16).cast(pa.list_(pa.float64()))}))
    got = M.cluster(rows, 0.8).toPandas().sort_values("idx")
    first = {}
    for i, w in enumerate(who.tolist()):
        first.setdefault(w, i)
    assert (got.label.to_numpy() == np.array([first[w] for w in who.tolist()])).all()

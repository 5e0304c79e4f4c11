"""Hard negatives against all pairs; intervals against all products; pruning on clustered vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segspark.llm import hard_negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int, q int, at string, key int"


def by_hand(rows, positives=5, negatives=3):
    live = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            live.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for a in {(i, label, tuple(q)): None for i, label, q in live if i % 50 == 0}:
        i, label, q = a
        others = list(live)
        others.remove((i, label, list(q)))
        others = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), j, k) for j, k, r in others if len(r) == len(q))
        for s, p, _ in [o for o in others if o[2] == label][:positives]:
            s = -s
            hit = [(j, -n) for n, j, k in others if k != label and 50 * s <= -100 * n <= 95 * s][:negatives]
            out += [(i, p, rank, j, s, n) for rank, (j, n) in enumerate(hit, 1)]
    return sorted(out)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def clustered(n=700, dim=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim)) * 3
    x = centres[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * 0.05
    return [(i, [float(np.float32(v)) for v in x[i]], int(r.integers(0, 4)), 1, "x", 2) for i in range(n)]


def awkward():
    rows = clustered(420)
    same = rows[0][1]
    rows += [(1000 + i, same, 1 if i < 200 else 2, 1, "x", 2) for i in range(300)]  # equal vectors of two labels, anchors among them
    rows += [(50, same, 1, 1, "x", 2), rows[3], rows[3], rows[0], (None, same, 1, 1, "x", 2), (2000, None, 1, 1, "x", 2), (2050, same, None, 1, "x", 2)]
    rows += [(2100, [*same[:-1], None], 1, 1, "x", 2), (2150, [*same[:-1], float("nan")], 1, 1, "x", 2), (2200, [*same[:-1], float("inf")], 1, 1, "x", 2), (2250, [0.0] * 12, 1, 1, "x", 2)]
    rows += [(2300, [1.0, 2.0], 1, 1, "x", 2), (2301, [1.0, 2.5], 1, 1, "x", 2), (2302, [0.5, 1.0], 2, 1, "x", 2), (2350, [], 1, 1, "x", 2), (-50, [-x for x in same], 3, 1, "x", 2)]
    return rows


@pytest.mark.parametrize("sizes", [(2048, 4096, 2048, 8192, 16384), (4, 16, 3, 8, 100)])
def test_mine(spark, monkeypatch, sizes):
    for name, value in zip(("ANCHOR_LEAF", "LEAF", "ANCHOR_BLOCK", "BLOCK", "SAMPLE"), sizes, strict=True):
        monkeypatch.setattr(m, name, value)
    rows = awkward()
    got = m.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 50 == 0)
    assert result(got) == by_hand(rows)


def test_empty_and_large(spark):
    assert m.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1e5, 3.0], 1), (1, [9e4, 1.0], 1), (2, [8e4, 7.0], 2), (50, [1e30, 1.0], 1)]  # scores beyond 2^53; the last is too large
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = [t for t in by_hand([(i, v, k, 0, 0, 0) for i, v, k in rows[:3]])]
    assert result(m.mine(df, F.col("vec_id") % 50 == 0)) == want and want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_best(seed):
    r = np.random.default_rng(seed)
    s, k = r.integers(-3, 4, (5, r.integers(1, 9))), int(r.integers(1, 4))
    ok = r.random(s.shape) < 0.7
    row, col = m.best(s.astype(float), ok, k)
    want = [(i, j) for i in range(5) for j in sorted(np.flatnonzero(ok[i]), key=lambda j: (-s[i, j], j))[:k]]
    assert list(zip(row.tolist(), col.tolist(), strict=True)) == want


def bounded(x, leaves):
    tree = m.Tree(x, leaves)
    at = tree.route(x)
    far = np.sqrt(((x - tree.leaf_centres()[at]) ** 2).sum(1))
    norm = np.sqrt((x * x).sum(1))
    tree.bound({n: far[at == n].max() for n in set(at.tolist())}, {n: norm[at == n].max() for n in set(at.tolist())})
    return tree, at


def test_intervals_and_pruning():
    x = np.floor(256 * np.array([r[1] for r in clustered(1500)]))
    (a, at), (c, to) = bounded(x[:300], 16), bounded(x, 64)
    s = x[:300] @ x.T
    for i, g in a.leaf.items():
        for j, n in c.leaf.items():
            if (at == g).any() and (to == n).any():
                lo, hi = m.interval(a, i, c, j)
                part = s[np.ix_(at == g, to == n)]
                assert lo <= part.min() and part.max() <= hi
    best = np.sort(s, 1)[:, -6]
    least = {g: best[at == g].min() for g in set(at.tolist())}
    pairs = set(m.open_pairs(a, c, least, dict.fromkeys(least, np.inf)))
    assert all((g, n) in pairs for g, n in zip(at[np.nonzero(s >= best[:, None])[0]].tolist(), to[np.nonzero(s >= best[:, None])[1]].tolist(), strict=True))
    assert len(pairs) < 0.5 * len(a.leaf) * len(c.leaf)
    assert len(m.Tree(np.ones((50, 3)), 8).leaf) == 1

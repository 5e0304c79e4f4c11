"""The variational chain in pieces against the kernel, and the kernel's steps against a dense chain."""

import numpy as np
import pytest

from segspark.operators import kernels as K
from segspark.operators import longchain as L
from segspark.operators import models as M
from segspark.plans import diarize as D
from segspark.operators import vectors

PHI = [3.0, 2.0, 1.0, 0.5]


def dense(ll, weights, loop):
    """Responsibilities, evidence and draws with the whole transition matrix."""
    gamma, evidence, fw, bw = K.forward_backward(ll, np.diag(np.full(len(weights), loop)) + (1 - loop) * weights, weights)
    draws = gamma[0].copy()
    if len(ll) > 1:
        draws += (1 - loop) * weights * np.exp((K.lse(fw[:-1], 1) - evidence)[:, None] + ll[1:] + bw[1:]).sum(0)
    return gamma, evidence, draws


@pytest.mark.parametrize("loop", [0.0, 0.4, 0.99, 1.0])
@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_structured_chain(loop, scale):
    r = np.random.default_rng(1)
    for frames, s in ((1, 3), (2, 1), (40, 5)):
        ll, w = r.normal(size=(frames, s)) * scale, r.dirichlet(np.ones(s))
        got, want = K.smoothed(ll, w, loop), dense(ll, w, loop)
        assert np.allclose(got[0], want[0], atol=1e-9) and np.isclose(got[1], want[1], rtol=1e-10) and np.allclose(got[2], want[2], atol=1e-8)
        # cut anywhere, pieces between what is before and behind give the same
        chain, cut = K.Chain(loop, w), frames // 3
        if cut:
            begun = chain.forward(ll[:cut], np.log(w + K.LOG_FLOOR))
            ahead = np.log(np.maximum(begun[0][-1], 1e-300)) + begun[1][-1]
            behind = K.lse(chain.through(ll[cut:]), 1)
            one, a = chain.smoothed(ll[:cut], np.log(w + K.LOG_FLOOR), behind, True)
            two, b = chain.smoothed(ll[cut:], chain.step(ahead), np.zeros(s), False)
            assert np.allclose(np.concatenate((one, two)), want[0], atol=1e-8) and np.allclose(a + b, want[2], atol=1e-7)


def talk(seed, frames, speakers=3):
    r = np.random.default_rng(seed)
    who = np.repeat(r.integers(0, speakers, frames // 9 + 1), 9)[:frames]
    return r.normal(size=(speakers, 4))[who] * np.sqrt(PHI) + r.normal(size=(frames, 4)), (who + r.integers(0, 2, frames)) * 5


def test_pieces_equal_whole(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 32)
    rows = []
    for rec, frames in (("a", 150), ("b", 97), ("short", 12), ("one", 40)):
        x, label = talk(len(rec) + frames, frames)
        rows += [(rec, 7 * i - 30, v.tolist(), int(k) if rec != "one" else 3, 1) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "rec string, idx long, v array<double>, label long, part int").repartition(4)
    take = lambda got: {(q.rec, q.idx): q for q in got.collect()}
    args = dict(loop=0.8, fa=0.5, fb=2.0, rounds=6, epsilon=0.3)
    want, got = take(M.vb_cluster(df, PHI, **args)), take(M.vb_cluster(df, PHI, limit=30, **args))
    assert set(got) == set(want) and len({q.rounds for q in want.values()}) > 1
    for k, q in want.items():
        assert np.allclose(got[k].gamma, q.gamma, atol=1e-7) and np.allclose(got[k].pi, q.pi, atol=1e-7)
        assert np.isclose(got[k].objective, q.objective, rtol=1e-9) and (got[k].rounds, got[k].label, got[k].second) == (q.rounds, q.label, q.second)
    drawn = take(M.vb_cluster(df, PHI, limit=30, seed=4, speakers=3, **args))
    assert set(drawn) == set(want) and all(len(q.gamma) == 3 and np.isclose(sum(q.gamma), 1) for q in drawn.values())


def test_long_recordings_end_to_end(spark, monkeypatch):
    """Long recordings through the operators get the labels that one kernel gives them."""
    monkeypatch.setattr(L, "CHUNK", 32)
    rows = []
    for rec, frames in (("long", 140), ("short", 20)):
        x, _ = talk(frames, frames)
        rows += [(rec, i, f"{rec}_{i}", (v * 3).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rec string, idx long, key string, xvec array<double>")
    t = vectors.Transform([0.0] * 4, np.eye(4).tolist(), [0.0] * 4)
    p = vectors.Plda([0.0] * 4, np.eye(4).tolist(), PHI)
    for init in ("AHC+VB",):
        s = D.Settings(init=init, lda_dim=3, fb=1.0, rounds=3)
        take = lambda got: sorted((q.rec, q.idx, q.key, q.label, -1 if q.second is None else q.second) for q in got.collect())
        assert take(D.diarize(df, t, p, s, limit=60)) == take(D.diarize(df, t, p, s))
    assert D.diarize(df, t, p, D.Settings(init="random_3", lda_dim=3, rounds=2), limit=60).count() == 160

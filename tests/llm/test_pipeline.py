"""The pipeline stage by stage, and the registered queries against their oracles."""

import hashlib
import struct
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from segspark.llm import common, pieces, queries
from segspark.llm.common import Scratch

from ..conftest import SMALL, canonical
from . import cases
from .test_dedup import near_truth
from .test_text import slow_pieces


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck):
    df = queries.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.ORACLES:
        rel = duck.sql(queries.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(rel.fetchall(), rel.columns)


def test_stages(spark):
    docs, kept = cases.frame(spark), {}
    scratch = Scratch(spark, "stages")
    for name, stage in cp.STAGES:
        out = scratch.save(stage(spark, docs, ""), name)
        kept[name] = (docs.collect(), out.collect())
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = kept["language_id"]
    assert Counter(map(str, after)) == Counter(str(r) for r in before if any(c.isalpha() for c in r.text or ""))
    before, after = kept["exact_dedup"]
    ids = {}
    for r in before:
        ids.setdefault(r.text, []).append(-1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in after) == sorted((t, max(i)) for t, i in ids.items())
    before, after = kept["ngram_join"]
    truth = near_truth([tuple(r) for r in before])
    assert sorted(str(r.doc_id) for r in after) == sorted(i for i, _, c in truth if i == c)
    before, after = kept["mixing"]
    assert Counter((r.doc_id, r.source, r.text) for r in after) <= Counter({(r.doc_id, r.source, r.text): 3 for r in before})
    size = lambda r: len(cases.SPACE.findall(r.text or ""))
    assert Counter((r.doc_id, r.source, size(r)) for r in after) == mix_slow([(r.doc_id, r.source, size(r)) for r in before])
    before, after = kept["sentencepiece"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and all(r.lossless and r.n_tokens == len(r.ids) for r in after)
    short = [r for r in before if len(r.text) <= 1500]
    ids = {r.doc_id for r in before if len(r.text) > 1500}
    assert len(short) > 20 and Counter((r.doc_id, tuple(r.ids)) for r in after if r.doc_id not in ids) == Counter(cut_slow([(r.doc_id, r.text) for r in short if r.doc_id not in ids]))


def mix_slow(rows):
    """Copies by walking every source's documents in order, with the running sum in whole grains."""
    total = defaultdict(int)
    for _, source, n in rows:
        total[source] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(3.0 * total[s] for s in full)
        free = free - full if full else set()
    out = Counter()
    for s in names:
        step = min(int(target[s] / total[s] * (1 << 28)), 3 << 28) if total[s] else 0
        at = int(hashlib.md5(f"0:{int(s is None)}{s or ''}".encode()).hexdigest()[:7], 16)
        own = sorted(((n, i is not None, i or 0) for i, source, n in rows if source == s))
        for n, known, i in own:
            copies = (at + step >> 28) - (at >> 28)
            at += step
            if copies:
                out[i if known else None, s, n] += copies
    return out


def cut_slow(rows):
    """``(id, ids)`` with the keys of rows and copies made by hand."""
    import sentencepiece
    import xxhash

    proc = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [i for i in range(proc.get_piece_size()) if not (proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i) or proc.is_byte(i))]
    table = {proc.id_to_piece(i): i for i in plain}
    xx = lambda raw, seed: xxhash.xxh64(raw, seed=seed).intdigest()
    seen = Counter()
    for i, text in rows:
        seen[i, text] += 1
        name = xx(str(i).encode() if i is not None else text.encode(), xx(struct.pack("<i", 0), 42))
        own = xx(struct.pack("<i", seen[i, text]), xx(struct.pack("<Q", name), 42))
        yield i, tuple(slow_pieces(proc, text, own, pieces.DROPOUT, table))


def test_run(spark, tmp_path, monkeypatch):
    """Nothing but the last stage's input stays in the shared folder."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = cp.run(spark, SMALL).collect()
    left = [p.relative_to(tmp_path).parts for p in tmp_path.glob("*/*")]
    assert rows and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    assert [x[1] for x in left] == ["mixing"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], cases.SCHEMA)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0

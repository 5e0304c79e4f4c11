"""Repeated windows of words: machinery of the substring operator.

Every word that lies in a window of ``length`` words which also starts anywhere else is removed; these
windows are found in two steps:

* anchors: short stretches whose position follows from a rule, so that a repeated window always contains
  an anchor that occurs elsewhere.  Anchors are dealt by hash into buckets, as packed arrays; a bucket is
  sorted and equal neighbours are kept.
* extension: each kept anchor is extended left and right to every window of full length around it; these
  are compared by 96-bit hashes in the same packed way, and windows that follow each other make up the
  maximal repeats.

What occurs twice within one task's batch is settled there and sent on once, so a passage that a third
of all documents share adds a few entries per batch.  Bucket numbers grow with the input, and a bucket
holds about ``BUCKET_BYTES`` worth of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Scratch, arrow_map
from .ngram_join import groups
from .passages import cut, split
from .textkit import NOT_SPACE, U, buffers, mix, rolling, slices, words

BUCKET_BYTES = 4 << 20
#: Words, and entries, that a task gathers before it settles and sends them.
BATCH = 1 << 20
KEY_ROWS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """``length`` words must repeat; anchors have ``anchor`` words.

    ``pick(hashes, first, rule)`` gives for the anchor hashes of a range of texts the positions to look
    up (None: all valid ones) and the positions that are anchors.
    """

    length: int
    anchor: int
    pick: Callable


def bucket_bits(docs: DataFrame, text: Column) -> int:
    """How many bits number the buckets, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(5, np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))


def _cuts(bits: int, *sorted_hashes: np.ndarray):
    """The buckets that occur, and for each array where each of them begins and ends."""
    own = [(h >> U(64 - bits)).astype(np.int64) for h in sorted_hashes]
    some = np.unique(np.concatenate(own))
    return some.tolist(), [list(zip(np.searchsorted(x, some, "left").tolist(), np.searchsorted(x, some, "right").tolist(), strict=True)) for x in own]


def _ride(size: int, buckets: int) -> list[tuple[int, int]]:
    """Equal parts: what is settled need not travel by hash and rides with all buckets."""
    at = np.linspace(0, size, buckets + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _batches(some: list[int], columns, names: list[str]):
    """Rows ``bucket, packed arrays`` of ``(array, cuts)`` columns, 64 buckets at a time."""
    for a in range(0, len(some), 64):
        now = range(a, min(a + 64, len(some)))
        packed = [pa.array([x[c[i][0] : c[i][1]].tobytes() for i in now], pa.binary()) for x, c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 64], pa.int64()), *packed], ["bucket", *names])


def _rest(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return ((h << U(bits)) >> U(32)).astype(np.uint32)


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def _twice(sorted_values: np.ndarray) -> np.ndarray:
    """Values that occur at least twice."""
    return np.unique(sorted_values[1:][sorted_values[1:] == sorted_values[:-1]])


ANCHORS = "bucket long, probes binary, mh binary, mk binary, mp binary, hk binary, hp binary"


def anchor_rows(docs: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Packed anchors of ``(key, text)``, a row per batch and bucket."""

    def make():
        probes, mh, mk, mp = [], [], [], []
        held = [0]

        def flush():
            p = np.sort(np.concatenate(probes))
            h, k, at = np.concatenate(mh), np.concatenate(mk), np.concatenate(mp)
            for x in (probes, mh, mk, mp):
                x.clear()
            held[0] = 0
            first = np.concatenate(([True], p[1:] != p[:-1]))
            second = np.concatenate(([False], ~first[1:] & first[:-1]))
            p = p[first | second]
            twice = _twice(p)
            order = np.argsort(h, kind="stable")
            h, k, at = h[order], k[order], at[order]
            known = _in_sorted(h, twice)
            some, (cp, ch) = _cuts(bits, p, h[~known])
            ck = _ride(int(known.sum()), len(some))
            columns = [(_rest(p, bits), cp), (_rest(h[~known], bits), ch), (k[~known], ch), (at[~known], ch), (k[known], ck), (at[known], ck)]
            yield from _batches(some, columns, ["probes", "mh", "mk", "mp", "hk", "hp"])

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in slices(offsets):
                w = words(data, offsets, i, j, NOT_SPACE, False)
                n = w.counts()
                if not (n >= rule.length).any():
                    continue
                grams = rolling(w.hashes(), rule.anchor)
                look, mark = rule.pick(grams, w.first, rule)
                grams = mix(grams)  # what is picked may favour small hashes; buckets should not
                probes.append(grams[look])
                text = np.searchsorted(w.first, mark, "right") - 1
                mh.append(grams[mark])
                mk.append(keys[i + text])
                mp.append((mark - w.first[text]).astype(np.int32))
                held[0] += len(look)
                if held[0] >= BATCH:
                    yield from flush()

        def finish():
            if probes:
                yield from flush()

        step.finish = finish
        return step

    return arrow_map(docs.select("key", "text"), make, ANCHORS)


def _joined(column, kind):
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def _key_rows(k: np.ndarray, p: np.ndarray):
    """``(key, at)`` rows, ``at`` the packed positions of one key."""
    order = np.argsort(k, kind="stable")
    k, p = k[order], np.ascontiguousarray(p[order], np.int32)
    cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)])) if len(k) else np.zeros(1, np.int64)
    raw, heads = p.tobytes(), cut[:-1]
    for a in range(0, len(heads), KEY_ROWS):
        b = min(a + KEY_ROWS, len(heads))
        lo, hi = int(cut[a]), int(cut[b])
        packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((cut[a : b + 1] - lo) * 4).astype(np.int32).tobytes()), pa.py_buffer(raw[lo * 4 : hi * 4])])
        yield pa.RecordBatch.from_arrays([pa.array(k[heads[a:b]], pa.int64()), packed], ["key", "at"])


PACKS = "bucket long, k binary, p binary"


def _packs(k: np.ndarray, p: np.ndarray, bits: int):
    """Keys and positions as packed arrays, a row per bucket of keys."""
    h = mix(k.view(U))
    order = np.argsort(h, kind="stable")
    some, (cut,) = _cuts(bits, h[order])
    yield from _batches(some, [(k[order], cut), (p[order], cut)], ["k", "p"])


def by_key(packs: DataFrame) -> DataFrame:
    """``key, at``: one row per document, from the packed rows of all buckets."""

    def run(batches):
        for t in groups(batches, ("bucket",)):
            yield from _key_rows(_joined(t.column("k"), np.int64), _joined(t.column("p"), np.int32))

    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, at binary")


def kept_anchors(rows: DataFrame, bits: int) -> DataFrame:
    """Packed anchors that occur elsewhere, sorting each bucket and keeping equal neighbours."""

    def run(batches):
        for t in groups(batches, ("bucket",)):
            twice = _twice(np.sort(_joined(t.column("probes"), np.uint32)))
            hit = _in_sorted(_joined(t.column("mh"), np.uint32), twice)
            k = np.concatenate((_joined(t.column("mk"), np.int64)[hit], _joined(t.column("hk"), np.int64)))
            p = np.concatenate((_joined(t.column("mp"), np.int32)[hit], _joined(t.column("hp"), np.int32)))
            yield from _packs(k, p, bits)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKS)


STRETCHES = "bucket long, h1 binary, h2 binary, k binary, p binary, m1 binary, m2 binary, hk binary, hp binary"


def stretch_rows(bodies: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Packed full-length stretches around the kept anchors of ``(key, text, at)``."""

    def make():
        parts: list[tuple] = []
        held = [0]

        def flush():
            h1, h2, k, p = (np.concatenate([x[c] for x in parts]) for c in range(4))
            parts.clear()
            held[0] = 0
            order = np.lexsort((h2, h1))
            h1, h2, k, p = h1[order], h2[order], k[order], p[order]
            alike = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            multi = np.zeros(len(h1), bool)
            multi[1:] |= alike
            multi[:-1] |= alike
            head = multi.copy()
            head[1:] &= ~alike
            one = ~multi
            some, (c1, cm) = _cuts(bits, h1[one], h1[head])
            kk, pp = k[multi], p[multi]
            ride = _ride(len(kk), len(some))
            columns = [(h1[one], c1), (h2[one], c1), (k[one], c1), (p[one], c1), (h1[head], cm), (h2[head], cm), (kk, ride), (pp, ride)]
            yield from _batches(some, columns, ["h1", "h2", "k", "p", "m1", "m2", "hk", "hp"])

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            keys, ats = batch.column("key").to_numpy(), batch.column("at").to_pylist()
            for i, j in slices(offsets):
                w = words(data, offsets, i, j, NOT_SPACE, False)
                r1, r2 = rolling(w.hashes(1), rule.length, 3), rolling(w.hashes(2), rule.length, 4)
                for d in range(i, j):
                    first, n = int(w.first[d - i]), int(w.first[d - i + 1] - w.first[d - i])
                    if n < rule.length:
                        continue
                    marks = np.frombuffer(ats[d], np.int32)
                    delta = np.zeros(n + 2, np.int32)
                    np.add.at(delta, np.maximum(marks - (rule.length - rule.anchor), 0), 1)
                    np.add.at(delta, np.minimum(marks, n) + 1, -1)
                    start = np.flatnonzero(np.cumsum(delta[: n - rule.length + 1]) > 0)
                    parts.append((r1[first + start], (r2[first + start] >> U(32)).astype(np.uint32), np.full(len(start), keys[d], np.int64), start.astype(np.int32)))
                    held[0] += len(start)
                if held[0] >= BATCH:
                    yield from flush()

        def finish():
            if held[0]:
                yield from flush()

        step.finish = finish
        return step

    return arrow_map(bodies.select("key", "text", "at"), make, STRETCHES)


def repeated_stretches(rows: DataFrame, bits: int) -> DataFrame:
    """Packed places where a stretch of full length starts whose words also start elsewhere."""

    def run(batches):
        for t in groups(batches, ("bucket",)):
            h1, h2 = _joined(t.column("h1"), U), _joined(t.column("h2"), np.uint32)
            m1, m2 = _joined(t.column("m1"), U), _joined(t.column("m2"), np.uint32)
            k, p = _joined(t.column("k"), np.int64), _joined(t.column("p"), np.int32)
            a, b = np.concatenate((h1, m1)), np.concatenate((h2, m2))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            alike = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            hit = np.zeros(len(a), bool)
            hit[1:] |= alike
            hit[:-1] |= alike
            hit = order[hit]
            hit = hit[hit < len(h1)]
            yield from _packs(np.concatenate((k[hit], _joined(t.column("hk"), np.int64))), np.concatenate((p[hit], _joined(t.column("hp"), np.int32))), bits)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKS)


def cleaned(found: DataFrame, rule: Rule, with_text: bool = False) -> DataFrame:
    """Rows ``(id, text, at)`` without the words of the stretches that start at ``at``."""

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for raw, at in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("at").to_pylist(), strict=True):
                at = np.frombuffer(at or b"", np.int32)
                rows.append(cut(raw, at, at + rule.length, with_text))
            n, gone, sha, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "sha", "spans", "kept"])

        return step

    return arrow_map(found, make, f"id {dict(found.dtypes)['id']}, n_words long, n_removed long, sha string, spans array<long>, kept string")


def without_repeats(docs: DataFrame, rule: Rule, id_col: str, text_col: str, with_text: bool = False, tag: str = "repeats") -> DataFrame:
    """``id, n_words, n_removed, sha, spans[, kept]`` for every row of ``docs``.

    ``spans`` are the removed stretches as flat ``start, end`` word numbers.  With ``with_text`` the kept
    words are returned as well.  Rows are told apart by a hash of id and text, so rows that share an id
    are judged each on its own text; rows whose hashes collide are named anew by a second hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, tag)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = bucket_bits(docs, text)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), F.xxhash64(text, F.col(id_col), F.lit("second")).alias("key2"), text.alias("text"))
    names = rows.groupBy("key").agg((F.min("key2") != F.max("key2")).alias("many")).where("many").select(F.col("key").alias("shared"))
    names = scratch.save(names, "names")
    if names.isEmpty():
        rows = rows.drop("key2")
    else:
        rows = rows.join(names, F.col("key") == F.col("shared"), "left").select("id", F.when(F.col("shared").isNull(), F.col("key")).otherwise(F.col("key2")).alias("key"), "text")
    hits = scratch.save(by_key(kept_anchors(anchor_rows(rows, rule, bits), bits)), "anchors")
    wanted = np.ones(sketch.CELLS, bool) if with_text else sketch.key_filter(hits, "key")
    staged = scratch.save(split(rows, spark.sparkContext.broadcast(wanted)), "staged")  # 1 MB
    maybe = staged.where("text is not null").select("id", "key", "text")
    found = repeated_stretches(stretch_rows(maybe.join(hits.hint("shuffle_hash"), "key"), rule, bits), bits)
    rest = cleaned(maybe.join(by_key(found).hint("shuffle_hash"), "key", "left").select("id", "text", "at"), rule, with_text)
    rest = scratch.save(rest, "rest")
    scratch.drop("anchors")
    none = F.array().cast("array<long>")
    done = staged.where("text is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", none.alias("spans"), F.lit(None).cast("string").alias("kept"))
    return done.unionByName(rest)

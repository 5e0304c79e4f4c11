"""Passage deduplication by sparse suffix arrays.

Of all word suffixes only those stay that start at a minimiser: a position whose next ``ANCHOR`` words
have the least hash among all positions of some stretch of full length.  The choice depends on the words
alone, so two copies of a stretch keep the same suffixes.

* Suffixes whose first ``ANCHOR`` words stand nowhere else cannot have a neighbour that begins alike;
  they are dropped by counting.
* The others become rows of the words ahead, the words behind (nearest first) and their place.  Those that
  begin alike are dealt to one partition, by a hash of these first words, and sorted by all their words: a
  sparse suffix array whose runs never cross a partition.  It is sorted once by the words behind, which
  gives how far a suffix can match anything to the left, and once by the words ahead.
* Neighbours are compared word by word, ahead and behind.  What two neighbours share gives the stretches
  that they prove to be repeats of each other.  A suffix shares most words with one of its neighbours in
  either order, so no stretch can be a repeat that would need more.  What is within that reach but not proven
  by a neighbour (its partner stands further off) is settled by counting 128-bit hashes of just these stretches.
* Suffixes of one beginning that very many places share are dealt in parts; what is not proven within a
  part is settled by counting as well.

A stretch of full length is removed if it is proven either way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Scratch, arrow_map, same
from .passages import cut, split
from .textkit import NOT_SPACE, buffers, mix, positions, rolling, slices, words

LENGTH = 50
ANCHOR = 16
#: A longer word stands in the array as its digest.
LONG_WORD = 64
#: Suffixes of one beginning that one part holds.
PART_ROWS = 1 << 14
#: Rows, and bytes of words, that are compared or sent on at once.
CHUNK = 4096
CHUNK_BYTES = 8 << 20
SPACE = 0x20


def sliding(x: np.ndarray, width: int, op: np.ufunc, empty) -> np.ndarray:
    """``op`` over every ``width`` consecutive values: two running passes over blocks, whatever the width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // width) * width, empty, x.dtype)
    full[: len(x)] = x
    full = full.reshape(-1, width)
    ahead = op.accumulate(full, axis=1).ravel()
    back = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def least_grams(grams: np.ndarray, first: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For every position at which a stretch of full length starts, the least gram in it; 0 elsewhere."""
    least = np.zeros(len(grams), grams.dtype)
    begin = positions(first, length)
    least[begin] = sliding(grams, length - anchor + 1, np.minimum, np.iinfo(np.uint64).max)[begin]
    return least


def minimisers(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Positions whose gram is the least of some stretch around them."""
    chosen = sliding(np.concatenate((np.zeros(width - 1, grams.dtype), least)), width, np.maximum, 0)
    return np.flatnonzero((chosen == grams) & (chosen > 0))


def suffix_starts(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``h, id, key, p``: hash of the first ``anchor`` words, and place, of every retained suffix."""

    def make():
        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                w = words(data, offsets, i, j, NOT_SPACE, False)
                if not (w.counts() >= length).any():
                    continue
                grams = rolling(w.hashes(), anchor)
                at = minimisers(grams, least_grams(grams, w.first, length, anchor), length - anchor + 1)
                text = np.searchsorted(w.first, at, "right") - 1
                own = pa.array(i + text)
                for a in range(0, len(at), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    # minimisers favour small hashes; what is dealt by them should not
                    yield pa.RecordBatch.from_arrays([pa.array(mix(grams[at[part]]).view(np.int64)), batch.column("id").take(own[part]), batch.column("key").take(own[part]), pa.array((at[part] - w.first[text[part]]).astype(np.int32))], ["h", "id", "key", "p"])

        return step

    return arrow_map(docs, make, f"h long, id {dict(docs.dtypes)['id']}, key long, p int")


SUFFIX = ["h", "part", "ahead", "behind", "near", "far", "id", "key", "p"]


def suffix_rows(bodies: DataFrame, length: int, anchor: int) -> DataFrame:
    """``h, part, ahead, behind, near, far, id, key, p`` of the suffixes ``at (p, parts)`` of ``id, key, text``.

    ``h`` is a hash of the beginning, ``part`` is -1 unless it is dealt in parts.  The stretches that a suffix stands for start ``near`` to ``far`` words before it; ``ahead`` and
    ``behind`` reach as far as these need, every word followed by a space.
    """
    width = length - anchor + 1

    def make():
        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            keys = batch.column("key").to_pylist()
            rows: list[tuple] = []
            held = 0

            def flush():
                h, part, ahead, behind, near, far, own, p = zip(*rows, strict=True)
                own = pa.array(own)
                return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(part, pa.int32()), pa.array(ahead, pa.binary()), pa.array(behind, pa.binary()), pa.array(near, pa.int32()), pa.array(far, pa.int32()), batch.column("id").take(own), batch.column("key").take(own), pa.array(p, pa.int32())], SUFFIX)

            for i, j in slices(offsets):
                w = words(data, offsets, i, j, NOT_SPACE, False)
                grams = rolling(w.hashes(), anchor)
                least = least_grams(grams, w.first, length, anchor)
                for d in range(i, j):
                    first, n = int(w.first[d - i]), int(w.first[d - i + 1] - w.first[d - i])
                    marks = batch.column("at")[d].values
                    at, parts = marks.field("p").to_numpy(), marks.field("parts").to_numpy()
                    parts, at = parts[at <= n - anchor], at[at <= n - anchor]
                    if n < length or not len(at):
                        continue
                    place_hash = mix(at.astype(np.uint64) ^ np.uint64(keys[d] & (1 << 64) - 1))
                    part = np.where(parts > 1, (place_hash % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), -1)
                    # which of the stretches around each suffix have it as their minimiser: a run of them
                    back = at[:, None] - np.arange(width)
                    own = (back >= 0) & (least[first + np.maximum(back, 0)] == grams[first + at][:, None])
                    some = own.any(1)
                    near, far = own.argmax(1), width - 1 - own[:, ::-1].argmax(1)
                    tokens = [x if len(x) <= LONG_WORD else b"\t" + hashlib.sha256(x).hexdigest().encode() for x in data[offsets[d] : offsets[d + 1]].tobytes().split()]
                    size = np.array([len(x) + 1 for x in tokens])
                    place = np.concatenate(([0], np.cumsum(size)))
                    text, turned = b" ".join(tokens) + b" ", b" ".join(tokens[::-1]) + b" "
                    hashes = mix(grams[first + at]).view(np.int64)
                    for p, lo, hi, h, one in zip(at[some].tolist(), near[some].tolist(), far[some].tolist(), hashes[some].tolist(), part[some].tolist(), strict=True):
                        ahead = text[place[p] : place[min(n, p + length - lo)]]
                        behind = turned[place[n] - place[p] : place[n] - place[p - hi]]
                        rows.append((h, one, ahead, behind, lo, hi, d, p))
                        held += len(ahead) + len(behind)
                    if held >= CHUNK_BYTES:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()

        return step

    return arrow_map(bodies, make, f"h long, part int, ahead binary, behind binary, near int, far int, id {dict(bodies.dtypes)['id']}, key long, p int")


def shared_words(column: pa.Array) -> np.ndarray:
    """How many leading words each value has in common with the next one."""
    data, offsets = buffers(column)
    size = np.diff(offsets)
    grid = np.zeros((len(size), int(size.max(initial=0)) + 1), np.uint8)
    inside = np.arange(grid.shape[1]) < size[:, None]
    grid[inside] = data[offsets[0] : offsets[-1]]
    # both end in zeros, which are no spaces, so equality beyond an end counts nothing
    unlike = grid[1:] != grid[:-1]
    upto = np.where(unlike.any(1), unlike.argmax(1), grid.shape[1])
    spaces = np.cumsum(grid[1:] == SPACE, axis=1, dtype=np.int32)
    return np.where(upto > 0, spaces[np.arange(len(upto)), np.maximum(upto - 1, 0)], 0)


def window_hash(ahead: bytes, behind: bytes, back: int, length: int) -> tuple[int, int]:
    """128 bits of the stretch that starts ``back`` words before a suffix."""
    stretch = behind.split(b" ", back)[:back][::-1] + ahead.split(b" ", length - back)[: length - back]
    h = hashlib.blake2b(b" ".join(stretch), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def chunks(batches):
    """``(rows, begins, ends)``: chunks of a sorted partition.

    A chunk's first and last row only lend their words, as the next chunk repeats the last two rows,
    unless the partition begins or ends there.
    """
    held: pa.Table | None = None
    begins = True
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            part = pa.Table.from_batches([batch.slice(a, CHUNK)])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows > 2:
                yield held, begins, False
                begins, held = False, held.slice(held.num_rows - 2)
    if held is not None:
        yield held, begins, True


def own_rows(n: int, begins: bool, ends: bool) -> np.ndarray:
    now = np.ones(n, bool)
    now[0], now[-1] = begins, ends
    return now


def between(t: pa.Table, column: str) -> np.ndarray:
    """Words shared with the neighbour before (entry ``i``) and after (entry ``i + 1``), 0 where another beginning stands."""
    out = np.zeros(t.num_rows + 1, np.int64)
    h = t.column("h").to_numpy()
    out[1:-1] = np.where(h[1:] == h[:-1], shared_words(t.column(column).combine_chunks()), 0)
    return out


def with_left(ordered: DataFrame, length: int) -> DataFrame:
    """Suffixes sorted by the words behind, with ``left``: how many of these any other suffix of the run may share."""

    def run(batches):
        for t, begins, ends in chunks(batches):
            shared = between(t, "behind")
            left = np.where(t.column("part").to_numpy() < 0, np.maximum(shared[:-1], shared[1:]), length).astype(np.int32)
            yield from t.append_column("left", pa.array(left)).filter(pa.array(own_rows(t.num_rows, begins, ends))).combine_chunks().to_batches()

    kind = dict(ordered.dtypes)["id"]
    return ordered.mapInArrow(run, f"h long, part int, ahead binary, behind binary, near int, far int, id {kind}, key long, p int, left int")


def compared(ordered: DataFrame, length: int, anchor: int) -> DataFrame:
    """Neighbours of the sorted suffixes compared: ``id, key, start, stop, w1, w2``.

    Rows without ``w1`` are proven: the stretches that start at words ``start`` to ``stop``.  The others
    are stretches to be counted, with their hash; one that a neighbour proves is among them once.
    """
    back = np.arange(length - anchor + 1)

    def run(batches):
        for t, begins, ends in chunks(batches):
            near, far, p, part, left, h = (t.column(c).to_numpy() for c in ("near", "far", "p", "part", "left", "h"))
            r, l = between(t, "ahead"), between(t, "behind")
            reach = np.where(part < 0, np.maximum(r[:-1], r[1:]), length)
            own = (back >= near[:, None]) & (back <= far[:, None])
            proven_by = lambda r, l: own & (back >= (length - r)[:, None]) & (back <= l[:, None])
            by_last, by_next = proven_by(r[:-1], l[:-1]), proven_by(r[1:], l[1:])
            proven = by_last | by_next
            unsure = own & (back >= (length - reach)[:, None]) & (back <= left[:, None]) & ~proven
            # runs of suffixes that begin alike: where nothing is unsure, nothing needs to be counted;
            # the first and last may go on in another chunk, parts of a beginning in another partition
            run_ = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
            needed = np.bincount(run_, unsure.any(1) | (part >= 0)) > 0
            needed[0] |= not begins
            needed[-1] |= not ends
            now = own_rows(t.num_rows, begins, ends)
            counted = (unsure | by_next & ~by_last) & (needed[run_] & now)[:, None]
            # proven stretches as runs of starts
            edge = np.diff(np.pad(proven & now[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, lo = np.nonzero(edge == 1)
            hi = np.nonzero(edge == -1)[1] - 1
            who, far_back = np.nonzero(counted)
            ahead, behind = t.column("ahead"), t.column("behind")
            hashes = [window_hash(ahead[i].as_py(), behind[i].as_py(), o, length) for i, o in zip(who.tolist(), far_back.tolist(), strict=True)]
            take = pa.array(np.concatenate((row, who)))
            if not len(take):
                continue
            start = np.concatenate((p[row] - hi, p[who] - far_back)).astype(np.int32)
            stop = np.concatenate((p[row] - lo, p[who] - far_back)).astype(np.int32)
            none = [None] * len(row)
            got = pa.Table.from_arrays([t.column("id").take(take), t.column("key").take(take), pa.array(start), pa.array(stop), pa.array([*none, *(a for a, _ in hashes)], pa.int64()), pa.array([*none, *(b for _, b in hashes)], pa.int64())], ["id", "key", "start", "stop", "w1", "w2"])
            yield from got.combine_chunks().to_batches()

    return ordered.mapInArrow(run, f"id {dict(ordered.dtypes)['id']}, key long, start int, stop int, w1 long, w2 long")


def cleaned(found: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Rows ``id, text, spans`` without the words of the stretches that start in ``spans``."""

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for raw, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at = np.array([(s["start"], s["stop"]) for s in spans or ()], np.int64).reshape(-1, 2)
                rows.append(cut(raw, at[:, 0], at[:, 1] + length, with_text))
            n, gone, sha, where, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(where, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "sha", "spans", "kept"])

        return step

    return arrow_map(found, make, f"id {dict(found.dtypes)['id']}, n_words long, n_removed long, sha string, spans array<long>, kept string")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, kept``, a row per row of ``docs``.

    Removes each word covered by ``length`` consecutive words that also start anywhere else, the same
    document included.  ``spans`` are the removed stretches as flat ``start, end`` word numbers; with
    ``with_text``, ``kept`` holds the words that stay.  Null and wordless texts have no words; shorter texts
    lose none; repeated rows are repeats of each other.  Rows are told apart by id and a hash of the text,
    so rows that share an id are judged each on its own text.  Extra columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    anchor = min(anchor, length)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    starts = scratch.save(suffix_starts(rows, length, anchor), "starts")
    alike = starts.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = starts.join(alike.hint("shuffle_hash"), "h").groupBy("id", "key").agg(F.collect_set(F.struct("p", "parts")).alias("at"))
    hits = scratch.save(hits.withColumnsRenamed({"id": "hit_id", "key": "hit_key"}), "hits")
    scratch.drop("starts")
    wanted = np.ones(sketch.CELLS, bool) if with_text else sketch.key_filter(hits, "hit_key")
    staged = scratch.save(split(rows, spark.sparkContext.broadcast(wanted)), "staged")  # 1 MB
    maybe = staged.where("text is not null").select("id", "key", "text")
    match = same("id", "hit_id") & (F.col("key") == F.col("hit_key"))
    suffixes = suffix_rows(maybe.join(hits.hint("shuffle_hash"), match).select("id", "key", "text", "at"), length, anchor)
    run = ["h", "part"]
    suffixes = with_left(suffixes.repartition(*run).sortWithinPartitions(*run, "behind"), length)
    judged = scratch.save(compared(suffixes.sortWithinPartitions(*run, "ahead", "behind", "key", "p"), length, anchor), "compared")
    # a place counts once however many suffixes stand for it
    open_ = judged.where("w1 is not null").select("id", "key", "start", "w1", "w2").distinct()
    again = open_.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    settled = open_.join(again.hint("shuffle_hash"), ["w1", "w2"], "left_semi").select("id", "key", "start", F.col("start").alias("stop"))
    spans = judged.where("w1 is null").select("id", "key", "start", "stop").unionByName(settled)
    spans = spans.groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rest = cleaned(maybe.join(spans.hint("shuffle_hash"), match, "left").select("id", "text", "spans"), length, with_text)
    rest = scratch.save(rest, "rest")
    scratch.drop("hits", "compared")
    none = F.array().cast("array<long>")
    done = staged.where("text is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", none.alias("spans"), F.lit(None).cast("string").alias("kept"))
    return done.unionByName(rest).withColumnsRenamed({"id": "doc_id", "sha": "kept_sha256"})


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 48)) AS p, ws FROM d WHERE len(ws) >= 50),
h AS (SELECT r, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM w),
k AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS p FROM h JOIN k USING (h)),
g AS (SELECT r, list(p) AS ps FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    got = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.col("kept_sha256"))

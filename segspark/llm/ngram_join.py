"""N-gram Jaccard join: documents whose word-shingle sets reach a Jaccard threshold, exactly.

Candidates: shingles take a global order, rarest first (by fixed-size counts over the whole corpus, less
what a count holds of unrelated shingles; the order steers cost, never results).  Two sets that reach the threshold share a shingle in their
prefixes, so documents meet in buckets by prefix shingle; buckets with equal members are one.

Tiles: in a bucket, documents of compatible sizes are compared by hashed bitmaps whose width follows
the size band; bit counts bound the overlap from above.  What passes spans candidate components.  A
component is one tile, in which exact intersections of sorted shingle arrays decide, and a spanning forest of
true links leaves it.  The sets of a large one meet in blocks, each set in one; then the best connected sets
of what hangs together meet; and only what is still apart meets the rest in tiles of size-band blocks.  No
list of pairs within a group is ever emitted, and nothing is capped.

Equal shingle sets are one node throughout, so copies cost nothing.  A set is known by two 64-bit
hashes: the first names it, and names that two different sets share are made anew from both.  Shingles
are compared by 64-bit hashes, within a pair of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import Scratch, arrow_map, components, same, unused
from .textkit import NOT_SPACE, U, buffers, mix, rolling, slices, words

SHINGLE = 5
#: Threshold as a fraction: ``DEN * intersection >= NUM * union``.
NUM, DEN = 75, 100
#: Documents of a bucket, and shingles of a component, that one tile block holds.
BUCKET_DOCS = 1 << 11
TILE_SHINGLES = 1 << 21
#: So many documents of a shingle, by the counts of all shingles, are counted together; of more, in parts of about so many.
HOT_DOCS = 1 << 14
#: Best connected sets of a connected part that stand for it, and rounds in which these meet; what is left meets in tiles.
HUBS, MEETINGS = 16, 4
MAX_BITS = 1 << 15
FLUSH_ROWS = 1 << 16


def shingle_sets(data, offsets, i, j, k=SHINGLE):
    """Sorted distinct shingle hashes of each of texts ``i .. j - 1``."""
    w = words(data, offsets, i, j, NOT_SPACE, True)
    h = w.hashes()
    grams = rolling(h, k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        m = int(b - a)
        if m >= k:
            s = np.sort(grams[a : b - k + 1])
            yield s if len(s) == 1 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif m:
            yield mix(rolling(h[a:b], m) + U(m))
        else:
            yield np.zeros(0, U)


def set_id(s: np.ndarray, salt: int = 0x51) -> int:
    return int(mix(np.array([np.add.reduce(mix(s + U(salt))) + U(len(s))], U)).view(np.int64)[0])


def second_id(s: np.ndarray) -> int:
    return set_id(s, 0x9E3779B97F4A7C15)


def needed(n, m):
    """Least overlap with which sets of sizes n and m link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def bitmap_bits(n: int) -> int:
    return min(MAX_BITS, max(256, 1 << int(2 * n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> bytes:
    x = np.zeros(bits, np.uint8)
    x[(s & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(x, bitorder="little").tobytes()


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``id, print, sid, sid2, n, bits`` per row of ``(id, print, text)``, and rows ``slice, blob`` of shingle counts."""
    kind = dict(docs.dtypes)["id"]

    def make():
        counts = np.zeros(sketch.CELLS, np.uint32)

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sets = list(shingle_sets(data, offsets, i, j, k))
                np.add.at(counts, sketch.cells(np.concatenate(sets)), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("print").slice(i, j - i), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([second_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s, bitmap_bits(len(s))) if len(s) else None for s in sets], pa.binary()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())],
                    ["id", "print", "sid", "sid2", "n", "bits", "slice", "blob"],
                )

        def finish():
            i, blobs = sketch.rows_of(counts)
            m = len(i)
            none = [pa.nulls(m, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.nulls(m, ids_type[0]), *none, pa.nulls(m, pa.binary()), pa.array(i, pa.int32()), pa.array(blobs, pa.binary())], ["id", "print", "sid", "sid2", "n", "bits", "slice", "blob"])

        ids_type = [pa.int64()]

        def typed(batch):
            ids_type[0] = batch.column("id").type
            yield from step(batch)

        typed.finish = finish
        return typed

    return arrow_map(docs, make, f"id {kind}, print long, sid long, sid2 long, n long, bits binary, slice int, blob binary")


def standing_out(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """What each count has beyond the median of all, and what chance may add to that.

    Counts have a fixed number, so in a large corpus each holds many unrelated shingles; their median is that
    background (0 where most are empty), and a frequent shingle stands out of it at any size.
    """
    background = int(np.median(counts))
    return counts - np.minimum(counts, background).astype(counts.dtype), 6 * background**0.5


def postings(docs: DataFrame, counts, k: int = SHINGLE, both: bool = False) -> DataFrame:
    """``h, sid[, sid2], n, parts`` for every prefix shingle of every distinct set that a task sees.

    ``counts`` is a broadcast of ``standing_out``; ``parts`` is how many parts a shingle's rows are dealt in.
    """
    limit = HOT_DOCS

    def make():
        seen: set[tuple[int, int]] = set()
        rank, chance = counts.value
        names = ["h", "sid", *(["sid2"] if both else []), "n", "parts"]

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                hs, sids, seconds, ns = [], [], [], []
                for s in shingle_sets(data, offsets, i, j, k):
                    if not len(s) or (own := (set_id(s), second_id(s))) in seen:
                        continue
                    seen.add(own)
                    p = prefix_length(len(s))
                    key = (np.minimum(rank[sketch.cells(s)], 0xFFFFFF).astype(U) << U(40)) | (s >> U(24))
                    hs.append(s[np.argsort(key, kind="stable")[:p]])
                    sids.append(own[0])
                    seconds.append(own[1])
                    ns.append(len(s))
                if hs:
                    reps = [len(x) for x in hs]
                    h = np.concatenate(hs)
                    columns = [h.view(np.int64), *(np.repeat(np.array(x, np.int64), reps) for x in ((sids, seconds, ns) if both else (sids, ns))), np.ceil(np.maximum(rank[sketch.cells(h)] - chance, 1) / limit).astype(np.int32)]
                    for a in range(0, len(h), FLUSH_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + FLUSH_ROWS]) for x in columns], names)

        return step

    return arrow_map(docs.select("text"), make, f"h long, sid long, {'sid2 long, ' if both else ''}n long, parts int")


def shingle_arrays(docs: DataFrame, wanted, k: int = SHINGLE) -> DataFrame:
    """``sid, sid2, arr`` of the sets that may be wanted, once per task."""

    def make():
        seen: set[tuple[int, int]] = set()
        cells_wanted = wanted.value

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sids, seconds, arrs = [], [], []
                for s in shingle_sets(data, offsets, i, j, k):
                    if not len(s):
                        continue
                    sid = set_id(s)
                    if not cells_wanted[sketch.cells(np.array([sid], np.int64).view(U))[0]]:
                        continue
                    sid2 = second_id(s)
                    if (sid, sid2) not in seen:
                        seen.add((sid, sid2))
                        sids.append(sid)
                        seconds.append(sid2)
                        arrs.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(seconds, pa.int64()), pa.array(arrs, pa.binary())], ["sid", "sid2", "arr"])

        return step

    return arrow_map(docs.select("text"), make, "sid long, sid2 long, arr binary")


# ---------------------------------------------------------------- tiles


def groups(batches, keys: tuple[str, ...]):
    """Consecutive groups of sorted batches, each as one RecordBatch-like table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def bound_links(sids, ns, maps):
    """Spanning forest of the pairs of one bucket whose bit counts allow the overlap they need."""
    if len(sids) <= 12:
        yield from _bound_small(sids, ns, maps)
        return
    order = np.argsort(ns, kind="stable")
    sids, ns, maps = [sids[i] for i in order], np.asarray(ns)[order], [np.frombuffer(maps[i], U) for i in order]
    width = np.array([len(m) for m in maps])
    pops = np.array([int(np.bitwise_count(m).sum()) for m in maps])
    levels = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    native = {w: np.stack([maps[i] for i in at]) for w, at in levels.items()}
    folded = {w: x[:, : w // 2] | x[:, w // 2 :] for w, x in native.items()}
    fpops = np.zeros(len(maps), np.int64)
    place = np.zeros(len(maps), np.int64)
    for w, at in levels.items():
        fpops[at] = np.bitwise_count(folded[w]).sum(1)
        place[at] = np.arange(len(at))
    fresh = np.ones(len(maps), bool)

    def hits(x):
        """Unvisited documents that x may link with."""
        n, w = ns[x], width[x]
        lo, hi = np.searchsorted(ns, -(-NUM * n // DEN)), np.searchsorted(ns, n * DEN // NUM, "right")
        for v in (w // 2, w, w * 2):
            if v not in levels:
                continue
            at = levels[v]
            at = at[(at >= lo) & (at < hi)]
            at = at[fresh[at]]
            if not len(at):
                continue
            if v == w:
                mine, pop, rows, rpop = native[w][place[x]], pops[x], native[v][place[at]], pops[at]
            elif v < w:
                mine, pop, rows, rpop = folded[w][place[x]], fpops[x], native[v][place[at]], pops[at]
            else:
                mine, pop, rows, rpop = native[w][place[x]], pops[x], folded[v][place[at]], fpops[at]
            both = np.bitwise_count(rows & mine).sum(1).astype(np.int64)
            most = np.minimum(n - pop + both, ns[at] - rpop + both)
            yield from at[most >= -(-NUM * (n + ns[at]) // (NUM + DEN))]

    for start in range(len(maps)):
        if not fresh[start]:
            continue
        fresh[start] = False
        front = [start]
        while front:
            x = front.pop()
            for y in list(hits(x)):
                fresh[y] = False
                front.append(int(y))
                yield sids[x], sids[y]


def _bound_small(sids, ns, maps):
    k = len(sids)
    bits = [int.from_bytes(m, "little") for m in maps]
    label = list(range(k))
    for i in range(k):
        for j in range(i + 1, k):
            if label[i] == label[j] or DEN * min(ns[i], ns[j]) < NUM * max(ns[i], ns[j]):
                continue
            x, y, wx, wy = bits[i], bits[j], len(maps[i]), len(maps[j])
            while wx > wy:
                wx //= 2
                x = (x >> (8 * wx)) | (x & ((1 << (8 * wx)) - 1))
            while wy > wx:
                wy //= 2
                y = (y >> (8 * wy)) | (y & ((1 << (8 * wy)) - 1))
            both = (x & y).bit_count()
            if min(ns[i] - x.bit_count() + both, ns[j] - y.bit_count() + both) >= needed(ns[i], ns[j]):
                old, new = label[j], label[i]
                label = [new if v == old else v for v in label]
                yield sids[i], sids[j]


def true_links(sids, arrays):
    """Spanning forest of the pairs of one tile that reach the threshold, by exact intersection."""
    order = sorted(range(len(sids)), key=lambda i: len(arrays[i]))
    sids, arrays = [sids[i] for i in order], [arrays[i] for i in order]
    ns = np.array([len(a) for a in arrays])
    bits = bitmap_bits(int(np.median(ns)))
    maps = np.stack([np.frombuffer(bitmap(a, bits), U) for a in arrays])
    pops = np.bitwise_count(maps).sum(1).astype(np.int64)
    fresh = np.ones(len(sids), bool)
    for start in range(len(sids)):
        if not fresh[start]:
            continue
        fresh[start] = False
        front = [start]
        while front:
            x = front.pop()
            n, mine = int(ns[x]), arrays[x]
            lo, hi = np.searchsorted(ns, -(-NUM * n // DEN)), np.searchsorted(ns, n * DEN // NUM, "right")
            at = np.arange(lo, hi)[fresh[lo:hi]]
            if not len(at):
                continue
            both = np.bitwise_count(maps[at] & maps[x]).sum(1).astype(np.int64)
            most = np.minimum(n - pops[x] + both, ns[at] - pops[at] + both)
            at = at[most >= -(-NUM * (n + ns[at]) // (NUM + DEN))]
            while len(at):
                take = max(1, int(np.searchsorted(np.cumsum(ns[at]), TILE_SHINGLES, "right")))
                now, at = at[:take], at[take:]
                theirs = np.concatenate([arrays[y] for y in now])
                spot = np.minimum(np.searchsorted(mine, theirs), n - 1)
                begin = np.cumsum(ns[now]) - ns[now]
                shared = np.add.reduceat((mine[spot] == theirs).astype(np.int64), begin)
                for y in now[DEN * shared >= NUM * (n + ns[now] - shared)]:
                    fresh[y] = False
                    front.append(int(y))
                    yield sids[x], sids[y]


def _edge_stream(keys, each, columns):
    def run(batches):
        out: set[tuple[int, int]] = set()

        def flush():
            a, b = [x[0] for x in out], [x[1] for x in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for table in groups(batches, keys):
            for a, b in each(*(table.column(c) for c in columns)):
                out.add((min(a, b), max(a, b)))
            if len(out) >= FLUSH_ROWS:
                yield flush()
        yield flush()

    return run


def _bound_each(sid, n, bits):
    sids = sid.to_pylist()
    if len(sids) > 1:
        yield from bound_links(sids, n.to_pylist(), bits.to_pylist())


def _true_each(sid, arr):
    once = dict(zip(sid.to_pylist(), arr.to_pylist(), strict=True))
    if len(once) > 1:
        yield from true_links(list(once), [np.frombuffer(x, U) for x in once.values()])


def _dealt(own: str, blocks: str, band: str):
    """Tiles of a member: one for all, or, of several blocks, those in which it meets each block of its and the next bands."""
    one = F.array(F.struct(F.lit(0).alias("band"), F.lit(0).alias("step"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    own, band = F.col(own), F.col(band)
    many = F.flatten(F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda t: F.array(
        F.struct(band.alias("band"), F.lit(0).alias("step"), F.least(own, t).alias("i"), F.greatest(own, t).alias("j")),
        F.struct(band.alias("band"), F.lit(1).alias("step"), own.alias("i"), t.alias("j")),
        F.struct((band - 1).alias("band"), F.lit(1).alias("step"), t.alias("i"), own.alias("j")),
    )))
    return F.explode(F.when(F.col(blocks) == 1, one).otherwise(many))


def _banded(df: DataFrame, name: str) -> DataFrame:
    """With the size band (sets further than one band apart never link) and the member's own block."""
    return df.withColumn("size_band", F.floor(F.log("n") / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")).withColumn("own", F.pmod(F.xxhash64(name), "blocks").cast("int"))


def set_links(docs: DataFrame, scratch: Scratch, sets: DataFrame, counts: tuple[np.ndarray, float], named, split_names: bool, k: int = SHINGLE) -> DataFrame:
    """Edges ``a, b`` between set ids: a spanning forest of all links between different sets."""
    spark = docs.sparkSession
    posts = named(postings(docs, spark.sparkContext.broadcast(counts), k, split_names))  # 4 MB, whatever the input
    # rows of a shingle meet once; those of one that very many sets share, in parts
    salt = F.pmod(F.xxhash64("sid"), "parts").cast("int")
    posts = posts.withColumn("salt", salt).repartition("h", "salt")
    # a set whose copies several tasks read counts once; else its own copies would make buckets, all of one gid
    posts = posts.groupBy("h", "salt", "sid").agg(F.first("n").alias("n"), (F.first("parts") > 1).alias("hot"))
    names, part = ("size", "x", "y"), Window.partitionBy("h", "salt")
    members = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("sid")), F.bit_xor(F.xxhash64("sid", F.lit(7))))
    posts = posts.select("h", "salt", "sid", "n", "hot", *(m.over(part).alias(x) for m, x in zip(members, names, strict=True))).where("size > 1 or hot")
    posts = scratch.save(posts, "members")
    hot = posts.where("hot")
    whole = hot.select("h", "salt", *names).distinct().groupBy("h").agg(F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    hot = hot.drop(*names).join(whole, "h").select("sid", "n", *names)
    posts = posts.where("not hot").select("sid", "n", *names).unionByName(hot).where("size > 1")
    posts = scratch.save(posts.groupBy(F.xxhash64(*names).alias("gid"), "sid").agg(F.first("n").alias("n")), "posts")
    scratch.drop("members")
    # a large bucket, by the members it has, is dealt in blocks of its size bands, which meet pairwise
    large = posts.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / BUCKET_DOCS).cast("int").alias("blocks")).where("blocks > 1")
    meets = _banded(posts.join(large, "gid", "left").fillna(1, ["blocks"]), "sid")
    meets = meets.select("gid", "sid", _dealt("own", "blocks", "size_band").alias("t")).select("gid", "sid", "t.*")
    key = ("gid", "band", "step", "i", "j")
    tiles = meets.join(sets.select("sid", "n", "bits"), "sid").repartition(*key).sortWithinPartitions(*key)
    maybe = tiles.mapInArrow(_edge_stream(key, _bound_each, ("sid", "n", "bits")), "a long, b long")
    groups_ = scratch.save(components(scratch, maybe, "maybe"), "groups")
    scratch.drop("posts")
    # exact tiles of each candidate component
    wanted = spark.sparkContext.broadcast(_wanted(groups_, sets, split_names))  # 1 MB
    sized = groups_.join(sets.select(F.col("sid").alias("node"), "n"), "node").withColumnRenamed("node", "sid")
    heavy = sized.groupBy("root").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > TILE_SHINGLES)
    heavy = scratch.save(heavy.select("root"), "heavy")
    arrays = named(shingle_arrays(docs, wanted, k)).select("sid", "arr")
    links = _tiled(arrays.join(sized.join(heavy, "root", "left_anti").select("sid", "root"), "sid"), ("root",))
    if heavy.isEmpty():  # saves a pass over the texts, no more
        return links
    of_large = arrays.join(sized.join(heavy, "root").select("sid", "root", "n"), "sid")
    of_large = of_large.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("root", "n", "arr")))
    return links.unionByName(large_links(scratch, scratch.save(of_large, "large")))


def _tiled(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """A spanning forest of the links of each tile."""
    tiles = rows.repartition(*key).sortWithinPartitions(*key)
    return tiles.mapInArrow(_edge_stream(key, _true_each, ("sid", "arr")), "a long, b long")


def large_links(scratch: Scratch, members: DataFrame) -> DataFrame:
    """Links of ``members (sid, root, n, arr)`` that connect all sets of a ``root`` which links connect.

    A root's sets are dealt in blocks by hash, so a set travels once, and meet there.  Up to ``HUBS`` sets with most
    links stand for each connected part in the next round, dealt anew, while rounds connect anything.  Sets
    of one part need not meet any more.  Of a root in several parts, those outside the one of most shingles are
    the rest: they meet that part, and each other, in tiles of size-band blocks.
    """
    links, meet, before = None, members, None
    for nth in range(MEETINGS):
        blocks = meet.groupBy("root").agg(F.ceil(F.sum("n") / TILE_SHINGLES).alias("blocks"))
        dealt = meet.join(blocks, "root").select("sid", "arr", "root", F.pmod(F.xxhash64("sid", F.lit(nth)), "blocks").alias("own"))
        found = scratch.save(_tiled(dealt, ("root", "own")), f"found{nth}")
        links = found if links is None else links.unionByName(found)
        parts = components(scratch, links, f"part{nth}").select(F.col("node").alias("sid"), F.col("root").alias("part"))
        known = members.select("sid", "root", "n").join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
        known = scratch.save(known, f"known{nth}")
        sizes = scratch.save(known.groupBy("root", "part").agg(F.sum("n").alias("shingles")), f"sizes{nth}")
        main = sizes.groupBy("root").agg(F.max(F.struct("shingles", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        main = scratch.save(main.select("root", F.col("most.part").alias("main")), f"main{nth}")
        still = sizes.count()
        if main.isEmpty() or still == before:
            break
        before = still
        degree = links.select(F.col("a").alias("sid")).union(links.select("b")).groupBy("sid").agg(F.count(F.lit(1)).alias("degree"))
        best = Window.partitionBy("part").orderBy(F.desc_nulls_last("degree"), "sid")
        hubs = known.join(main, "root").join(degree, "sid", "left").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= HUBS)
        meet = members.join(hubs.select("sid"), "sid", "left_semi")
    if main.isEmpty():
        return links
    half = TILE_SHINGLES // 2
    apart = known.join(main, "root").withColumn("far", F.col("part") != F.col("main"))
    blocks = apart.groupBy("root", "far").agg(F.ceil(F.sum("n") / half).cast("int").alias("blocks"))
    apart = scratch.save(_banded(apart.join(blocks, ["root", "far"]), "sid").select("sid", "root", "far", "blocks", "size_band", "own"), "apart")
    rest, core = apart.where("far"), apart.where("not far")
    among = rest.select("sid", "root", _dealt("own", "blocks", "size_band").alias("t")).select("sid", "root", F.lit(-1).alias("side"), "t.*")
    # a tile of both: one block and band of the rest, one block of the part, which sends the bands that may link
    spots = rest.select("root", F.col("size_band").alias("band"), F.col("own").alias("i")).distinct()
    many = core.select("root", F.col("blocks").alias("core_blocks")).distinct()
    tile = ("root", F.lit(0).alias("side"), "band", F.lit(0).alias("step"), "i", "j")
    sent = rest.join(many, "root").select("sid", "root", F.col("size_band").alias("band"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("core_blocks") - 1)).alias("j"))
    near = F.explode(F.array(*(F.col("size_band") + d for d in (-1, 0, 1))))
    met = core.select("sid", "root", F.col("own").alias("j"), near.alias("band")).join(spots, ["root", "band"])
    tiles = among.unionByName(sent.select("sid", *tile)).unionByName(met.select("sid", *tile))
    return links.unionByName(_tiled(tiles.join(members.select("sid", "arr"), "sid"), ("root", "side", "band", "step", "i", "j")))


def _wanted(groups_: DataFrame, sets: DataFrame, split_names: bool) -> np.ndarray:
    """Filter of the first hashes of the sets that have candidates."""
    if not split_names:
        return sketch.key_filter(groups_, "node")
    return sketch.key_filter(groups_.join(sets.select(F.col("sid").alias("node"), "hashed"), "node").select("hashed"), "hashed")


def classes(docs: DataFrame, id_col: str, text_col: str, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Per row ``id, print, sid, n``, and per set ``sid, root, least``: ``least`` is the first row of the class.

    ``print`` is a hash of the text.  The first row of a class has the least id, null ids last, then the
    least set and print.  ``sid`` is null for an empty set.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).alias("text"))
    signed = scratch.save(signatures(docs, k), "signed")
    counts = standing_out(sketch.merged(signed.where("slice is not null")))
    rows = signed.where("slice is null").select("id", "print", "sid", "sid2", "n", "bits")
    full = rows.where("n > 0")
    # names that different sets share: rare at any size, and then made anew from both hashes
    shared = scratch.save(full.groupBy("sid").agg(F.min("sid2").alias("lo"), F.max("sid2").alias("hi")).where("lo <> hi").select(F.col("sid").alias("shared")), "shared")
    split_names = not shared.isEmpty()

    def named(df: DataFrame) -> DataFrame:
        if not split_names:
            return df
        hit = df.join(shared, F.col("sid") == F.col("shared"), "left")
        return hit.withColumn("sid", F.when(F.col("shared").isNull(), F.col("sid")).otherwise(F.xxhash64("sid", "sid2"))).drop("shared")

    if split_names:
        full = named(full.withColumn("hashed", F.col("sid")))
    else:
        full = full.withColumn("hashed", F.col("sid"))
    first = F.min(F.struct(F.col("id").isNull().alias("nil"), F.col("id"), F.col("print")))
    sets = scratch.save(full.groupBy("sid").agg(F.first("hashed").alias("hashed"), F.first("n").alias("n"), F.first("bits").alias("bits"), first.alias("least")), "sets")
    links = set_links(docs, scratch, sets, counts, named, split_names, k)
    roots = scratch.save(components(scratch, links, "links"), "roots")
    # the first row of every component, then of every set
    of_set = sets.join(roots, sets["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    of_root = of_set.groupBy("root").agg(F.min(F.struct("least.nil", "least.id", "sid", "least.print")).alias("least"))
    of_set = scratch.save(of_set.drop("least").join(of_root, "root"), "classes")
    return named(rows).select("id", "print", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")), of_set


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per row of ``docs``.

    A null or wordless text has an empty set and its own id as component; fewer than ``k`` words make
    one shingle.  Repeated rows and ties share the least id of their component; null ids are ignored in
    that minimum.  Extra columns are ignored; an empty table gives no rows.
    """
    rows, of_set = classes(docs, id_col, text_col, k, Scratch(docs.sparkSession, "ngram"))
    # one set may hold a third of all rows: plain exchanges on both sides, split at run time
    out = rows.join(of_set.select("sid", F.col("least.id").alias("component_id")), "sid", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per near-duplicate component, with its columns.

    The row of least id stays, null ids last; of several with that id, the one of least set and text hash;
    of rows alike in id and text, any one.  Rows without words are linked with nothing and all stay.
    """
    i, hashed, copies = unused(docs, "kept_id", "kept_print", "kept_copies")
    scratch = Scratch(docs.sparkSession, "near-kept")
    rows, of_set = classes(docs, id_col, text_col, k, scratch)
    kept = of_set.groupBy("root").agg(F.first("least").alias("least")).select(F.col("least.id").alias(i), F.col("least.print").alias(hashed))
    # how many rows are alike in id and text
    alike = rows.where("n > 0").join(kept.hint("shuffle_hash"), same("id", i) & (F.col("print") == F.col(hashed)), "left_semi")
    kept = scratch.save(alike.groupBy(F.col("id").alias(i), F.col("print").alias(hashed)).agg(F.count(F.lit(1)).alias(copies)), "kept")
    match = same(F.col(id_col), F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(hashed))
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = docs.where(~wordless).join(kept.where(F.col(copies) == 1).hint("shuffle_hash"), match, "left_semi").unionByName(docs.where(wordless))
    repeated = kept.where(F.col(copies) > 1)
    if repeated.isEmpty():  # saves a pass over the texts, no more
        return out
    return out.unionByName(docs.join(repeated.hint("shuffle_hash"), match).dropDuplicates([i, hashed]).select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, list_sort(sh) AS sh FROM s),
g AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n, list(doc_id) AS ids FROM t GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM g WHERE n > 0),
f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
i AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
      FROM e a JOIN f USING (x) JOIN e b USING (x)
      WHERE a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * o >= 75 * (na + nb - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM g UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.root END AS component_id
FROM s JOIN (SELECT rep, unnest(ids) AS doc_id FROM g) k USING (doc_id) JOIN m ON m.node = k.rep
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

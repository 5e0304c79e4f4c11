"""Hard-negative mining by a dual-tree search for inner products.

Two ball trees, one over anchors and one over candidates, are fitted on bounded samples; every row is then
routed to a leaf, and a leaf's radius and largest norm come from all its rows.  A pair of nodes bounds the
inner products of all their rows by an interval; the pair is dropped, with the whole group of anchors below
it, if the interval lies outside what these anchors can still use, and opened otherwise.  What is left are
pairs of leaves, scored exactly in tiles of fixed size.

Both searches take two rounds: each group of anchors first meets the one leaf that promises most, which
tells how good a row must be; then all other pairs that may hold one.  Positives are the best rows of the
anchor's own label.  Negatives lie between two shares of a positive's score, so both ends of the interval prune.

Scores are exact: components are whole numbers, products of doubles below 2^53 and of 64-bit integers beyond.
Of equal vectors of one label only those of the ``positives + 1`` least ids can be a result, so further
copies are left out before any row is moved.

Defined results: rows with null id, label or vector, or with a null or non-finite component, or with one too
large for exact scores (dimension times its square beyond 2^56), take no part; rows of different dimension do not
meet; ties go to the smaller id; an anchor that is repeated is answered once, a repeated candidate is a row of
its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .ngram_join import groups

#: Rows on which a tree is fitted at most, about.
SAMPLE = 16384
#: Rows that a leaf is meant for, of anchors and candidates, and the most leaves of a tree.
ANCHOR_LEAF, LEAF = 2048, 4096
ANCHOR_LEAVES, LEAVES = 256, 1024
#: Rows of a leaf that one tile holds, and anchors that are scored at once.
ANCHOR_BLOCK, BLOCK, STRIP = 2048, 8192, 128
#: Slack of the bounds, for rounding.
SLACK = 1e-9
TILE = ("g", "l", "ab", "cb")


class Tree:
    """A ball tree on a sample: nodes are halved along their longest direction, the fullest first.

    ``kids[i]`` are the children of node ``i`` or None; leaves are numbered in ``leaf``.  ``radius`` and
    ``norm`` hold for all rows once ``bound`` has seen the leaves' figures; a node without rows has radius -1.
    """

    def __init__(self, x: np.ndarray, leaves: int):
        self.centre, self.kids, self.cut, parts = [], [], [], []

        def node(at):
            self.centre.append(x[at].mean(0))
            self.kids.append(None)
            self.cut.append(None)
            parts.append(at)
            return len(parts) - 1

        heap = [(-len(x), node(np.arange(len(x))))]
        n = 1
        while n < leaves and heap:
            _, i = heapq.heappop(heap)
            at = parts[i]
            far = x[at[((x[at] - self.centre[i]) ** 2).sum(1).argmax()]]
            way = x[at[((x[at] - far) ** 2).sum(1).argmax()]] - far
            along = x[at] @ way
            middle = np.median(along)
            below = along < middle if (along < middle).any() else along <= middle
            if below.all() or not below.any():
                continue
            self.cut[i] = (way, float(middle), bool((along < middle).any()))
            self.kids[i] = (node(at[below]), node(at[~below]))
            for k in self.kids[i]:
                heapq.heappush(heap, (-len(parts[k]), k))
            n += 1
        self.centre = np.array(self.centre)
        self.leaf = {i: n for n, i in enumerate(i for i, k in enumerate(self.kids) if k is None)}
        self.radius = self.norm = None

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            i, at = todo.pop()
            if self.kids[i] is None:
                out[at] = self.leaf[i]
                continue
            way, middle, strict = self.cut[i]
            along = x[at] @ way
            below = along < middle if strict else along <= middle
            todo += [(self.kids[i][0], at[below]), (self.kids[i][1], at[~below])]
        return out

    def leaf_centres(self) -> np.ndarray:
        return self.centre[list(self.leaf)]

    def bound(self, far: dict[int, float], norm: dict[int, float]) -> None:
        """Radii and norms of all nodes from the leaves' largest distances and norms."""
        self.radius, self.norm = np.full(len(self.kids), -1.0), np.zeros(len(self.kids))
        for i in range(len(self.kids) - 1, -1, -1):  # children come after their parent
            if self.kids[i] is None:
                self.radius[i], self.norm[i] = far.get(self.leaf[i], -1.0), norm.get(self.leaf[i], 0.0)
                continue
            for k in self.kids[i]:
                if self.radius[k] >= 0:
                    self.radius[i] = max(self.radius[i], self.radius[k] + np.sqrt(((self.centre[k] - self.centre[i]) ** 2).sum()))
                    self.norm[i] = max(self.norm[i], self.norm[k])

    def spread(self, of_leaf: dict[int, float], pick, empty: float) -> np.ndarray:
        """``pick`` (min or max) of a figure of the leaves, for all nodes."""
        out = np.full(len(self.kids), empty)
        for i in range(len(self.kids) - 1, -1, -1):
            out[i] = of_leaf.get(self.leaf[i], empty) if self.kids[i] is None else pick(out[k] for k in self.kids[i])
        return out


def interval(a: Tree, i: int, c: Tree, j: int) -> tuple[float, float]:
    """Between which values all inner products of the rows of two nodes lie."""
    middle = float(a.centre[i] @ c.centre[j])
    ca, cc = np.sqrt(a.centre[i] @ a.centre[i]), np.sqrt(c.centre[j] @ c.centre[j])
    reach = a.radius[i] * cc + c.radius[j] * ca + a.radius[i] * c.radius[j]
    most = a.norm[i] * c.norm[j]
    slack = SLACK * (most + ca * cc + reach) + SLACK
    return max(middle - reach, -most) - slack, min(middle + reach, most) + slack


def open_pairs(a: Tree, c: Tree, least: dict[int, float], most: dict[int, float]) -> list[tuple[int, int]]:
    """Pairs of leaves whose interval meets what the anchors can use: from ``least`` to ``most`` by anchor leaf."""
    low, high = a.spread(least, min, np.inf), a.spread(most, max, -np.inf)
    out, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        if a.radius[i] < 0 or c.radius[j] < 0 or low[i] > high[i]:
            continue
        lo, hi = interval(a, i, c, j)
        if hi < low[i] or lo > high[i]:
            continue
        ka, kc = a.kids[i], c.kids[j]
        if ka is None and kc is None:
            out.append((a.leaf[i], c.leaf[j]))
        elif kc is None or (ka is not None and a.radius[i] * c.norm[j] > c.radius[j] * a.norm[i]):
            todo += [(k, j) for k in ka]
        else:
            todo += [(i, k) for k in kc]
    return out


def matrix(column) -> np.ndarray:
    """Rows of an array column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exactly: in doubles where they hold them, else in integers."""
    if np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * max(1, a.shape[1]) < 2.0**53:
        return a @ c.T
    return a.astype(np.int64) @ c.astype(np.int64).T


def best(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first ``k`` allowed entries of every row: higher first, ties by column."""
    s = np.where(ok, s, -np.inf if s.dtype.kind == "f" else np.iinfo(np.int64).min)
    if s.shape[1] > k:
        ok = ok & (s >= np.partition(s, -k, axis=1)[:, -k, None])
    row, col = np.nonzero(ok)
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    first = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1)) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[rank < k], col[rank < k]


def halves(tile: pa.Table):
    """Anchors and candidates of a tile, candidates by id; labels as numbers of the tile."""
    tile = tile.combine_chunks()
    label = tile.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    role, ids, q = tile.column("role").to_numpy(), tile.column("id").to_numpy(), matrix(tile.column("q"))
    a, c = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    return a, c[np.argsort(ids[c], kind="stable")], label, ids, q


def positive_tiles(k: int):
    """Per anchor of a tile its first ``k`` rows of the same label: ``id, key, other, score``."""

    def run(batches):
        for tile in groups(batches, TILE):
            a, c, label, ids, q = halves(tile)
            key = tile.column("key").to_numpy()
            for one in np.unique(label[a]):
                mine, others = a[label[a] == one], c[label[c] == one]
                for at in range(0, len(mine), STRIP):
                    some = mine[at : at + STRIP]
                    s = products(q[some], q[others])
                    ok = np.ones(s.shape, bool)
                    lo, hi = np.searchsorted(ids[others], ids[some]), np.searchsorted(ids[others], ids[some], "right")
                    for i in np.flatnonzero(hi > lo):  # the anchor's own row
                        own = np.flatnonzero((q[others[lo[i] : hi[i]]] == q[some[i]]).all(1))
                        ok[i, lo[i] + own[:1]] = False
                    row, col = best(s, ok, k)
                    if len(row):
                        who = some[row]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(key[who]), pa.array(ids[others[col]]), pa.array(s[row, col].astype(np.int64))], ["id", "key", "other", "score"])

    return run


def negative_tiles(k: int):
    """Per anchor of a tile and window its first ``k`` rows of another label: ``id, key, nth, other, score``."""

    def run(batches):
        for tile in groups(batches, TILE):
            a, c, label, ids, q = halves(tile)
            if not len(a) or not len(c):
                continue
            key, windows = tile.column("key").to_numpy(), tile.column("windows")
            for at in range(0, len(a), STRIP):
                some = a[at : at + STRIP]
                s = products(q[some], q[c])
                other = label[some][:, None] != label[c]
                spans = [[(w["lo"], w["hi"]) for w in windows[int(i)].as_py()] for i in some]
                for j in range(max(map(len, spans))):
                    lo, hi = (np.array([w[j][e] if j < len(w) else (1, 0)[e] for w in spans], np.int64)[:, None] for e in (0, 1))
                    row, col = best(s, other & (s >= lo) & (s <= hi), k)
                    if len(row):
                        who = some[row]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(key[who]), pa.array(np.full(len(row), j, np.int32)), pa.array(ids[c[col]]), pa.array(s[row, col].astype(np.int64))], ["id", "key", "nth", "other", "score"])

    return run


def sampled(rows: DataFrame, total: int) -> np.ndarray:
    """About ``SAMPLE`` vectors at most, picked by a hash of id and vector, in its order."""
    some = rows.select("q", F.xxhash64("id", "q").alias("h"))
    if total > SAMPLE:
        some = some.where(F.col("h") < int((2 * SAMPLE / total - 1) * 2.0**63))
    return matrix(some.toArrow().combine_chunks().sort_by("h").column("q"))


def grown(scratch: Scratch, rows: DataFrame, name: str, leaf_rows: int, leaves: int) -> tuple[Tree, DataFrame, dict[int, int]]:
    """A tree over ``rows``, the rows with their leaf in ``at``, and rows by leaf."""
    total = rows.count()
    x = sampled(rows, total)
    tree = Tree(x if len(x) else matrix(rows.select("q").limit(1).toArrow().column("q")), int(np.clip(-(-total // leaf_rows), 1, leaves)))
    sent = rows.sparkSession.sparkContext.broadcast(tree)
    kind = dict(rows.dtypes)

    def make():
        own = sent.value
        centres = own.leaf_centres()

        def step(batch: pa.RecordBatch):
            x = matrix(batch.column("q"))
            at = own.route(x)
            far = np.sqrt(((x - centres[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], [*batch.schema.names, "at", "far", "norm"])

        return step

    schema = ", ".join(f"{c} {kind[c]}" for c in rows.columns) + ", at int, far double, norm double"
    routed = scratch.save(arrow_map(rows, make, schema), name)
    figures = routed.groupBy("at").agg(F.count(F.lit(1)), F.max("far"), F.max("norm")).collect()  # one row per leaf
    tree.bound({r[0]: r[2] for r in figures}, {r[0]: r[3] for r in figures})
    return tree, routed.drop("far", "norm"), {r[0]: r[1] for r in figures}


def scored(anchors: DataFrame, rows: DataFrame, pairs, sizes, run, schema: str) -> DataFrame:
    """The tiles of ``pairs`` of leaves: blocks of anchors meet blocks of candidates.

    The pairs, at most ``ANCHOR_LEAVES * LEAVES`` of four numbers, are broadcast.
    """
    spark = anchors.sparkSession
    of_anchor, of_row = sizes
    listed = [(g, c, -(-of_anchor[g] // ANCHOR_BLOCK), -(-of_row[c] // BLOCK)) for g, c in sorted(pairs)]
    listed = F.broadcast(spark.createDataFrame(listed, "g int, l int, na int, nc int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = anchors.withColumnRenamed("at", "g").join(listed, "g").withColumns({"ab": F.pmod("key", "na").cast("int"), "cb": spread("nc"), "role": F.lit(0)})
    other = rows.withColumnRenamed("at", "l").join(listed, "l").withColumns({"cb": F.pmod(F.xxhash64("id"), "nc").cast("int"), "ab": spread("na"), "role": F.lit(1), "key": F.lit(0).cast("long")})
    tiles = mine.drop("na", "nc").unionByName(other.drop("na", "nc"), allowMissingColumns=True)
    return tiles.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(run, schema)


def first_pairs(a: Tree, c: Tree, groups_of, worth) -> list[tuple[int, int]]:
    """The candidate leaf that promises most to each anchor leaf, by ``worth`` of the products of centres."""
    full = [(i, n) for i, n in c.leaf.items() if c.radius[i] >= 0]
    out = []
    for i, g in a.leaf.items():
        if g in groups_of and full:
            value = worth(g, np.array([a.centre[i] @ c.centre[j] for j, _ in full]))
            out.append((g, full[int(np.argmax(value))][1]))
    return out


def mined(scratch: Scratch, rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int, tag: str) -> DataFrame:
    """``mine`` for rows ``id, label, q`` and anchors ``id, label, q, key`` of one dimension."""
    a, anchors, of_anchor = grown(scratch, anchors, f"anchors-{tag}", ANCHOR_LEAF, ANCHOR_LEAVES)
    c, rows, of_row = grown(scratch, rows, f"rows-{tag}", LEAF, LEAVES)
    sizes = (of_anchor, of_row)
    found = "id long, key long, other long, score long"
    order = (F.col("score").desc(), "other")
    who = ["id", "key"]

    first = first_pairs(a, c, of_anchor, lambda g, x: x)
    one = scratch.save(scored(anchors, rows, first, sizes, positive_tiles(positives), found), f"positives-{tag}-1")
    rank = F.row_number().over(Window.partitionBy(*who).orderBy(*order))
    worst = one.withColumn("nth", rank).where(F.col("nth") == positives).select(*who, "score")
    need = anchors.select(*who, "at").join(worst, who, "left").groupBy("at").agg(F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("least"))
    least = dict(need.collect())  # one row per anchor leaf
    pairs = set(open_pairs(a, c, least, dict.fromkeys(least, np.inf))) - set(first)
    two = scratch.save(scored(anchors, rows, pairs, sizes, positive_tiles(positives), found), f"positives-{tag}-2")
    top = one.unionByName(two).withColumn("nth", rank).where(F.col("nth") <= positives)

    # a positive's window in whole scores: low * p <= 100 * n <= high * p
    lo, hi = F.expr(f"({low} * score + 99) div 100"), F.expr(f"({high} * score) div 100")
    top = top.where("score >= 0").select(*who, (F.col("nth") - 1).cast("int").alias("nth"), F.col("other").alias("positive"), F.col("score").alias("pscore"), lo.alias("lo"), hi.alias("hi"))
    top = scratch.save(top.where("lo <= hi"), f"top-{tag}")

    def armed(windows):
        held = windows.groupBy(*who).agg(F.array_sort(F.collect_list(F.struct("nth", "lo", "hi"))).alias("windows"))  # at most ``positives``
        return anchors.join(held, who)

    found = "id long, key long, nth int, other long, score long"
    # windows are told apart by their place in the anchor's list
    top = top.withColumn("w", (F.row_number().over(Window.partitionBy(*who).orderBy("nth")) - 1).cast("int"))
    ready = scratch.save(armed(top), f"armed-{tag}")
    ends = {r[0]: (r[1], r[2]) for r in ready.groupBy("at").agg(F.min(F.array_min("windows.lo")), F.max(F.array_max("windows.hi"))).collect()}  # one row per anchor leaf
    first = first_pairs(a, c, ends, lambda g, x: -np.abs(x - ends[g][1]))
    one = scratch.save(scored(ready, rows, first, sizes, negative_tiles(negatives), found), f"negatives-{tag}-1")
    nth = F.row_number().over(Window.partitionBy(*who, "nth").orderBy(*order))
    worst = one.withColumn("r", nth).where(F.col("r") == negatives).select(*who, F.col("nth").alias("w"), F.col("score").alias("least"))
    tight = scratch.save(armed(top.join(worst, [*who, "w"], "left").withColumn("lo", F.greatest("lo", F.coalesce("least", "lo")))), f"tight-{tag}")
    ends = {r[0]: (r[1], r[2]) for r in tight.groupBy("at").agg(F.min(F.array_min("windows.lo")), F.max(F.array_max("windows.hi"))).collect()}  # one row per anchor leaf
    pairs = set(open_pairs(a, c, {g: e[0] for g, e in ends.items()}, {g: e[1] for g, e in ends.items()})) - set(first)
    two = scored(tight, rows, pairs, sizes, negative_tiles(negatives), found)
    chosen = one.unionByName(two).withColumn("rank", nth).where(F.col("rank") <= negatives).withColumnRenamed("nth", "w")
    out = chosen.join(top, [*who, "w"])
    return out.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its
    best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score is between
    ``low`` and ``high`` percent of the positive's.  Scores are inner products of ``floor(scale * component)``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    v = F.col(vector_col).cast("array<double>")
    limit = F.sqrt(F.lit(2.0**56) / F.greatest(F.size("v"), F.lit(1)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(~F.exists("v", lambda x: F.abs(F.floor(scale * x)) > limit))
    rows = rows.select("id", "label", "anchor", F.transform("v", lambda x: F.floor(scale * x).cast("int")).alias("q")).withColumns({"dim": F.size("q"), "h": F.xxhash64("label", "q")})
    alike = Window.partitionBy("dim", "h", "label", "q").orderBy("id")
    units = scratch.save(rows.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= positives + 1).select("dim", "id", "label", "q"), "units")
    asked = rows.where("anchor").select("dim", "id", "label", "q", F.xxhash64("id", "h").alias("key")).dropDuplicates(["id", "key", "label", "q"])
    asked = scratch.save(asked, "asked")
    out = None
    for (dim,) in asked.select("dim").distinct().orderBy("dim").collect():  # one row per dimension
        one = mined(scratch, units.where(F.col("dim") == dim).drop("dim"), asked.where(F.col("dim") == dim).drop("dim"), positives, negatives, low, high, str(dim))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


ORACLE = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)

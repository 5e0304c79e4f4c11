"""Embedding near-duplicates by product quantisation.

Unit vectors are assigned to coarse inverted lists, in two levels; an entry keeps its residual as subspace
codes and the length of what the codes miss.  A query probes every list that can hold a vector within the
radius (by the distance to the boundary between lists, on both levels), looks up distances in its table
of subspace distances, discards entries whose looked-up distance less their coding error is beyond the
radius, and ranks the rest by exact cosine in double precision.  Both prunings are bounds, so no link is
lost.

Codebooks are fitted, in double precision, on about ``SAMPLE`` vectors at most, those whose content hash is small; every vector
is indexed.  Equal vectors are one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, components
from .ngram_join import groups

COSINE = 0.98
#: Vectors on which the codebooks are fitted at most, about.
SAMPLE = 16384
SUBSPACES = 8
CODES = 64
#: Vectors of one list that a tile block holds, and lists for how many vectors.
BLOCK = 2048
PER_LIST = 4096
#: Sample vectors that a list is fitted on at least: so there are at most ``SAMPLE / LIST_SAMPLE`` lists.
LIST_SAMPLE = 8
#: Slack of the bounds, for rounding.
SLACK = 1e-6


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, from their products."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from evenly spaced rows; an empty cluster keeps its centre."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        order = np.argsort(near, kind="stable")
        some, first = np.unique(near[order], return_index=True)
        c[some] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return c


def between(c: np.ndarray) -> np.ndarray:
    """Distances of all rows from each other, from their differences: near rows keep theirs."""
    return np.stack([np.sqrt(((c - one) ** 2).sum(1)) for one in c])


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and the rows scaled by a power of two so that squares neither vanish nor overflow."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(vectors), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True)), x


class Codebook:
    """Coarse centres in two levels, ``lists`` of them in all, and the codes of their residuals.

    A vector belongs to its nearest top centre, and to the nearest of that one's own centres; the lists of
    top ``t`` are ``first[t] .. first[t + 1] - 1``.
    """

    def __init__(self, sample: np.ndarray, lists: int):
        dim = sample.shape[1]
        self.tops = k_means(sample, int(np.ceil(np.sqrt(lists))))
        home = squared(sample, self.tops).argmin(1)
        own = [sample[home == t] for t in range(len(self.tops))]
        subs = [k_means(x, round(lists * len(x) / len(sample))) if len(x) else top[None] for x, top in zip(own, self.tops, strict=True)]
        self.coarse = np.concatenate(subs)
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in subs])))
        self.top_gaps, self.gaps = between(self.tops), [between(c) for c in subs]
        cut = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        self.spans = list(zip(cut[:-1], cut[1:], strict=True))
        residual = sample - self.coarse[self.near(sample)]
        self.books = [k_means(residual[:, a:b], CODES) for a, b in self.spans]

    def of_top(self, t: int) -> np.ndarray:
        return self.coarse[self.first[t] : self.first[t + 1]]

    def near(self, x: np.ndarray) -> np.ndarray:
        top = squared(x, self.tops).argmin(1)
        out = np.zeros(len(x), np.int64)
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            out[at] = self.first[t] + squared(x[at], self.of_top(t)).argmin(1)
        return out

    @staticmethod
    def reached(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray, radius: float) -> np.ndarray:
        """Whose cells may hold a vector within ``radius``: it must lie on their side of the boundary."""
        d = squared(x, centres)
        own = d.argmin(1)
        ok = d - d[np.arange(len(x)), own][:, None] <= 2 * radius * gaps[own] + SLACK
        ok[np.arange(len(x)), own] = True
        return ok

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the lists that may hold a vector within ``radius``."""
        tops = self.reached(x, self.tops, self.top_gaps, radius)
        rows, lists = [], []
        for t in np.flatnonzero(tops.any(0)):
            at = np.flatnonzero(tops[:, t])
            row, one = np.nonzero(self.reached(x[at], self.of_top(t), self.gaps[t], radius))
            rows.append(at[row])
            lists.append(self.first[t] + one)
        return np.concatenate(rows), np.concatenate(lists)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of what they miss."""
        r = x - self.coarse[lists]
        codes = np.empty((len(x), len(self.spans)), np.uint8)
        for i, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            part = r[:, a:b]
            codes[:, i] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            r[:, a:b] -= book[codes[:, i]]
        return codes, np.sqrt((r * r).sum(1))

    def tables(self, x: np.ndarray, one: int) -> np.ndarray:
        """Squared distances of each query's residual to every code of every subspace."""
        r = x - self.coarse[one]
        return np.stack([np.pad(((r[:, None, a:b] - book[None]) ** 2).sum(2), ((0, 0), (0, CODES - len(book)))) for (a, b), book in zip(self.spans, self.books, strict=True)], 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, v, ok`` per row; single precision stays as it is, all else is double."""
    v = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x).cast("double")) > 0
    fine = v.isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(flat, F.lit(False))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("ok"))


def index_rows(units: DataFrame, book, cosine: float) -> DataFrame:
    """Per vector its entry ``(list, role 0)`` with codes and error, and its probes ``(list, role 1)``."""
    kind = dict(units.dtypes)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def make():
        b = book.value

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, _ = unit_rows(part.column("v"))
                own = b.near(x)
                codes, miss = b.encode(x, own)
                row, lists = b.probes(x, radius)
                n = len(x)
                pick = pa.array(np.concatenate((np.arange(n), row)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(pick), part.column("gid").take(pick), pa.array(np.concatenate((own, lists)).astype(np.int32)), pa.array(np.concatenate((np.zeros(n, np.int32), np.ones(len(row), np.int32)))),
                     part.column("copies").take(pick), part.column("v").take(pick), pa.array([c.tobytes() for c in codes] + [None] * len(row), pa.binary()), pa.array(np.concatenate((miss, np.zeros(len(row)))))],
                    ["label", "gid", "list", "role", "copies", "v", "codes", "miss"],
                )

        return step

    return arrow_map(units.select("label", "gid", "copies", "v"), make, f"label {kind['label']}, gid long, list int, role int, copies long, v {kind['v']}, codes binary, miss double")


def tile_links(tiles: DataFrame, book, cosine: float) -> DataFrame:
    """Per tile, each query's number of links with the tile's entries and a forest of the links.

    Rows ``a, b, n``: ``b`` is null for a count, ``n`` null for a link.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(batches):
        code = book.value
        for t in groups(batches, ("tile", "tile2", "list", "qi", "qj")):
            role = t.column("role").to_numpy()
            gid, copies = t.column("gid").to_numpy(), t.column("copies").to_numpy()
            e, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(e) or not len(q):
                continue
            x, raw = unit_rows(t.column("v").combine_chunks())
            one = int(t.column("list")[0].as_py())
            codes = np.frombuffer(b"".join(c for c in t.column("codes").to_pylist() if c is not None), np.uint8).reshape(len(e), -1)
            reach = (radius + t.column("miss").to_numpy()[e] + 1e-6) ** 2
            a, b, n, parent = [], [], [], {}

            def root(i, parent=parent):
                while parent.get(i, i) != i:
                    parent[i] = parent.get(parent[i], parent[i])
                    i = parent[i]
                return i

            for lo in range(0, len(q), 256):
                some = q[lo : lo + 256]
                table = code.tables(x[some], one)
                far = np.zeros((len(some), len(e)))
                for s in range(codes.shape[1]):
                    far += table[:, s][:, codes[:, s]]
                qs, es = np.nonzero(far <= reach)
                qs, es = some[qs], e[es]
                ok = gid[qs] != gid[es]
                qs, es = qs[ok], es[ok]
                for c in range(0, len(qs), 1 << 16):
                    qq, ee = qs[c : c + (1 << 16)], es[c : c + (1 << 16)]
                    u, v = raw[qq], raw[ee]
                    cos = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))
                    hit = cos >= cosine
                    qq, ee = qq[hit], ee[hit]
                    if not len(qq):
                        continue
                    who, back = np.unique(qq, return_inverse=True)
                    a += gid[who].tolist()
                    b += [None] * len(who)
                    n += np.bincount(back, copies[ee]).astype(np.int64).tolist()
                    for i, j in zip(gid[qq].tolist(), gid[ee].tolist(), strict=True):
                        i, j = root(i), root(j)
                        if i != j:
                            parent[j] = i
                            a.append(min(i, j))
                            b.append(max(i, j))
                            n.append(None)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return tiles.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample_rows: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row per row of ``vectors``.

    Links need equal non-null labels, equal dimension and a cosine of at least ``cosine``.  Null, zero and
    non-finite vectors link with nothing and stay.  Repeated rows and equal vectors link with each other;
    ``kept`` holds for every row with the component's least id.  A null id has no say in that minimum.
    Extra columns are ignored; an empty table gives no rows.  The codebooks are fitted on about
    ``sample_rows`` vectors at most.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "embed")
    rows = usable(vectors, id_col, vector_col, label_col)
    # equal vectors of a label are one entry; entries are told apart by two hashes of label and content
    content = ("label", F.size("v"), "v")
    rows = rows.select("id", "label", "v", "ok", *(F.when(F.col("ok"), F.xxhash64(*content, *salt)).alias(h) for h, salt in (("h1", ()), ("h2", (F.lit("second"),)))))
    units = rows.where("ok").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    units = scratch.save(units.withColumn("dim", F.size("v")), "units")
    # an entry is named by its first hash, or, where others have the same, by both
    shared = scratch.save(units.groupBy(F.col("h1").alias("shared")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shared"), "shared")
    named = units.withColumn("gid", F.col("h1"))
    if not shared.isEmpty():
        named = units.join(shared, F.col("h1") == F.col("shared"), "left").withColumn("gid", F.when(F.col("shared").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))).drop("shared")
    units = named
    found = []
    for dim, total in units.groupBy("dim").count().orderBy("dim").collect():  # one row per dimension
        own = units.where(F.col("dim") == dim)
        share = min(1.0, sample_rows / total)
        sample = own.select("v", F.xxhash64("v").alias("h"))
        if share < 1:  # content hashes are even, so this is about SAMPLE vectors, picked where they are read
            sample = sample.where(F.col("h") < int((2 * share - 1) * 2.0**63))
        sample = sample.toArrow().combine_chunks().sort_by("h")
        x = unit_rows(sample.column("v").combine_chunks())[0]
        book = sc.broadcast(Codebook(x, int(np.clip(total // PER_LIST, 1, max(1, len(x) // LIST_SAMPLE)))))
        indexed = scratch.save(index_rows(own, book, cosine), f"indexed-{dim}")
        # blocks of entries meet blocks of queries, list by list
        cell = indexed.groupBy("label", "list").agg(F.ceil(F.sum(1 - F.col("role")) / BLOCK).cast("int").alias("ne"), F.ceil(F.sum("role") / BLOCK).cast("int").alias("nq"))
        entries = indexed.where("role = 0").join(cell, ["label", "list"]).withColumns({"qi": F.pmod("gid", "ne").cast("int"), "qj": F.explode(F.sequence(F.lit(0), F.greatest("nq", F.lit(1)) - 1))})
        queries = indexed.where("role = 1").join(cell.where("ne > 0"), ["label", "list"]).withColumns({"qj": F.pmod("gid", "nq").cast("int"), "qi": F.explode(F.sequence(F.lit(0), F.col("ne") - 1))})
        tiles = entries.unionByName(queries).withColumns({"tile": F.xxhash64("label"), "tile2": F.xxhash64("label", F.lit("second"))}).drop("label", "ne", "nq")
        key = ("tile", "tile2", "list", "qi", "qj")
        found.append(tile_links(tiles.repartition(*key).sortWithinPartitions(*key), book, cosine))
    if not found:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = scratch.save(links, "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    roots = scratch.save(components(scratch, links.where("b is not null").select("a", "b")), "roots")
    of_unit = units.select("h1", "h2", "gid", "copies", "least").join(counts, "gid", "left").join(roots, F.col("gid") == F.col("node"), "left")
    of_unit = of_unit.select("h1", "h2", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "gid").alias("root"))
    least = of_unit.groupBy("root").agg(F.min("least").alias("component_id"))
    of_unit = scratch.save(of_unit.join(least, "root").select("h1", "h2", "n_links", "component_id"), "classes")
    # one vector may hold a third of all rows: plain exchanges on both sides, split at run time
    out = rows.select("id", "h1", "h2").join(of_unit, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS z FROM v
      WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.z * b.z) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, vec_id = c.root AS kept
FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

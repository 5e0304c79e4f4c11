"""Prefix trie of conversations by pointer jumping.

A node is a distinct sequence of first turns.  Its digest is the exclusive or of one hash per turn, keyed by
the turn's place, so a running exclusive or names all prefixes of a conversation and a node's parent is its
digest without the last turn: parent edges need no join.  Leaf counts and savings reach all ancestors in
doubling rounds: in round ``r`` every node of depth ``2^r`` or more hands what it holds of its nearest
``2^r`` levels to the ancestor ``2^r`` levels up, then points ``2^(r+1)`` levels up.  A trie of depth ``n``
takes ``log2(n)`` rounds, and a node takes part only while it has such an ancestor.

Nothing is held per conversation or node: turns are numbered by ranges, with the counts of earlier ranges
carried in; running digests by chunks of ``CHUNK`` turns, likewise; the ids that end at a node are joined in
pieces by ranges and digested as a stream, so a conversation, a node or a parent may hold a third of all rows.

Defined results: null role or text is empty; turns that tie are ordered by a digest of role and text; a row
without conversation id takes no part; extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: Turns of one conversation whose running digest is one window.
CHUNK = 1 << 12
#: Ids in one piece of a node's list.
PIECE = 1 << 9
NODE = ("p1", "p2")


def ordered_turns(scratch: Scratch, conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns ``c, p, k, w1, w2, bytes`` numbered ``k`` from 1, and per conversation and range ``c, p, n``.

    ``w1, w2`` are a digest of role and text, ``p`` a range of the order, ``n`` all turns of the conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.select("c", "t", part(1).alias("w1"), part(16).alias("w2"), "bytes")
    order = (F.col("t").asc_nulls_first(), "w1", "w2")
    dealt = scratch.save(rows.repartitionByRange("c", *order).withColumn("p", F.spark_partition_id()), "dealt")
    of_conv = Window.partitionBy("c")
    before = F.coalesce(F.sum("m").over(of_conv.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = dealt.groupBy("c", "p").agg(F.count(F.lit(1)).alias("m")).select("c", "p", before.alias("before"), F.sum("m").over(of_conv).alias("n"))
    spans = scratch.save(spans, "spans")
    place = F.row_number().over(Window.partitionBy("c", "p").orderBy(*order))
    ranked = dealt.join(spans.select("c", "p", "before"), ["c", "p"]).select("c", "p", (F.col("before") + place).alias("k"), "w1", "w2", "bytes")
    return scratch.save(ranked, "ranked"), spans.select("c", "p", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn ``c, d, len, w1, w2, bytes`` of place ``d`` its prefix: ``c, d, len, p1, p2, q1, q2, bytes``, ``q`` the parent."""
    keyed = turns.select("c", "d", "len", "bytes", F.xxhash64("d", "w1").alias("x1"), F.xxhash64("d", "w2").alias("x2"), F.floor((F.col("d") - 1) / CHUNK).alias("chunk"))
    both = lambda w: [F.bit_xor(x).over(w).alias(p) for x, p in (("x1", "p1"), ("x2", "p2"))]
    chunks = keyed.where(F.col("len") > CHUNK).groupBy("c", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carried = chunks.select("c", "chunk", *both(Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.select("c", "chunk", F.coalesce("p1", F.lit(0)).alias("c1"), F.coalesce("p2", F.lit(0)).alias("c2"))
    running = keyed.select("*", *both(Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))
    whole = running.join(carried, ["c", "chunk"], "left").withColumns({p: F.col(p).bitwiseXOR(F.coalesce(c, F.lit(0))) for p, c in (("p1", "c1"), ("p2", "c2"))})
    return whole.select("c", "d", "len", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "bytes")


def _pieces(size: int):
    """Sorted ``p1, p2, c`` to lists of up to ``size`` ids of one node."""

    def step(batch: pa.RecordBatch):
        p1, p2 = (batch.column(n).to_numpy() for n in NODE)
        change = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
        starts = np.unique(np.concatenate(([0], change, np.arange(0, batch.num_rows, size))))
        ends = np.append(starts[1:], batch.num_rows)
        names = pc.cast(batch.column("c"), pa.string()).to_pylist()
        blobs = [",".join(names[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        first = batch.column("c").take(pa.array(starts))
        yield pa.RecordBatch.from_arrays([pa.array(p1[starts]), pa.array(p2[starts]), first, pa.array(blobs, pa.string())], ["p1", "p2", "first", "ids"])

    return step


def _digests():
    """Pieces in order to one SHA-256 per node, a piece at a time."""
    now: list = [None, None]

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([now[0][0]], pa.int64()), pa.array([now[0][1]], pa.int64()), pa.array([now[1].hexdigest()])], ["p1", "p2", "ends_sha256"])

    def step(batch: pa.RecordBatch):
        done = []
        for p1, p2, ids in zip(*(batch.column(n).to_pylist() for n in ("p1", "p2", "ids")), strict=True):
            if (p1, p2) == now[0]:
                now[1].update(b"," + ids.encode())
                continue
            if now[0]:
                done.append((*now[0], now[1].hexdigest()))
            now[:] = [(p1, p2), hashlib.sha256(ids.encode())]
        if done:
            a, b, h = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h)], ["p1", "p2", "ends_sha256"])

    def finish():
        if now[0]:
            yield closed()

    step.finish = finish
    return step


def ends_digests(ends: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256`` of ``p1, p2, c``: the digest of a node's ids, ascending, joined by commas."""
    pieces = arrow_map(ends.repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c"), partial(_pieces, PIECE), "p1 long, p2 long, first long, ids string")
    return arrow_map(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first"), _digests, "p1 long, p2 long, ends_sha256 string")


def rolled_up(scratch: Scratch, nodes: DataFrame, depth: int) -> DataFrame:
    """Per node with descendants ``p1, p2, leaves, saved`` summed over its descendants, itself left out.

    ``nodes``: ``p1, p2, q1, q2, depth, leaves, saved``; ``q`` is the parent.
    """
    active = nodes.where("depth >= 1").select(*NODE, F.col("q1").alias("a1"), F.col("q2").alias("a2"), "depth", "leaves", "saved")
    given, step, i = [], 1, 0
    while step <= depth:
        up = scratch.save(active.groupBy("a1", "a2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), f"given-{i}")
        up = up.select(F.col("a1").alias("p1"), F.col("a2").alias("p2"), "leaves", "saved")
        given.append(up)
        step, i = 2 * step, i + 1
        if step > depth:
            break
        jump = active.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        more = up.withColumnsRenamed({"leaves": "l", "saved": "s"})
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        moved = active.where(F.col("depth") >= step).join(jump, ["a1", "a2"]).join(more, list(NODE), "left")
        active = scratch.save(moved.select(*NODE, F.col("b1").alias("a1"), F.col("b2").alias("a2"), "depth", plus("leaves", "l"), plus("saved", "s")), f"active-{i}")
        if i > 1:
            scratch.drop(f"active-{i - 1}")
    if not given:
        return nodes.where("false").select(*NODE, "leaves", "saved")
    every = given[0]
    for one in given[1:]:
        every = every.unionByName(one)
    return every.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(scratch: Scratch, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of ``turns (c, d, len, w1, w2, bytes)``; ``convs (c, len)`` names every conversation, turnless ones too."""
    named = scratch.save(prefixes(turns), "prefixes")
    inner = named.groupBy(*NODE).agg(F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("d").cast("long").alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"))
    nodes = scratch.save(inner.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children"))
    parents = scratch.save(nodes.select(*NODE, "conv_id").join(children, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2"))).select(*NODE, "conv_id", "n_children"), "parents")
    above = parents.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents.select(*NODE, "n_children"), list(NODE), "left").join(above, ["q1", "q2"], "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", zero), "saved": (F.col("n_convs") - 1) * F.col("bytes")}).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    nodes = scratch.save(nodes, "own")
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    below = rolled_up(scratch, nodes, depth).withColumnsRenamed({"leaves": "l", "saved": "s"})
    ends = named.where("d = len").select(*NODE, "c").unionByName(convs.where("len = 0").select(zero.alias("p1"), zero.alias("p2"), "c"))
    out = nodes.join(below, list(NODE), "left").join(ends_digests(ends), list(NODE), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("l", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("s", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per node of the trie of conversations, each with its turns in order.

    ``conv_id`` (its least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes that sharing saves in the subtree), ``ends_sha256`` (of the ids that end there).
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    ranked, spans = ordered_turns(scratch, conversations, conv_col, turn_col, role_col, text_col)
    turns = ranked.join(spans, ["c", "p"]).select("c", F.col("k").alias("d"), F.col("n").alias("len"), "w1", "w2", "bytes")
    return trie(scratch, turns, spans.groupBy("c").agg(F.first("n").alias("len")))


def rebuilt_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, heads: int = 9) -> DataFrame:
    """The trie of rebuilt conversations: ``c`` begins with the first ``h`` turns of ``c - c % family`` instead of its own, ``h`` = ``crc32(c) % heads``."""
    scratch = Scratch(conversations.sparkSession, "trie")
    ranked, spans = ordered_turns(scratch, conversations, conv_col, turn_col, role_col, text_col)
    convs = spans.groupBy("c").agg(F.first("n").alias("n")).withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % heads, "b": F.col("c") - F.col("c") % family})
    bases = convs.where("c = b").select("b", F.col("n").alias("nb"))
    convs = convs.join(bases, "b", "left").withColumn("head", F.least("h", F.coalesce("nb", F.lit(0))))
    convs = scratch.save(convs.select("c", "b", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    own = ranked.join(spans.join(convs, "c").select("c", "p", "h", "head", "len"), ["c", "p"]).where("k > h")
    own = own.select("c", (F.col("head") + F.col("k") - F.col("h")).alias("d"), "len", "w1", "w2", "bytes")
    first = ranked.where((F.col("k") < heads) & (F.col("c") % family == 0)).select(F.col("c").alias("b"), F.col("k").alias("d"), "w1", "w2", "bytes")
    taken = convs.where("head > 0").join(first, "b").where("d <= head").select("c", "d", "len", "w1", "w2", "bytes")
    return trie(scratch, own.unionByName(taken), convs.select("c", "len"))


ORACLE = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, 1 AS i, 4294967295::BIGINT AS r FROM ids
  UNION ALL
  SELECT c, i + 1, list_reduce(list_concat([xor(r, ascii(substr(c::VARCHAR, i, 1)))], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) FROM crc WHERE i <= length(c::VARCHAR)),
conv AS (SELECT c, c - c % 5 AS b, xor(r, 4294967295) % 9 AS h FROM crc WHERE i = length(c::VARCHAR) + 1),
ord AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
raw AS (SELECT conv.c, 0 AS own, k, role, text FROM conv JOIN ord ON ord.c = conv.b AND k <= h
        UNION ALL SELECT conv.c, 1, k, role, text FROM conv JOIN ord ON ord.c = conv.c AND k > h),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, role, text FROM raw),
pre AS (SELECT c, d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS path FROM seq
        UNION ALL SELECT c, 0, '', [] FROM conv),
len AS (SELECT c, max(d) AS n FROM pre GROUP BY c),
node AS (SELECT path, d, min(pre.c) AS c, count(*) AS n, any_value(octet_length(encode(text))) AS bytes,
         sha256(coalesce(string_agg(pre.c::VARCHAR, ',' ORDER BY pre.c) FILTER (WHERE d = len.n), '')) AS ends
         FROM pre JOIN len ON len.c = pre.c GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS kids, up.c AS parent FROM node
        LEFT JOIN kids ON kids.d = node.d AND kids.path = node.path LEFT JOIN node up ON up.d = node.d - 1 AND up.path = node.path[1:node.d - 1]),
tot AS (SELECT a.path, a.d, count(*) FILTER (WHERE b.kids = 0) AS leaves, sum((b.n - 1) * b.bytes) AS saved
        FROM own a JOIN pre ON pre.c = a.c AND pre.d = a.d JOIN own b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.path, a.d)
SELECT own.c AS conv_id, own.d AS depth, own.parent AS parent_conv_id, own.n AS n_convs, own.kids AS n_children,
       tot.leaves AS n_leaves, tot.saved::BIGINT AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN tot ON tot.path = own.path AND tot.d = own.d
"""


def query(spark, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of bytes; each chunk is hashed on its own, in parallel for huge texts, and
shifted by the number of bytes that follow it, so the fingerprint of the whole is a plain sum of its
chunks' terms.  Texts with equal fingerprints are then compared chunk by chunk: over a class, the
least and the greatest bytes of every chunk position must agree.  A class that fails (a collision) is
split by a digest of the text, so classes are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, same, unused
from .textkit import buffers

#: Two prime moduli below 2**31 and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (1664525069, 1103515249)


def _descending(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % modulus
    return out[::-1].copy()


def chunk_terms(chunk_bytes: int):
    """Batch function: ``(…, octets, no, piece)`` to ``(…, octets, t1, t2, head)``."""

    def make():
        tables = [_descending(b, m, chunk_bytes) for b, m in zip(BASES, MODULI, strict=True)]

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("piece"))
            octets, no = batch.column("octets").to_numpy(), batch.column("no").to_numpy()
            terms = np.zeros((2, batch.num_rows), np.int64)
            for i in range(batch.num_rows):
                piece = data[offsets[i] : offsets[i + 1]].astype(np.int64) + 1
                n = len(piece)
                after = int(octets[i]) - int(no[i]) * chunk_bytes - n
                for k, table in enumerate(tables):
                    h = int(np.dot(piece, table[chunk_bytes - n :])) % MODULI[k]
                    terms[k, i] = h * pow(BASES[k], after, MODULI[k]) % MODULI[k] if after else h
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), batch.column("octets"), pa.array(terms[0]), pa.array(terms[1]), pa.array((no == 0).astype(np.int64))], ["id", "sha", "octets", "t1", "t2", "head"])

        return step

    return make


def _chunks(rows: DataFrame, chunk_bytes: int, *keep: str) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil(F.col("octets") / chunk_bytes).cast("int") - 1)
    return rows.select(*keep, F.col("b"), F.explode(F.sequence(F.lit(0), last)).alias("no")).select(*keep, "no", F.expr(f"substring(b, no * {chunk_bytes} + 1, {chunk_bytes})").alias("piece"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 16) -> DataFrame:
    """One row per distinct (id, text): ``id, sha, octets, f1, f2, copies``.

    Texts longer than a chunk have their chunks dealt over the cluster; the others are hashed where
    they are read.  Only ids, digests and terms are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("octets"), text.cast("binary").alias("b"))
    short = rows.where(F.col("octets") <= chunk_bytes).select("id", "sha", "octets", F.lit(0).alias("no"), F.col("b").alias("piece"))
    long = _chunks(rows.where(F.col("octets") > chunk_bytes), chunk_bytes, "id", "sha", "octets").repartition("id", "no")
    kind = f"id {dict(docs.dtypes)[id_col]}, sha string, octets long, t1 long, t2 long, head long"
    terms = arrow_map(short, chunk_terms(chunk_bytes), kind).unionByName(arrow_map(long, chunk_terms(chunk_bytes), kind))
    copies = F.sum("head")
    # identical rows add the same terms: the exact sum is divided by how many there are
    return terms.groupBy("id", "sha", "octets").agg(*(F.expr(f"(sum(t{k}) div sum(head)) % {m}L").alias(f"f{k}") for k, m in zip((1, 2), MODULI, strict=True)), copies.alias("copies"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 16) -> DataFrame:
    """Every row's exact-copy group: ``id, keep_id, group_size, kept, sha, copies``, a row per distinct (id, text).

    Null text equals the empty text.  Of equal texts the largest id stays; null ids are the smallest.
    ``copies`` counts repeated identical rows; one of them stays where ``kept``.  Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    print_ = ["octets", "f1", "f2"]
    units = scratch.save(fingerprints(docs, id_col, text_col, chunk_bytes), "units")
    shared = scratch.save(units.groupBy(*print_).agg(F.count(F.lit(1)).alias("n_units")).where("n_units > 1"), "shared")
    members = scratch.save(units.join(shared, print_).select("id", "sha", *print_), "members")
    # chunkwise comparison of the texts that share a fingerprint
    text = F.coalesce(F.col(text_col), F.lit(""))
    bodies = docs.select(F.col(id_col).alias("tid"), text.cast("binary").alias("b"))
    matched = bodies.join(members.hint("shuffle_hash"), same("tid", "id") & (F.octet_length("b") == F.col("octets")) & (F.sha2(F.col("b"), 256) == F.col("sha")))
    unlike = _chunks(matched, chunk_bytes, *print_).groupBy(*print_, "no").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("lo <> hi").select(*print_).distinct()
    unlike = scratch.save(unlike.withColumn("split", F.lit(True)), "unlike")
    units = units.join(unlike, print_, "left").withColumn("part", F.when(F.col("split"), F.col("sha")).otherwise(F.lit("")))
    key = [*print_, "part"]
    groups = units.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("n"))
    groups = scratch.save(groups.where("n > 1").drop("n"), "groups")
    # a group may hold a third of all rows: both sides are plain exchanges, which adaptive execution splits
    out = units.join(groups, key, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", keep.alias("keep_id"), F.coalesce("group_size", "copies").alias("group_size"), same("id", keep).alias("kept"), "sha", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 16) -> DataFrame:
    """One row per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    g = exact_groups(docs, id_col, text_col, chunk_bytes)
    g = g.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("kept") & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 16) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of identical rows one stays."""
    i, sha, copies = unused(docs, "kept_id", "kept_sha", "kept_copies")
    kept = exact_groups(docs, id_col, text_col, chunk_bytes).where("kept").select(F.col("id").alias(i), F.col("sha").alias(sha), F.col("copies").alias(copies))
    kept = Scratch(docs.sparkSession, "exact-kept").save(kept, "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    match = same(F.col(id_col), F.col(i)) & (F.sha2(text, 256) == F.col(sha))
    once = docs.join(kept.where(F.col(copies) == 1).hint("shuffle_hash"), match, "left_semi")
    repeated = kept.where(F.col(copies) > 1)
    if repeated.isEmpty():  # saves a pass over the texts, no more
        return once
    more = docs.join(repeated.hint("shuffle_hash"), match).dropDuplicates([i, sha]).select(*docs.columns)
    return once.unionByName(more)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

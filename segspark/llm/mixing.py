"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents stand in order of size; each expects ``target / source size`` copies.
The running sum of expected copies plus one random offset crosses an integer boundary once for every
copy that a document gets.  Sizes being in order, the words taken stay within one largest document of
the target.  All sums are exact integers, so reruns agree and no document exceeds the copy limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, unused

#: Offsets and expected copies are multiples of ``1 / GRAIN``.
GRAIN = 1 << 28
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LIMIT = 3
#: Documents of one source and size that one task ranks.
CELL_ROWS = 1 << 10


def running(scratch: Scratch, rows: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with exclusive running sums of columns in a total order, by ranges: no task sees all rows.

    Rows are dealt by range and written with the number of their range; every range sums its own, and the
    totals of the ranges, a row each, are summed before them.
    """
    dealt = scratch.save(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    whole = dealt.groupBy("range").agg(*(F.sum(c).alias(new) for new, c in sums.items())).select("range", *(ahead(new, before).alias(f"{new}_range") for new in sums))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = dealt.join(whole, "range")
    return got.select(*rows.columns, *((ahead(c, inside) + F.col(f"{new}_range")).alias(new) for new, c in sums.items()))


def source_targets(scratch: Scratch, sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """A row per source: ``nil, src, source_size, target, step, shift``.

    Sources by code point, null last, take the weights in turn.  The targets share all sizes by
    weight; one that would pass ``limit`` times its source's size stops there and the rest is shared
    again: with sources by limit per weight, the first whose share of what is left fits sets the level.
    All sums are of whole numbers, so their order does not matter.
    """
    per = sizes.groupBy("nil", "src").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    per = running(scratch, per, ["nil", "src"], {"place": "one"}, "by_name")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("w", F.element_at(turn, (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", limit * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    per = running(scratch, per, ["ratio", "nil", "src"], {"caps": "cap", "ws": "w"}, "by_ratio")
    size, weight = per.agg(F.sum(F.col("source_size").cast("double")), F.sum("w")).first()
    per = per.withColumn("level", (F.lit(size or 0.0) - F.col("caps")) / (F.lit(weight or 0.0) - F.col("ws")))
    fits = per.where("level <= ratio").agg(F.min(F.struct("ratio", "nil", "src", "level")).alias("m")).first()["m"]
    level = F.lit(fits["level"] if fits else None).cast("double")
    per = per.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))))
    step = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * GRAIN), F.lit(limit * GRAIN).cast("long"))).otherwise(F.lit(0).cast("long"))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("nil").cast("int").cast("string"), F.col("src"))), 1, 7), 16, 10).cast("long")
    return per.select("nil", "src", "source_size", "target", step.alias("step"), shift.alias("shift"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, prints: list[str], weights, limit: int, seed: int, cell_rows: int) -> DataFrame:
    """``id, print, nil, src, size, source_size, target, copies``, a row per row; ``print`` hashes the columns ``prints``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("id"), F.xxhash64(*prints).alias("print"), F.when(F.col(id_col).isNull(), text).alias("spread"), F.col(source_col).isNull().alias("nil"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # a hash of the id deals documents evenly whatever its type or pattern; without one the text does
    name = F.coalesce(F.col("id").cast("string"), F.col("spread"))
    sizes = sizes.withColumn("deal", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")).drop("spread")
    sizes = scratch.save(sizes, "sizes")
    targets = source_targets(scratch, sizes, weights, limit, seed)
    # number of documents of each source and size, where they start, and how many cells they need
    steps = sizes.groupBy("nil", "src", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("nil", "src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long"))).withColumn("cells", F.ceil(F.col("n") / cell_rows).cast("long"))
    steps = scratch.save(steps.join(targets, ["nil", "src"]), "steps")
    rows = sizes.join(steps.select("nil", "src", "size", "cells"), ["nil", "src", "size"]).select("nil", "src", "size", "id", "print", F.pmod("deal", "cells").alias("cell"))
    key = ["nil", "src", "size", "cell"]
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("in_cell"))
    upto = Window.partitionBy("nil", "src", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("in_cell").over(upto), F.lit(0).cast("long")))
    cells = cells.join(steps, ["nil", "src", "size"]).select(*key, (F.col("start") + F.col("ahead")).alias("ahead"), "source_size", "target", "step", "shift")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("id", "print")))
    rows = rows.join(cells, key)
    # (rank before this one) * step + shift, modulo GRAIN, without overflow
    rank = F.col("ahead") + F.col("nth") - 1
    part = F.pmod(F.pmod("step", F.lit(GRAIN)) * F.pmod(rank, F.lit(GRAIN)) + F.col("shift"), F.lit(GRAIN))
    return rows.withColumn("copies", F.floor((part + F.col("step")) / GRAIN))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, limit: int = LIMIT, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, a row per row of ``docs``.

    Null text has size 0; null source is a source of its own, last; null ids come first among equals; ids
    may have any type.  Rows with equal id, source and size stand in the order of a hash of the text;
    identical rows are interchangeable.  An empty table gives no rows, and a table of empty texts takes
    nothing.  Ranking is two-level: counts per (source, size, cell) give each cell its start, and only a
    cell of about ``cell_rows`` documents, dealt by a hash of the id, is ordered by one task, however
    large the source.
    """
    out = _planned(docs, id_col, text_col, source_col, [text_col], weights, limit, seed, cell_rows)
    return out.select(F.col("id").alias("doc_id"), F.when(~F.col("nil"), F.col("src")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, limit: int = LIMIT, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it.

    Rows are told apart by id and a hash of all their columns (maps aside), so rows that share an id, or
    have none, are taken each for itself; of identical rows one stands for all, with their copies summed.
    """
    i, hashed, n_rows, copies, nth = unused(docs, "mix_id", "mix_print", "mix_rows", "mix_copies", "mix_nth")
    prints = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    plan = _planned(docs, id_col, text_col, source_col, prints, weights, limit, seed, cell_rows)
    plan = plan.groupBy(F.col("id").alias(i), F.col("print").alias(hashed)).agg(F.count(F.lit(1)).alias(n_rows), F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    plan = Scratch(docs.sparkSession, "mixed").save(plan, "plan")
    match = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(*prints) == F.col(hashed))
    hit = docs.join(plan.where(F.col(n_rows) == 1).hint("shuffle_hash"), match)
    repeated = plan.where(F.col(n_rows) > 1)
    if not repeated.isEmpty():  # saves a pass over the texts, no more
        hit = hit.unionByName(docs.join(repeated.hint("shuffle_hash"), match).dropDuplicates([i, hashed]))
    return hit.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(nth)).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, (source IS NULL)::INT AS nil, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT nil, src, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY nil, src) - 1) % 3 + 1)::DOUBLE AS w
      FROM d GROUP BY nil, src),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, nil, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (ratio, nil, src)) AS level FROM l WHERE level <= ratio),
t AS (SELECT nil, src, source_size, least(cap, coalesce(f.level * w, cap)) AS target,
             ('0x' || md5('0:' || nil || src)[1:7])::BIGINT AS shift
      FROM l, f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size * 268435456)::BIGINT, 805306368) ELSE 0 END AS step FROM t),
n AS (SELECT *, (row_number() OVER (PARTITION BY nil, src ORDER BY size, ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % cells, doc_id) - 1)::HUGEINT AS rank
      FROM (SELECT *, ceil(count(*) OVER (PARTITION BY nil, src, size) / 1024.0)::BIGINT AS cells FROM d)),
k AS (SELECT n.doc_id, n.size, u.source_size, u.target,
             ((rank + 1) * step + shift) // 268435456 - (rank * step + shift) // 268435456 AS copies
      FROM n JOIN u USING (nil, src))
SELECT doc_id, size, source_size, round(target, 3) AS target, (copies * size)::BIGINT AS taken FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")

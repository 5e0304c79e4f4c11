"""Domain views of the standard tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A segment's length in microseconds.
SPAN = 30_000_000_000
KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 2024-01-01 of a timestamp without zone, independent of the session's zone."""
    day = F.unix_date(F.to_date(ts)) - 19723
    second = F.expr(f"extract(SECOND FROM {ts})")
    return (day.cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000000 + (second * 1000000).cast("bigint")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, idx, start, end, label, value``: a segment of fixed length per event, in microseconds."""
    e = table(spark, sf_dir, "events")
    start = micros("ts")
    return e.select(F.col("user_id").alias("rec"), F.col("event_id").alias("idx"), start.alias("start"), (start + SPAN).alias("end"), F.col("event_type").alias("label"), "value")


SEGMENTS = f"""ev AS (SELECT user_id AS rec, event_id AS idx, event_type AS label, value,
  epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS st, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + {SPAN} AS en FROM events)"""


def merged_sql(source: str = "ev", label: str = "label", name: str = "mg") -> str:
    """Merge of ``rec, idx, st, en`` as CTEs ending in ``name (rec, run, s2, e2, label)``, times doubled."""
    return f"""{name}_b AS (SELECT *, {label} AS lb, CASE WHEN row_number() OVER w = 1 THEN 1
    WHEN lag({label}) OVER w = {label} AND (lag(en) OVER w > st OR abs(lag(en) OVER w - st) * 100000 <= abs(st) + 1000) THEN 0 ELSE 1 END AS nb
  FROM {source} WINDOW w AS (PARTITION BY rec ORDER BY st, idx)),
{name}_r AS (SELECT *, sum(nb) OVER (PARTITION BY rec ORDER BY st, idx ROWS UNBOUNDED PRECEDING) - 1 AS run FROM {name}_b),
{name}_g AS (SELECT rec, run, min(st) AS s, arg_max(en, (st, idx)) AS e, any_value(lb) AS label FROM {name}_r GROUP BY rec, run),
{name} AS (SELECT rec, run::BIGINT AS run, label, CASE WHEN lag(e) OVER w > s THEN lag(e) OVER w + s ELSE 2 * s END AS s2,
    CASE WHEN lead(s) OVER w < e THEN e + lead(s) OVER w ELSE 2 * e END AS e2 FROM {name}_g WINDOW w AS (PARTITION BY rec ORDER BY run))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, idx, xvec, label``: fifty vectors a recording."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("rec"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("xvec"), "label")


VECTORS = "em AS (SELECT vec_id // 50 AS rec, vec_id AS idx, embedding::DOUBLE[] AS v, label FROM embeddings)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, n, x``: a supplier's quantities in order, as samples in [-1, 1]."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("rec"), (F.row_number().over(w) - 1).cast("bigint").alias("n"), ((F.col("l_quantity") - 25.5) / 32).alias("x"))


SIGNAL = """sg AS (SELECT l_suppkey AS rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS n,
  (l_quantity - 25.5::DOUBLE) / 32 AS x FROM lineitem),
sz AS (SELECT rec, max(n) + 1 AS size FROM sg GROUP BY rec)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, idx, start, end, label``: conversation turns on a scale of characters."""
    c = table(spark, sf_dir, "conversations")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text").cast("bigint")
    return c.select(F.col("conv_id").alias("rec"), F.col("turn").alias("idx"), (F.sum(size).over(upto) - size).alias("start"), F.sum(size).over(upto).alias("end"), F.col("role").alias("label"))


TURNS = """tn AS (SELECT conv_id AS rec, turn AS idx, role AS label, (sum(length(text)) OVER w - length(text))::BIGINT AS st, (sum(length(text)) OVER w)::BIGINT AS en
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def doubles(values) -> str:
    """A DuckDB list literal of doubles, nested lists allowed."""

    def text(v):
        return "[" + ", ".join(map(text, v)) + "]" if isinstance(v, (list, tuple)) else repr(float(v)) + "::DOUBLE"

    return text(list(values))

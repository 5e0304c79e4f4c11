"""Text formats: recording lists, voice segments, window timings, speaker segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.ship import ensure

from .files import NamedLines


def _fields(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Lines as whitespace-separated fields, with the file's stem and a number that orders a file's lines.

    Files are read split by split.  A line's number is the byte at which its split begins plus its place
    in the split: unique and rising within a file, as a line has at least a byte.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    split = Window.partitionBy("file", "block")
    lines = lines.withColumn("line", F.col("block") + F.col("at") - F.min("at").over(split))
    value = F.trim(F.regexp_replace("value", r"#.*$" if not whole else r"$^", ""))
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return lines.select(stem.alias("stem"), "line", value.alias("value")).where("value <> ''").select("stem", "line", F.split("value", r"\s+").alias("f"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``rec``: recording ids, one or more a line; ``#`` starts a comment."""
    return _fields(spark, path).select(F.explode("f").alias("rec"))


def read_vad(spark: SparkSession, path: str) -> DataFrame:
    """``rec, segnum, start, end`` from ``<rec>.lab`` files of ``start end [name]`` lines."""
    place = F.row_number().over(Window.partitionBy("stem").orderBy("line")) - 1
    return _fields(spark, path).select(F.col("stem").alias("rec"), place.alias("segnum"), F.get("f", F.lit(0)).cast("double").alias("start"), F.get("f", F.lit(1)).cast("double").alias("end"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """``idx, key, rec, start, end`` from lines of ``key rec start end``; ``idx`` keeps the order."""
    f = F.col("f")
    return _fields(spark, path).select(F.col("line").cast("bigint").alias("idx"), F.get(f, F.lit(0)).alias("key"), F.get(f, F.lit(1)).alias("rec"), F.get(f, F.lit(2)).cast("double").alias("start"), F.get(f, F.lit(3)).cast("double").alias("end"))


def parse_rttm(value: Column) -> Column:
    """A speaker line as ``struct<rec, chan, start, dur, spk>``."""
    f = F.split(F.trim(value), r"\s+")
    return F.struct(F.get(f, F.lit(1)).alias("rec"), F.get(f, F.lit(2)).cast("int").alias("chan"), F.get(f, F.lit(3)).cast("double").alias("start"), F.get(f, F.lit(4)).cast("double").alias("dur"), F.get(f, F.lit(7)).alias("spk"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """``rec, chan, start, dur, spk`` from all files under ``path``; other line types are left out."""
    return spark.read.text(path).where(F.col("value").startswith("SPEAKER")).select(parse_rttm(F.col("value")).alias("r")).select("r.*")


def seconds_text(x: Column) -> Column:
    """A time as its shortest decimal, with at least one decimal place."""
    return x.cast("double").cast("string")


def timing_line(key: Column, rec: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(" ", key, rec.cast("string"), seconds_text(start), seconds_text(end))


def rttm_line(rec: Column, start: Column, dur: Column, label: Column) -> Column:
    """One speaker line; times have six decimals."""
    return F.format_string("SPEAKER %s 1 %.6f %.6f <NA> <NA> %s <NA> <NA>", rec.cast("string"), start.cast("double"), dur.cast("double"), label.cast("string"))


def vector_line(name: Column, v: Column) -> Column:
    """``name  [ a b c ]``."""
    return F.concat(name.cast("string"), F.lit("  [ "), F.concat_ws(" ", F.transform(v, lambda x: x.cast("string"))), F.lit(" ]"))


def write_lines(df: DataFrame, value: Column, path: str, rec: str | None = None, mode: str = "overwrite") -> None:
    """Lines as text; with ``rec`` a folder per recording."""
    if rec:
        df.select(F.col(rec), value.alias("value")).repartition(rec).sortWithinPartitions(rec, "value").write.mode(mode).partitionBy(rec).text(path)
    else:
        df.select(value.alias("value")).write.mode(mode).text(path)


def write_named(rows: DataFrame, path: str, suffix: str = "", mode: str = "overwrite") -> None:
    """Lines ``name, at, value`` as one file ``<path>/<name><suffix>`` per name, in order of ``at``.

    Files appear when all are written, a rerun replaces them, and a failed run leaves none.
    """
    ensure(rows.sparkSession)
    rows.sparkSession.dataSource.register(NamedLines)
    ordered = rows.repartition("name").sortWithinPartitions("name", "at", "value").select(F.col("name").cast("string").alias("name"), "value")
    ordered.write.format("named_lines").mode(mode).option("path", path).option("suffix", suffix).save()


def write_rttm(df: DataFrame, path: str, rec: str = "rec", start: str = "start", end: str = "end", label: str = "label", mode: str = "overwrite") -> None:
    """``<path>/<rec>.rttm`` for each recording, lines in order of time; numeric labels are written from 1."""
    line = rttm_line(F.col(rec), F.col(start), F.col(end) - F.col(start), F.col(label) + 1)
    write_named(df.select(F.col(rec).alias("name"), F.col(start).alias("at"), line.alias("value")), path, ".rttm", mode)

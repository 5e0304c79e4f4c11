"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


class Tables:
    """Tables of one run, written as Parquet under ``spark.checkpoint.dir``: a lost executor costs the running stage only.

    A local session without that setting gets a temporary folder; a cluster session must name its own.
    """

    def __init__(self, spark: SparkSession, tag: str):
        sc = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _own.setdefault(sc.applicationId, "")
            if not base:
                base = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tables-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Shared plumbing: scratch tables in the shared checkpoint folder, packed batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.ship import ensure


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session gets a temporary one; a cluster session must name its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="scratch-")
            sc.setCheckpointDir(_own_dirs[sc.applicationId])
        named = _own_dirs[sc.applicationId]
    return named.rstrip("/")


_open: list[list[Scratch]] = []


@contextmanager
def swept() -> Iterator[None]:
    """Deletes, at the end of the block, the intermediate tables of all operators that began in it.

    For a caller that has written what the operators returned; nothing may read their tables any more.
    """
    made: list[Scratch] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for scratch in made:
            scratch.drop("")


class Scratch:
    """Intermediate tables of one operator run, written as Parquet to the shared folder.

    Writing cuts lineage durably: a lost executor costs only the running stage.  ``drop`` removes a
    table that nothing reads any more; the tables that the returned DataFrame reads stay (see ``swept``).
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        for made in _open:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list]], schema: str) -> DataFrame:
    """``mapInArrow`` whose state is built once per task: ``make()`` gives the batch function.

    The batch function may have a ``finish`` attribute, called once at the end for what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        finish = getattr(step, "finish", None)
        if finish:
            yield from finish()

    ensure(df.sparkSession)
    return df.mapInArrow(run, schema)



def same(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.eqNullSafe(b)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` does not have, whatever its columns are called."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def ordered_pairs(edges: DataFrame) -> DataFrame:
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return edges.select(a.alias("a"), b.alias("b")).where("a < b").distinct()


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc", max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges (a, b)``: one row ``(node, root)`` per node, root = least node.

    Alternating large-star and small-star rounds: each round is a grouped minimum and an equi-join on
    the node, and the edge table never grows.  A node with very many neighbours is one long key: its
    minimum is combined before the shuffle, and the join side is a plain exchange that adaptive
    execution may split.  Each round is a scratch table, so lineage stays short.
    """
    spark = scratch.spark
    now = scratch.save(ordered_pairs(edges), f"{tag}-0")
    mark = None
    for i in range(max_rounds):
        # large star: neighbours above a node join the least neighbour
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = scratch.save(large, f"{tag}-l{i}")
        # small star: a node and its lower neighbours join the least of them
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        hung = large.join(low, large["b"] == low["n"])
        small = hung.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(low.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()
        small = scratch.save(small, f"{tag}-s{i}")
        scratch.drop(f"{tag}-l{i}", f"{tag}-{i}" if i == 0 else f"{tag}-s{i - 1}")
        seen = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now = small
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)

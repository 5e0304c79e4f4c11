"""Streams in event order: shuffled micro-batches give what the batch operators give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.operators import kernels as K
from segspark.operators import segments as S
from segspark.streaming import events as ST
from segspark.streaming import ordered as O


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    O.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def fed(spark, tmp_path, parts, schema, build, name, late):
    """Runs a stream over ``parts``, one micro-batch each, in order of arrival."""
    path = str(tmp_path / name)
    spark.createDataFrame(parts[0], schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    timed = ST.timed(stream.withColumn("ts", O.event_times(F.col("at"))), late=late)
    run = build(timed).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        for part in parts[1:]:
            run.processAllAvailable()
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        run.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect(), run.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        run.stop()


def test_hmm_in_event_order(spark, tmp_path, rocksdb):
    r = np.random.default_rng(0)
    ll = r.normal(size=(24, 3)) * 2
    tr, ip = np.eye(3) * 0.8 + 0.2 / 3, np.ones(3) / 3
    rows = [("r", i, v.tolist(), float(i + 1)) for i, v in enumerate(ll)]
    order = [[3, 0, 5], [1, 2, 8], [4, 7, 6, 12], [9, 11, 10, 13], [20, 15, 14, 22], [16, 18, 17, 19, 21, 23]]
    parts = [[rows[i] for i in p] for p in order] + [[("end", 0, [0.0] * 3, 9000.0)], [("end", 1, [0.0] * 3, 18000.0)]]
    got, kept = fed(spark, tmp_path, parts, "rec string, idx long, ll array<double>, at double", lambda s: O.ordered_hmm(s, tr.tolist(), ip.tolist(), idle=60.0), "ordered_hmm", "8 seconds")
    _, total, fw, _ = K.forward_backward(ll, tr, ip)
    own = [q for q in got if q.rec == "r"]
    assert [q.idx for q in own] == list(range(24)) and [q.state for q in own] == fw.argmax(1).tolist()
    assert np.allclose([q.evidence for q in own], K.lse(fw, 1)) and np.isclose(own[-1].evidence, total)
    assert kept <= 4  # the idle key is forgotten


@pytest.mark.parametrize("seed", [1])
def test_merge_in_event_order(spark, tmp_path, rocksdb, seed):
    r = random.Random(seed)
    rows = []
    for rec in ("a", "b"):
        at = 1.0
        for i in range(40):
            rows.append((rec, i, at, at + r.choice([0.5, 1.0, 2.0, 3.0]), r.choice("xy"), at))
            at += r.choice([0.5, 1.0, 1.5, 4.0])
    schema = "rec string, idx long, start double, end double, label string, at double"
    want = {(q.rec, q.start, q.end, q.label) for q in S.merge_adjacent(spark.createDataFrame(rows, schema), order=["start", "idx"]).collect()}
    shuffled = sorted(rows, key=lambda x: x[5] + r.uniform(0, 6))
    parts = [shuffled[i : i + 20] for i in range(0, len(shuffled), 20)] + [[("end", 0, 9e3, 9e3 + 1, "x", 9e3)], [("end", 1, 2e4, 2e4 + 1, "x", 2e4)]]
    got, kept = fed(spark, tmp_path, parts, schema, lambda s: O.ordered_merge(s, idle=600.0), "ordered_merge", "10 seconds")
    assert {(q.rec, q.start, q.end, q.label) for q in got if q.rec != "end"} == want and len(got) >= len(want) > 30
    assert kept <= 4

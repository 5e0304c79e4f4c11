"""Named files and archives as data sources: round trips, reruns, failures that leave nothing."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.sources import files, kaldi
from segspark.sources import text as X


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def segments(spark, recs, shift=0.0):
    rows = [(rec, 2.0 * i + shift, 2.0 * i + 1.5 + shift, i % 3, "x") for rec in recs for i in range(5)]
    return spark.createDataFrame(rows[::-1], "rec string, start double, end double, label int, value string").repartition(4)


def test_a_file_per_recording(spark, tmp_path):
    out = str(tmp_path / "rttm")
    X.write_rttm(segments(spark, ["m", "n o", "é"]), out)
    assert names(out) == ["m.rttm", "n o.rttm", "é.rttm"]
    lines = (tmp_path / "rttm" / "m.rttm").read_text().splitlines()
    assert lines[0] == "SPEAKER m 1 0.000000 1.500000 <NA> <NA> 1 <NA> <NA>" and [float(x.split()[3]) for x in lines] == [0, 2, 4, 6, 8]
    (tmp_path / "rttm" / "kept.txt").write_text("not ours")
    X.write_rttm(segments(spark, ["m", "p"], 1.0), out)  # a rerun replaces what it wrote, and nothing else
    assert names(out) == ["kept.txt", "m.rttm", "p.rttm"]
    back = X.read_rttm(spark, f"{out}/*.rttm")
    assert {(r.rec, r.start) for r in back.collect()} == {(rec, 2.0 * i + 1) for rec in "mp" for i in range(5)}
    X.write_rttm(segments(spark, ["q"]), out, mode="append")
    assert names(out) == ["kept.txt", "m.rttm", "p.rttm", "q.rttm"]


def test_failures_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "rttm")
    X.write_rttm(segments(spark, ["m"]), out)
    before = (tmp_path / "rttm" / "m.rttm").read_text()
    for bad in ("a/b", ".hidden", "", None):
        with pytest.raises(Exception, match="cannot name a file"):
            X.write_rttm(segments(spark, ["m", "z", bad], 1.0), out)
    fails = segments(spark, ["m", "z"], 1.0).withColumn("end", F.when(F.col("rec") == "z", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("end")))
    with pytest.raises(Exception, match="lost"):
        X.write_rttm(fails, out)
    assert names(out) == ["m.rttm"] and (tmp_path / "rttm" / "m.rttm").read_text() == before


def vectors(spark, n=50):
    r = np.random.default_rng(1)
    return spark.createDataFrame([(f"r{i % 3}", i, f"r{i % 3}_{i:04d}-0-1", r.normal(size=4 + i % 2).astype(np.float32).tolist()) for i in range(n)], "rec string, idx long, key string, xvec array<double>").repartition(4)


def test_archive_round_trip(spark, tmp_path):
    out = str(tmp_path / "ark")
    df = vectors(spark)
    kaldi.write_archive(df, out)
    made = names(out)
    assert made and all(x.endswith((".ark", ".scp")) for x in made) and len(made) % 2 == 0
    want = {r.key: (r.rec, r.xvec) for r in df.collect()}
    back = kaldi.read_archive(spark, out).orderBy("idx").collect()
    assert {r.key: (r.rec, r.xvec) for r in back} == want
    assert [r.key for r in back] == [r.key for r in df.orderBy("rec", "idx").collect()]  # order goes on from part to part
    # plain readers of the format find the same, by stream and by position
    found = {}
    for x in made:
        if x.endswith(".ark"):
            raw = (tmp_path / "ark" / x).read_bytes()
            found |= {k: v.tolist() for k, v in kaldi.vectors_in(io.BytesIO(raw))}
    assert found == {k: v for k, (_, v) in want.items()}
    index = kaldi.read_index(spark, out)
    assert {r.key: r.xvec for r in kaldi.vectors_at(index).collect()} == found
    kaldi.write_archive(df.where("idx < 3"), out)
    assert kaldi.read_archive(spark, out).count() == 3
    kaldi.write_archive(df.where("idx < 0"), out)
    assert names(out) == []


def test_only_these_bytes_are_read(spark, tmp_path):
    """A vector is found by its position although the rest of the file is no archive at all."""
    body = io.BytesIO()
    kaldi.write_vector(body, "a_0", np.array([1.0, 2.0], np.float32))
    (tmp_path / "x.ark").write_bytes(b"\xff" * 5000 + body.getvalue() + b"\xff" * 5000)
    (tmp_path / "x.scp").write_text(f"a_0 {tmp_path}/x.ark:{5000 + 4}\nb_0 {tmp_path}/absent.ark:7\n")
    index = kaldi.read_index(spark, str(tmp_path / "x.scp"))
    assert [tuple(r) for r in kaldi.vectors_at(index.where("key = 'a_0'")).collect()] == [("a", "a_0", [1.0, 2.0])]
    matrix = b"key \0BFM \4" + (1).to_bytes(4, "little") + b"\4" + (2).to_bytes(4, "little") + np.array([1, 2], "<f4").tobytes()
    (tmp_path / "m.ark").write_bytes(b"junk" + matrix + b"\xff" * 100)
    assert [r.x for r in kaldi.matrix_rows(spark, str(tmp_path / "m.ark"), "key", 8).collect()] == [[1.0, 2.0]]
    with pytest.raises(Exception, match="expected"):
        kaldi.matrix_rows(spark, str(tmp_path / "m.ark"), "kez", 8).collect()


def test_a_failed_archive_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "ark")
    bad = vectors(spark).withColumn("xvec", F.when(F.col("idx") == 40, F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("xvec")))
    with pytest.raises(Exception, match="lost"):
        kaldi.write_archive(bad, out)
    assert names(out) == []


def test_listing(tmp_path):
    for x in ("b.wav", "a.wav", "c.txt", "_run", ".x.crc"):
        (tmp_path / x).write_text("1")
    assert [os.path.basename(p) for p, _ in files.listed(f"{tmp_path}/*.wav")] == ["a.wav", "b.wav"]
    assert [os.path.basename(p) for p, _ in files.listed(f"file://{tmp_path}")] == ["a.wav", "b.wav", "c.txt"]
    assert [s for _, s in files.listed(f"{tmp_path}/c.txt")] == [1]

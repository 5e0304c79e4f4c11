"""Binary and text archives of vectors and matrices, and PLDA models, in the Kaldi formats."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from segspark.ship import ensure

from .files import Staged, Written, file_system, listed


class FormatError(ValueError):
    """The bytes are not in the expected format."""


def _take(fd: BinaryIO, n: int) -> bytes:
    got = fd.read(n)
    if len(got) != n:
        raise FormatError(f"{n} bytes expected, {len(got)} left")
    return got


def _sized(fd: BinaryIO, kinds: dict[int, str]):
    """A number preceded by its size in bytes."""
    size = _take(fd, 1)[0]
    if size not in kinds:
        raise FormatError(f"unexpected number size {size}")
    return struct.unpack("<" + kinds[size], _take(fd, size))[0]


INT, REAL = {4: "i", 8: "q"}, {4: "f", 8: "d"}
WIDTH = {b"F": "<f4", b"D": "<f8"}


def read_vector(fd: BinaryIO) -> np.ndarray:
    head = _take(fd, 3)
    if head not in (b"FV ", b"DV "):
        raise FormatError(f"no vector header: {head!r}")
    kind = np.dtype(WIDTH[head[:1]])
    return np.frombuffer(_take(fd, _sized(fd, INT) * kind.itemsize), kind)


def _compressed(fd: BinaryIO, head: bytes) -> np.ndarray:
    if head == b"CM ":
        version = 1
    else:
        version = int(head[2:3])
        _take(fd, 1)
    low, span, rows, cols = struct.unpack("<ffii", _take(fd, 16))
    if version == 2:
        return (low + span / 65535 * np.frombuffer(_take(fd, 2 * rows * cols), "<u2").reshape(rows, cols)).astype(np.float32)
    if version == 3:
        return (low + span / 255 * np.frombuffer(_take(fd, rows * cols), "u1").reshape(rows, cols)).astype(np.float32)
    # per column: values at 0, 25, 75 and 100 percent, then a byte an entry between them
    marks = low + span / 65535 * np.frombuffer(_take(fd, 8 * cols), "<u2").reshape(cols, 4)
    data = np.frombuffer(_take(fd, rows * cols), "u1").reshape(cols, rows).astype(float)
    a, b, c, d = (marks[:, i : i + 1] for i in range(4))
    out = np.where(data <= 64, a + (b - a) * data / 64, np.where(data <= 192, b + (c - b) * (data - 64) / 128, c + (d - c) * (data - 192) / 63))
    return out.T.astype(np.float32)


def read_sparse(fd: BinaryIO) -> tuple[list[tuple[int, int, float]], tuple[int, int]]:
    """``(row, column, value)`` entries and the shape; the width is the widest row's."""
    entries, width = [], 0
    rows = _sized(fd, INT)
    for r in range(rows):
        if _take(fd, 3) != b"SV ":
            raise FormatError("no sparse vector header")
        width = max(width, _sized(fd, INT))
        for _ in range(_sized(fd, INT)):
            c = _sized(fd, INT)
            entries.append((r, c, float(_sized(fd, REAL))))
    return entries, (rows, width)


def read_matrix(fd: BinaryIO) -> np.ndarray:
    """A dense, compressed or sparse matrix, as a dense one."""
    head = _take(fd, 3)
    if head[:2] == b"CM":
        return _compressed(fd, head)
    if head == b"SM ":
        entries, shape = read_sparse(fd)
        out = np.zeros(shape)
        for r, c, x in entries:
            out[r, c] = x
        return out
    if head not in (b"FM ", b"DM "):
        raise FormatError(f"unknown matrix header {head!r}")
    kind = np.dtype(WIDTH[head[:1]])
    rows, cols = _sized(fd, INT), _sized(fd, INT)
    return np.frombuffer(_take(fd, rows * cols * kind.itemsize), kind).reshape(rows, cols)


def _text_numbers(fd: BinaryIO) -> list[list[float]]:
    """Rows between ``[`` and ``]``."""
    text = b""
    while not (c := fd.read(1)) == b"[":
        if not c:
            raise FormatError("no opening bracket")
    while not (c := fd.read(1)) == b"]":
        if not c:
            raise FormatError("no closing bracket")
        text += c
    return [[float(x) for x in line.split()] for line in text.decode().split("\n") if line.strip()]


def read_plda(source: str | bytes | BinaryIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``mu, tr, psi`` of a binary or text PLDA model, from a path, bytes or an open file."""
    if isinstance(source, str):
        with open(source, "rb") as fd:
            return read_plda(fd)
    fd = io.BytesIO(source) if isinstance(source, bytes) else source
    head = _take(fd, 2)
    if head == b"\0B":
        if _take(fd, 7) != b"<Plda> ":
            raise FormatError("no PLDA model")
        got = read_vector(fd), read_matrix(fd), read_vector(fd)
    else:
        if head + _take(fd, 5) != b"<Plda> ":
            raise FormatError("no PLDA model")
        got = np.array(sum(_text_numbers(fd), [])), np.array(_text_numbers(fd)), np.array(sum(_text_numbers(fd), []))
    if fd.read().strip() != b"</Plda>":
        raise FormatError("the PLDA model does not end")
    return got


def read_key(fd: BinaryIO) -> str | None:
    key = b""
    while (c := fd.read(1)) and c != b" ":
        key += c
    return key.decode().strip() or None


def vectors_in(fd: BinaryIO) -> Iterator[tuple[str, np.ndarray]]:
    """All vectors of a binary or text archive, in order."""
    while (key := read_key(fd)) is not None:
        mark = fd.read(2)
        if mark == b"\0B":
            yield key, read_vector(fd)
        else:
            rest = io.BytesIO(mark + fd.readline())
            yield key, np.array(sum(_text_numbers(rest), []))


def matrix_at(data: bytes | BinaryIO, key: str, position: int) -> np.ndarray:
    """The matrix whose content begins at ``position``, after a check of the key in front of it.

    Of a file only these bytes are read.
    """
    fd = io.BytesIO(data) if isinstance(data, bytes) else data
    fd.seek(position - len(key.encode()) - 1)
    if (found := read_key(fd)) != key:
        raise FormatError(f"key {key!r} expected, {found!r} found")
    if _take(fd, 2) != b"\0B":
        raise FormatError("only binary matrices can be read by position")
    return read_matrix(fd)


def write_vector(fd: BinaryIO, key: str, v: np.ndarray) -> None:
    v = np.asarray(v)
    kind = "D" if v.dtype == np.float64 else "F"
    fd.write(f"{key} ".encode() + b"\0B" + f"{kind}V ".encode() + b"\4" + struct.pack("<i", len(v)) + v.astype(WIDTH[kind.encode()]).tobytes())


def archive_bytes(items) -> bytes:
    out = io.BytesIO()
    for key, v in items:
        write_vector(out, key, v)
    return out.getvalue()


class ArkWriter(Staged):
    def __init__(self, path, overwrite):
        super().__init__(path, (".ark", ".scp"), overwrite)

    def write(self, iterator):
        """One archive and its index; index lines are ``key <target file>:<first byte of the content>``."""
        system, folder = self.task_folder()
        stem = f"part-{TaskContext.get().partitionId():05d}"
        at, some = 0, False
        with system.open_output_stream(f"{folder}/{stem}.ark") as ark, system.open_output_stream(f"{folder}/{stem}.scp") as scp:
            for row in iterator:
                raw = io.BytesIO()
                write_vector(raw, row.key, np.asarray(row.xvec, np.float32))
                ark.write(raw.getvalue())
                scp.write(f"{row.key} {self.path}/{stem}.ark:{at + len(row.key.encode()) + 1}\n".encode())
                at, some = at + len(raw.getvalue()), True
        return Written([(f"{folder}/{stem}{x}", f"{stem}{x}") for x in (".ark", ".scp")] if some else [])


@dataclass
class ArkFile(InputPartition):
    """One archive file and its place among the files."""

    path: str
    number: int


class ArkReader(DataSourceReader):
    #: Vectors of a batch.
    BATCH = 4096

    def __init__(self, path):
        self.path = path

    def partitions(self):
        return [ArkFile(path, i) for i, (path, _) in enumerate(x for x in listed(self.path) if not x[0].endswith((".scp", ".crc")))]

    def read(self, partition):
        """The vectors of a file as a stream; ``idx`` rises along the file and from file to file."""
        system, _ = file_system(self.path)
        with io.BufferedReader(system.open_input_stream(partition.path), 1 << 20) as fd:
            found = enumerate(vectors_in(fd))
            while some := list(islice(found, self.BATCH)):
                sizes = np.cumsum([0] + [len(v) for _, (_, v) in some]).astype(np.int32)
                flat = np.concatenate([v.astype(float) for _, (_, v) in some])
                keys = [k for _, (k, _) in some]
                yield pa.RecordBatch.from_arrays([pa.array([k.rpartition("_")[0] for k in keys]), pa.array([(partition.number << 40) + i for i, _ in some]), pa.array(keys), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["rec", "idx", "key", "xvec"])


class Ark(DataSource):
    """``format("ark")``: vector archives.

    Reads ``rec, idx, key, xvec`` of a file, folder or pattern, a task a file; writes ``key, xvec`` as single
    precision, an archive ``part-*.ark`` and its index ``part-*.scp`` a partition.
    """

    @classmethod
    def name(cls):
        return "ark"

    def schema(self):
        return "rec string, idx bigint, key string, xvec array<double>"

    def reader(self, schema):
        return ArkReader(self.options["path"])

    def writer(self, schema, overwrite):
        return ArkWriter(self.options["path"], overwrite)


def _ready(spark: SparkSession) -> None:
    ensure(spark)
    spark.dataSource.register(Ark)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``rec, idx, key, xvec`` from archives; ``rec`` is the key before its last underscore.

    ``path`` holds raw archive files, or Parquet rows with an archive in ``content``, as ``archives`` makes
    them.
    """
    _ready(spark)
    if not listed(path, ".parquet"):
        return spark.read.format("ark").option("path", path).load()

    def parse(batches):
        for pdf in batches:
            for content in pdf.content:
                rows = [(k.rpartition("_")[0], i, k, v.astype(float)) for i, (k, v) in enumerate(vectors_in(io.BytesIO(content)))]
                yield pd.DataFrame(rows, columns=["rec", "idx", "key", "xvec"])

    return spark.read.parquet(path).select("content").mapInPandas(parse, "rec string, idx bigint, key string, xvec array<double>")


def write_archive(df: DataFrame, path: str, rec: str = "rec", order: str = "idx", key: str = "key", vector: str = "xvec", mode: str = "overwrite") -> None:
    """Archives and indexes in ``path``, in order of recording and ``order`` within and across the parts."""
    _ready(df.sparkSession)
    rows = df.repartitionByRange(rec, order).sortWithinPartitions(rec, order).select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("xvec"))
    rows.write.format("ark").mode(mode).option("path", path).save()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``key, file, position`` from index files; ``position`` is the content's first byte."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    place = F.get(parts, F.lit(1))
    return spark.read.text(path, pathGlobFilter="*.scp").where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("key"), F.regexp_extract(place, r"^(.*):(\d+)$", 1).alias("file"), F.regexp_extract(place, r"^(.*):(\d+)$", 2).cast("bigint").alias("position"))


def _by_position(index: DataFrame, read, schema: str) -> DataFrame:
    """``read(file, key, position)`` of every row of an index, files in order, each opened once in a row."""

    def run(batches):
        system, now, fd = None, None, None
        try:
            for pdf in batches:
                out = []
                for key, file, position in zip(pdf.key, pdf.file, pdf.position.tolist(), strict=True):
                    if file != now:
                        if fd:
                            fd.close()
                        system, inner = file_system(file)
                        now, fd = file, io.BufferedReader(system.open_input_file(inner), 1 << 16)
                    out += read(fd, key, position)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        finally:
            if fd:
                fd.close()

    ordered = index.select("key", "file", "position").repartitionByRange("file", "position").sortWithinPartitions("file", "position")
    return ordered.mapInPandas(run, schema)


def vectors_at(index: DataFrame) -> DataFrame:
    """``rec, key, xvec`` of the rows of an index; filter the index first, and only those bytes are read."""

    def read(fd, key, position):
        fd.seek(position)
        if _take(fd, 2) != b"\0B":
            raise FormatError("only binary vectors can be read by position")
        return [(key.rpartition("_")[0], key, read_vector(fd).astype(float))]

    return _by_position(index, read, "rec string, key string, xvec array<double>")


def matrix_rows(spark: SparkSession, path: str, key: str, position: int) -> DataFrame:
    """``row, x`` of one matrix of an archive, by byte position; the rest of the file is not read."""
    ensure(spark)
    index = spark.createDataFrame([(key, path, position)], "key string, file string, position bigint")
    return _by_position(index, lambda fd, key, position: [(i, r.astype(float)) for i, r in enumerate(matrix_at(fd, key, position))], "row bigint, x array<double>")


def archives(df: DataFrame, rec: str = "rec", order: str = "idx", key: str = "key", vector: str = "xvec") -> DataFrame:
    """``rec, content``: one binary archive of single-precision vectors per recording."""
    kind = dict(df.dtypes)[rec]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        return pd.DataFrame({"rec": [pdf.rec.iloc[0]], "content": [archive_bytes((k, np.asarray(v, np.float32)) for k, v in zip(pdf.key, pdf.v, strict=True))]})

    rows = df.selectExpr(f"`{rec}` as rec", f"`{order}` as o", f"`{key}` as key", f"`{vector}` as v")
    return rows.groupBy("rec").applyInPandas(pack, f"rec {kind}, content binary")

"""Waveforms as tables: whole files, or ranges of files so that a recording may have any length."""

from __future__ import annotations

import io
import re
import struct
import wave
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from segspark.ship import ensure

from .files import file_system, listed

#: Samples of a chunk, and bytes of a read partition.
CHUNK, SPLIT = 1 << 16, 32 << 20
RATES = (8000, 16000)


def checked_rate(rate: int) -> int:
    if rate not in RATES:
        raise ValueError(f"sampling rate must be 8000 or 16000, not {rate}")
    return rate


def scaled(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1] of the first channel of interleaved little-endian integers."""
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2.0**31
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels)[:, 0].astype(float)


def samples_of(content: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] of the first channel, and the sampling rate, which must be 8 or 16 kHz."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    return scaled(raw, width, channels), checked_rate(rate)


def name_of(path: str) -> str:
    """The recording: a file's name without its last suffix."""
    return re.search(r"([^/]+?)(\.[^./]*)?$", path)[1]


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """``rec, samplerate, x array<double>``, a row per ``<rec>.wav``; for files that fit a row, see ``read_chunks``."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                x, rate = samples_of(content)
                rows.append((name_of(p), rate, x))
            yield pd.DataFrame(rows, columns=["rec", "samplerate", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "rec string, samplerate int, x array<double>")


@dataclass(frozen=True)
class Layout:
    """Where the samples of a RIFF file are: rate, bytes a sample, channels, first byte and number of sample times."""

    rate: int
    width: int
    channels: int
    begin: int
    total: int

    @staticmethod
    def of(f, size: int) -> Layout:
        """From the chunk headers alone; a data chunk of unknown length (0 or all ones) goes to the file's end."""
        head = f.read(12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise ValueError("no RIFF/WAVE file")
        at, form = 12, None
        while at + 8 <= size:
            f.seek(at)
            name, length = struct.unpack("<4sI", f.read(8))
            if name == b"fmt ":
                code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
                if code not in (1, 0xFFFE):
                    raise ValueError(f"samples must be plain integers, not format {code}")
                form = checked_rate(rate), (bits + 7) // 8, channels
            elif name == b"data":
                if form is None:
                    break
                if length in (0, 0xFFFFFFFF) or at + 8 + length > size:
                    length = size - at - 8
                return Layout(*form, at + 8, length // (form[1] * form[2]))
            at += 8 + length + length % 2
        raise ValueError("a WAVE file without format or data")

    def samples_before(self, byte: int) -> int:
        """Sample times that begin before this byte of the file."""
        return int(np.clip(-(-(byte - self.begin) // (self.width * self.channels)), 0, self.total))


@dataclass
class Ranges(InputPartition):
    """Byte ranges ``(path, size, from, to)`` of one task."""

    ranges: list


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk, self.split = options["path"], int(options.get("chunk", CHUNK)), int(options.get("split", SPLIT))

    def partitions(self):
        """Files are cut every ``split`` bytes, and short ones share a partition; no header is read yet."""
        out, now, held = [], [], 0
        for path, size in listed(self.path):
            for at in range(0, size, self.split):
                part = min(self.split, size - at)
                if now and held + part > self.split:
                    out.append(Ranges(now))
                    now, held = [], 0
                now.append((path, size, at, at + part))
                held += part
        return [*out, Ranges(now)] if now else out

    def read(self, partition):
        """Chunks whose first sample begins in the byte range, each whole."""
        system, _ = file_system(self.path)
        for path, size, low, high in partition.ranges:
            with system.open_input_file(path) as f:
                form = Layout.of(f, size)
                first = [-(-form.samples_before(b) // self.chunk) * self.chunk for b in (low, high)]
                for at in range(first[0], min(first[1], form.total) if high < size else form.total, self.chunk):
                    n = min(self.chunk, form.total - at)
                    f.seek(form.begin + at * form.width * form.channels)
                    x = scaled(f.read(n * form.width * form.channels), form.width, form.channels)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name_of(path)]), pa.array([form.rate], pa.int32()), pa.array([form.total]), pa.array([at]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))],
                        ["rec", "samplerate", "total", "first", "x"],
                    )


class WavRanges(DataSource):
    """``spark.read.format("wav_ranges")``: options ``path``, ``chunk`` (samples a row), ``split`` (bytes a partition)."""

    @classmethod
    def name(cls):
        return "wav_ranges"

    def schema(self):
        return "rec string, samplerate int, total bigint, first bigint, x array<double>"

    def reader(self, schema):
        return WavReader(self.options)


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """``rec, samplerate, total, first, x``: chunks of ``chunk`` samples, ``first`` a multiple of it, of ``total`` in a file.

    Partitions are byte ranges, so a file of any length is read by many tasks, each of which opens it and
    reads its header and its own range.  Paths may be of any store that ``pyarrow.fs`` reaches.
    """
    ensure(spark)
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav_ranges").options(path=path, chunk=chunk, split=split).load()

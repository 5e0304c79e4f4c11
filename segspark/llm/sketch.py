"""Fixed-size counts over unbounded keys: built in tasks, summed by slices, small enough to broadcast.

``CELLS`` counters whatever the input; a key's counter is an upper bound of its count, and every use
in this package is safe for any value of the counters (they order keys or skip certain misses).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

BITS = 20
CELLS = 1 << BITS
SLICE = 1 << 16
U = np.uint64


def cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(64 - BITS)).astype(np.int64)


def rows_of(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The non-empty slices of one task's counters."""
    found = [(i, counts[i * SLICE : (i + 1) * SLICE]) for i in range(CELLS // SLICE)]
    found = [(i, zlib.compress(x.astype("<u4").tobytes(), 1)) for i, x in found if x.any()]
    return [i for i, _ in found], [x for _, x in found]


def _summing():
    sums: dict[int, np.ndarray] = {}

    def step(batch: pa.RecordBatch):
        for i, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
            sums[i] = sums[i] + part if i in sums else part.copy()
        return []

    def finish():
        blobs = [zlib.compress(np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

    step.finish = finish
    return step


def merged(rows: DataFrame) -> np.ndarray:
    """Sums of the tasks' counters as one array of 4 MB: each slice is summed as a stream by one task."""
    summed = arrow_map(rows.select("slice", "blob").repartition(CELLS // SLICE, "slice"), _summing, "slice int, blob binary")
    out = np.zeros(CELLS, np.uint32)
    for i, blob in summed.collect():  # at most CELLS // SLICE rows
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(zlib.decompress(bytes(blob)), "<u4")
    return out


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Which cells hold a key of ``column`` (long): a filter without false negatives."""

    def make():
        counts = np.zeros(CELLS, np.uint32)

        def step(batch: pa.RecordBatch):
            counts[cells(batch.column(column).to_numpy().view(U))] = 1
            return []

        def finish():
            i, blobs = rows_of(counts)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

        step.finish = finish
        return step

    return merged(arrow_map(keys.select(column), make, "slice int, blob binary")) > 0



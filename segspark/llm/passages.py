"""What the two passage operators do with texts: pass on those without candidates, and cut spans of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sketch
from .common import arrow_map


def split(docs: DataFrame, wanted) -> DataFrame:
    """``id, key, n_words, sha, text``: documents whose key is in no wanted cell are done, the others keep their text."""

    def make():
        cells = wanted.value

        def step(batch: pa.RecordBatch):
            keys = batch.column("key").to_numpy()
            maybe = cells[sketch.cells(keys.view(np.uint64))] if len(keys) else np.zeros(0, bool)
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            n, sha, text = [], [], []
            for r, m in zip(raw, maybe, strict=True):
                ws = None if m else r.split()
                n.append(None if m else len(ws))
                sha.append(None if m else hashlib.sha256(b" ".join(ws)).hexdigest())
                text.append(r if m else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()).cast(pa.string())], ["id", "key", "n_words", "sha", "text"])

        return step

    return arrow_map(docs, make, f"id {dict(docs.dtypes)['id']}, key long, n_words long, sha string, text string")


def cut(raw: bytes, begin: np.ndarray, end: np.ndarray, with_text: bool) -> tuple[int, int, str, list[int], bytes | None]:
    """A text without the words ``begin .. end - 1`` of any span: words, removed words, digest, removed runs, kept words."""
    ws = raw.split()
    delta = np.zeros(len(ws) + 1, np.int64)
    np.add.at(delta, begin, 1)
    np.add.at(delta, end, -1)
    gone = np.cumsum(delta[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    body = b" ".join(w for w, g in zip(ws, gone.tolist(), strict=True) if not g) if len(edge) else b" ".join(ws)
    return len(ws), int(gone.sum()), hashlib.sha256(body).hexdigest(), edge.tolist(), body if with_text else None

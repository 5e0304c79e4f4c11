"""Embedding inference over windows of features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_windows(features: DataFrame, windows: DataFrame, model: str = "pooling", path: str = "", unit: tuple[str, ...] = ("rec", "segnum")) -> DataFrame:
    """``rec, key, xvec`` of each window ``first .. last`` of ``unit``'s frames ``(frame, feat)``.

    Frames are gathered in blocks that reach a window's length into the next one, so a window finds all its
    frames in the block in which it starts: one equi-join, and a frame is sent about 1.25 times however
    much windows overlap.  The model is loaded once per worker and fed batches of windows of equal length.
    Embeddings with NaN are dropped, and so are windows without frames.
    """
    longest = windows.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 1
    span = 4 * longest
    of = lambda c: F.floor(F.col(c) / span).cast("bigint")
    reach = (F.pmod("frame", F.lit(span)) < longest - 1) & (F.col("frame") >= span)
    blocks = features.select(*unit, "frame", "feat", F.explode(F.when(reach, F.array(of("frame"), of("frame") - 1)).otherwise(F.array(of("frame")))).alias("block"))
    blocks = blocks.groupBy(*unit, "block").agg(F.array_sort(F.collect_list(F.struct("frame", "feat"))).alias("frames"))
    rows = windows.select(*unit, "key", "first", "last", of("first").alias("block")).join(blocks, [*unit, "block"])
    own = F.filter("frames", lambda s: (s["frame"] >= F.col("first")) & (s["frame"] < F.col("last")))
    rows = rows.select(unit[0], "key", F.transform(own, lambda s: s["feat"]).alias("feats")).where(F.size("feats") > 0)
    kind = dict(rows.dtypes)

    def infer(batches):
        from segspark.sources.models import load

        embed = load(model, path)
        for pdf in batches:
            out = [None] * len(pdf)
            for size in pdf.feats.map(len).unique():
                at = np.flatnonzero(pdf.feats.map(len) == size)
                got = embed(np.stack([np.stack(pdf.feats.iloc[i]) for i in at]))
                for i, v in zip(at, got, strict=True):
                    out[i] = np.asarray(v, float)
            keep = [not np.isnan(v).any() for v in out]
            yield pd.DataFrame({"rec": pdf[unit[0]], "key": pdf.key, "xvec": out})[keep]

    return rows.mapInPandas(infer, f"rec {kind[unit[0]]}, key string, xvec array<double>")

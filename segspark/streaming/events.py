"""Streaming forms of the segment operators.  All keep bounded state behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from segspark.operators.kernels import LOG_FLOOR, lse


def timed(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event times as timestamps with a watermark; rows later than ``late`` are left out by what follows."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, key: str = "event_type", column: str = "ts") -> DataFrame:
    """``start, end, key, n`` per tumbling or sliding window."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    return events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", column: str = "ts") -> DataFrame:
    """``key, start, end, n``: events of a key merged while they are less than ``gap`` apart."""
    return events.groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")


def online_hmm(events: DataFrame, transition: list[list[float]], initial: list[float], key: str = "rec", order: str = "idx", vector: str = "ll", time: str = "ts", idle: float = 3600.0) -> DataFrame:
    """``rec, idx, state, evidence``: the HMM's forward filter, one vector of log probabilities per key as state.

    ``time`` is the watermarked event time (see ``timed``).  A key that the watermark finds idle for
    ``idle`` seconds is forgotten, and begins anew should it return; so state is bounded by the keys that
    are active.  Rows of one micro-batch are put in order; a row that comes later than its successors, but
    within the watermark, is filtered where it arrives.
    """
    tr, ip = np.log(np.array(transition) + LOG_FLOOR), np.log(np.array(initial) + LOG_FLOOR)
    kind = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, total, latest = (np.array(state.get[0]), state.get[1], state.get[2]) if state.exists else (None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for i, ll in zip(rows[order], rows[vector], strict=True):
            now = np.asarray(ll, float) + (ip if now is None else lse(now[:, None] + tr, 0))
            norm = float(lse(now, 0))
            now, total = now - norm, total + norm
            out.append((k[0], i, int(now.argmax()), total))
        latest = max(latest, int(rows[time].max().timestamp() * 1000))
        state.update((now.tolist(), total, latest))
        # never at or before the watermark, which a late row may be
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(idle * 1000))
        yield pd.DataFrame(out, columns=["rec", "idx", "state", "evidence"])

    return events.groupBy(key).applyInPandasWithState(step, f"rec {kind[key]}, idx {kind[order]}, state int, evidence double", "f array<double>, total double, latest long", "append", GroupStateTimeout.EventTimeTimeout)

"""Streams in the order of event time, whatever the order of arrival.

Rows wait in state until the watermark has passed their time; then they are worked on in order, so a row that
is late within the watermark gives what it gives in order.  An event-time timer a key releases what is due and
forgets a key that the watermark finds idle, so state holds the rows of one watermark delay and what open keys
remember.  Needs the RocksDB state store (``use_rocksdb``); results appear once the watermark is past their rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from segspark.operators.kernels import LOG_FLOOR, lse
from segspark.operators.segments import ABS_TOL, REL_TOL


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need, for streams of this session that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Calls ``advance(memory, row)`` for every row of a key in order of time and ``order``.

    It returns the new memory and result rows; ``leave(memory)`` gives the last results of a key that has been idle
    for ``idle`` milliseconds.  ``fields`` are the input columns of a row, ``names`` those of a result after the key.
    """

    def __init__(self, key: str, fields: list[str], names: list[str], advance: Callable, leave: Callable, idle: int):
        self.key, self.fields, self.names, self.advance, self.leave, self.idle = key, fields, names, advance, leave, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, nth long, row binary")
        self.memory = handle.getValueState("memory", "latest long, timer long, content binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            some = [(int(ms), int(nth), pickle.dumps(tuple(row))) for ms, nth, *row in pdf[["ms_", "nth_", *self.fields]].itertuples(index=False)]
            if some:
                self.waiting.appendList(some)
                least = min(x[0] for x in some)
                first = least if first is None else min(first, least)
        if first is not None:
            latest, timer, content = self.remembered()
            if timer is None or first < timer:
                self.remember(latest, self.set_timer(timer, first), content)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        latest, _, content = self.remembered()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:2])
        rest = [r for r in rows if r[0] > now]
        memory, out = pickle.loads(content) if content is not None else None, []
        for ms, _, row in due:
            memory, found = self.advance(memory, pickle.loads(bytes(row)))
            out += found
            latest = ms if latest is None else max(latest, ms)
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if not rest and latest is not None and now >= latest + self.idle:
            out += self.leave(memory)
            self.memory.clear()
        else:
            goal = min(r[0] for r in rest) if rest else latest + self.idle
            self.remember(latest, self.set_timer(None, goal), pickle.dumps(memory))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.names])

    def remembered(self):
        return tuple(self.memory.get()) if self.memory.exists() else (None, None, None)

    def remember(self, latest, timer, content):
        self.memory.update((latest, timer, content))

    def set_timer(self, old, new):
        """One timer a key."""
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        return new


def in_order(events: DataFrame, key: str, time: str, order: str, fields: list[str], names: list[str], schema: str, advance: Callable, leave: Callable, idle: float) -> DataFrame:
    """The results of ``InOrder`` over a stream with a watermark on ``time`` (see ``events.timed``)."""
    rows = events.select(key, time, F.unix_millis(time).alias("ms_"), F.col(order).cast("bigint").alias("nth_"), *fields)
    return rows.groupBy(key).transformWithStateInPandas(InOrder(key, fields, names, advance, leave, int(idle * 1000)), f"{key} {dict(events.dtypes)[key]}, {schema}", "Append", "EventTime")


def ordered_hmm(events: DataFrame, transition: list[list[float]], initial: list[float], key: str = "rec", order: str = "idx", vector: str = "ll", time: str = "ts", idle: float = 3600.0) -> DataFrame:
    """``key, idx, state, evidence``: the HMM's forward filter in order of event time.

    A key that the watermark finds idle for ``idle`` seconds is forgotten and begins anew should it return.
    """
    tr, ip = np.log(np.array(transition) + LOG_FLOOR), np.log(np.array(initial) + LOG_FLOOR)

    def advance(memory, row):
        idx, ll = row
        now, total = memory if memory else (None, 0.0)
        now = np.asarray(ll, float) + (ip if now is None else lse(now[:, None] + tr, 0))
        norm = float(lse(now, 0))
        return (now - norm, total + norm), [(idx, int(now.argmax()), total + norm)]

    return in_order(events, key, time, order, [order, vector], ["idx", "state", "evidence"], f"idx {dict(events.dtypes)[order]}, state int, evidence double", advance, lambda memory: [], idle)


def near_seconds(a: float, b: float) -> bool:
    return abs(a - b) <= ABS_TOL + REL_TOL * abs(b)


def ordered_merge(segments: DataFrame, key: str = "rec", order: str = "idx", time: str = "ts", label: str = "label", near: Callable[[float, float], bool] = near_seconds, idle: float = 3600.0) -> DataFrame:
    """``key, start, end, label``: ``merge_adjacent`` of a stream of segments ``start, end, label``.

    State is a key's open run.  It is given out when the next run of its key begins, with the middle for an end where
    they overlap, or when the watermark finds the key idle for ``idle`` seconds; choose that longer than any
    segment and pause after which a segment may still touch.
    """
    kind = dict(segments.dtypes)

    def advance(memory, row):
        start, end, name = row
        if memory is None:
            return (start, end, name), []
        began, ended, held = memory
        if name == held and (near(ended, start) or ended > start):
            return (began, end, held), []
        middle = (ended + start) / 2 if start < ended else None
        return (start if middle is None else middle, end, name), [(float(began), float(ended if middle is None else middle), held)]

    def leave(memory):
        return [(float(memory[0]), float(memory[1]), memory[2])] if memory else []

    rows = segments.withColumns({c: F.col(c).cast("double") for c in ("start", "end")})
    return in_order(rows, key, time, order, ["start", "end", label], ["start", "end", "label"], f"start double, end double, label {kind[label]}", advance, leave, idle)


def event_times(seconds: Column) -> Column:
    """Event time of a position in seconds."""
    return F.timestamp_micros((seconds * 1000000).cast("bigint"))

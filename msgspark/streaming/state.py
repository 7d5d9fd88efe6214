"""Keyed state of the streaming jobs: processors for ``transformWithState`` on the RocksDB store."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which these processors need; a query that is
    resumed keeps the store it was started with."""
    if spark.conf.get(PROVIDER, None) != ROCKS_DB:
        spark.conf.set(PROVIDER, ROCKS_DB)


class RateLimiter(StatefulProcessor):
    """Whether each request of a client is within ``limit`` accepted ones per ``span`` microseconds.

    State is a list of the accepted times of the last span, ``limit`` at most, and a timer that clears it once the
    watermark has passed the span of the last one. Chunks of a batch are sorted one by one and merged; of a row only its
    time and place are held.
    """

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "at bigint")

    def decided(self, taken: deque, times: Iterator[int]) -> Iterator[bool]:
        for at in times:
            while taken and taken[0] <= at - self.span:
                taken.popleft()
            ok = len(taken) < self.limit
            if ok:
                taken.append(at)
            yield ok

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = deque(int(r[0]) for r in self.taken.get()) if self.taken.exists() else deque()
        parts = []
        for chunk in rows:
            order = np.lexsort((chunk["request_id"].to_numpy(), chunk["at"].to_numpy()))
            parts.append((chunk["at"].to_numpy()[order], chunk["request_id"].to_numpy()[order]))
        places = heapq.merge(*(zip(times.tolist(), ids.tolist(), repeat(k)) for k, (times, ids) in enumerate(parts)))
        if len(parts) == 1:
            answers = [np.fromiter(self.decided(taken, map(int, parts[0][0])), bool, len(parts[0][0]))]
        else:
            answers = [np.empty(len(times), bool) for times, _ in parts]
            done = [0] * len(parts)
            order: deque = deque()

            def times():
                for at, _, k in places:
                    order.append(k)
                    yield at

            for ok in self.decided(taken, times()):
                k = order.popleft()
                answers[k][done[k]] = ok
                done[k] += 1
        self.keep(taken, timerValues)
        for (_, ids), ok in zip(parts, answers, strict=True):
            yield pd.DataFrame({"client": [key[0]] * len(ids), "request_id": ids, "accepted": ok})

    def keep(self, taken: deque, timer_values) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if taken:
            self.taken.put([(int(at),) for at in taken])
            over = (taken[-1] + self.span) // 1000 + 1
            self.handle.registerTimer(max(over, timer_values.getCurrentWatermarkInMs() + 1))
        else:
            self.taken.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.taken.clear()
        return iter([])

    def close(self) -> None:
        pass


class LatestIds(StatefulProcessor):
    """The ids of the ``n`` latest rows of a key, as a list state of that length at most; one row a key and micro-batch."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at bigint, id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(r[0]), int(r[1])) for r in self.held.get()] if self.held.exists() else []
        for chunk in rows:
            held = heapq.nlargest(self.n, held + list(zip(chunk["at"].astype(int), chunk["error_id"].astype(int), strict=True)))
        held.sort()
        self.held.put(held)
        yield pd.DataFrame({"component": [key[0]], "operation": [key[1]], "error_ids": [[i for _, i in held]]})

    def close(self) -> None:
        pass

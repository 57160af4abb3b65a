"""Circuit breakers as the state of a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATES = "service string, seq long, ms long, state string"


class Breaker(StatefulProcessor):
    """Of each service the failures in a row and when they reached the threshold; a timer tells when the cooldown is over."""

    def __init__(self, threshold: int, cooldown_ms: int):
        self.threshold, self.cooldown_ms = threshold, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("breaker", "failures long, opened long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values("seq")
        failures, opened = self.held.get() if self.held.exists() else (0, 0)
        before, states = opened if failures >= self.threshold else None, []
        for ms, ok in zip(calls["ms"].tolist(), calls["ok"].tolist(), strict=True):
            states.append("closed" if failures < self.threshold else "half-open" if ms - opened >= self.cooldown_ms else "open")
            failures = 0 if ok else failures + 1
            opened = ms if failures == self.threshold else opened
        self.held.update((failures, opened))
        now = opened if failures >= self.threshold else None
        if now != before:
            if before is not None:
                self.handle.deleteTimer(before + self.cooldown_ms)
            if now is not None:
                self.handle.registerTimer(now + self.cooldown_ms)
        yield pd.DataFrame({"service": key[0], "seq": calls["seq"].to_numpy(), "ms": calls["ms"].to_numpy(), "state": states})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame({"service": [key[0]], "seq": pd.array([None], "Int64"), "ms": [at], "state": ["half-open"]})

    def close(self) -> None:
        """The state is Spark's."""


def breaker_stream(calls: DataFrame, threshold: int = 5, cooldown_ms: int = 30_000, late: str = "1 hour") -> DataFrame:
    """(service, seq, ms, state) before each call of a stream (service, seq, ms, ok), and a row without seq when a cooldown is over, by the calls' own time.

    Calls of a micro-batch go by seq; those that are more than ``late`` behind are dropped. Needs a state store with timers (RocksDB's).
    """
    timed = calls.select(F.col("service").cast("string").alias("service"), "seq", "ms", "ok", F.timestamp_millis("ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("service").transformWithStateInPandas(Breaker(threshold, cooldown_ms), STATES, "Append", "EventTime")

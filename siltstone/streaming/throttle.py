"""A sliding throttle over a stream: at most so many requests of a key in the last seconds."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.streaming.timers import in_order

#: Requests in an entry of the state.
CHUNK = 1 << 13


class _Throttle(StatefulProcessor):
    """Keeps requests until the watermark has passed them, so that they are decided in order of time, in whatever order they
    came. State is the times to come, eight bytes each in chunks, and the last allowed times, ``limit`` at most. It is read
    and written once for a key and batch, not for each request: one timer, at the first time to come, decides all that the
    watermark has passed."""

    def __init__(self, seconds: int, limit: int):
        self.micros, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros binary")
        self.recent = handle.getValueState("recent", "micros array<long>")

    def _wait(self, times: np.ndarray) -> None:
        for i in range(0, len(times), CHUNK):
            self.waiting.appendValue((times[i : i + CHUNK].tobytes(),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, chunk = None, []
        for row in rows:
            first = row.micros if first is None else min(first, row.micros)
            chunk.append(row.micros)
            if len(chunk) == CHUNK:
                self._wait(np.array(chunk, np.int64))
                chunk = []
        self._wait(np.array(chunk, np.int64))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = np.sort(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c[0], np.int64) for c in self.waiting.get())]))
        n = int(np.searchsorted(times, passed, "right"))
        recent = deque(self.recent.get()[0] if self.recent.exists() else ())
        for i in range(0, n, CHUNK):
            chunk, verdicts, waits = times[i : min(i + CHUNK, n)].tolist(), [], []
            for micros in chunk:
                while recent and recent[0] <= micros - self.micros:
                    recent.popleft()
                verdicts.append(len(recent) < self.limit)
                waits.append(0.0 if verdicts[-1] else (recent[0] + self.micros - micros) / 1e6)
                if verdicts[-1]:
                    recent.append(micros)
            yield Row(key=key[0], micros=chunk, allowed=verdicts, retry_after=waits)
        if n:
            self.waiting.clear()
            self._wait(times[n:])
        if n < len(times):
            self.handle.registerTimer(-(-int(times[n]) // 1000))
        if recent and recent[-1] <= passed - self.micros:  # the key's last window has gone by
            self.recent.clear()
        elif n:
            self.recent.update((list(recent),))
            self.handle.registerTimer(-(-(recent[-1] + self.micros) // 1000) + 1)

    def close(self) -> None:
        pass


def throttled(requests: DataFrame, key: str, time: str = "ts", seconds: int = 60, limit: int = 60, delay: str = "10 minutes") -> DataFrame:
    """``(key, ts, allowed, retry_after)`` for each request that the watermark has passed. A refused request doesn't count.

    Requests of a key are decided one after the other in order of event time; of a key, only the times that wait for the
    watermark are held together, eight bytes each. ``limit`` is 1 or more. Requests later than ``delay`` are dropped, as by
    any watermark.
    """
    kind = requests.schema[key].dataType.simpleString()
    own = requests.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(time).alias("ts"), F.unix_micros(time).alias("micros"))
    out = in_order(own, _Throttle(seconds, limit), f"key {kind}, micros array<long>, allowed array<boolean>, retry_after array<double>")
    each = out.select(F.col("key"), F.inline(F.arrays_zip("micros", "allowed", "retry_after")))
    return each.select(F.col("key").alias(key), F.timestamp_micros("micros").alias("ts"), "allowed", "retry_after")

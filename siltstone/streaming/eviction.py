"""Evictions over a stream of accesses: a snapshot goes once it hasn't been used for some days of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import values as V


def evictions(accesses: DataFrame, key: str, time: str = "ts", days: float = V.EVICT_AFTER_DAYS, delay: str = "10 minutes") -> DataFrame:
    """``(key, last_access)``: a row each time that a snapshot wasn't used for ``days`` up to the watermark. One that is used
    again later is live again, and may be evicted again. State is a row for each session of accesses less than ``days``
    apart, until the watermark has passed its end. Accesses later than ``delay`` count while their own ``days`` aren't over
    at the watermark, and are dropped from then on.
    """
    # sessions that only touch become one, so they end a microsecond before the time to live does
    gap = round(days * 86_400_000) * 1000 - 1
    own = accesses.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(time).alias("ts"))
    last = own.groupBy("key", F.session_window("ts", f"{gap} microseconds")).agg(F.max(F.unix_micros("ts")).alias("micros"))
    return last.select(F.col("key").alias(key), F.timestamp_micros("micros").alias("last_access"))

"""Arbitrary state with event-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def in_order(rows: DataFrame, processor: StatefulProcessor, out: str) -> DataFrame:
    """``processor`` over the rows of each ``key``."""
    return rows.groupBy("key").transformWithState(processor, out, "append", "eventTime")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which timers and maps need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def with_state_on_disk(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    with state_on_disk(spark):
        return run()

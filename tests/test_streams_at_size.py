"""Streams: what a replay costs, and results at the borders of a time to live."""

from pyspark.sql import functions as F


def _live(spark, folder, rows):
    spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_micros("t").alias("ts")).repartition(2).write.parquet(str(folder))
    return spark.readStream.schema("k string, ts timestamp").parquet(str(folder))


def test_evictions_need_no_timer_for_an_access(spark, tmp_path):
    from siltstone.streaming import eviction, metrics as stream, timers

    ttl = 86_400_000_000
    rows = [("edge", 0), ("edge", ttl), ("within", 0), ("within", ttl - 1), ("over", 0), ("over", ttl + 1), ("twice", 5), ("twice", 5), (None, 7), ("end", 10 * ttl)]
    live = eviction.evictions(_live(spark, tmp_path / "log", rows), "k", days=1)
    got = timers.with_state_on_disk(spark, lambda: stream.replayed(live, "append")).select("k", F.unix_micros("last_access"))
    want = [("edge", 0), ("edge", ttl), ("over", 0), ("over", ttl + 1), ("twice", 5), ("within", ttl - 1), (None, 7)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "TransformWithState" not in live._jdf.queryExecution().analyzed().toString()


def test_throttle_reads_and_writes_state_once_for_a_key_and_batch():
    from pyspark.sql import Row

    from siltstone.streaming.throttle import _Throttle

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendValue", "appendList"):
                    self.held += [args[0]] if name == "appendValue" else args[0]
                elif name == "update":
                    self.held = [args[0]]
                elif name == "clear":
                    self.held = []
                elif name == "exists":
                    return bool(self.held)
                elif name == "get":
                    return self.held[0] if isinstance(self, Value) else iter(list(self.held))

            return call

    class Value(State):
        pass

    class Handle:
        def __init__(self):
            self.timers = set()

        getListState = getMapState = lambda self, *_: State()
        getValueState = lambda self, *_: Value()
        registerTimer = lambda self, ms: (calls.append("timer"), self.timers.add(ms))

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    own, handle = _Throttle(60, 2), Handle()
    own.init(handle)

    def batch(times, watermark):
        own.handleInputRows(("k",), iter([Row(micros=t) for t in times]), At(-1))
        out = []
        for ms in sorted(x for x in handle.timers if x <= watermark):
            handle.timers.remove(ms)
            for r in own.handleExpiredTimer(("k",), At(watermark), At(ms)):
                out += zip(r.micros, r.allowed, r.retry_after)
        return out

    seconds = [i * 1_000_000 for i in range(2000)]
    first = batch(seconds[1000::-1], 899_000)  # 900 and later wait
    second = batch(seconds[1001:], 5_000_000)
    assert len(calls) < 40, len(calls)
    want, recent = [], []
    for t in seconds:
        recent = [x for x in recent if x > t - 60_000_000]
        want.append((t, len(recent) < 2, 0.0 if len(recent) < 2 else (recent[0] + 60_000_000 - t) / 1e6))
        recent += [t] if len(recent) < 2 else []
    assert first == want[:900] and second == want[900:]

"""Weighted aggregates over a request log (``siltstone.plans.fixtures.requests`` has its columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import values as V


def is_error() -> Column:
    """Three-digit statuses compare as text."""
    return F.col("status") >= "400"


def requests_() -> Column:
    return F.sum("weight").cast("long").alias("requests")


def errors_() -> Column:
    return F.coalesce(F.sum(F.when(is_error(), F.col("weight"))), F.lit(0)).cast("long").alias("errors")


#: Bins of the quantiles' histogram: so many to a factor of e in the duration, beyond one millisecond.
BINS = 4096


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys of which null is one like any other; the columns of ``b`` beside its keys come along."""
    names = {k: f"_{i}_{k}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return a.join(b.withColumnsRenamed(names), on, how).drop(*names.values())


def with_quantiles(groups: DataFrame, log: DataFrame, keys: list[str], *shares: float) -> DataFrame:
    """``groups`` (a row for each value of ``keys``) with exact, interpolated quantiles of the duration over the rows of
    ``log`` repeated by their weight, as ``p50`` and so on; null for a group without durations.

    A histogram on a logarithmic scale tells which bin holds each rank; only the values of these bins are put in
    order, and a bin is a task's share. Equal values are summed before anything is shuffled, and no group is held
    in a buffer: bins and values are summed up row by row in sorted order.
    """
    keys = keys or ["_all"]
    if keys == ["_all"]:
        groups, log = groups.withColumn("_all", F.lit(0)), log.withColumn("_all", F.lit(0))
    v = F.col("duration_ms").cast("double")
    counts = log.where(v.isNotNull() & (F.col("weight") > 0)).groupBy(*keys, v.alias("_v")).agg(F.sum("weight").alias("_n"))
    counts = counts.withColumn("_bin", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * BINS))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys)
    bins = bins.withColumns({"_upto": F.sum("_n").over(group.orderBy("_bin")), "_total": F.sum("_n").over(group)})
    ranks = F.array(*[F.struct(F.lit(i).alias("share"), F.lit(hi).alias("upper"), (F.ceil if hi else F.floor)(F.lit(q) * (F.col("_total") - 1)).alias("rank")) for i, q in enumerate(shares) for hi in (False, True)])
    wanted = F.filter(ranks, lambda r: (r["rank"] >= F.col("_upto") - F.col("_n")) & (r["rank"] < F.col("_upto")))
    bins = bins.withColumn("_wanted", wanted).where(F.size("_wanted") > 0).select(*keys, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_total", "_wanted")
    inside = same_keys(counts, bins, [*keys, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    found = inside.withColumn("_r", F.explode(F.filter("_wanted", lambda r: (r["rank"] >= F.col("_upto") - F.col("_n")) & (r["rank"] < F.col("_upto")))))
    at = lambda i, hi: F.max(F.when((F.col("_r")["share"] == i) & (F.col("_r")["upper"] == F.lit(hi)), F.col("_v")))
    out = []
    for i, q in enumerate(shares):
        place, low, high = F.lit(q) * (F.max("_total") - 1), at(i, False), at(i, True)
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when(low == high, low).otherwise(between).alias(f"p{round(q * 100)}"))
    return same_keys(groups, found.groupBy(*keys).agg(*out), keys, "left").drop("_all")


def recent(log: DataFrame, hours: int) -> DataFrame:
    """The last hours before the newest row; the newest time is one scalar."""
    newest = log.agg(F.max("ts")).first()[0]
    return log.where(F.col("ts") > F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS"))


def in_repo(log: DataFrame) -> DataFrame:
    return log.where((F.col("owner") != "-") & (F.col("owner") != "") & F.col("action").isin(V.REPO_ACTIONS))


def grouped(log: DataFrame, keys: list[str], *measures: Column, limit: int | None = None, shares: tuple[float, ...] = ()) -> DataFrame:
    """Groups by weight, largest first; ties in key order, so that a limit is well defined. Quantiles are those of the
    groups within the limit only."""
    out = log.groupBy(*keys).agg(requests_(), *measures)
    out = out.orderBy(F.desc("requests"), *keys).limit(limit) if limit else out
    return quantiles(out, log, keys, shares, limit) if shares else out


def quantiles(groups: DataFrame, log: DataFrame, keys: list[str], shares: tuple[float, ...], limit: int | None) -> DataFrame:
    """``with_quantiles``, of rows of the groups alone where these are few."""
    own = same_keys(log, F.broadcast(groups.select(*keys)), keys) if limit and keys else log
    return with_quantiles(groups, own, keys, *shares)


def top_repos(log: DataFrame, limit: int = 50) -> DataFrame:
    out = grouped(in_repo(log), ["owner", "repo"], errors_(), limit=min(limit, 200), shares=(0.5, 0.95))
    return out.withColumn("error_rate", F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0))


def by_action(log: DataFrame) -> DataFrame:
    return grouped(log, ["action"], limit=50, shares=(0.5, 0.95, 0.99))


def top_errors(log: DataFrame) -> DataFrame:
    return grouped(log.where(is_error()), ["status", "action", "owner", "repo"], limit=30, shares=(0.95,))


def by_status(log: DataFrame) -> DataFrame:
    return grouped(log, ["status"], limit=20)


def totals(log: DataFrame) -> DataFrame:
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    edge = F.sum(F.when(F.col("source") == "edge", F.col("weight")))
    return with_quantiles(log.agg(zero(F.sum("weight"), "requests"), errors_(), zero(edge, "edge")), log, [], 0.5, 0.95, 0.99)


def unique_repos(log: DataFrame, approximate: bool = False) -> DataFrame:
    pair = F.struct("owner", "repo")
    return log.agg((F.approx_count_distinct(F.xxhash64("owner", "repo")) if approximate else F.countDistinct(pair)).alias("repos"))


def time_series(log: DataFrame, minutes: int) -> DataFrame:
    """Tumbling buckets of whole minutes; 5 for an hour's view, 60 otherwise."""
    own = log.withColumn("bucket", F.window("ts", f"{minutes} minutes")["start"])
    return with_quantiles(own.groupBy("bucket").agg(requests_(), errors_()), own, ["bucket"], 0.95)


def by_client(log: DataFrame) -> DataFrame:
    named = log.withColumn("client", F.when(F.col("client") == "", "unknown").otherwise(F.col("client")))
    return grouped(named, ["client"], errors_(), F.countDistinct("owner", "repo").alias("unique_repos"), limit=30, shares=(0.5, 0.95))


def slow_requests(log: DataFrame, limit: int = 20) -> DataFrame:
    slow = F.coalesce(F.sum(F.when(F.col("duration_ms") > V.SLOW_MS, F.col("weight"))), F.lit(0)).cast("long")
    keys = ["action", "owner", "repo", "client"]
    out = log.groupBy(*keys).agg(slow.alias("slow"), requests_()).where("slow > 0")
    return quantiles(out.orderBy(F.desc("slow"), *keys).limit(limit), log, keys, (0.95, 0.99), limit)


def recent_failures(log: DataFrame) -> DataFrame:
    keys = ["minute", "status", "action", "owner", "repo", "client", "path"]
    own = log.where(is_error()).withColumn("minute", F.date_trunc("minute", F.col("ts")))
    out = own.groupBy(*keys).agg(requests_()).orderBy(F.desc("minute"), *keys[1:]).limit(50)
    return quantiles(out, own, keys, (0.95,), 50)


def ingest_failures(log: DataFrame) -> DataFrame:
    """Failures by slug and reason; the slug is owner/repo, a missing part is ``?``."""
    slug = F.split(F.concat_ws("/", F.nullif(F.col("owner"), F.lit("-")), "repo"), "/")
    part = lambda i: F.coalesce(F.get(slug, F.lit(i)), F.lit("?"))
    rows = log.where(F.col("status") == "500").select(part(0).alias("owner"), part(1).alias("repo"), F.col("status").alias("reason"), "weight")
    return grouped(rows, ["owner", "repo", "reason"], limit=25)


def latency_histogram(log: DataFrame) -> DataFrame:
    edges = V.LATENCY_EDGES
    order, label = F.lit(len(edges)), F.lit("5s+")
    for i, edge in reversed(list(enumerate(edges))):
        order, label = F.when(F.col("duration_ms") < edge, i).otherwise(order), F.when(F.col("duration_ms") < edge, f"<{edge}ms").otherwise(label)
    return log.groupBy(label.alias("bucket"), order.alias("bucket_order")).agg(requests_())


def by_dimension(log: DataFrame) -> DataFrame:
    """Action, status, source and kind of reference in one pass over the log."""
    own = log.select(F.posexplode(F.array("action", "status", "source", "ref_kind")).alias("pos", "value"), "weight")
    name = F.get(F.array(*[F.lit(n) for n in ("action", "status", "source", "ref_kind")]), F.col("pos"))
    return own.groupBy(name.alias("dimension"), "value").agg(requests_())


def error_groups(log: DataFrame) -> DataFrame:
    return grouped(log.where(is_error()), ["status", "action"], limit=25, shares=(0.95,))


def of_repo(log: DataFrame, owner: str, repo: str) -> DataFrame:
    return log.where((F.col("owner") == owner) & (F.col("repo") == repo))


def bundle(log: DataFrame) -> DataFrame:
    """The ratios of the overview, without division by zero."""
    t = totals(log)
    share = lambda n: F.when(F.col("requests") > 0, F.col(n) / F.col("requests")).otherwise(0.0)
    return t.select("requests", "errors", share("errors").alias("error_rate"), share("edge").alias("cache_hit_rate"), "p50", "p95", "p99")


def error_reason(status: Column, body: Column) -> Column:
    """A name for an upstream failure by status, and by what the body says."""
    limited = F.lower(body).contains("rate limit")
    out = F.when(status == "404", "not_found").when((status == "403") & limited, "rate_limited").when(status == "403", "forbidden")
    return out.when(status == "451", "unavailable_legal").when(status.isin("502", "503", "504"), "upstream_down").when(status >= "400", "upstream_error")


def repo_series(log: DataFrame, owner: str, repo: str, minutes: int = 60) -> DataFrame:
    return time_series(of_repo(log, owner, repo), minutes)


DETAIL_LIMITS = {"action": 30, "status": 20, "source": 10, "ref_kind": 10}


def repo_detail(log: DataFrame, owner: str, repo: str) -> DataFrame:
    """``(dimension, value, requests)`` of one repository, the most frequent values of each; one pass over its rows.

    An empty client or kind is ``(none)``, a missing value ``(unknown)``.
    """
    own = by_dimension(of_repo(log, owner, repo))
    named = own.withColumn("value", F.when(F.col("value") == "", "(none)").otherwise(F.coalesce("value", F.lit("(unknown)"))))
    limit = F.create_map(*[F.lit(x) for kv in DETAIL_LIMITS.items() for x in kv])
    best = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("requests"), "value"))
    return named.withColumn("_n", best).where(F.col("_n") <= F.element_at(limit, F.col("dimension"))).drop("_n")


def overview(log: DataFrame) -> dict[str, DataFrame]:
    """The parts of the overview page over one log, which the caller may persist."""
    parts = {"ratios": bundle, "top_repos": top_repos, "by_action": by_action, "by_status": by_status, "by_client": by_client, "top_errors": top_errors, "unique_repos": unique_repos, "slow_requests": slow_requests, "recent_failures": recent_failures, "ingest_failures": ingest_failures, "latency": latency_histogram}
    return {name: f(log) for name, f in parts.items()} | {"series": time_series(log, 60)}


def overview_counts(log: DataFrame) -> DataFrame:
    """``(part, label, requests)``: the counted parts of the overview, in one pass over the log."""
    latency = F.lit("5s+")
    for edge in reversed(V.LATENCY_EDGES):
        latency = F.when(F.col("duration_ms") < edge, f"<{edge}ms").otherwise(latency)
    client = F.when(F.col("client") == "", "unknown").otherwise(F.col("client"))
    repo = F.when(F.col("owner").isin("-", "") | ~F.col("action").isin(V.REPO_ACTIONS), None).otherwise(F.concat_ws("/", "owner", "repo"))
    parts = {"by_action": (F.col("action"), 50), "by_status": (F.col("status"), 20), "by_client": (client, 30), "latency": (latency, len(V.LATENCY_EDGES) + 1), "top_repos": (repo, 50)}
    each = F.array(*[F.struct(F.lit(p).alias("part"), c.alias("label"), F.lit(n).alias("most")) for p, (c, n) in parts.items()])
    counted = log.select(F.explode(each).alias("e"), "weight").where("NOT (e.part = 'top_repos' AND e.label IS NULL)").select("e.*", "weight").groupBy("part", "label", "most").agg(requests_())
    best = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("requests"), "label"))
    return counted.withColumn("_n", best).where("_n <= most").select("part", "label", "requests")


def throttle(log: DataFrame, key: str, seconds: int = 60, limit: int = 60, stretch: int = 20) -> DataFrame:
    """Requests of the same key in the last seconds, the row's own included, and whether the limit is exceeded.

    A key's time is cut into stretches of ``stretch * seconds``; a row near the end of one goes into the next as
    well, where it only counts. So a key with many rows is many tasks' work.
    """
    width = seconds * stretch
    at, own = F.unix_micros(F.col("ts").cast("timestamp")), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (width * 1_000_000))
    near = F.floor((at + seconds * 1_000_000) / (width * 1_000_000)) > own
    both = log.withColumn("_at", at).withColumn("_in", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_own", own)
    w = Window.partitionBy(key, "_in").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    counted = both.withColumn("in_window", F.count(F.lit(1)).over(w)).where(F.col("_in") == F.col("_own")).drop("_at", "_in", "_own")
    return counted.withColumn("throttled", F.col("in_window") > limit)


def rate_limited(log: DataFrame, key: str, limits: list[tuple[int, int]]) -> DataFrame:
    """``(key, seconds, window_start, requests)`` of tumbling windows in which a key had more than it may; each limit is
    ``(seconds, requests)``. All limits in one pass over the log."""
    starts = F.array(*[F.struct(F.lit(s).alias("seconds"), F.lit(n).alias("most"), (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / s) * s).alias("start")) for s, n in limits])
    each = log.select(F.col(key).alias("key"), F.explode(starts).alias("w")).select("key", "w.*")
    counted = each.groupBy("key", "seconds", "most", "start").agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") > F.col("most"))
    return counted.select("key", "seconds", "most", F.timestamp_seconds("start").cast("timestamp_ntz").alias("window_start"), "requests")


def evicted(accesses: DataFrame, keys: list[str], days: int = V.EVICT_AFTER_DAYS) -> DataFrame:
    """Snapshots not used for ``days`` before the newest access; the newest time is one scalar."""
    newest = accesses.agg(F.max("ts")).first()[0]
    last = accesses.groupBy(*keys).agg(F.max("ts").alias("last_access"))
    return last.where(F.col("last_access") <= F.lit(newest) - F.expr(f"INTERVAL {days} DAYS"))

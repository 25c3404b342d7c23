"""Queries over the given tables, one for each operator, and independent SQL for what SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import paths as P
from siltstone.functions import values as V
from siltstone.functions.embedding import text_vector
from siltstone.functions.questions import like_symbol, question_parts, repository_parts
from siltstone.functions.text import line_count
from siltstone.functions.values import STOP_WORDS
from siltstone.operators import evaluation as E
from siltstone.operators import grep as G
from siltstone.operators import index as I
from siltstone.operators import judge as J
from siltstone.operators import line_index as X
from siltstone.operators import listing as L
from siltstone.operators import metrics as M
from siltstone.operators import outline as O
from siltstone.operators import retrieval as R
from siltstone.operators import shell as S
from siltstone.operators import vectors as N
from siltstone.plans import samples
from siltstone.plans.fixtures import FILES_SQL, REQUESTS_SQL, files, files_of, requests, table
from siltstone.streaming import metrics as K
from siltstone.sources.archives import write_archives
from siltstone.sources.snapshots import read_archives
from siltstone.sources.storage import new_folder, spread
from siltstone.streaming.eviction import evictions
from siltstone.streaming.throttle import throttled
from siltstone.streaming.timers import with_state_on_disk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_FILES = f"WITH files_v AS ({FILES_SQL})"
_LINES = f"{_FILES}, lines_v AS (SELECT path, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text FROM (SELECT path, string_split(text, chr(10)) AS a FROM files_v WHERE text <> ''))"
_REQUESTS = f"WITH requests_v AS ({REQUESTS_SQL})"
_DAY = "r AS (SELECT * FROM requests_v WHERE ts > (SELECT max(ts) FROM requests_v) - INTERVAL 168 HOURS)"
_ERRORS = "CAST(coalesce(sum(CASE WHEN status >= '400' THEN weight END), 0) AS BIGINT) AS errors"
_REQ = "CAST(sum(weight) AS BIGINT) AS requests"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _w(*shares: float) -> str:
    """The weighted quantile in SQL: over rows repeated by weight."""
    return ", ".join(f"quantile_cont(duration_ms, {q}) AS p{round(q * 100)}" for q in shares)


def _weighted(keys: list[str], shares: tuple[float, ...], extra: str = "", where: str = "TRUE", tail: str = "") -> str:
    """Counts over the rows, quantiles over their repetitions."""
    k = ", ".join(keys)
    on = f"USING ({k})" if keys else "ON TRUE"
    select = f"{k}, " if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    return f"""{_REQUESTS}, {_DAY},
        own AS (SELECT * FROM r WHERE {where}),
        n AS (SELECT {select}{_REQ}{extra} FROM own {group}),
        q AS (SELECT {select}{_w(*shares)} FROM (SELECT *, unnest(range(weight)) AS i FROM own) {group})
        SELECT * FROM n JOIN q {on} {tail}"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recent(requests(spark, sf_dir), 168)


# ---- line search


def _line_index(spark, d):
    return X.kept_line_index(spark, f"{d}/documents.parquet", lambda: files(spark, d), "files of documents")


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text FROM lines_v WHERE contains(text, 'icensed')")
def grep_literal(spark, d):
    return G.grep(files(spark, d), "icensed")


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text FROM lines_v WHERE regexp_matches(text, '[Ll]icensed? under|version [0-9]+')")
def grep_regex(spark, d):
    """Over the kept line index: only blocks that can hold a match are read."""
    return X.indexed_grep(spark, _line_index(spark, d), "[Ll]icensed? under|version [0-9]+", regex=True)


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text FROM lines_v WHERE contains(lower(text), 'license')")
def grep_icase(spark, d):
    return G.grep(files(spark, d), "LICENSE", ignore_case=True)


@query(rf"{_LINES} SELECT path, line, substring(text, 1, 400) AS text FROM lines_v WHERE regexp_matches(text, '\bthe\b')")
def grep_word(spark, d):
    return X.indexed_grep(spark, _line_index(spark, d), "the", word=True)


@query(
    f"""{_LINES}, c AS (
        SELECT path, line, text, string_agg(substring(text, 1, 400), '|') OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
               string_agg(substring(text, 1, 400), '|') OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM lines_v)
    SELECT path, line, coalesce(b, '') AS before, coalesce(a, '') AS after FROM c WHERE contains(text, 'icense')"""
)
def grep_context(spark, d):
    return G.grep(files(spark, d), "icense", context=2).select("path", "line", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"{_FILES} SELECT DISTINCT path FROM files_v WHERE contains(text, 'icense')")
def grep_files_only(spark, d):
    return G.files_with_matches(files(spark, d), "icense")


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text FROM lines_v WHERE contains(text, 'the') AND path GLOB 'src1*' AND NOT path GLOB '*.ts' AND NOT path GLOB 'src1/en/*'")
def grep_exclude_glob(spark, d):
    return G.grep(files(spark, d), "the", glob="src1*", exclude=("**/*.ts", "src1/en/**"))


@query(f"""{_LINES} SELECT (SELECT count(*) FROM files_v WHERE contains(text, 'icense')) AS files_scanned, count(DISTINCT path) AS matched_files, count(*) AS matches FROM lines_v WHERE contains(text, 'icense')""")
def grep_counts(spark, d):
    return G.match_counts(files(spark, d), "icense")


@query(f"{_LINES}, n AS (SELECT path, line, contains(lower(text), 'public')::INT + contains(lower(text), 'version')::INT + contains(lower(text), 'license')::INT AS n_words FROM lines_v) SELECT path, line, n_words, CASE WHEN n_words >= 3 THEN 2 ELSE 1 END AS points FROM n WHERE n_words >= 2")
def grep_word_cooccurrence(spark, d):
    return G.cooccurring_words(files(spark, d), ["public", "version", "license"])


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text FROM lines_v WHERE contains(text, 'th') ORDER BY path, line LIMIT 200")
def grep_limit(spark, d):
    return G.grep(files(spark, d), "th", limit=200)


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text, (SELECT count(*) FROM lines_v WHERE contains(text, 'icense')) >= 20 AS truncated FROM lines_v WHERE contains(text, 'icense') ORDER BY path, line LIMIT 20")
def grep_truncated(spark, d):
    return G.grep_page(files(spark, d), "icense", limit=20)


# ---- listing


@query(f"{_FILES} SELECT path FROM files_v WHERE path = 'src1/en' OR starts_with(path, 'src1/en/')")
def tree_prefix(spark, d):
    return L.tree(files(spark, d), scope="src1/en")


@query(f"{_FILES} SELECT path FROM files_v WHERE path GLOB 'src*/en/d0000?[1-3].*'")
def tree_glob(spark, d):
    return L.tree(files(spark, d), glob="src*/en/d0000?[1-3].*")


@query(f"{_FILES} SELECT count(*) AS n FROM files_v WHERE path GLOB '*.md'")
def tree_count(spark, d):
    return L.tree_count(files(spark, d), glob="**/*.md")


@query(f"{_FILES} SELECT CASE WHEN contains(r, '/') THEN 'dir' ELSE 'file' END AS kind, split_part(r, '/', 1) AS name, count(*) AS n FROM (SELECT substring(path, 6) AS r FROM files_v WHERE starts_with(path, 'src1/')) GROUP BY ALL")
def tree_level(spark, d):
    return L.tree_level(files(spark, d), "src1")


@query(f"{_FILES} SELECT path, strlen(text) AS size, length(text) AS chars, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines FROM files_v")
def tree_sizes(spark, d):
    return L.tree(files(spark, d), sizes=True)


@query(f"{_LINES} SELECT path, line, text FROM lines_v WHERE path = (SELECT min(path) FROM lines_v WHERE line >= 4) AND line BETWEEN 2 AND 12")
def line_slice(spark, d):
    path = files(spark, d).where(line_count(F.col("text")) >= 4).agg(F.min("path")).first()[0]
    return L.line_slice(files(spark, d), path, 2, 12)


@query(f"{_LINES}, own AS (SELECT *, max(line) OVER () AS n FROM lines_v WHERE path = (SELECT max(path) FROM lines_v WHERE line >= 11)) SELECT path, line, lpad(CAST(line AS VARCHAR), CAST(length(CAST(least(n, 14) AS VARCHAR)) AS INT), ' ') || ' | ' || text AS text FROM own WHERE line BETWEEN 1 AND 14")
def line_numbered(spark, d):
    path = files(spark, d).where(line_count(F.col("text")) >= 11).agg(F.max("path")).first()[0]
    return L.line_slice(files(spark, d), path, 1, 14, numbered=True)


_WANTED = [(1, "src1/en/d000021.md"), (2, "no/such/file"), (3, "src0/fr/d000000.ts"), (4, "src1/en/d000021.md")]


@query(f"{_FILES}, w(ord, path) AS (VALUES {', '.join(f'({i}, {p!r})' for i, p in _WANTED)}) SELECT ord, w.path, strlen(text) AS size, CASE WHEN text IS NULL THEN 'not_found' END AS error FROM w LEFT JOIN files_v USING (path)")
def read_many(spark, d):
    return L.read_many(files(spark, d), spark.createDataFrame(_WANTED, "ord int, path string"))


@query(f"""{_FILES}, s AS (SELECT path, CASE WHEN path = 'src2/en/d000002.md' THEN 100 ELSE 0 END + CASE WHEN parse_filename(path) = 'd000002.md' THEN 50 ELSE 0 END
        + CASE WHEN regexp_replace(path, '/[^/]*$', '') = 'src2/en' THEN 20 ELSE 0 END AS score FROM files_v)
    SELECT path, score FROM s WHERE score > 0 ORDER BY score DESC, length(path), path LIMIT 5""")
def suggest_paths(spark, d):
    return L.suggest(files(spark, d), "src2/en/d000002.md")


@query(f"""{_FILES} SELECT path, e AS extension, CASE e WHEN 'ts' THEN 'application/typescript' WHEN 'py' THEN 'text/x-python' WHEN 'md' THEN 'text/markdown' WHEN 'go' THEN 'text/x-go' ELSE 'text/plain' END AS mime,
        CASE e WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'text' END AS language, e IN ('md', 'txt') AS is_docs, path GLOB '*.test.ts' AS is_test, path AS canonical
    FROM (SELECT path, regexp_extract(path, '\\.([a-z]+)$', 1) AS e FROM files_v)""".replace("\\\\", "\\"))
def path_attributes(spark, d):
    return L.attributes(files(spark, d))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth
    FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def parse_urls(spark, d):
    return L.parsed_urls(table(spark, d, "pages"))


@query(f"{_FILES} SELECT CASE WHEN strlen(text) > 8000 THEN 'skip-size' ELSE 'keep' END AS reason, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM files_v GROUP BY ALL")
def admission_filter(spark, d):
    return L.admission(files(spark, d), max_bytes=8000)


@query(f"{_FILES} SELECT path, strlen(text) AS size, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS INT) AS lines, md5(text) AS digest FROM files_v WHERE starts_with(path, 'src1')")
def archive_files(spark, d):
    """The snapshot written as archives, and what lies below a prefix streamed out of them."""
    folder = write_archives(spread(files(spark, d)))
    return read_archives(spark, folder).where(F.col("path").startswith("src1")).select("path", "size", "lines", F.md5("content").alias("digest"))


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_AGENTS = "WITH a(agent, ref, q) AS (VALUES " + ", ".join(f"({', '.join(map(_text, row))})" for row in samples.AGENTS) + ")"
_BUCKET = " ".join(f"WHEN regexp_matches(lower(agent), {_text(p)}) THEN '{n}'" for n, p in V.CLIENTS)


@query(rf"""{_AGENTS} SELECT agent, CASE WHEN agent IS NULL OR agent = '' THEN 'unknown' {_BUCKET} WHEN lower(agent) LIKE 'mozilla/5%' AND NOT regexp_matches(lower(agent), 'bot|crawler|spider') THEN 'browser'
        WHEN regexp_matches(lower(agent), 'bot|crawler|spider|scraper') THEN 'other-bot' ELSE 'other' END AS client,
        CASE WHEN ref IS NULL OR ref = '' THEN 'default' WHEN regexp_matches(ref, '^[0-9a-fA-F]{{40}}$') THEN 'sha' WHEN regexp_matches(ref, '^v?[0-9]+\.[0-9]+') THEN 'tag' ELSE 'branch' END AS ref_kind,
        CASE WHEN length(p) > 120 THEN substring(p, 1, 117) || '...' ELSE p END AS path FROM (SELECT *, '/o/r' || regexp_replace(q, '([?&])(key|token|secret)=[^&]*', '\1\2=REDACTED', 'gi') AS p FROM a)""")
def client_buckets(spark, d):
    return samples.agents(spark).select("agent", P.client_bucket(F.col("agent")).alias("client"), P.ref_kind(F.col("ref")).alias("ref_kind"), P.path_bucket(F.lit("/o/r"), F.col("query")).alias("path"))


@query(f"SELECT path, CASE WHEN contains('/' || path || '/', '/../') THEN NULL ELSE array_to_string(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')), '/') END AS normal FROM (SELECT concat('/./', path, '//') AS path FROM ({FILES_SQL}))")
def normal_paths(spark, d):
    return files(spark, d).select(F.concat(F.lit("/./"), "path", F.lit("//")).alias("path")).select("path", P.normalized(F.col("path")).alias("normal"))


@query(f"{_FILES} SELECT path, CASE WHEN path GLOB '*.test.ts' THEN 'tests' WHEN path GLOB '*.md' THEN 'docs' ELSE 'core' END AS role FROM files_v")
def roles(spark, d):
    return J.roles(files(spark, d))


# ---- request metrics


@query(_weighted(["owner", "repo"], (0.5, 0.95), f", {_ERRORS}", "owner NOT IN ('-', '') AND action IN ('tree', 'file', 'grep', 'outline')", "ORDER BY requests DESC, owner, repo LIMIT 50").replace("SELECT * FROM n JOIN", "SELECT *, CASE WHEN requests > 0 THEN errors / requests ELSE 0.0 END AS error_rate FROM n JOIN"))
def metrics_top_repos(spark, d):
    return M.top_repos(_log(spark, d))


@query(_weighted(["action"], (0.5, 0.95, 0.99)))
def metrics_by_action(spark, d):
    return M.by_action(_log(spark, d))


@query(_weighted(["status", "action", "owner", "repo"], (0.95,), where="status >= '400'", tail="ORDER BY requests DESC, status, action, owner, repo LIMIT 30"))
def metrics_top_errors(spark, d):
    return M.top_errors(_log(spark, d))


@query(f"{_REQUESTS}, {_DAY} SELECT status, {_REQ} FROM r GROUP BY status")
def metrics_by_status(spark, d):
    return M.by_status(_log(spark, d))


_TOTALS = _weighted([], (0.5, 0.95, 0.99), f", {_ERRORS}, CAST(coalesce(sum(CASE WHEN source = 'edge' THEN weight END), 0) AS BIGINT) AS edge")


@query(_TOTALS)
def metrics_totals(spark, d):
    return M.totals(_log(spark, d))


@query(f"SELECT requests, errors, CASE WHEN requests > 0 THEN errors / requests ELSE 0 END AS error_rate, CASE WHEN requests > 0 THEN edge / requests ELSE 0 END AS cache_hit_rate, p50, p95, p99 FROM ({_TOTALS})")
def metrics_bundle(spark, d):
    return M.bundle(_log(spark, d))


@query(f"{_REQUESTS}, {_DAY} SELECT count(DISTINCT (owner, repo)) AS repos FROM r")
def metrics_unique_repos(spark, d):
    return M.unique_repos(_log(spark, d))


@query()
def unique_repos_approx(spark, d):
    return M.unique_repos(_log(spark, d), approximate=True)


@query(_weighted(["bucket"], (0.95,), f", {_ERRORS}").replace("own AS (SELECT * FROM", "own AS (SELECT *, time_bucket(INTERVAL 60 MINUTES, ts) AS bucket FROM"))
def metrics_time_series(spark, d):
    return M.time_series(_log(spark, d), 60)


@query(_weighted(["client"], (0.5, 0.95), f", {_ERRORS}, count(DISTINCT (owner, repo)) AS unique_repos").replace("own AS (SELECT * FROM", "own AS (SELECT * REPLACE (CASE WHEN client = '' THEN 'unknown' ELSE client END AS client) FROM"))
def metrics_by_client(spark, d):
    return M.by_client(_log(spark, d))


@query(f"SELECT * FROM ({_weighted(['action', 'owner', 'repo', 'client'], (0.95, 0.99), ', CAST(coalesce(sum(CASE WHEN duration_ms > 5000 THEN weight END), 0) AS BIGINT) AS slow')}) WHERE slow > 0 ORDER BY slow DESC, action, owner, repo, client LIMIT 20")
def metrics_slow_requests(spark, d):
    return M.slow_requests(_log(spark, d))


@query(_weighted(["minute", "status", "action", "owner", "repo", "client", "path"], (0.95,), where="status >= '400'", tail="ORDER BY minute DESC, status, action, owner, repo, client, path LIMIT 50").replace("own AS (SELECT * FROM", "own AS (SELECT *, date_trunc('minute', ts) AS minute FROM"))
def metrics_recent_failures(spark, d):
    return M.recent_failures(_log(spark, d))


@query(f"{_REQUESTS}, {_DAY} SELECT CASE WHEN owner = '-' THEN repo ELSE owner END AS owner, CASE WHEN owner = '-' THEN '?' ELSE repo END AS repo, status AS reason, {_REQ} FROM r WHERE status = '500' GROUP BY ALL ORDER BY requests DESC, 1, 2, 3 LIMIT 25")
def metrics_ingest_failures(spark, d):
    return M.ingest_failures(_log(spark, d))


@query(f"""{_REQUESTS}, {_DAY}, b AS (SELECT weight, CASE WHEN duration_ms < 50 THEN 0 WHEN duration_ms < 100 THEN 1 WHEN duration_ms < 250 THEN 2 WHEN duration_ms < 500 THEN 3
        WHEN duration_ms < 1000 THEN 4 WHEN duration_ms < 2500 THEN 5 WHEN duration_ms < 5000 THEN 6 ELSE 7 END AS bucket_order FROM r)
    SELECT ['<50ms', '<100ms', '<250ms', '<500ms', '<1000ms', '<2500ms', '<5000ms', '5s+'][bucket_order + 1] AS bucket, bucket_order, {_REQ} FROM b GROUP BY ALL""")
def metrics_latency_histogram(spark, d):
    return M.latency_histogram(_log(spark, d))


@query(_weighted([], (0.5, 0.95, 0.99), f", {_ERRORS}, CAST(coalesce(sum(CASE WHEN source = 'edge' THEN weight END), 0) AS BIGINT) AS edge", "owner = 'o1' AND repo = 'r1'"))
def metrics_repo_totals(spark, d):
    return M.totals(M.of_repo(_log(spark, d), "o1", "r1"))


@query(f"{_REQUESTS}, {_DAY} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, {_REQ} FROM r GROUP BY {c}" for c in ("action", "status", "source", "ref_kind")))
def metrics_by_dimension(spark, d):
    return M.by_dimension(_log(spark, d))


@query(_weighted(["status", "action"], (0.95,), where="status >= '400'"))
def metrics_error_groups(spark, d):
    return M.error_groups(_log(spark, d))


@query(_weighted(["bucket"], (0.95,), f", {_ERRORS}", "owner = 'o1' AND repo = 'r1'").replace("own AS (SELECT * FROM", "own AS (SELECT *, time_bucket(INTERVAL 60 MINUTES, ts) AS bucket FROM"))
def metrics_repo_series(spark, d):
    return M.repo_series(_log(spark, d), "o1", "r1")


@query(f"{_REQUESTS}, {_DAY}, o AS (SELECT * FROM r WHERE owner = 'o1' AND repo = 'r1'), g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CASE WHEN {c} = '' THEN '(none)' ELSE coalesce({c}, '(unknown)') END AS value, {_REQ}, {n} AS most FROM o GROUP BY {c}" for c, n in M.DETAIL_LIMITS.items()) + ") SELECT dimension, value, requests FROM g QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY requests DESC, value) <= most")
def metrics_repo_detail(spark, d):
    return M.repo_detail(_log(spark, d), "o1", "r1")


@query(f"""{_REQUESTS}, {_DAY}, b AS (SELECT weight, CASE WHEN duration_ms < 50 THEN '<50ms' WHEN duration_ms < 100 THEN '<100ms' WHEN duration_ms < 250 THEN '<250ms' WHEN duration_ms < 500 THEN '<500ms' WHEN duration_ms < 1000 THEN '<1000ms'
        WHEN duration_ms < 2500 THEN '<2500ms' WHEN duration_ms < 5000 THEN '<5000ms' ELSE '5s+' END AS bucket FROM r)
    SELECT 'by_action' AS part, action AS label, {_REQ} FROM r GROUP BY ALL UNION ALL SELECT 'by_status', status, {_REQ} FROM r GROUP BY ALL UNION ALL SELECT 'by_client', CASE WHEN client = '' THEN 'unknown' ELSE client END, {_REQ} FROM r GROUP BY ALL
    UNION ALL SELECT 'latency', bucket, {_REQ} FROM b GROUP BY ALL UNION ALL (SELECT 'top_repos', owner || '/' || repo, {_REQ} FROM r WHERE owner NOT IN ('-', '') AND action IN ('tree', 'file', 'grep', 'outline') GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 50)""")
def metrics_overview(spark, d):
    return M.overview_counts(_log(spark, d))


@query(f"""{_REQUESTS}, w AS (SELECT client AS key, s AS seconds, m AS most, time_bucket(to_seconds(s), ts) AS window_start FROM requests_v, (VALUES (3600, 3), (86400, 40)) AS l(s, m))
    SELECT key, seconds, most, window_start, count(*) AS requests FROM w GROUP BY ALL HAVING count(*) > most""")
def rate_limits(spark, d):
    return M.rate_limited(requests(spark, d), "client", [(3600, 3), (86400, 40)])


@query(f"{_REQUESTS} SELECT owner, repo, max(ts) AS last_access FROM requests_v GROUP BY owner, repo HAVING max(ts) <= (SELECT max(ts) FROM requests_v) - INTERVAL 2 DAYS")
def evicted_snapshots(spark, d):
    return M.evicted(requests(spark, d), ["owner", "repo"], days=2)


@query("SELECT event_type AS label, count(*) FILTER (WHERE user_id % 2 = 0) AS base, count(*) FILTER (WHERE user_id % 2 = 1) AS treated, count(*) AS total FROM events GROUP BY event_type")
def call_labels(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("label"), F.when(F.col("user_id") % 2 == 0, "base").otherwise("treated").alias("condition"))
    return E.labels_by_condition(calls, ["base", "treated"])


@query(f"{_REQUESTS} SELECT event_id, count(*) OVER (PARTITION BY owner, repo ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM requests_v")
def throttle_window(spark, d):
    log = requests(spark, d).withColumn("slug", F.concat_ws("/", "owner", "repo"))
    return M.throttle(log, "slug").select("event_id", "in_window")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, avg(value) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, d):
    return E.nearest_rank(table(spark, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 9))


_HALF = "TIMESTAMP '2024-01-15'"


@query(f"""WITH b AS (SELECT user_id, avg(value) AS before FROM events WHERE ts < {_HALF} GROUP BY user_id), a AS (SELECT user_id, avg(value) AS after FROM events WHERE ts >= {_HALF} GROUP BY user_id)
    SELECT user_id, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' WHEN (after - before) / before > 0.05 THEN 'worse' WHEN (after - before) / before < -0.05 THEN 'better' ELSE 'same' END AS flag
    FROM b FULL JOIN a USING (user_id)""")
def run_diff(spark, d):
    events = table(spark, d, "events")
    early, late = (events.where(c).groupBy("user_id").agg(F.avg("value").alias("value")) for c in (f"ts < {_HALF}", f"ts >= {_HALF}"))
    return E.diff(early, late, ["user_id"], "value").withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})


@query("SELECT event_type, count(*) AS runs, avg((user_id % 3 = 0)::INT) AS pass_rate, avg(event_id % 5) AS mean_calls, avg(value) AS mean_ms, CAST(sum(event_id % 7) AS BIGINT) AS total_cost FROM events GROUP BY event_type")
def run_summary(spark, d):
    runs = table(spark, d, "events").select("event_type", (F.col("user_id") % 3 == 0).alias("passed"), (F.col("event_id") % 5).alias("calls"), F.col("value").alias("ms"), (F.col("event_id") % 7).alias("cost"))
    return E.summary(runs, "event_type")


# ---- retrieval

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms_sql(rows: str) -> str:
    """Postings of ``(id, text)`` rows."""
    return f"""tok AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+')) AS t FROM {rows}),
    parts AS (SELECT id, t, unnest(regexp_split_to_array(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_+')) AS p FROM tok WHERE regexp_matches(t, '[a-z][A-Z]|_')),
    term AS (SELECT id, lower(t) AS term FROM tok WHERE length(t) >= 2 AND lower(t) NOT IN ({_STOP})
             UNION ALL SELECT id, lower(p) FROM parts WHERE length(p) >= 3 AND lower(p) <> lower(t) AND lower(p) NOT IN ({_STOP})),
    posts AS (SELECT id, term, count(*) AS tf FROM term GROUP BY ALL)"""


_POSTINGS = f"{_FILES}, own AS (SELECT path AS id, text FROM files_v), {_terms_sql('own')}"
_CHUNKS = """c AS (SELECT path, n, unnest(CASE WHEN n <= 60 THEN [1] ELSE range(1, CAST(1 + 30 * ceil((n - 40) / 30) AS BIGINT) + 1, 30) END) AS start FROM
        (SELECT path, len(string_split(text, chr(10))) AS n FROM files_v WHERE text <> '')),
    chunks AS (SELECT path, start, CASE WHEN n <= 60 THEN n ELSE least(start + 39, n) END AS "end", CASE WHEN n <= 60 THEN 'file' ELSE 'window' END AS kind FROM c)"""
_CHUNK_TEXTS = f"""{_FILES}, {_CHUNKS},
    bodies AS (SELECT doc_id, source, chunks.*, array_to_string(list_slice(string_split(text, chr(10)), start, "end"), chr(10)) AS body FROM chunks JOIN files_v USING (path)),
    texts AS (SELECT doc_id, source, path, start, "end", kind, concat(path, ':', start) AS id, path || chr(10) || body AS text FROM bodies WHERE trim(translate(body, chr(10) || chr(9), '  ')) <> '')"""


def _posts(spark, d):
    return R.postings(spread(files(spark, d)), "path", F.col("text"))


@query(f"{_POSTINGS} SELECT * FROM posts")
def term_frequencies(spark, d):
    return _posts(spark, d)


@query(f"{_POSTINGS} SELECT term, count(*) AS df FROM posts GROUP BY term")
def document_frequencies(spark, d):
    return R.document_frequencies(_posts(spark, d))


_QUERY = ["license", "version", "public"]


def _chunks(spark, d):
    own = files(spark, d)
    return R.chunks(spread(own)).withColumn("id", F.concat_ws(":", "path", "start")), own.select("path", "doc_id", "source")


def _index(spark, d, table_path=None, files_at_once=1000, model=None):
    """Path and symbol of a chunk, and its document and source, stand with its postings."""

    def build(rows):
        own = spread(files_of(rows))
        # what a query wants back follows from the path; the document's number is in its name
        number = F.regexp_extract("path", r"/d([0-9]+)\.[a-z.]+$", 1).cast("long")
        return R.chunks(own).withColumns({"id": F.concat_ws(":", "path", "start"), "doc_id": number, "source": F.substring_index("path", "/", 1)})

    return I.kept_index(spark, table_path or f"{d}/documents.parquet", build, _KEYS, "chunks of files", files_at_once, model)


_KEYS = ["path", "doc_id", "source"]


def _bm25(spark, d):
    return I.bm25(_index(spark, d), _QUERY, ["path", "doc_id", "source"])


_BM25 = f"""{_CHUNK_TEXTS}, own AS (SELECT id, concat_ws(' ', translate(path, '/.', '  '), text) AS text FROM texts), {_terms_sql('own')},
    n AS (SELECT count(DISTINCT id) AS n, count(*) / count(DISTINCT id) AS avg FROM posts), len AS (SELECT id, count(*) AS len FROM posts GROUP BY id),
    df AS (SELECT term, count(*) AS df FROM posts WHERE term IN ('license', 'version', 'public') GROUP BY term),
    bm AS (SELECT id, any_value(path) AS path, any_value(doc_id) AS doc_id, any_value(source) AS source, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / n.avg))), 6) AS score FROM posts JOIN df USING (term) JOIN len USING (id) JOIN texts USING (id), n GROUP BY id)"""


@query(f"{_CHUNK_TEXTS}, own AS (SELECT id, concat_ws(' ', translate(path, '/.', '  '), text) AS text FROM texts), {_terms_sql('own')} SELECT id, term, tf FROM posts WHERE term IN ('license', 'version', 'src1', 'md')")
def chunk_postings(spark, d):
    """The kept index, pruned to some terms; path words count."""
    return _index(spark, d).postings.where(F.col("term").isin("license", "version", "src1", "md")).select("id", "term", "tf")


def built_index(spark, d):
    """Builds the index of chunks if it isn't there, and names its segments; likewise those below."""
    return spark.createDataFrame([(s,) for s in _index(spark, d).segments], "segment string")


def built_vector_index(spark, d):
    return spark.createDataFrame([(s,) for s in _vectors_index(spark, d).segments], "segment string")


def built_line_index(spark, d):
    return spark.createDataFrame([(_line_index(spark, d),)], "folder string")


@query(f"{_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return R.top_k(_bm25(spark, d).select("id", "score"), 20)


@query(f"""{_BM25}, best AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 30),
    s AS (SELECT id, score, round(1 / (1 + exp(2 - 2 * (contains(lower(text), 'apache')::INT + contains(lower(text), 'public')::INT + contains(lower(text), 'license')::INT))), 3) AS relevance FROM best JOIN texts USING (id))
    SELECT * FROM s ORDER BY relevance DESC, score DESC, id LIMIT 10""")
def search_reranked(spark, d):
    """Thirty hits of the index, judged by their texts, cut to ten; only the hits' files are read again."""
    hits = R.top_k(_bm25(spark, d), 30)
    own = files(spark, d).join(F.broadcast(hits.select("path").distinct()), "path", "left_semi")  # 30 paths
    return J.reranked(hits, R.chunks(own).select(F.concat_ws(":", "path", "start").alias("id"), "text"), J.word_scorer("apache public license"), 10)


@query("SELECT q, regexp_matches(q, '[a-z][A-Z]|_|[.]|^[A-Z]') AND NOT contains(q, ' ') AS symbol_like FROM (VALUES ('parseConfig'), ('max_retries'), ('how are files evicted'), ('Box'), ('license')) AS v(q)")
def symbol_like_queries(spark, d):
    asked = ["parseConfig", "max_retries", "how are files evicted", "Box", "license"]
    return spark.createDataFrame([(q, like_symbol(q)) for q in asked], "q string, symbol_like boolean")


def _vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


_DENSE = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE id = 0),
    dn AS (SELECT id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)), 4) AS score FROM e, q)"""


@query(f"WITH {_DENSE} SELECT id, score FROM dn ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark, d):
    return R.top_k(R.dense(table(spark, d, "embeddings"), _vector(spark, d), "vec_id"), 20)


@query("""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q, sqrt(list_dot_product(v, v)) AS m FROM e WHERE id = 0),
    p AS (SELECT id, v, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 THEN list_max(list_transform(v, lambda x: abs(x))) / 127 ELSE 1 END AS k FROM e),
    s AS (SELECT id, round(list_dot_product(list_transform(v, lambda x: floor(x / k + 0.5)), list_transform(q, lambda x: x / m)) * k, 4) AS score FROM p, q)
    SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20""")
def dense_quantized_topk(spark, d):
    return R.top_k(R.dense(table(spark, d, "embeddings"), _vector(spark, d), "vec_id", eight_bit=True), 20)


def _rrf(spark, d):
    lexical = _bm25(spark, d).groupBy(F.col("doc_id").alias("id")).agg(F.max("score").alias("score"))
    return R.fused(R.dense(table(spark, d, "embeddings"), _vector(spark, d), "vec_id"), lexical)


_RRF = f"""{_BM25}, {_DENSE}, lx AS (SELECT doc_id AS id, max(score) AS score FROM bm GROUP BY doc_id),
    ranks AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) AS part FROM (SELECT * FROM dn ORDER BY score DESC, id LIMIT 100)
              UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) FROM (SELECT * FROM lx WHERE score > 0 ORDER BY score DESC, id LIMIT 100)),
    rrf AS (SELECT id, round(sum(CAST(part AS DOUBLE)), 8) AS score FROM ranks GROUP BY id)"""


@query(f"{_RRF} SELECT id, score FROM rrf")
def rrf_fusion(spark, d):
    return _rrf(spark, d)


@query(f"{_BM25} SELECT id, score FROM bm WHERE starts_with(path, 'src1') AND NOT regexp_matches(path, '[.](md|txt)$') ORDER BY score DESC, id LIMIT 20")
def bm25_scoped(spark, d):
    """Code below a prefix only; terms are as rare as everywhere."""
    only = F.col("path").startswith("src1") & ~P.is_docs(F.col("path"))
    return R.top_k(I.bm25(_index(spark, d), _QUERY, _KEYS, only).select("id", "score"), 20)


@query(f"{_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_segments(spark, d):
    """The table in three part files, each indexed into a segment of its own: the same scores."""
    parts = new_folder(spark, "parts")
    table(spark, d, "documents").repartition(3, F.xxhash64("doc_id")).write.mode("overwrite").parquet(parts)
    index = _index(spark, d, parts, files_at_once=1)
    return R.top_k(I.bm25(index, _QUERY, _KEYS).select("id", "score"), 20)


_ASKED = ["the license of the work", "and that with this", "de la que elle"]
_MODEL_SQL = ", ".join(f"('{w}', {[int(x) for x in v]})" for w, v in zip(samples.MODEL_WORDS, samples.small_model().weights, strict=True))
# a vector is the sum of its words' vectors at length one, of the first 2,400 characters and 512 words that the model has
_EMBED = f"""model(w, v) AS (VALUES {_MODEL_SQL}), asked(query, text) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_ASKED))}),
    given AS (SELECT id, substring(text, 1, 2400) AS text FROM texts UNION ALL SELECT CAST(query AS VARCHAR), text FROM asked),
    known AS (SELECT id, list_slice(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '[\\p{{Mn}}\\p{{Cf}}]', '', 'g'), '[\\s\\p{{Z}}\\p{{P}}\\p{{S}}\\x{{4e00}}-\\x{{9fff}}]+'), lambda x: list_contains({samples.MODEL_WORDS}, x)), 1, 512) AS ws FROM given),
    sums AS (SELECT id, j, CAST(sum(v[j]) AS DOUBLE) AS x FROM (SELECT id, unnest(ws) AS w FROM known) JOIN model USING (w), (SELECT unnest(range(1, {samples.MODEL_WIDTH + 1})) AS j) GROUP BY ALL),
    unit AS (SELECT id, list_transform(v, lambda x: CAST(CAST(CASE WHEN n > 0 THEN x / n ELSE 0 END AS FLOAT) AS DOUBLE)) AS v FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT id, list(x ORDER BY j) AS v FROM sums GROUP BY id))),
    packed AS (SELECT t.id, coalesce(list_transform(v, lambda x: floor(x / k + 0.5)), [0.0 for i in range({samples.MODEL_WIDTH})]) AS v, k FROM texts t LEFT JOIN (SELECT *, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 THEN list_max(list_transform(v, lambda x: abs(x))) / 127 ELSE 1 END AS k FROM unit) u ON t.id = u.id),
    near AS (SELECT query, p.id, round(coalesce(list_dot_product(p.v, u.v) / sqrt(list_dot_product(u.v, u.v)) * k, 0), 4) AS score FROM packed p, asked JOIN unit u ON u.id = CAST(query AS VARCHAR))""".replace("\\\\", "\\")


def _vectors_index(spark, d):
    return _index(spark, d, model=samples.small_model())


def _asked_vectors(texts):
    return [text_vector(t, samples.small_model()).tolist() for t in texts]


@query(f"{_CHUNK_TEXTS}, {_EMBED} SELECT query, id, score FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def nearest_chunks(spark, d):
    """Vectors of the chunks themselves, kept in blocks beside the postings; all questions in one pass."""
    return N.nearest(_vectors_index(spark, d).vectors, _asked_vectors(_ASKED), 10).select("query", "id", "score")


@query(f"{_CHUNK_TEXTS}, {_EMBED} SELECT query, id, near.score FROM near JOIN texts USING (id) WHERE starts_with(path, 'src1') AND NOT regexp_matches(path, '[.](md|txt)$') QUALIFY row_number() OVER (PARTITION BY query ORDER BY near.score DESC, id) <= 10")
def nearest_scoped(spark, d):
    """Code below a prefix only, ranked within the scan of the blocks."""
    only = lambda r: r["path"].startswith("src1") & ~P.is_docs(r["path"])
    return N.nearest(_vectors_index(spark, d).vectors, _asked_vectors(_ASKED), 10, only=only).select("query", "id", "score")


@query(f"""{_BM25}, {_EMBED}, ranks AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) AS part FROM (SELECT id, score FROM near WHERE query = 0 ORDER BY score DESC, id LIMIT 100)
        UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 100))
    SELECT id, round(sum(CAST(part AS DOUBLE)), 8) AS score FROM ranks GROUP BY id""")
def hybrid_chunks(spark, d):
    """Words and vectors of the same chunks, fused by rank."""
    index = _vectors_index(spark, d)
    vectors = N.nearest(index.vectors, _asked_vectors(_ASKED[:1]), V.RRF_DEPTH).select("id", "score")
    return R.fused(vectors, I.bm25(index, _QUERY))


def _scored_chunks(spark, d):
    cut = R.windows(files(spark, d)).withColumns({"id": F.concat_ws(":", "path", "start"), "score": F.round(1 / (10 + F.pmod(F.length("path") * F.col("start"), F.lit(97))), 6), "symbol": F.lit(None).cast("string")})
    return cut


@query(f"{_FILES}, {_CHUNKS} SELECT * FROM chunks")
def chunk_windows(spark, d):
    return R.windows(files(spark, d))


@query(f"""{_FILES}, {_CHUNKS}, s AS (SELECT path, concat(path, ':', start) AS id, round(1 / (10 + length(path) * start % 97), 6) * CASE WHEN path GLOB '*.test.ts' THEN 0.7 ELSE 1 END AS score FROM chunks WHERE NOT regexp_matches(path, '\\.(md|txt)$')),
    w AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM s) SELECT path, id, round(score, 8) AS score FROM w WHERE n <= 2 ORDER BY w.score DESC, id LIMIT 50""")
def boosts_diversity(spark, d):
    code = _scored_chunks(spark, d).where(~P.is_docs(F.col("path")))
    return R.diverse_code(R.boosted(code, [], docs_too=False), 2, 50).select("path", "id", F.round("score", 8).alias("score"))


# hits of a page one after the other, best first; a list of what has stayed goes along
@query(f"""{_FILES.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_CHUNKS},
    s AS (SELECT concat('docs/', split_part(path, '/', 2), '/p', CAST(regexp_extract(path, '/d([0-9]+)[.]', 1) AS INT) % 40, '.md') AS path, concat('docs/p', CAST(regexp_extract(path, '/d([0-9]+)[.]', 1) AS INT) % 40, '.md') AS page, concat(path, ':', start) AS id, start // 40 AS region, round(1 / (10 + length(path) * start % 97), 6) * 0.8 AS score FROM chunks WHERE regexp_matches(path, '[.](md|txt)$')),
    n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS n FROM s),
    r(page, n, path, id, score, stays, paths, regions) AS (SELECT page, n, path, id, score, TRUE, [path], [region] FROM n WHERE n = 1 UNION ALL
        SELECT page, n, path, id, score, ok, CASE WHEN ok THEN list_append(paths, path) ELSE paths END, CASE WHEN ok THEN list_append(regions, region) ELSE regions END
        FROM (SELECT n.*, r.paths, r.regions, len(list_filter(r.paths, lambda x: x = n.path)) < 2 AND NOT list_contains(r.regions, n.region) AS ok FROM r JOIN n ON n.page = r.page AND n.n = r.n + 1))
    SELECT path, id, round(score, 8) AS score FROM r WHERE stays ORDER BY r.score DESC, id LIMIT 20""")
def docs_diversity(spark, d):
    """Documents as pages in several languages: a region counts once over all translations of its page."""
    docs = _scored_chunks(spark, d).where(P.is_docs(F.col("path")))
    number = F.regexp_extract("path", "/d([0-9]+)[.]", 1).cast("int") % 40
    docs = docs.withColumn("path", F.concat(F.lit("docs/"), F.get(F.split("path", "/"), F.lit(1)), F.lit("/p"), number.cast("string"), F.lit(".md")))
    return R.diverse_docs(R.boosted(docs, []), 2, 20).select("path", "id", F.round("score", 8).alias("score"))


@query(f"""{_BM25}, h AS (SELECT id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank, CASE WHEN (SELECT count(DISTINCT source) FROM bm) >= 3 THEN 5 ELSE 10 END AS cap FROM bm)
    SELECT id, source, score FROM h WHERE rank <= 10 ORDER BY rank > cap, score DESC, id LIMIT 10""")
def cross_repo_topk(spark, d):
    return R.across_repos(_bm25(spark, d), 10).select("id", "source", "score")


@query(f"""{_BM25}, h AS (SELECT id, source, score FROM bm WHERE source IN (SELECT source FROM bm GROUP BY source ORDER BY max(score) DESC, source LIMIT 2)) SELECT * FROM h ORDER BY score DESC, id LIMIT 10""")
def cross_repo_two(spark, d):
    """Two repositories have no cap."""
    hits = _bm25(spark, d)
    two = hits.groupBy("source").agg(F.max("score").alias("_m")).orderBy(F.desc("_m"), "source").limit(2).select("source")
    return R.across_repos(hits.join(F.broadcast(two), "source", "left_semi"), 10).select("id", "source", "score")


@query(f"""{_FILES}, {_CHUNKS}, s AS (SELECT path, start, concat(path, ':', start) AS id, round(1 / (10 + length(path) * start % 97), 6) AS score FROM chunks),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM s) WHERE n = 1 ORDER BY score DESC, id LIMIT 10)
    SELECT path, start, array_to_string(list_transform(list_slice(string_split(text, chr(10)), start, start + 2), lambda x, i: (start + i - 1)::VARCHAR || ' | ' || x), chr(10)) AS snippet FROM b JOIN files_v USING (path)""")
def hit_snippets(spark, d):
    hits = R.diverse_code(_scored_chunks(spark, d), 1, 10)
    return R.snippets(hits, files(spark, d), 3).select("path", "start", "snippet")


# ---- judgement


@query("""WITH e AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS logit FROM embeddings), m AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY label)) AS x FROM e)
    SELECT vec_id, label, round(x / sum(x) OVER (PARTITION BY label), 9) AS p FROM m""")
def softmax_choice(spark, d):
    logit = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return J.choice(table(spark, d, "embeddings").select("vec_id", "label", logit.alias("logit")), ["label"]).select("vec_id", "label", F.round("p", 9).alias("p"))


def _words_sql(text: str, *words: str) -> str:
    return "-2 + 2 * (" + " + ".join(f"contains(lower({text}), '{w}')::INT" for w in words) + ")"


@query(f"""{_LINES}, l AS (SELECT path, line, (line - 1) // 150 AS w, {_words_sql('text', 'public', 'license', 'version')} AS logit FROM lines_v),
    i AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY path, w)) AS x FROM l), o AS (SELECT path, w, max(logit) AS logit FROM l GROUP BY ALL), ow AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY path)) AS y FROM o),
    p AS (SELECT path, line, w, x / sum(x) OVER (PARTITION BY path, w) AS p FROM i), q AS (SELECT path, w, y / sum(y) OVER (PARTITION BY path) AS q FROM ow),
    s AS (SELECT path, line, w, round(p * q, 6) AS score FROM p JOIN q USING (path, w))
    SELECT path, line, score FROM s QUALIFY row_number() OVER (PARTITION BY path, w ORDER BY score DESC, line) <= 5""")
def locate_lines(spark, d):
    return J.locate(files(spark, d), J.word_scorer("public license version"))


@query(f"{_LINES} SELECT path, line, substring(text, 1, 400) AS text, round(1 / (1 + exp(-({_words_sql('text', 'apache', 'public', 'license')}))), 3) AS relevance FROM lines_v WHERE contains(text, 'icense')")
def rerank_matches(spark, d):
    ranked = J.rerank(G.grep(files(spark, d), "icense", max_text=None), J.word_scorer("apache public license"))
    return ranked.withColumn("text", F.substring("text", 1, G.MAX_TEXT))


_DEFINES = r"^\s*([a-z]+\s+){0,3}(function|class|interface|type|enum|struct|trait|impl|def|fn|func|const|let|var|module|package)\b|^\s*[A-Za-z_$][A-Za-z0-9_$]*\s*(:[^=]+)?=([^=]|$)"
_GREP_STAGE = rf"""g AS (SELECT path, line, tok, pts FROM (SELECT path, line, text, unnest([{{'tok': 'l', 'pts': CASE WHEN contains(text, 'License') THEN 3 END}}, {{'tok': 'i', 'pts': CASE WHEN contains(text, 'Public') THEN CASE WHEN regexp_matches(text, '{_DEFINES}') THEN 2 ELSE 1 END END}},
        {{'tok': 'w' || line, 'pts': CASE WHEN n >= 3 THEN 2 WHEN n = 2 THEN 1 END}}]) AS u FROM (SELECT *, contains(lower(text), 'version')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'under')::INT AS n FROM lines_v)), LATERAL (SELECT u.tok AS tok, u.pts AS pts) WHERE pts IS NOT NULL),
    gf AS (SELECT path, tok, min(line) AS line, arg_min(pts, line) AS pts FROM g GROUP BY ALL),
    gs AS (SELECT path, CAST(sum(pts) AS BIGINT) AS score, list_slice(list_sort(list(DISTINCT line)), 1, 3) AS lines FROM gf GROUP BY path ORDER BY score DESC, path LIMIT 14)"""


def _grep_stage(spark, d):
    return G.weighted_files(files(spark, d), ["License"], ["Public"], ["version", "license", "under"])


@query(f"{_LINES}, {_GREP_STAGE} SELECT path, score, array_to_string(lines, ',') AS lines FROM gs")
def grep_stage(spark, d):
    return _grep_stage(spark, d).select("path", "score", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


_PATH_STAGE = """ps AS (SELECT path, CASE WHEN contains(lower(parse_filename(path)), 'src1') THEN 2 WHEN contains(lower(path), 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(parse_filename(path)), 'md') THEN 2 WHEN contains(lower(path), 'md') THEN 1 ELSE 0 END AS score FROM files_v),
    pt AS (SELECT path, score FROM ps WHERE score > 0 ORDER BY score DESC, length(path), path LIMIT 12)"""


@query(f"""{_BM25}, lines_v AS (SELECT path, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text FROM (SELECT path, string_split(text, chr(10)) AS a FROM files_v WHERE text <> '')), {_GREP_STAGE}, {_PATH_STAGE},
    st AS (SELECT path, max(score) AS score FROM bm GROUP BY path ORDER BY score DESC, path LIMIT 12),
    u AS (SELECT path, 'path' AS via, 0 AS k, CAST(score AS DOUBLE) AS score FROM pt UNION ALL SELECT path, 'search', 1, score FROM st UNION ALL SELECT path, 'grep', 2, CAST(score AS DOUBLE) FROM gs)
    SELECT path, string_agg(via, ',' ORDER BY via) AS via, arg_min(score, k) AS score FROM u GROUP BY path""")
def find_candidates(spark, d):
    """Three stages; a path has the score of the first that found it, and the names of all."""
    score = F.col("score").cast("double").alias("score")
    paths = J.path_hits(files(spark, d), ["src1", "md"]).select("path", score)
    best = _bm25(spark, d).groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(12)
    return J.candidates({"path": paths, "search": best, "grep": _grep_stage(spark, d).select("path", score)})


def _assembled(spark, d):
    """Symbols are stood in for by lines that begin with a capital T; their chunks are single lines."""
    own = files(spark, d)
    every = L.numbered_lines(own)
    symbols = every.where(F.col("text").startswith("T") & F.contains("text", F.lit("the"))).select("path", "line", F.col("line").alias("end_line"), F.substring("text", 1, 60).alias("signature"))
    chunk = _scored_chunks(spark, d).where(F.pmod(F.length("path") + F.col("start"), F.lit(5)) == 0).select("path", "start", "end", "kind", F.lit("chunk").alias("text"))
    chunk = chunk.unionByName(symbols.select("path", F.col("line").alias("start"), F.col("line").alias("end"), F.lit("symbol").alias("kind"), F.lit("dropped").alias("text")))
    return J.assembled(symbols, chunk, G.grep(own, "icense").select("path", "line", F.substring("text", 1, 60).alias("text")), per_file=2)


_ASSEMBLED = f"""{_LINES}, {_CHUNKS}, sy AS (SELECT path, line, substring(text, 1, 60) AS signature, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM lines_v WHERE starts_with(text, 'T') AND contains(text, 'the')),
    m AS (SELECT path, line, substring(text, 1, 60) AS text FROM lines_v WHERE contains(text, 'icense')),
    u AS (SELECT path, line, line AS "end", 'symbol' AS kind, signature AS text, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.path = sy.path AND m.line = sy.line) THEN 0 ELSE 1 END AS priority FROM sy WHERE n <= 2
          UNION ALL SELECT path, start, "end", kind, 'chunk', 2 FROM chunks WHERE (length(path) + start) % 5 = 0
          UNION ALL SELECT path, line, line, 'match', text, 3 FROM m WHERE NOT EXISTS (SELECT 1 FROM sy WHERE m.path = sy.path AND m.line = sy.line)),
    a AS (SELECT * FROM u ORDER BY priority, path, line, kind LIMIT 255)"""


@query(f"{_ASSEMBLED} SELECT * FROM a")
def assembled_candidates(spark, d):
    return _assembled(spark, d).drop("ord")


@query(f"""{_ASSEMBLED}, l AS (SELECT *, {_words_sql('text', 'public', 'license')} AS logit FROM a), x AS (SELECT *, exp(logit - max(logit) OVER ()) AS e FROM l)
    SELECT path, line, kind, round(e / sum(e) OVER (), 9) AS p FROM x""")
def judged_candidates(spark, d):
    return J.judged(_assembled(spark, d), J.word_scorer("public license")).select("path", "line", "kind", F.round("p", 9).alias("p"))


@query()
def deepened_candidates(spark, d):
    """Where no candidate is sure, lines of the best files join in; the tests hold it against a plain version."""
    few = G.grep(files(spark, d), "icense", limit=3).select("path", "line", F.col("line").alias("end"), F.lit("match").alias("kind"), "text")
    return J.deepened(few, files(spark, d), J.word_scorer("public license version")).select("path", "line", "kind", F.round("p", 6).alias("p"), "read")


@query(f"""{_LINES}, s AS (SELECT path, line, round(1 / (1 + exp(-({_words_sql('text', 'licensed', 'under', 'the', 'apache', 'license')}))), 3) AS support FROM lines_v WHERE contains(text, 'icense'))
    SELECT *, CASE WHEN support >= 0.8 THEN 'supports' WHEN support >= 0.5 THEN 'partly' ELSE 'unrelated' END AS verdict FROM s""")
def verify_lines(spark, d):
    return J.verify(G.grep(files(spark, d), "icense", max_text=None), "licensed under the apache license").select("path", "line", "support", "verdict")


def _beam_sql(levels):
    """The levels one after the other, as many as the paths have."""
    out = [f"entry AS (SELECT DISTINCT array_to_string(list_slice(s, 1, i - 1), '/') AS parent, s[i] AS name, array_to_string(list_slice(s, 1, i), '/') AS path, CASE WHEN i = len(s) THEN 'file' ELSE 'dir' END AS kind FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT string_split(path, '/') AS s FROM files_v)))",
        "open0 AS (SELECT '' AS path, CAST(1 AS DOUBLE) AS joint)"]
    for k in range(1, levels + 1):
        out.append(f"list{k} AS (SELECT e.*, o.joint, row_number() OVER (PARTITION BY e.parent ORDER BY e.kind, e.name) AS n FROM entry e JOIN open{k - 1} o ON e.parent = o.path)")
        out.append(f"soft{k} AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY parent)) AS x FROM (SELECT *, {_words_sql('path', 'src1', '.md')} AS logit FROM list{k} WHERE n <= 255))")
        out.append(f"p{k} AS (SELECT *, x / sum(x) OVER (PARTITION BY parent) AS p FROM soft{k})")
        out.append(f"take{k} AS (SELECT path, kind, joint * p AS joint FROM p{k} WHERE p >= 0.06 QUALIFY row_number() OVER (PARTITION BY parent ORDER BY p DESC, n) <= 4)")
        out.append(f"open{k} AS (SELECT path, joint FROM take{k} WHERE kind = 'dir' ORDER BY joint DESC, path LIMIT 6)")
    leaves = " UNION ALL ".join(f"SELECT path, joint FROM take{k} WHERE kind = 'file'" for k in range(1, levels + 1))
    return ", ".join([*out, f"beam AS (SELECT path, round(joint, 9) AS joint FROM ({leaves}) ORDER BY {{}}.joint DESC, path LIMIT 10)".replace("{}.", "")])


@query(f"{_FILES}, {_beam_sql(4)} SELECT * FROM beam")
def beam_search(spark, d):
    return J.beam(J.prefix_table(files(spark, d)), J.word_scorer("src1 .md")).withColumn("joint", F.round("joint", 9))


@query(f"""{_FILES}, {_beam_sql(4)}, flat AS (SELECT path, exp(logit - max(logit) OVER ()) AS x FROM (SELECT path, {_words_sql('path', 'src1', '.md')} AS logit FROM files_v)),
    one AS (SELECT path, round(x / sum(x) OVER (), 9) AS joint FROM flat ORDER BY x DESC, path LIMIT 10), total AS (SELECT count(*) AS n FROM files_v)
    SELECT * FROM one WHERE (SELECT n FROM total) <= 220 UNION ALL SELECT * FROM beam WHERE (SELECT n FROM total) > 220""")
def path_stage(spark, d):
    """One choice over a small snapshot's paths, the beam over a large one's."""
    return J.path_stage(files(spark, d), J.word_scorer("src1 .md")).withColumn("joint", F.round("joint", 9))


@query(f"""{_FILES}, l AS (SELECT path, {_words_sql('text', 'license', 'copyright', 'reserved')} AS a, {_words_sql('text', 'then', 'that', 'with')} AS b FROM files_v)
    SELECT path, CASE WHEN a > b THEN 'legal' ELSE 'prose' END AS label, round(1 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS confidence FROM l""")
def classify_rows(spark, d):
    labels = {"legal": J.word_scorer("license copyright reserved"), "prose": J.word_scorer("then that with")}
    return J.classify(files(spark, d), labels, "path").select("path", "label", F.round("confidence", 6).alias("confidence"))


# ---- structure

# what the first pattern of a language's forms makes of a line that begins with it
_FORMS = r"""CASE WHEN e = 'ts' THEN CASE WHEN regexp_matches(text, '^(export\s+)?(default\s+)?(async\s+)?function\s*\*?\s*[A-Za-z_$]') THEN 'function' WHEN regexp_matches(text, '^(export\s+)?(default\s+)?(abstract\s+)?class\s+[A-Za-z_$]') THEN 'class' END
        WHEN e = 'py' THEN CASE WHEN regexp_matches(text, '^(async\s+)?def\s+[A-Za-z_]') THEN 'function' WHEN regexp_matches(text, '^class\s+[A-Za-z_]') THEN 'class' END
        WHEN e = 'go' THEN CASE WHEN regexp_matches(text, '^func\s+[A-Za-z_]') THEN 'function' END END"""
#: Documents are prose; this makes a line of three words of each a function's head, by the file's language.
_CODED_SQL = """SELECT path, regexp_extract(path, '[.]([a-z]+)$', 1) AS e, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 <> 1 THEN '    ' || x ELSE
        (CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'ts' THEN 'function ' WHEN 'py' THEN 'def ' WHEN 'go' THEN 'func ' ELSE '' END) || 'f' || i || '() {' || CASE WHEN i % 2 = 0 THEN ' }' ELSE '' END END), chr(10)) AS text FROM files_v"""


def _coded(spark, d):
    keyword = F.when(F.col("path").endswith(".ts"), "function ").when(F.col("path").endswith(".py"), "def ").when(F.col("path").endswith(".go"), "func ").otherwise("")
    line = lambda x, i: F.when(i % 3 != 0, F.concat(F.lit("    "), x)).otherwise(F.concat(keyword, F.lit("f"), (i + 1).cast("string"), F.lit("() {"), F.when(i % 2 == 1, " }").otherwise("")))
    return files(spark, d).select("path", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(f"""{_FILES}, coded AS ({_CODED_SQL}), cl AS (SELECT path, e, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text FROM (SELECT path, e, string_split(text, chr(10)) AS a FROM coded)),
    k AS (SELECT *, {_FORMS} AS kind FROM cl) SELECT path, kind, regexp_extract(text, '(f[0-9]+)\\(', 1) AS name, line, substring(trim(text), 1, 200) AS signature FROM k WHERE kind IS NOT NULL""".replace("\\\\", "\\"))
def outline_files(spark, d):
    """Symbols of the whole table, whose lines are made into code."""
    return O.outline(_coded(spark, d)).select("path", "kind", "name", "line", "signature")


@query(f"""{_FILES}, coded AS ({_CODED_SQL}), cl AS (SELECT path, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text FROM (SELECT path, string_split(text, chr(10)) AS a FROM coded WHERE e = 'py')),
    h AS (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line) AS nxt FROM cl WHERE starts_with(text, 'def ')),
    b AS (SELECT path, line FROM cl WHERE trim(text) <> '')
    SELECT h.path, h.line, max(b.line) AS end_line FROM h LEFT JOIN b ON b.path = h.path AND b.line > h.line AND (nxt IS NULL OR b.line < nxt) GROUP BY h.path, h.line HAVING max(b.line) IS NOT NULL""")
def outline_spans(spark, d):
    """Spans by indentation of the whole table's Python files."""
    return O.outline(_coded(spark, d).where(F.col("path").endswith(".py"))).where("end_line > line").select("path", "line", F.col("end_line").cast("long").alias("end_line"))


@query(f"""{_FILES}, coded AS ({_CODED_SQL}), first AS (SELECT * FROM coded WHERE path GLOB 'src1*' ORDER BY path LIMIT 20), cl AS (SELECT path, e, unnest(string_split(text, chr(10))) AS text FROM first)
    SELECT path, CAST(count({_FORMS}) AS INT) AS n_symbols, (SELECT count(*) FROM coded WHERE path GLOB 'src1*') > 20 AS truncated FROM cl GROUP BY path""")
def tree_outlines(spark, d):
    return L.tree_with_outlines(_coded(spark, d), O.outline, most=20, glob="src1*").drop("symbols")


_EXTENSION = "CASE doc_id % 12 WHEN 0 THEN 'ts' WHEN 1 THEN 'py' WHEN 2 THEN 'rs' WHEN 3 THEN 'test.ts' WHEN 4 THEN 'go' WHEN 5 THEN 'c' WHEN 6 THEN 'ts' WHEN 7 THEN 'py' WHEN 8 THEN 'txt' WHEN 9 THEN 'swift' WHEN 10 THEN 'go' ELSE 'rs' END"


def _code(spark, d):
    """Every document as a source file of as many lines: code by its extension, with the document's words in comments and
    strings."""
    own = files(spark, d).withColumn("_e", F.expr(_EXTENSION))
    template = F.create_map(*[x for e, lines_ in samples.CODE.items() for x in (F.lit(e), F.array(*map(F.lit, lines_)))])[F.element_at(F.split("_e", "[.]"), -1)]
    words = lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z ]", ""))
    line = lambda x, i: F.replace(F.replace(F.coalesce(F.get(template, F.pmod(i, F.lit(6))), F.lit("~")), F.lit("@"), (i + 1).cast("string")), F.lit("~"), words(x))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("."), F.col("_e")))
    return own.select(path.alias("path"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _rows(*rows):
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _text(x) for x in row) + ")" for row in rows)


# what the templates put into each line, without a look at the text: symbols, their ends, and the lines around
_CODE_SQL = f"""WITH template(e, r, t) AS (VALUES {_rows(*[(e, r, t) for e, ts in samples.CODE.items() for r, t in enumerate(ts)])}), spec(e, r, kind, letter, ends) AS (VALUES {_rows(*samples.CODE_SYMBOLS)}),
    docs AS (SELECT source || '/' || lang || '/c' || doc_id || '.' || x AS path, list_extract(string_split(x, '.'), -1) AS e, string_split(text, chr(10)) AS a FROM (SELECT *, {_EXTENSION} AS x FROM documents)),
    rough AS (SELECT path, e, generate_subscripts(a, 1) AS line, trim(regexp_replace(unnest(a), '[^A-Za-z ]', '', 'g')) AS w FROM docs),
    every AS (SELECT path, rough.e, line, (line - 1) % 6 AS r, w, replace(replace(coalesce(t, '~'), '@', line::VARCHAR), '~', w) AS text FROM rough LEFT JOIN template ON template.e = rough.e AND template.r = (line - 1) % 6),
    whole AS (SELECT path, max(line) AS m FROM every GROUP BY path),
    code AS (SELECT path, e, line, r, w, text, n FROM every JOIN (SELECT path, CASE WHEN m = 1 AND text = '' THEN 0 WHEN text = '' THEN m - 1 ELSE m END AS n FROM whole JOIN every USING (path) WHERE line = m) USING (path) WHERE line <= n),
    sym AS (SELECT path, code.e AS e, code.r AS r, kind, letter || line AS name, line, CASE WHEN ends >= 0 AND line + ends <= n THEN line + ends WHEN ends = -2 AND n > line THEN least(line + 2, n) END AS end_line, substring(trim(text), 1, 200) AS signature, n FROM code JOIN spec ON spec.e = code.e AND spec.r = code.r)"""


@query(f"{_CODE_SQL} SELECT path, kind, name, line, end_line, signature FROM sym")
def outline_items(spark, d):
    """Symbols of six languages over the whole table."""
    return O.outline(_code(spark, d)).drop("language")


@query(f"""{_CODE_SQL}, owner AS (SELECT path, e, name AS parent, line, end_line, n FROM sym WHERE e IN ('ts', 'py') AND end_line IS NOT NULL)
    SELECT o.path, parent, CASE WHEN off = 1 THEN 'method' ELSE 'property' END AS kind, CASE WHEN off = 1 THEN 'm' ELSE 'p' END || o.line + off AS name, o.line + off AS line,
        CASE WHEN o.e = 'ts' AND off = 1 THEN o.line + 1 WHEN o.e = 'py' AND o.n > o.line + 1 THEN o.line + 2 END AS end_line, substring(trim(text), 1, 200) AS signature
    FROM owner o JOIN (VALUES (1), (2)) AS v(off) ON TRUE JOIN code c ON c.path = o.path AND c.line = o.line + off WHERE off = 1 OR o.e = 'ts'""")
def outline_members(spark, d):
    return O.members(_code(spark, d))


@query(f"{_CODE_SQL} SELECT s.path, s.name, s.line, CASE WHEN s.r = 1 THEN c.w END AS comment FROM sym s JOIN code c ON c.path = s.path AND c.line = s.line - 1")
def outline_comments(spark, d):
    code = _code(spark, d)
    return O.leading_comments(code, O.outline(code)).select("path", "name", "line", "comment")


@query(f"{_CODE_SQL}, i AS (SELECT path, line, replace(t, '@', line::VARCHAR) AS import FROM code JOIN (VALUES {_rows(*samples.CODE_IMPORTS.items())}) AS v(e, t) USING (e) WHERE r = 5) SELECT path, array_to_string(list_slice(list(import ORDER BY line), 1, 200), ',') AS imports FROM i GROUP BY path")
def outline_imports(spark, d):
    return O.imports(_code(spark, d)).select("path", F.array_join("imports", ",").alias("imports"))


@query(f"{_CODE_SQL}, p AS (SELECT min(path) AS path FROM sym WHERE line = 8 AND path GLOB '*.ts') SELECT path, name, line, levenshtein(lower(name), 'c999') AS distance FROM sym JOIN p USING (path) ORDER BY distance, name, line LIMIT 5")
def symbol_lookup(spark, d):
    """A name that isn't there: the nearest ones of a file."""
    symbols = O.outline(_code(spark, d))
    path = symbols.where((F.col("line") == 8) & F.col("path").endswith(".ts")).agg(F.min("path")).first()[0]
    return O.symbol_lookup(symbols, path, "C999").select("path", "name", "line", "distance")


@query(f"""{_CODE_SQL} SELECT c.path, c.line, substring(text, 1, 400) AS text, (SELECT arg_max(name, s.line) FROM sym s WHERE s.path = c.path AND c.line BETWEEN s.line AND s.end_line) AS symbol FROM code c WHERE contains(text, 'th')""")
def enclosing_symbol(spark, d):
    """Matches of the whole table with the symbol around them."""
    code = _code(spark, d)
    return G.enclosing_symbols(G.grep(code, "th"), O.outline(code).where(F.col("end_line").isNotNull()))


@query(f"""{_CODE_SQL}, span AS (SELECT path, line AS start, least(end_line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, end_line)) AS "end", name FROM sym WHERE end_line IS NOT NULL),
    b AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY path ORDER BY start), 0) + 1 AS from_ FROM span), t AS (SELECT path, max("end") + 1 AS start FROM span GROUP BY path),
    n AS (SELECT DISTINCT path, n FROM code), bare AS (SELECT path, n, unnest(CASE WHEN n <= 60 THEN [1] ELSE range(1, CAST(1 + 30 * ceil((n - 40) / 30) AS BIGINT) + 1, 30) END) AS start FROM n WHERE path NOT IN (SELECT path FROM span)),
    region AS (SELECT path, start, "end", 'symbol' AS kind, name AS symbol FROM span UNION ALL SELECT path, from_, start - 1, 'window', NULL FROM b WHERE from_ < start UNION ALL SELECT path, start, n, 'window', NULL FROM t JOIN n USING (path) WHERE start <= n
        UNION ALL SELECT path, start, CASE WHEN n <= 60 THEN n ELSE least(start + 39, n) END, CASE WHEN n <= 60 THEN 'file' ELSE 'window' END, NULL FROM bare)
    SELECT path, start, "end", kind, symbol FROM region WHERE EXISTS (SELECT 1 FROM code c WHERE c.path = region.path AND c.line BETWEEN start AND "end" AND trim(c.text) <> '')""")
def symbol_chunks(spark, d):
    code = _code(spark, d)
    return R.chunks(code, O.outline(code)).select("path", "start", "end", "kind", "symbol")


# ---- text operators in the manner of a shell


@query(f"{_LINES} SELECT text AS line FROM lines_v WHERE starts_with(path, 'src1/en/') ORDER BY path, lines_v.line LIMIT 15")
def shell_head(spark, d):
    return S.cat(files(spark, d), scope="src1/en").transform(S.head, 15).select("line")


@query(f"{_LINES} SELECT text AS line FROM lines_v WHERE starts_with(path, 'src1/en/') ORDER BY path DESC, lines_v.line DESC LIMIT 15")
def shell_tail(spark, d):
    return S.cat(files(spark, d), scope="src1/en").transform(S.tail, 15).select("line")


@query(f"{_FILES} SELECT path, len(string_split(text, chr(10))) AS lines, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, length(text) AS chars FROM files_v".replace("\\\\", "\\"))
def shell_wc(spark, d):
    return S.wc_files(files(spark, d))


@query(f"{_LINES} SELECT text AS line FROM lines_v WHERE path GLOB '*.md' AND NOT contains(text, 'th')")
def shell_grep(spark, d):
    return S.cat(files(spark, d), glob="**/*.md").transform(S.grep, "th", invert=True).select("line")


@query(f"{_FILES}, e AS (SELECT DISTINCT array_to_string(list_slice(s, 1, i), '/') AS path, CASE WHEN i = len(s) THEN 'f' ELSE 'd' END AS kind FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT string_split(path, '/') AS s FROM files_v))) SELECT path, kind FROM e WHERE kind = 'd' OR path GLOB '*.go'")
def shell_find(spark, d):
    return S.find(files(spark, d), kind="d").unionByName(S.find(files(spark, d), name="*.go", kind="f"))


@query("WITH n AS (SELECT DISTINCT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) || '/' ELSE p END AS name FROM (" + _FILES[len("WITH files_v AS (") : -1].replace("FROM documents", "FROM documents) f(doc_id, source, lang, p, text)").replace("SELECT doc_id", "SELECT p FROM (SELECT doc_id", 1) + ")) SELECT name FROM n")
def shell_ls(spark, d):
    return S.ls(files(spark, d))


@query("SELECT c_name AS line FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20")
def shell_sort(spark, d):
    rows = table(spark, d, "customer").select(F.struct(F.col("c_custkey")).alias("ord"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("line"), "c_name")
    return S.sort_lines(rows, numeric=True, reverse=True).limit(20).select(F.col("c_name").alias("line"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS s FROM conversations),
    g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m) SELECT conv_id, min(turn) AS turn, role AS line, count(*) AS n FROM g GROUP BY conv_id, k, role""")
def shell_uniq(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("line"))
    return S.uniq(rows, ["conv_id"]).withColumnRenamed("ord", "turn")


@query(f"{_LINES} SELECT path, text AS line FROM lines_v WHERE line BETWEEN 2 AND 3")
def shell_sed(spark, d):
    rows = L.numbered_lines(files(spark, d)).select("path", F.col("line").alias("line_no"), F.col("text").alias("line"))
    return S.sed_print(rows, 2, 3).select("path", "line")


@query(f"{_LINES} SELECT lpad(CAST(n AS VARCHAR), 7, ' ') || ' ' || text AS line FROM (SELECT text, count(*) AS n FROM lines_v WHERE contains(text, 'icense') GROUP BY text) ORDER BY n DESC, text LIMIT 10")
def shell_pipeline(spark, d):
    """cat | grep | sort | uniq -c | sort -nr | head"""
    return S.cat(files(spark, d)).transform(S.grep, "icense").transform(S.uniq_sorted).orderBy(F.desc("n"), "line").limit(10).transform(S.counted)


@query(f"{_LINES} SELECT path || ':' || count(*) AS line FROM lines_v WHERE contains(text, 'icense') GROUP BY path")
def shell_grep_counts(spark, d):
    return S.grep_paths(files(spark, d), "icense", show="counts")


@query(f"{_LINES} SELECT path || ':' || line || ':' || substring(text, 1, 400) AS line FROM lines_v WHERE contains(text, 'icense') AND starts_with(path, 'src1/')")
def shell_grep_lines(spark, d):
    return S.grep_paths(files(spark, d), "icense", scope="src1")


@query(f"{_FILES} SELECT CASE WHEN contains(r, '/') THEN 'd' ELSE '-' END AS kind, split_part(r, '/', 1) AS name, CAST(sum(strlen(text)) AS BIGINT) AS size FROM (SELECT substring(path, 6) AS r, text FROM files_v WHERE starts_with(path, 'src1/')) GROUP BY ALL")
def shell_ls_long(spark, d):
    return S.ls_long(files(spark, d), "src1")


@query(f"{_LINES} SELECT path, line, regexp_replace(text, '[Ll]icense', '<\\0>', 'g') AS text, regexp_replace(text, '[Ll]icense', 'x') AS first FROM lines_v WHERE contains(text, 'icense')".replace("\\\\", "\\"))
def shell_sed_replace(spark, d):
    rows = G.grep(files(spark, d), "icense").select("path", F.col("line").alias("n"), F.col("text").alias("line"))
    both = S.sed_replace(rows.withColumn("first", F.col("line")), "[Ll]icense", "<&>").withColumnRenamed("line", "text")
    return S.sed_replace(both.withColumnRenamed("first", "line"), "[Ll]icense", "x", every=False).select("path", F.col("n").alias("line"), "text", F.col("line").alias("first"))


@query("WITH r AS (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM events), g AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS k FROM r) SELECT min(event_id) AS ord, event_type AS line, count(*) AS n FROM g GROUP BY k, event_type")
def shell_uniq_whole(spark, d):
    """Runs over one whole table, found range by range."""
    return S.uniq(table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("line")))


@query("SELECT CAST(1 AS BIGINT) AS ord, 'a b' AS line")
def shell_echo(spark, d):
    return S.echo(spark, "a", "b")


# ---- relational layer


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def join_semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49")
    return table(spark, d, "part").join(big, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def join_range(spark, d):
    """An equi key with a range on top: what follows a purchase within six hours."""
    e = table(spark, d, "events")
    a, b = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    near = (F.col("user_id") == F.col("u")) & (F.col("t") > F.col("ts")) & (F.col("t") <= F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return a.join(b, near, "left").groupBy("event_id").agg(F.count("u").alias("n"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def group_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT action, source, count(*) AS n FROM (" + REQUESTS_SQL + ") GROUP BY GROUPING SETS ((action), (source), ())")
def group_sets(spark, d):
    requests(spark, d).createOrReplaceTempView("requests_v")
    return spark.sql("SELECT action, source, count(*) AS n FROM requests_v GROUP BY GROUPING SETS ((action), (source), ())")


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, ntile(4) OVER w AS quarter, CAST(sum(event_id) OVER w AS BIGINT) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.sum("event_id").over(w).alias("running"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def pivot_status(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
def scalar_subquery(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("supplier_v")
    return spark.sql("SELECT s_suppkey FROM supplier_v WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier_v)")


@query("SELECT c_name, levenshtein(lower(c_name), 'customer#000000101') AS distance FROM customer ORDER BY distance, c_name LIMIT 5")
def levenshtein_names(spark, d):
    return table(spark, d, "customer").select("c_name", F.levenshtein(F.lower("c_name"), F.lit("customer#000000101")).alias("distance")).orderBy("distance", "c_name").limit(5)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return K.replayed(K.windowed(K.event_stream(spark, d), "1 hour"))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTES, ts) - i * INTERVAL 15 MINUTES FOR i IN range(4)]) AS w FROM events) GROUP BY ALL")
def stream_sliding(spark, d):
    return K.replayed(K.windowed(K.event_stream(spark, d), "1 hour", "15 minutes"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stream_session(spark, d):
    return K.replayed(K.sessions(K.event_stream(spark, d)), "append")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
def stream_late(spark, d):
    """Append mode: a window comes out once the watermark has passed it, later rows for it are dropped."""
    return K.replayed(K.windowed(K.event_stream(spark, d), "1 hour"), "append")


# a key's requests one after the other; those that the watermark hasn't passed are not decided yet
@query("""WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) FROM events) - 600000000),
    r(user_id, ts, n, allowed, retry_after, recent) AS (
        SELECT user_id, ts, n, TRUE, CAST(0 AS DOUBLE), [t] FROM e WHERE n = 1
        UNION ALL
        SELECT user_id, ts, n, len(live) < 2, CASE WHEN len(live) < 2 THEN 0 ELSE (live[1] + 3600000000 - t) / 1e6 END, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END
        FROM (SELECT e.*, list_filter(recent, lambda x: x > e.t - 3600000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, ts, allowed, retry_after FROM r""")
def stream_throttle(spark, d):
    """Requests that the watermark has passed, in order of event time, with state by timers."""
    run = lambda: K.replayed(throttled(K.event_stream(spark, d), "user_id", seconds=3600, limit=2), "append")
    return with_state_on_disk(spark, run).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events)
    SELECT user_id, ts AS last_access FROM e WHERE (next IS NULL OR next >= ts + INTERVAL 2 DAYS) AND ts + INTERVAL 2 DAYS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stream_evictions(spark, d):
    """What wasn't used for two days, each time, as timers tell."""
    run = lambda: K.replayed(evictions(K.event_stream(spark, d), "user_id", days=2), "append")
    return with_state_on_disk(spark, run).withColumn("last_access", F.col("last_access").cast("timestamp_ntz"))


_SPAN, _ENDS, _CODE = (x.replace("'", "''") for x in (V.QUOTED_SPAN, V.TOKEN_ENDS, "|".join(V.CODE_SHAPES)))
_NOISE = ", ".join(_text(w) for w in V.QUESTION_STOP_WORDS)


@query(f"""WITH q AS (SELECT conv_id, turn, text AS question FROM conversations),
    r AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(question, '{_SPAN}', ' ', 'g'), '{V.TOKEN_SEPARATORS}'), lambda t: regexp_replace(t, '{_ENDS}', '', 'g')) AS n FROM q),
    i AS (SELECT conv_id, turn, p, t, length(t) >= 3 AND regexp_matches(t, '{_CODE}') AS coded FROM (SELECT conv_id, turn, unnest(n) AS t, generate_subscripts(n, 1) AS p FROM r)),
    d AS (SELECT conv_id, turn, coded, CASE WHEN coded THEN t ELSE lower(t) END AS t, min(p) AS p FROM i WHERE coded OR (length(t) >= 4 AND lower(t) NOT IN ({_NOISE}) AND NOT regexp_matches(t, '^[0-9]+$')) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, coded ORDER BY p) AS rank FROM d),
    g AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY p) FILTER (WHERE coded AND rank <= 8) AS identifiers, string_agg(t, ' ' ORDER BY p) FILTER (WHERE NOT coded AND rank <= 12) AS words FROM k GROUP BY ALL)
    SELECT conv_id, turn, len(list_filter(regexp_extract_all(question, '{_SPAN}'), lambda x: length(trim(substring(x, 2, length(x) - 2))) >= 2)) AS n_literals, coalesce(identifiers, '') AS identifiers, coalesce(words, '') AS words FROM r LEFT JOIN g USING (conv_id, turn)""")
def questions(spark, d):
    parts = table(spark, d, "conversations").select("conv_id", "turn", question_parts(F.col("text")).alias("q"))
    return parts.select("conv_id", "turn", F.size("q.literals").cast("long").alias("n_literals"), F.array_join("q.identifiers", " ").alias("identifiers"), F.array_join("q.words", " ").alias("words"))


@query()
def question_samples(spark, d):
    return samples.asked(spark).select("question", question_parts(F.col("question")).alias("q")).select("question", "q.*")


@query(r"""SELECT page_id, CASE WHEN h <> '' AND n <> '' THEN h ELSE '-' END AS owner, CASE WHEN h <> '' AND n <> '' THEN n ELSE '-' END AS repo
    FROM (SELECT page_id, regexp_extract(p, '^([A-Za-z0-9_.-]+)/', 1) AS h, regexp_replace(regexp_extract(p, '^[^/]+/([A-Za-z0-9_.-]+)', 1), '\.git$', '') AS n FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS p FROM pages))""")
def repository_paths(spark, d):
    return table(spark, d, "pages").select("page_id", repository_parts(F.col("url")).alias("r")).select("page_id", "r.owner", "r.repo")

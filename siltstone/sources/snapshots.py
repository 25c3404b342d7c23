"""Snapshots of source trees, evaluation records and the sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.paths import mime, skip_reason
from siltstone.functions.text import line_count
from siltstone.functions.values import MAX_FILE_BYTES
from siltstone.sources.archives import MAX_ARCHIVE_BYTES, archived_files

FILES = "path string, size long, mime string, lines int, content binary"
REQUESTS = "ts timestamp, action string, source string, status string, owner string, repo string, ref_kind string, client string, path string, duration_ms double, weight long"
RUNS = "runId string, benchRunId string, ts string, provider string, model string, taskId string, condition string, trial int, category string, passed boolean, answer string, toolCalls int, iterations int, wallClockMs long, inputTokens long, outputTokens long, costUsd double"
TASKS = "id string, repo string, ref string, category string, question string, expected struct<type:string,value:string,pattern:string,values:array<string>>"


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below a directory as a snapshot. What ingestion leaves out by name or size is never read: the filter
    is on path and length, and the content column comes after it. Spark's reader passes over files of no bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.expr(f"substring(path, locate('{base.split('://')[-1]}/', path) + {len(base.split('://')[-1]) + 1})")
    admitted = raw.select(relative.alias("path"), "length", "content").where(skip_reason(F.col("path"), F.col("length"), max_bytes).isNull())
    text = F.decode("content", "UTF-8")
    return admitted.select("path", F.col("length").alias("size"), mime(F.col("path")).alias("mime"), line_count(text).cast("int").alias("lines"), text.alias("text"), "content")


def read_archives(spark: SparkSession, path: str, max_archive: int = MAX_ARCHIVE_BYTES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``(archive, path, size, mime, lines, text, content)`` of the files in ``.tar.gz`` archives below ``path``, without what
    ingestion leaves out; see ``ArchiveSource``."""
    each = archived_files(spark, path, max_archive, max_bytes)
    kept = each.where(skip_reason(F.col("path"), F.col("size"), max_bytes).isNull())
    text = F.decode("content", "UTF-8")
    return kept.select("archive", "path", "size", mime(F.col("path")).alias("mime"), line_count(text).cast("int").alias("lines"), text.alias("text"), "content")


def append_failures(failures: DataFrame, path: str) -> None:
    """The sink of failed ingests: ``owner, repo, reason, ts`` are added to what is there."""
    failures.select("owner", "repo", "reason", "ts").write.mode("append").parquet(path)


def latest(snapshots: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Of files ingested several times, the last."""
    w = Window.partitionBy("owner", "repo", "sha", "path").orderBy(F.desc(order))
    return snapshots.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_snapshot(files: DataFrame, path: str, owner: str, repo: str, sha: str) -> None:
    """A directory for each snapshot, sorted by path, so that prefix scopes skip row groups."""
    rows = files.withColumns({"owner": F.lit(owner), "repo": F.lit(repo), "sha": F.lit(sha)})
    rows.sortWithinPartitions("path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner", "repo", "sha").parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a fixed schema, and the file that each is from."""
    return spark.read.schema(schema).json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def resolve_refs(wanted: DataFrame, cache: DataFrame, now, ttl_hours: int = 24) -> DataFrame:
    """``(ref, sha, age_hours, fresh)``: cached resolutions within their time to live; a miss has a null sha."""
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("resolved_at")) / 3600
    return wanted.join(cache, "ref", "left").select("ref", F.when(age <= ttl_hours, F.col("sha")).alias("sha"), age.alias("age_hours"), F.coalesce(age <= ttl_hours, F.lit(False)).alias("fresh"))


def append_requests(log: DataFrame, path: str) -> None:
    log.select(*[f.split(" ")[0] for f in REQUESTS.split(", ")]).write.mode("append").parquet(path)


def as_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def as_pretty_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def as_markdown(rows: DataFrame, title: str = "") -> DataFrame:
    """``(ord, value)``: a heading, a table's head and a line for each row; marks that would end a cell are escaped. ``ord``
    puts the head first, rows follow in any order."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|\\])", r"\\$1"), r"\r?\n", "<br>")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f"`{c}`") for c in rows.columns]), F.lit(" |"))
    head = [f"# {title}", ""] * bool(title) + [f"| {' | '.join(rows.columns)} |", "|" + " --- |" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "ord int, value string")
    return top.unionByName(rows.select(F.lit(len(head)).alias("ord"), line.alias("value")))


def as_text(matches: DataFrame) -> DataFrame:
    """``path:line:text``."""
    return matches.select(F.concat_ws(":", "path", F.col("line").cast("string"), "text").alias("value"))


def cached_answers(questions: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Answers known already, and the questions that have none."""
    return questions.join(cache, key), questions.join(cache, key, "left_anti")

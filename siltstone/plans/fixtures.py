"""Stand-ins for a repository snapshot and a request log, over the given tables. The text is valid Spark and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES_SQL = """
    SELECT doc_id, source, lang,
           concat(source, '/', lang, '/d', lpad(CAST(doc_id AS string), 6, '0'),
                  CASE doc_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.md'
                                  WHEN 3 THEN '.test.ts' WHEN 4 THEN '.go' ELSE '.txt' END) AS path,
           text
    FROM documents"""

REQUESTS_SQL = """
    SELECT event_id, ts,
           CASE event_type WHEN 'view' THEN 'tree' WHEN 'click' THEN 'file' WHEN 'purchase' THEN 'grep'
                           WHEN 'signup' THEN 'find' ELSE 'outline' END AS action,
           CASE WHEN event_id % 4 = 0 THEN 'edge' ELSE 'do' END AS source,
           CASE WHEN event_type = 'error' THEN CASE user_id % 3 WHEN 0 THEN '404' WHEN 1 THEN '500' ELSE '429' END
                ELSE '200' END AS status,
           CASE WHEN user_id % 50 = 0 THEN '-' ELSE concat('o', CAST(user_id % 7 AS string)) END AS owner,
           concat('r', CAST(user_id % 40 AS string)) AS repo,
           CASE user_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'branch' WHEN 2 THEN 'tag' ELSE 'sha' END AS ref_kind,
           CASE user_id % 4 WHEN 0 THEN 'curl' WHEN 1 THEN 'browser' WHEN 2 THEN 'library' ELSE '' END AS client,
           concat('/p', CAST(event_id % 17 AS string)) AS path,
           value * 20 AS duration_ms,
           1 + event_id % 3 AS weight
    FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "documents", FILES_SQL)


def files_of(documents: DataFrame) -> DataFrame:
    """The snapshot of some of the documents."""
    return documents.sparkSession.sql(FILES_SQL.replace("FROM documents", "FROM {t}"), t=documents)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "events", REQUESTS_SQL)

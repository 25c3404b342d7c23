"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.storage import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder. A lost executor costs a reread, not a rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return row["n"], row["b"] or 0

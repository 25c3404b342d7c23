"""Numbers for ids of any type, in the ids' own order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.columns import quoted
from siltstone.llm.storage import written


def are_numbers(df: DataFrame, id_col: str) -> bool:
    return isinstance(df.schema[id_col].dataType, T.IntegralType)


def id_numbers(df: DataFrame, id_col: str) -> DataFrame:
    """``(id, number long)`` for each distinct id: a smaller id has a smaller number. Ids are ranged over partitions, and
    numbered by partition and place in it, so nothing is put in order in one task."""
    each = df.select(quoted([id_col])[0].alias("id")).where("id IS NOT NULL").distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(each.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id()), "ids")


def with_numbers(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``rows`` of ``id`` with ``number``, null for a null id; rows of null id stay where they are."""
    named = rows.where("id IS NOT NULL").join(numbers, "id")
    return named.unionByName(rows.where("id IS NULL").withColumn("number", F.lit(None).cast("long")))

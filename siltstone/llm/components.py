"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.storage import written

#: A value is hot beyond so many rows, and beyond one in so many of all: there can't be more hot ones than that.
HOT_ROWS, HOT_VALUES = 4096, 4096
#: Rows that are looked at to find the hot ones.
SAMPLED = 1 << 16


def hot_values(rows: DataFrame, column: str) -> list:
    """Values that so many rows have that they shouldn't meet in one task, as a sample of ``SAMPLED`` rows shows; at most two
    for each of ``HOT_VALUES``. What is missed or taken in vain changes the plan and no result."""
    n = rows.count()
    most, share = max(HOT_ROWS, n // HOT_VALUES), min(1.0, SAMPLED / max(1, n))
    if n <= most:
        return []
    some = rows.sample(share, seed=1) if share < 1 else rows
    return [r[0] for r in some.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most * share * (0.75 if share < 1 else 1)).select(column).collect()]


def looked_up(rows: DataFrame, known: DataFrame, column: str, hot: list) -> DataFrame:
    """``rows`` with what ``known`` has once for each value of ``column``. What it has for hot values goes to every worker,
    so that their rows stay where they are; the rest meet by value."""
    if not hot:
        return rows.join(known, column, "left")
    few = rows.sparkSession.createDataFrame([(v,) for v in hot], T.StructType([rows.schema[column]]))
    marked = rows.join(F.broadcast(few.withColumn("_hot", F.lit(True))), column, "left")
    sent = F.broadcast(known.join(F.broadcast(few), column, "left_semi"))
    cold = marked.where("_hot IS NULL").drop("_hot").join(known, column, "left")
    return cold.unionByName(marked.where("_hot").drop("_hot").join(sent, column, "left"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that a link has; the component is its smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then its label's label.
    A table is written every round, so that neither lineage nor a lost executor grows costly; the number of
    rounds goes with the logarithm of the longest path. Nodes with many links, and labels of many nodes, are sent to
    the workers instead of gathering their rows.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(pairs.union(pairs.select(F.col("other"), F.col("node"))).distinct(), "links")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component"))
    labels = written(labels, "labels")
    centres = hot_values(both, "other")
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("component").alias("_c"))
        near = looked_up(both, known, "other", centres).groupBy("node").agg(F.min("_c").alias("_near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        up = labels.select(F.col("node").alias("_new"), F.col("component").alias("_up"))
        jumped = looked_up(lower, up, "_new", hot_values(labels, "component")).select("node", "_old", F.least("_new", F.coalesce("_up", "_new")).alias("component"))
        jumped = written(jumped, "labels")
        if not jumped.where(F.col("component") != F.col("_old")).limit(1).count():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")

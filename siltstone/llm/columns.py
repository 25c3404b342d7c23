"""Names of columns: what an input keeps, and names for an operator's own columns that no input can clash with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_names(df: DataFrame, new: Iterable[str]) -> list[str]:
    """The input's columns but those that a new one replaces; case counts for nothing, as in Spark."""
    replaced = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in replaced]


def quoted(names: Iterable[str]) -> list[Column]:
    """As columns, whatever dots or marks a name holds."""
    return [F.col(f"`{n.replace('`', '``')}`").alias(n) for n in names]


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """``_name`` for each wanted name, with as many more underscores as the input's names ask for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` whose columns are known to the function by place, so that any names go through."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(function, schema)

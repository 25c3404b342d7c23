"""From documents to a training mix: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.jaccard_join import jaccard_components
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.mixing import count_words, mix
from siltstone.llm.quality_classifier import fit_quality, quality_scores
from siltstone.llm.queries import KEEP_SCORE, MIX, held_out, table
from siltstone.llm.storage import written

#: The classifier and an iterative join can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _packed(docs: DataFrame) -> DataFrame:
    """``text`` beside one struct of all other columns, so that no name of theirs meets one of an operator's."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("kept"), "text")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in its order."""
    return rows.select(*[F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier doesn't reject.

    A row is judged by its text alone: null and empty texts by the score of no words, repeated rows alike, null ids
    like others. The model is fitted on the labelled rows of ``documents``, whatever ``docs`` are. All columns
    stay as they are. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = fit_quality(table(spark, sf_dir, "documents"), labels)
    return _unpacked(quality_scores(_packed(docs), model).where(F.col("score") >= KEEP_SCORE), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of ten or more documents out of all of them.

    Repeated rows count as documents of their own, null ids too. A null text comes back empty; ``n_chars`` follows
    the text. All rows and all other columns stay.
    """
    rows = _unpacked(line_dedup(_packed(docs), min_docs=10), docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id in each group of near copies: five-word shingles, similarity 0.8.

    A row counts by itself, whatever its id. Of rows repeated whole one stays; of rows that share an id those go
    that are copies of a row before them; a row of null id comes after all others of its group. Rows without
    words are in no group and stay. All columns stay as they are.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("kept"), "text", order.alias("order"), F.monotonically_increasing_id().alias("row"))
    rows = written(packed, "rows")
    groups = jaccard_components(rows, n=5, numerator=80, denominator=100, id_col="row")
    placed = rows.select("row", F.struct("order", "row").alias("order")).join(groups.select("row", "component_id"), "row")
    first = placed.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first")["row"].alias("row"))
    return _unpacked(rows.join(first, "row", "left_semi"), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all words of a shorter one.

    Null and empty texts hold none and stay; repeated rows and null ids are judged like others. All columns stay
    as they are.
    """
    return _unpacked(decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), window=10).where("n_hit = 0"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document comes in the mix of sources, with its text.

    Rows without words never come; a null source is a source of its own; repeated rows are rows of their own, and
    rows of null id share a block. Columns of ``docs`` that are named as one of the mix give way.
    """
    return mix(docs.withColumn("n_tokens", count_words(F.col("text"))), MIX)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

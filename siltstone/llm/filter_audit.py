"""Filter interaction audit: what every order of a set of filters removes, from counts over the lattice of applied sets.

What a filter does depends on which filters came before it, not on their order. So documents are counted once
for each edge (set of filters already applied, filter that comes next) of the lattice of sets, and every order
is a path over such edges: its steps look their counts up.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.columns import quoted
from siltstone.llm.storage import written

#: Of a text and its words: whether the document fails.
Filter = Callable[[Column, Column], Column]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 7


def short(least: int) -> Filter:
    return lambda text, words: F.size(words) < least


def repetitive(percent: int) -> Filter:
    """Distinct words are less than so many in a hundred."""
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def shouting(percent: int) -> Filter:
    """Characters of A-Z are more than so many in a hundred."""
    return lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.length(text)


def marked(characters: str) -> Filter:
    """Any of the characters stands in the text."""
    return lambda text, words: F.length(F.translate(text, characters, "")) < F.length(text)


def _fails(docs: DataFrame, filters: dict[str, Filter], part_col: str, id_col: str, text_col: str) -> DataFrame:
    """``(part, id, salt, same, mask)``: which filters a document fails, a bit each, and a digest of its text.
    Rows of null id, which meet nothing by id, have a salt each."""
    given = docs.select(*[c.alias(n) for c, n in zip(quoted([part_col, id_col, text_col]), ("part", "id", "text"), strict=True)])
    given = given.select(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), "id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), "")
    given = given.withColumn("words", words)
    mask = sum((F.when(f(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, f in enumerate(filters.values())), F.lit(0))
    salt = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    return given.select("part", "id", salt.alias("salt"), F.unhex(F.sha2("text", 256)).alias("same"), mask.alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    found = labels.select(*[c.alias(n) for c, n in zip(quoted([id_col, "quality", "toxic"]), ("id", "quality", "toxic"), strict=True)])
    found = found.withColumn("id", F.col("id").try_cast(rows.schema["id"].dataType)).where("id IS NOT NULL")
    each = found.groupBy("id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(each.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")


def edge_counts(cells: DataFrame, n_filters: int) -> DataFrame:
    """Counts for every edge ``(applied, next)`` of the lattice and part, from ``(part, mask, n, good, toxic)``."""
    edges = cells.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(n_filters * (1 << n_filters) - 1))))
    edges = edges.withColumns({"next": (F.col("edge") % n_filters).cast("int"), "applied": F.floor(F.col("edge") / n_filters).cast("int")})
    edges = edges.withColumn("bit", F.expr("shiftleft(1, next)")).where("applied & bit = 0")
    alive, fails = F.expr("mask & applied = 0"), F.expr("mask & bit != 0")
    total = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0))
    sums = [total(alive & ~fails), total(alive & fails), total(~alive & fails), total(F.col("mask") == F.col("bit")), total(alive & fails, "good"), total(alive & fails, "toxic")]
    return edges.groupBy("part", "applied", "next").agg(*[s.alias(c) for s, c in zip(sums, COUNTS, strict=True)])


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter], copies: str | None = "E", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: a row for
    every part, order of the filters and step of the order. Filters are named by one letter each.

    ``copies`` names one more filter: texts identical to that of a smaller id anywhere in the table, removed or not.
    ``kept`` is what is left after the step; ``removed`` what it takes, of that ``good_lost`` are labelled quality 1
    and ``toxic_lost`` toxic 1; ``redundant`` what it would take but earlier filters took; ``unique_fails`` what fails
    this filter only; ``shapley`` the filter's removed, summed over all orders. All are long.

    A null text is empty, a null part the part ``""``. A row of null id fails no ``copies`` and has no labels. Rows of
    one id and one text aren't copies of each other; repeated labels of an id count if any says 1. A filter that gives
    null isn't failed. An empty table has no parts and so no rows. Other columns are not read. At most
    ``MOST_FILTERS`` filters, ``ValueError`` otherwise.

    Documents are counted by part and mask of failed filters before anything is shuffled, then once for each edge.
    Which row of a text is the first is found by joining on text and id together, so that a text that many rows
    share is no hot key.
    """
    names = [*filters, *([copies] if copies else [])]
    if len(names) > MOST_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError(f"at most {MOST_FILTERS} filters, named by a letter each: {names}")
    spark = docs.sparkSession
    rows = written(_fails(docs, filters, part_col, id_col, text_col), "audit")
    marked_rows = _labelled(rows, labels, id_col)
    mask = F.col("mask")
    if copies:
        first = rows.where("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("id"))
        marked_rows = marked_rows.join(first.withColumns({"salt": F.lit(0).cast("long"), "first": F.lit(True)}), ["id", "salt", "same"], "left")
        mask = mask + F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    ones = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    cells = marked_rows.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), ones("good").alias("good"), ones("toxic").alias("toxic"))
    place = {n: i for i, n in enumerate(names)}
    steps = [("".join(order), k + 1, sum(1 << place[x] for x in order[:k]), place[x]) for order in permutations(names) for k, x in enumerate(order)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, applied int, next int")  # bounded by MOST_FILTERS
    paths = edge_counts(cells, len(names)).join(F.broadcast(steps), ["applied", "next"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "next"))
    return paths.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))

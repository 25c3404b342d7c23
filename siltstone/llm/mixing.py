"""Mixing sources to target weights: tempered token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.columns import kept_names, quoted
from siltstone.llm.storage import written

#: Halvings that one pass over the source table settles, and passes.
HALVINGS, PASSES = 4, 8
#: A source is dealt into blocks of about so many tokens, and into so many blocks at most.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 18, 1 << 16
#: Rows of the plan that every worker may get.
SENT_SOURCES = 50_000


@dataclass(frozen=True)
class Target:
    """``entropy``: least entropy of the weights, as a share of the logarithm of the number of sources.
    ``repeats``: how often a document may come on average at most; it holds even if entropy suffers."""

    entropy: float | None = 0.95
    repeats: float | None = 4.0


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of rows, for values relative to a largest one of 1."""
    return F.sum(x.cast("decimal(38, 18)")).cast("double")


def _measures(sources: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """Entropy and most repeats of the weights for each exponent; ``share`` is relative to the largest source."""
    each = sources.select("tokens", "share", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x"))
    power = F.pow("share", F.col("x"))
    sums = each.groupBy("x").agg(_sum(power).alias("z"), _sum(power * F.log(power)).alias("s"), F.max(power / F.col("tokens")).alias("m"))
    return {r["x"]: (math.log(r["z"]) - r["s"] / r["z"], r["m"] / r["z"] * budget) for r in sums.collect()}


def find_exponent(sources: DataFrame, target: Target, budget: float) -> float:
    """The exponent in [0, 1] nearest 1 that meets the entropy target, raised to what the repeat limit asks for.

    Both measures are monotone, so each bound is bisected: every pass over the sources evaluates the
    midpoints of the next few halvings at once.
    """

    def bisect(holds_below) -> tuple[float, float]:
        """The border between exponents where ``holds_below`` is true and, above, where it isn't."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            n = 1 << HALVINGS
            points = [lo + (hi - lo) * i / n for i in range(1, n)]
            got = _measures(sources, points, budget)
            a, b = 0, n
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if holds_below(got[points[mid - 1]]) else (a, mid)
            lo, hi = lo + (hi - lo) * a / n, lo + (hi - lo) * b / n
        return (lo, hi)

    n_sources = sources.count()
    ends = _measures(sources, [0.0, 1.0], budget)
    exponent = 1.0
    if target.entropy is not None and n_sources > 1:
        least = target.entropy * math.log(n_sources)
        if ends[1.0][0] < least:
            exponent = bisect(lambda m: m[0] >= least)[0]
    if target.repeats is not None and ends[0.0][1] > target.repeats:
        if ends[1.0][1] >= target.repeats:
            return 1.0
        exponent = max(exponent, bisect(lambda m: m[1] > target.repeats)[1])
    return exponent


def mixing_weights(docs: DataFrame, target: Target, budget: int | None, source_col: str, tokens_col: str) -> DataFrame:
    """``(source, tokens, weight, source_budget, passes, rest)``: weights sum to 1, budgets to the whole budget."""
    sources = written(docs.where(F.col(tokens_col) > 0).groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).alias("tokens")), "sources")
    top = sources.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("all")).first()
    if top["most"] is None:
        return sources.select("source", "tokens", *[F.lit(None).cast(t).alias(n) for n, t in (("weight", "double"), ("source_budget", "double"), ("passes", "long"), ("rest", "double"))])
    budget = budget if budget is not None else top["all"]
    sources = sources.withColumn("share", F.col("tokens") / F.lit(float(top["most"])))
    exponent = find_exponent(sources, target, float(budget))
    power = F.pow("share", F.lit(exponent))
    z = sources.agg(_sum(power)).first()[0]
    out = sources.withColumn("weight", power / F.lit(z)).withColumn("source_budget", F.col("weight") * F.lit(float(budget)))
    out = out.withColumn("passes", F.floor(F.col("source_budget") / F.col("tokens")))
    return out.withColumn("rest", F.col("source_budget") - F.col("passes") * F.col("tokens")).drop("share")


RESULTS = ("source", "n_tokens", "weight", "copy", "block", "block_rank", "shuffle_key")


def _planned(rows: DataFrame, parts: DataFrame, n_sources: int) -> DataFrame:
    """Rows with their source's part of the plan. The plan goes to every worker; beyond ``SENT_SOURCES`` sources that of the
    largest ones does, and only rows of the others meet it by source."""
    on = F.col("source").eqNullSafe(F.col("_s"))
    if n_sources <= SENT_SOURCES:
        return rows.join(F.broadcast(parts), on).drop("_s")
    large = parts.orderBy(F.desc("_n"), "_s").limit(SENT_SOURCES)
    marked = rows.join(F.broadcast(large), on, "left")
    known = F.col("_n").isNotNull()
    rest = marked.where(~known).select(*rows.columns).join(parts, on)
    return marked.where(known).unionByName(rest).drop("_s")


def mix(docs: DataFrame, target: Target = Target(), budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", tokens_col: str = "n_tokens", seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(id, source, n_tokens, weight, copy, block, block_rank, shuffle_key)``: a row for each time a document comes, with
    the other columns of ``docs`` behind them.

    A source's documents are dealt into blocks by a hash of the id. A pass goes over all blocks in an order of
    its own (``copy`` is the pass, ``block_rank`` the block's place in it; within a block ``shuffle_key``
    orders). A source gets as many whole passes as its budget holds, then the blocks of one more pass up to
    the rest; in the block where the rest ends, documents in order while they fit, so that no source exceeds
    its budget and none falls short of it by more than the next document.

    ``budget`` is in tokens, all tokens of the input if None. A null source is a source of its own; rows of no
    (or null) tokens are never drawn; rows of a null id all fall into one block. Repeated rows are rows of
    their own. Other columns come along, but for those named as a result. An empty table gives an empty table.
    """
    others = kept_names(docs, (id_col, source_col, tokens_col, *RESULTS))
    more = [F.struct(*quoted(others)).alias("_more")] if others else []
    rows = docs.select(quoted([id_col])[0], quoted([source_col])[0].alias("source"), quoted([tokens_col])[0].cast("long").alias("n_tokens"), *more).where(F.col("n_tokens") > 0)
    rows = written(rows, "mix-rows")
    plan = written(mixing_weights(rows, target, budget, "source", "n_tokens"), "mix-plan")
    n_blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / block_tokens))
    parts = plan.select(F.col("source").alias("_s"), "weight", "passes", "rest", n_blocks.alias("_n"))
    dealt = _planned(rows, parts, plan.count())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.col("_n"))).drop("_n")

    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("_tokens"), F.first("passes").alias("_pass"), F.first("rest").alias("_rest"))
    order = F.xxhash64(F.lit(seed), F.col("block"), F.col("_pass"))
    w = Window.partitionBy("source").orderBy(order, "block")
    last = blocks.withColumn("_to", F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("_tokens"))
    last = last.where(F.col("_from") < F.col("_rest")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_from", (F.col("_to") <= F.col("_rest")).alias("_whole"))

    key = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("copy"))
    full = dealt.where(F.col("passes") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    part = dealt.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b").withColumn("copy", F.col("passes"))
    inner = Window.partitionBy("source", "block").orderBy(key, id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    border = part.where(~F.col("_whole")).withColumn("_upto", F.col("_from") + F.sum("n_tokens").over(inner)).where(F.col("_upto") <= F.col("rest"))
    columns = [id_col, "source", "n_tokens", "weight", "copy", "block", *(["_more"] if others else [])]
    drawn = full.select(columns).unionByName(part.where("_whole").select(columns)).unionByName(border.select(columns))
    drawn = drawn.withColumns({"block_rank": F.xxhash64(F.lit(seed), F.col("block"), F.col("copy")), "shuffle_key": key})
    return drawn.select(*columns[:6], "block_rank", "shuffle_key", "_more.*") if others else drawn

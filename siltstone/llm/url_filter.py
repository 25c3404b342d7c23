"""URL filters: host rules, and for what they leave open a character language-model ratio.

URLs are folded to an alphabet of 36 symbols, so a table with the log-odds of every symbol behind every three
others has 36 ** 4 cells, whatever the input. It is computed once, smoothed over orders, and each URL is scored
by looking its symbols up within its own row: no join and no shuffle of URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.columns import kept_names, quoted, spare
from siltstone.llm.storage import written

#: A gram is a symbol behind ``ORDER - 1`` others.
ORDER = 4
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols: a letter of either case, any digit, these characters, what queries are made of, all else, both ends.
DIGIT, MARKS, QUERY, OTHER, EDGE, END, SYMBOLS = 26, {".": 27, "/": 28, "-": 29, "_": 30, "%": 31}, 32, 33, 34, 35, 36
#: What the final table is cut into, so that no task holds all of it before it is put together.
BLOCK = SYMBOLS**2


def symbol(character: str) -> int:
    if character.lower() in LETTERS and character.isascii():
        return LETTERS.index(character.lower())
    if character in "0123456789":
        return DIGIT
    return QUERY if character in "?=&#;+" else MARKS.get(character, OTHER)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(url: Column) -> Column:
    """The URL's grams, one for each character and one for its end, as numbers of ``ORDER`` digits to base ``SYMBOLS``."""
    characters = F.filter(F.split(F.coalesce(url.cast("string"), F.lit("")), ""), lambda c: c != "")
    table = F.array(*[F.lit(symbol(chr(i))) for i in range(128)])
    codes = F.transform(characters, lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(OTHER)))
    padded = F.concat(F.array(*[F.lit(EDGE)] * (ORDER - 1)), codes, F.array(F.lit(END)))

    def of(p: Column) -> Column:
        gram = lambda i: sum((F.get(p, i + k) * SYMBOLS ** (ORDER - 1 - k) for k in range(ORDER)), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.size(p) - ORDER), gram)

    return F.element_at(F.transform(F.array(padded), of), 1)


def fold(url: Column) -> Column:
    """0 or 1, by the URL itself, so that equal URLs are never on both sides of a calibration."""
    return F.crc32(F.coalesce(url.cast("string"), F.lit("")).cast("binary")) % 2


#: Models: of all taught URLs, and of those outside each fold.
MODELS = ("all", "0", "1")
_COUNTS = [f"{c}_{m}" for c in ("allow", "block") for m in MODELS]


def gram_counts(taught: DataFrame) -> DataFrame:
    """``(g, allow_all, ..., block_1)`` of ``(verdict, fold, grams)``: at most ``SYMBOLS ** ORDER`` rows, combined where the URLs are read."""
    each = taught.select("verdict", "fold", F.explode("grams").alias("g"))
    n = {f"{c}_{m}": (F.col("verdict") == c) & (F.lit(True) if m == "all" else F.col("fold") != int(m)) for c in ("allow", "block") for m in MODELS}
    return each.groupBy("g").agg(*[F.count_if(test).alias(name) for name, test in n.items()])


def smoothed(counts: DataFrame) -> DataFrame:
    """``(g, q_allow_all, ..., q_block_1)`` for every possible gram: Witten-Bell probabilities of its last symbol.

    A context seen n times with t distinct symbols behind it gives ``t / (n + t)`` to the order below, one not
    seen gives all; below the first order all symbols are alike.
    """
    spark, below = counts.sparkSession, None
    for size in range(1, ORDER + 1):
        own = counts.groupBy((F.col("g") % SYMBOLS**size).alias("g")).agg(*[F.sum(c).alias(c) for c in _COUNTS])
        contexts = own.groupBy(F.expr(f"g div {SYMBOLS}").alias("h")).agg(*[F.sum(c).alias(f"n_{c}") for c in _COUNTS], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in _COUNTS])
        cells = spark.range(SYMBOLS**size).select(F.col("id").alias("g"), F.expr(f"id div {SYMBOLS}").alias("h"), (F.col("id") % SYMBOLS ** (size - 1)).alias("s"))
        cells = cells.join(own, "g", "left").join(contexts, "h", "left")
        if below is None:
            cells = cells.select("*", *[F.lit(1 / SYMBOLS).alias(f"p_{c}") for c in _COUNTS])
        else:
            cells = cells.join(below.select(F.col("g").alias("s"), *[F.col(f"q_{c}").alias(f"p_{c}") for c in _COUNTS]), "s")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        q = lambda c: F.when(zero(f"n_{c}") == 0, F.col(f"p_{c}")).otherwise((zero(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
        below = written(cells.select("g", *[q(c).alias(f"q_{c}") for c in _COUNTS]), f"url-order-{size}")
    return below


def ratio_tables(probabilities: DataFrame) -> DataFrame:
    """One row: for each model, the log-odds of all grams as arrays of blocks, ``SYMBOLS ** ORDER`` numbers in all."""
    ratio = [(F.log(f"q_allow_{m}") - F.log(f"q_block_{m}")).cast("float").alias(m) for m in MODELS]
    sorted_ = lambda key: F.sort_array(F.collect_list(F.struct(key, *MODELS)))
    blocks = probabilities.select("g", *ratio).groupBy(F.expr(f"g div {BLOCK}").alias("b")).agg(sorted_("g").alias("x"))
    blocks = blocks.select("b", *[F.col("x")[m].alias(m) for m in MODELS])
    return blocks.agg(sorted_("b").alias("x")).select(*[F.col("x")[m].alias(m) for m in MODELS])


def looked_up(table: str, g: Column) -> Column:
    return F.get(F.get(F.col(table), F.floor(g / BLOCK).cast("int")), g % BLOCK)


def score(grams_: str, ratio) -> Column:
    """Mean of ``ratio(g)`` over the grams. The column is named once, so that the optimizer can put grams and tables in its place
    and no row has to hold a table."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda s, g: F.struct((s["sum"] + ratio(g)).alias("sum"), (s["n"] + 1).alias("n"))
    return F.aggregate(grams_, start, step, lambda s: s["sum"] / s["n"])


def calibrated_threshold(scored: DataFrame) -> float:
    """The cut between blocked (below) and accepted with the best balanced accuracy on ``(verdict, llr)``, from a 200-step histogram."""
    span = scored.agg(F.min("llr").alias("lo"), F.max("llr").alias("hi")).first()
    if span["lo"] is None or span["lo"] == span["hi"]:
        return 0.0
    step = (span["hi"] - span["lo"]) / 200
    bins = scored.groupBy(F.floor((F.col("llr") - span["lo"]) / step).alias("bin")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("b"))
    rows = sorted((r["bin"], r["a"], r["b"]) for r in bins.collect())  # 201 at most
    n_allow, n_block = max(1, sum(r[1] for r in rows)), max(1, sum(r[2] for r in rows))
    best, cut, allow_below, block_below = -1.0, 0.0, 0, 0
    for bin_, a, b in rows:
        allow_below, block_below = allow_below + a, block_below + b
        if (accuracy := block_below / n_block - allow_below / n_allow) > best:
            best, cut = accuracy, span["lo"] + (bin_ + 1) * step
    return cut


RESULTS = ("host", "path", "rule", "llr", "verdict")


def url_filter(pages: DataFrame, rules: list[UrlRule], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, llr, verdict``; equal names are replaced, all other columns stay.

    A rule fits its host and all subdomains of it where the path starts with the rule's; the longest that
    fits decides. URLs that a rule decides teach the two models, all of them, each as often as it stands
    there; the others are blocked where the length-normalised log-likelihood ratio ``llr`` is under the cut.
    The cut is calibrated on the taught URLs, each scored by a model of the other half of them. A symbol that
    no taught URL has counts with the weight that the models give to the unseen. Without URLs of both
    verdicts to learn from, ``llr`` is null and the others are allowed. Null and empty URLs have an empty host
    and path and are judged by their end alone. Repeated rows get equal verdicts; an empty table stays empty.
    """
    names = kept_names(pages, RESULTS)
    judged_, grams_, table_ = spare(pages, "judged", "grams", "table")
    url = quoted([url_col])[0]
    host, path = split_url(url)
    rule, verdict = matching_rule(F.col(f"{judged_}.host"), F.col(f"{judged_}.path"), rules)
    ruled = pages.select(*quoted(names), F.struct(host.alias("host"), path.alias("path"), url.cast("string").alias("url")).alias(judged_))
    own = ruled.select(rule.alias("rule"), verdict.alias("verdict"), F.col(judged_)["url"].alias("url"))
    taught = own.where(F.col("verdict").isNotNull()).select("verdict", fold(F.col("url")).alias("fold"), grams(F.col("url")).alias("grams"))
    counts = written(gram_counts(taught), "url-grams")
    seen = counts.agg(F.coalesce(F.sum("allow_all"), F.lit(0)).alias("a"), F.coalesce(F.sum("block_all"), F.lit(0)).alias("b")).first()
    out = [*quoted(names), F.col(judged_)["host"].alias("host"), F.col(judged_)["path"].alias("path"), rule.alias("rule")]
    if not (seen["a"] and seen["b"]):
        return ruled.select(*out, F.lit(None).cast("double").alias("llr"), F.coalesce(verdict, F.lit("allow")).alias("verdict"))
    tables = written(ratio_tables(smoothed(counts)), "url-model")
    # The table is a scalar that the optimizer puts into the expression that reads it, so no row carries it.
    of = {m: tables.select(m).scalar().alias(f"{table_}{m}") for m in MODELS}
    by_fold = score("grams", lambda g: F.when(F.col("fold") == 0, looked_up(f"{table_}0", g)).otherwise(looked_up(f"{table_}1", g)))
    held_out = taught.select("verdict", "fold", "grams", of["0"], of["1"]).select("verdict", by_fold.alias("llr"))
    cut = calibrated_threshold(written(held_out, "url-held-out"))
    scored = ruled.select("*", grams(F.col(judged_)["url"]).alias(grams_), of["all"])
    scored = scored.select(*quoted(names), judged_, score(grams_, lambda g: looked_up(f"{table_}all", g)).alias("llr"))
    return scored.select(*out, "llr", F.coalesce(verdict, F.when(F.col("llr") < cut, "block").otherwise("allow")).alias("verdict"))

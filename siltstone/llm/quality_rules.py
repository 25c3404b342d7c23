"""Quality rules as a short-circuit cascade of native expressions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.columns import kept_names, quoted, spare

BLANK = r"[\x20\x09-\x0D]+"
#: The sample that orders the rules: so many rows, of texts no longer than this (others are judged like all, but not timed).
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 18


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` is true; null counts as false."""

    name: str
    fails: Column


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(words_: Column, n: int = 3) -> Column:
    """How many words lie in an ``n``-word window that stands twice or more in the array.

    Windows are compared by 64-bit hashes. They are sorted with their positions, so equal ones are neighbours; the
    positions found, sorted, cover ``min(n, distance to the next)`` words each. O(length * log length) within the row.
    """

    def positions(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
        inner = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(inner, lambda j: F.get(s, j)["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1), x + n) - x))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("g"), i.alias("p"))))

    found = _let(words_, lambda w: F.when(F.size(w) > n, _let(_let(windows(w), positions), covered)))
    return F.coalesce(found, F.lit(0).cast("long"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def most_frequent(words_: Column) -> Column:
    """How often the most frequent word stands in the array: the longest run of the sorted words."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["word"] == w, s["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.sort_array(words_), start, step, lambda s: s["most"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long); equal names are replaced.

    Words are runs of anything but ASCII white space; a null or empty text has none. ``n_dup_lines`` counts
    the lines with a word that equal an earlier line of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words_, lines_ = spare(docs, "words", "lines")
    split = docs.withColumns({words_: words(text), lines_: lines_with_words(text)})
    return split.select(
        *quoted(kept_names(docs, MEASURES)),
        F.size(words_).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words_)).alias("n_repeat_words"),
    )


def base_rule() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Beyond the base: each catches junk that hardly any prose has. Costs go from a look at the measures to a sort of all words."""
    # a look for what the costly test needs at least comes before it
    has = lambda *marks: F.lit(False) if not marks else F.contains(text, F.lit(marks[0])) | has(*marks[1:])
    of_lines = lambda pattern, least, share: _let(lines_with_words(text), lambda ls: (F.size(ls) >= least) & (F.size(F.filter(ls, lambda x: x.rlike(pattern))) * 10 > F.size(ls) * share))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words_ = F.col("n_words")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > words_),
        Rule("word_length", (F.col("word_chars") < 2 * words_) | (F.col("word_chars") > 20 * words_)),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.regexp_count(text, F.lit("\n")) + 1)),
        Rule("shouting", F.regexp_count(text, F.lit("!")) * 10 > words_),
        Rule("capitals", F.regexp_count(text, F.lit("[A-Z]")) * 2 > F.col("word_chars")),
        Rule("bullets", has("- ", "* ", "• ") & of_lines(r"^[ \t]*[-*•] ", 5, 9)),
        Rule("ellipses", has("...", "…") & of_lines(r"(?:\.\.\.|…)[ \t]*$", 5, 5)),
        Rule("one_word", _let(words(text), lambda w: (F.size(F.array_distinct(w)) * 5 <= words_ * 3 + 5) & (most_frequent(w) * 5 > words_ * 2))),
        Rule("no_letters", F.regexp_count(text, F.lit(r"\p{L}")) * 2 < F.col("word_chars")),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, text_col: str | None = None) -> DataFrame:
    """At most ``rows`` rows from all over the table, for estimates; the share that is drawn follows from the table's count, so few rows more are moved.

    With ``text_col``, rows of very long texts are passed over, so the sample's bytes are bounded as well.
    """
    share = min(1.0, 2 * rows / max(1, docs.count()))
    drawn = docs.sample(fraction=share, seed=11) if share < 1 else docs
    if text_col:
        drawn = drawn.where(F.coalesce(F.octet_length(quoted([text_col])[0].cast("string")), F.lit(0)) <= SAMPLE_BYTES)
    return drawn.limit(rows)


def ordered_rules(sample: DataFrame, rules: list[Rule], repeats: int = 50) -> list[Rule]:
    """The rules by rejected share per second of work, both estimated on the sample.

    A rule is timed on ``repeats`` copies of each row, less the time that the copies alone take. Only the
    order, and so the work, depends on the estimates; the verdicts do not.
    """
    sample = sample.cache()
    try:
        n = max(1, sample.count()) * repeats
        (copy,) = spare(sample, "copy")
        copies = sample.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def timed(test: Column) -> tuple[float, int]:
            began = time.perf_counter()
            rejected = copies.agg(F.coalesce(F.sum(F.when(test & (F.col(copy) > 0), 1)), F.lit(0))).first()[0]
            return time.perf_counter() - began, rejected

        timed(F.lit(True))
        idle, _ = timed(F.lit(True))
        rates = []
        for rule in rules:
            seconds, rejected = timed(rule.fails)
            rates.append((rejected / n + 1e-9) / max(seconds - idle, 1e-4))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(zip(rates, rules, strict=True), key=lambda x: -x[0])]


def quality_cascade(docs: DataFrame, rules: list[Rule], first: Rule | None = None, sample: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``failed_rule``: the first rule in the cascade's order that a row fails, else null.

    ``first``, if given, goes before the others. A later rule isn't evaluated for a row that has failed.
    ``sample`` has the columns that the rules read; without it, one is taken from ``docs``. A row is kept where
    ``failed_rule`` is null, which doesn't depend on the order. An empty table stays empty.
    """
    order = ([first] if first else []) + ordered_rules(sampled(docs) if sample is None else sample, rules)
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return docs.select(*quoted(kept_names(docs, ["failed_rule"])), verdict.alias("failed_rule"))


RESULTS = (*MEASURES, "failed_rule", "base_failed", "kept")


def quality_rules(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the measures, ``failed_rule`` (string) and ``base_failed, kept`` (boolean).

    Columns of equal names are replaced, all others stay, whatever their names. A null or empty text has no
    words, so it fails the base. Rows are judged by their texts alone; repeated rows get equal verdicts. An
    empty table stays empty. ``failed_rule`` names the first failure in the cascade's order, which depends on
    timings and so may differ between runs where a row fails several rules; ``kept`` doesn't.
    """
    sample = measured(sampled(docs, sample_rows, text_col), text_col)
    out = quality_cascade(measured(docs, text_col), default_rules(text_col), Rule("base", base_rule()), sample)
    return out.select(*quoted(kept_names(out, ["base_failed", "kept"])), F.coalesce(base_rule(), F.lit(False)).alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))

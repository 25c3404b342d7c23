"""Line-level search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions.patterns import line_pattern
from siltstone.functions.text import lines
from siltstone.operators.listing import scoped

MAX_TEXT, MAX_LIMIT, MAX_CONTEXT = 400, 10_000, 10


def _candidates(files: DataFrame, needle: str, regex: bool, word: bool, ignore_case: bool) -> DataFrame:
    """Files that can have a match at all: for a plain literal, a substring test before any line is split."""
    if regex or word or "\n" in needle:
        return files
    return files.where(F.contains(F.lower("text"), F.lit(needle.lower())) if ignore_case else F.contains("text", F.lit(needle)))


def grep(files: DataFrame, needle: str, *, regex: bool = False, word: bool = False, ignore_case: bool = False, glob: str | None = None, scope: str | None = None, exclude: tuple[str, ...] = (), context: int = 0, limit: int | None = None, max_text: int | None = MAX_TEXT, ordered: bool = True) -> DataFrame:
    """``(path, line, text)`` of matching lines, and with ``context`` the lines around as ``before, after``.

    Texts are cut to ``max_text`` characters for display; None keeps them whole, for what judges them.
    Order is by path and line. ``limit`` keeps the first matches in that order, as a bounded top-k; with ``ordered`` false
    any matches, and reading ends once there are enough.
    """
    own = _candidates(scoped(files, glob, scope, exclude), needle, regex, word, ignore_case)
    split = own.select("path", lines(F.col("text")).alias("_all"))
    plain = not (regex or word or ignore_case)
    test = lambda text: F.contains(text, F.lit(needle)) if plain else text.rlike(line_pattern(needle, regex, word, ignore_case))
    cut = lambda c: F.substring(c, 1, max_text) if max_text else c
    if context:
        # hits are found and cut out within the row, so that no line carries all others along
        n = min(max(context, 0), MAX_CONTEXT)

        def hits(all_: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: test(F.get(all_, i)))
            around = lambda i, first, size: F.transform(F.slice(all_, first, size), cut)
            begin = lambda i: F.greatest(i - n, F.lit(0))
            return F.transform(places, lambda i: F.struct((i + 1).alias("line"), cut(F.get(all_, i)).alias("text"), around(i, begin(i) + 1, i - begin(i)).alias("before"), around(i, i + 2, F.lit(n)).alias("after")))

        found = split.where(F.size("_all") > 0).select("path", F.inline(hits(F.col("_all"))))
    else:
        each = split.select("path", F.posexplode("_all").alias("pos", "text"))
        found = each.where(test(F.col("text"))).select("path", (F.col("pos") + 1).alias("line"), cut(F.col("text")).alias("text"))
    if limit is None:
        return found
    return (found.orderBy("path", "line") if ordered else found).limit(clamped(limit))


def clamped(limit: int) -> int:
    return min(max(limit, 1), MAX_LIMIT)


def grep_page(files: DataFrame, needle: str, limit: int = 200, **options) -> DataFrame:
    """The first matches with ``truncated``, which says that the limit was reached."""
    found = grep(files, needle, limit=limit, **options)
    return found.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) >= clamped(limit))  # MAX_LIMIT rows at most


def files_with_matches(files: DataFrame, needle: str, **options) -> DataFrame:
    return grep(files, needle, **options).select("path").distinct()


def match_counts(files: DataFrame, needle: str, *, regex: bool = False, word: bool = False, ignore_case: bool = False, glob: str | None = None, scope: str | None = None) -> DataFrame:
    """In one pass: files that pass the prefilter, files that match, and matching lines."""
    scanned = _candidates(scoped(files, glob, scope), needle, regex, word, ignore_case)
    pattern = line_pattern(needle, regex, word, ignore_case)
    n = F.size(F.filter(lines(F.col("text")), lambda x: x.rlike(pattern)))
    return scanned.select(n.alias("n")).agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("n") > 0).alias("matched_files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"))


def cooccurring_words(files: DataFrame, words: list[str], least: int = 2) -> DataFrame:
    """Lines with several of the words, two points for three or more."""
    each = files.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "text"))
    n = sum((F.contains(F.lower("text"), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return each.select("path", (F.col("pos") + 1).alias("line"), n.alias("n_words")).where(F.col("n_words") >= least).withColumn("points", F.when(F.col("n_words") >= 3, 2).otherwise(1))


def enclosing_symbols(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(path, line, text, symbol)``: each match with the symbol around it that begins last (of those that begin at one
    line, the last by name); ``symbols`` has ``path, name, line, end_line``, and one without an end goes on to the file's.

    A sweep over the beginnings and matches of a file in order of lines, with the open symbols on a stack: work in
    proportion to both, and no more memory than symbols are nested. Matches of null path have none.
    """
    kept = T.StructType([matches.schema[c] for c in ("path", "line", "text")])
    begins = symbols.where(F.col("line").isNotNull()).select("path", F.col("line").cast("long").alias("at"), F.lit(0).alias("kind"), F.coalesce("end_line", F.lit(2**31 - 1)).cast("long").alias("end"), "name", F.lit(None).cast(kept).alias("match"))
    hits = matches.select("path", F.col("line").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("name"), F.struct("path", "line", "text").alias("match"))
    events = begins.unionByName(hits).repartition("path").sortWithinPartitions("path", "at", "kind", "name")
    schema = T.StructType([T.StructField("match", kept), T.StructField("symbol", T.StringType())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            found, at_rows = [], []
            for i, (path, at, kind, end, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "at", "kind", "end", "name")), strict=True)):
                if path is None or path != file:
                    file, open_ = path, []
                if kind == 0 and path is not None:
                    open_.append((end, name))
                elif kind == 1:
                    while open_ and open_[-1][0] < at:
                        open_.pop()
                    at_rows.append(i)
                    found.append(open_[-1][1] if open_ else None)
            yield pa.RecordBatch.from_arrays([batch.column("match").take(pa.array(at_rows, pa.int64())), pa.array(found, pa.string())], names=schema.names)

    return events.mapInArrow(sweep, schema).select("match.*", "symbol")


#: A line that defines a name: a keyword of some language before it, or an assignment behind it.
DEFINES = r"^\s*(?:[a-z]+\s+){0,3}(?:function|class|interface|type|enum|struct|trait|impl|def|fn|func|const|let|var|module|package)\b|^\s*[A-Za-z_$][\w$]*\s*(?::[^=]+)?=(?!=)"


def defines(line: Column) -> Column:
    return line.rlike(DEFINES)


def weighted_files(files: DataFrame, literals: list[str], identifiers: list[str], words: list[str], per_file: int = 3, limit: int = 14) -> DataFrame:
    """``(path, score, lines)``: a literal counts 3, an identifier 2 where the file's first line with it defines something
    and else 1; a line with two of the words counts 1, with three or more 2. The first lines are named."""
    each = files.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "t"))
    own = [(F.contains("t", F.lit(x)), F.lit(3)) for x in literals] + [(F.contains("t", F.lit(x)), F.when(defines(F.col("t")), 2).otherwise(1)) for x in identifiers]
    n = sum((F.contains(F.lower("t"), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    of_words = F.when(n >= 3, 2).when(n >= 2, 1)
    hits = [F.when(test, F.struct(F.lit(i).alias("token"), points.alias("points"))) for i, (test, points) in enumerate(own)]
    hits.append(F.when(of_words.isNotNull(), F.struct((F.lit(len(own)) + F.col("pos")).alias("token"), of_words.alias("points"))))
    found = each.select("path", "pos", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "pos", "h.*")
    first = found.groupBy("path", "token").agg(F.min(F.struct("pos", "points")).alias("f"))
    shown = F.transform(F.slice(F.sort_array(F.collect_set(F.col("f")["pos"])), 1, per_file), lambda p: p + 1)
    scored = first.groupBy("path").agg(F.sum(F.col("f")["points"]).cast("long").alias("score"), shown.alias("lines"))
    return scored.orderBy(F.desc("score"), "path").limit(limit)


def ranked_files(files: DataFrame, tokens: dict[str, int], per_file: int = 3, limit: int = 14) -> DataFrame:
    """Files by the weights of the tokens they hold, with their first matching lines."""
    weight = sum((F.when(F.contains("text", F.lit(t)), w).otherwise(0) for t, w in tokens.items()), F.lit(0))
    each = files.where(weight > 0).select("path", weight.alias("score"), F.posexplode(lines(F.col("text"))).alias("pos", "line_text"))
    hit = each.where(sum((F.contains("line_text", F.lit(t)).cast("int") for t in tokens), F.lit(0)) > 0)
    first = hit.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where(F.col("rank") <= per_file)
    by_file = first.groupBy("path", "score").agg(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("lines"))
    return by_file.orderBy(F.desc("score"), "path").limit(limit)

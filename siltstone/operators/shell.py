"""Text operators in the manner of a shell, on frames of ``(ord, line)``. They compose by ``DataFrame.transform``.

There is no command line to parse: a pipeline is Python, ``cat(...).transform(sort_lines).transform(uniq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.patterns import glob_regex, line_pattern
from siltstone.functions.text import lines
from siltstone.operators.grep import grep as grep_files
from siltstone.operators.listing import scoped, tree_level
from siltstone.sources.storage import written


def echo(spark, *words: str) -> DataFrame:
    return spark.createDataFrame([(1, " ".join(words))], "ord long, line string")


def cat(files: DataFrame, glob: str | None = None, scope: str | None = None) -> DataFrame:
    """Lines of the files in path order; ``ord`` is ``(path, line)``, so nothing is numbered globally."""
    own = scoped(files, glob, scope)
    return own.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "line")).select(F.struct("path", "pos").alias("ord"), "line")


def ls(files: DataFrame, scope: str = "") -> DataFrame:
    """Names in byte order, directories with a slash."""
    return tree_level(files, scope).select(F.when(F.col("kind") == "dir", F.concat("name", F.lit("/"))).otherwise(F.col("name")).alias("name")).orderBy("name")


def head(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy("ord").limit(n)


def tail(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("ord")).limit(n).orderBy("ord")


def wc(rows: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum(F.length("line") + 1), F.lit(0)).cast("long").alias("chars"))


def wc_files(files: DataFrame) -> DataFrame:
    all_ = lines(F.col("text"))
    return files.select("path", F.size(all_).cast("long").alias("lines"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


def grep(rows: DataFrame, needle: str, *, regex: bool = False, ignore_case: bool = False, word: bool = False, invert: bool = False) -> DataFrame:
    hit = F.col("line").rlike(line_pattern(needle, regex, word, ignore_case))
    return rows.where(~hit if invert else hit)


def ls_long(files: DataFrame, scope: str = "") -> DataFrame:
    """``(kind, size, name)``: directories with what lies below them, files with their bytes."""
    scope = scope.strip("/")
    own = files.where(F.col("path").startswith(f"{scope}/")) if scope else files
    rest = F.substring(F.col("path"), len(scope) + 2, 1 << 20) if scope else F.col("path")
    is_dir = F.contains("_rest", F.lit("/"))
    return own.select(rest.alias("_rest"), F.octet_length("text").cast("long").alias("_size")).groupBy(F.when(is_dir, "d").otherwise("-").alias("kind"), F.substring_index("_rest", "/", 1).alias("name")).agg(F.sum("_size").alias("size")).orderBy("name")


def grep_paths(files: DataFrame, needle: str, *, scope: str = "", show: str = "lines", **options) -> DataFrame:
    """Over paths: ``lines`` as ``path:line:text``, ``counts`` as ``path:n`` of files with a match, or the ``files`` alone."""
    found = grep_files(files, needle, scope=scope or None, **options)
    if show == "files":
        return found.select(F.col("path").alias("line")).distinct().orderBy("line")
    if show == "counts":
        counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        return counts.orderBy("path").select(F.concat_ws(":", "path", F.col("n").cast("string")).alias("line"))
    return found.orderBy("path", "line").select(F.concat_ws(":", "path", F.col("line").cast("string"), "text").alias("line"))


def sed_replace(rows: DataFrame, pattern: str, replacement: str, every: bool = True) -> DataFrame:
    """``s/pattern/replacement/`` on each line, with ``g`` as ``every``; ``&`` is the match."""
    java = replacement.replace("\\", r"\\").replace("$", r"\$").replace("&", "$0")
    if every:
        return rows.withColumn("line", F.regexp_replace("line", pattern, java))
    return rows.withColumn("line", F.regexp_replace("line", rf"(?s)^(.*?)(?:{pattern})", "$1" + java.replace("$0", "")))


def find(files: DataFrame, scope: str = "", name: str | None = None, kind: str | None = None) -> DataFrame:
    """Files and all directories above them, strictly below the scope, in byte order."""
    segments = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.struct(F.array_join(F.slice(segments, 1, i), "/").alias("path"), F.when(i == F.size(segments), "f").otherwise("d").alias("kind")))
    out = files.select(F.explode(up).alias("e")).select("e.*").distinct()
    if scope.strip("/"):
        out = out.where(F.col("path").startswith(f"{scope.strip('/')}/"))
    if name:
        out = out.where(F.substring_index("path", "/", -1).rlike(glob_regex(name)))
    return (out.where(F.col("kind") == kind) if kind else out).orderBy("path")


def _number(line: Column) -> Column:
    return F.coalesce(F.expr("try_cast(regexp_extract(line, '^\\\\s*([-+]?[0-9]*\\\\.?[0-9]+)', 1) AS double)"), F.lit(0.0))


def sort_lines(rows: DataFrame, *, numeric: bool = False, reverse: bool = False, unique: bool = False, locale: bool = False) -> DataFrame:
    """Byte order, or by number (unparsable counts as 0), or by the Unicode collation; ``ord`` becomes the sort key."""
    key = _number(F.col("line")) if numeric else F.expr("line COLLATE UNICODE") if locale else F.col("line")
    if unique:
        rows = rows.groupBy("line").agg(F.min("ord").alias("ord"))
    order = [F.desc(key), F.desc("ord")] if reverse else [F.asc(key), F.asc("ord")]
    return rows.orderBy(*order)


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ord")
    new = F.coalesce((F.col("line") != F.lag("line").over(w)).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*by, "_run", "line").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


def uniq(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs of equal neighbours, as ``(ord, line, n)``; with ``by``, separately in each group.

    Without it, rows are sorted into ranges and each range finds its own runs; only the first and last run of
    every range, which may go on in the next, meet in one task.
    """
    if by:
        return _runs(rows, by).select(*by, "ord", "line", "n")
    ranges = written(rows.repartitionByRange("ord").withColumn("_part", F.spark_partition_id()), "ranges")
    own = _runs(ranges, ["_part"])
    last = F.max("_run").over(Window.partitionBy("_part"))
    own = written(own.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last)), "runs")
    border = own.where("_edge")
    chain = Window.orderBy("_part", "_run")
    goes_on = (F.col("line") == F.lag("line").over(chain)) & (F.col("_part") != F.lag("_part").over(chain))
    joined = border.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(chain))
    joined = joined.groupBy("_chain", "line").agg(F.min("ord").alias("ord"), F.sum("n").alias("n"))
    return own.where("NOT _edge").select("ord", "line", "n").unionByName(joined.select("ord", "line", "n"))


def uniq_sorted(rows: DataFrame) -> DataFrame:
    """``sort | uniq -c`` without a global sort: equal lines are neighbours then, so counting is enough."""
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lpad(F.col("n").cast("string"), 7, " "), F.lit(" "), F.col("line")).alias("line"))


def sed_print(rows: DataFrame, first: int, last: int | None = None, to_end: bool = False, number: str = "line_no") -> DataFrame:
    """Lines ``first`` to ``last`` (one line without, the rest with ``to_end``) of rows with line numbers."""
    upper = F.lit(True) if to_end else F.col(number) <= (last or first)
    return rows.where((F.col(number) >= first) & upper)

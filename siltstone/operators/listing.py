"""Listing of a snapshot's files: ``files`` has at least ``path`` and, where content counts, ``text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import paths as P
from siltstone.functions.patterns import matches_glob, under
from siltstone.functions.text import line_count, lines


MOST_OUTLINED = 2000


def scoped(files: DataFrame, glob: str | None = None, scope: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    path = F.col("path")
    if scope:
        files = files.where(under(path, scope))
    if glob:
        files = files.where(matches_glob(path, glob))
    for pattern in exclude:
        files = files.where(~matches_glob(path, pattern))
    return files


def tree(files: DataFrame, glob: str | None = None, scope: str | None = None, sizes: bool = False) -> DataFrame:
    """Paths in byte order, with bytes, characters and logical lines if asked for."""
    extra = [F.octet_length("text").cast("long").alias("size"), F.length("text").cast("long").alias("chars"), line_count(F.col("text")).alias("lines")] if sizes else []
    return scoped(files, glob, scope).select("path", *extra).orderBy("path")


def tree_with_outlines(files: DataFrame, outline, most: int = 500, glob: str | None = None, scope: str | None = None) -> DataFrame:
    """``(path, n_symbols, symbols, truncated)`` of the first files in path order. ``outline`` makes symbols of files and sees
    only these; one path more is looked for, so ``truncated`` is exact."""
    most = min(max(most, 1), MOST_OUTLINED)
    first = scoped(files, glob, scope).select("path").orderBy("path").limit(most + 1)
    listed = first.withColumn("_n", F.row_number().over(Window.orderBy("path")))  # most + 1 rows
    listed = listed.withColumn("truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > most).where(F.col("_n") <= most).drop("_n")
    own = files.join(F.broadcast(listed.select("path")), "path", "left_semi")  # most paths
    named = outline(own).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "kind", "name"))).alias("symbols"))
    out = listed.join(named, "path", "left")
    return out.select("path", F.greatest(F.coalesce(F.size("symbols"), F.lit(0)), F.lit(0)).alias("n_symbols"), "symbols", "truncated").orderBy("path")


def tree_count(files: DataFrame, glob: str | None = None, scope: str | None = None) -> DataFrame:
    return scoped(files, glob, scope).agg(F.count(F.lit(1)).alias("n"))


def tree_level(files: DataFrame, scope: str = "") -> DataFrame:
    """One level: directories made up from what lies below, then files; each with the number of files in it."""
    scope = scope.strip("/")
    rest = F.substring(F.col("path"), len(scope) + 2, 1 << 20) if scope else F.col("path")
    below = files.where(F.col("path").startswith(f"{scope}/")) if scope else files
    below = below.select(rest.alias("rest"))
    kind = F.when(F.contains("rest", F.lit("/")), "dir").otherwise("file")
    return below.groupBy(kind.alias("kind"), F.substring_index("rest", "/", 1).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "name")


def read_many(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` has ``ord, path``; asked order and repeats stay, a missing path is an error row. Filtering to what is asked comes first."""
    found = files.join(wanted.select("path").distinct(), "path", "left_semi").select("path", "text")
    return wanted.join(found, "path", "left").select("ord", "path", F.octet_length("text").cast("long").alias("size"), F.when(F.col("text").isNull(), "not_found").alias("error")).orderBy("ord")


def stat(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("path", P.mime(F.col("path")).alias("mime"), F.octet_length("text").cast("long").alias("size"), line_count(F.col("text")).alias("lines"))


def path_kind(files: DataFrame, path: str) -> DataFrame:
    """file, dir or none."""
    is_file, is_dir = F.col("path") == path, F.col("path").startswith(f"{path.rstrip('/')}/")
    hit = files.where(is_file | is_dir).agg(F.max(is_file.cast("int")).alias("f"), F.max(is_dir.cast("int")).alias("d"))
    return hit.select(F.when(F.col("f") == 1, "file").when(F.col("d") == 1, "dir").otherwise("none").alias("kind"))


def suggest(files: DataFrame, path: str, limit: int = 5) -> DataFrame:
    """Paths like a missing one: same path 100, same base name 50, same parent (or the stem below a slash) 20."""
    base = path.rpartition("/")[2]
    folder = path.rpartition("/")[0]
    stem = base.rpartition(".")[0] or base
    near = P.parent(F.col("path")) == folder if folder else F.contains("path", F.lit(f"/{stem}"))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(F.col("path") == path, 100) + points(P.basename(F.col("path")) == base, 50) + points(near, 20)
    return files.select("path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.length("path"), "path").limit(limit)


def numbered_lines(files: DataFrame) -> DataFrame:
    """``(path, line, text)`` with lines from 1."""
    return files.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def line_slice(files: DataFrame, path: str, first: int, last: int, numbered: bool = False) -> DataFrame:
    """Lines ``first`` to ``last``, cut at the end of the file; numbered as ``N | line`` at even width if asked for."""
    if first < 1 or last < first:
        raise ValueError(f"bad line range {first}-{last}")
    own = files.where(F.col("path") == path).withColumn("_all", lines(F.col("text")))
    end = F.least(F.lit(last), F.size("_all"))
    part = own.withColumn("_end", end).select("path", "_end", F.posexplode(F.slice("_all", first, last - first + 1)).alias("pos", "text"))
    number = F.col("pos") + first
    shown = F.concat(F.lpad(number.cast("string"), F.length(F.col("_end").cast("string")), F.lit(" ")), F.lit(" | "), F.col("text")) if numbered else F.col("text")
    return part.select("path", number.alias("line"), shown.alias("text")).orderBy("line")


def attributes(files: DataFrame) -> DataFrame:
    path = F.col("path")
    flags: dict[str, Column] = {"extension": P.extension(path), "mime": P.mime(path), "language": P.language(path), "is_docs": P.is_docs(path), "is_test": P.is_test(path), "canonical": P.canonical_docs(path)}
    return files.select("path", *[c.alias(n) for n, c in flags.items()])


def admission(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    size = F.octet_length("text")
    reason = P.skip_reason(F.col("path"), size, *([max_bytes] if max_bytes else []))
    return files.groupBy(F.coalesce(reason, F.lit("keep")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))


def parsed_urls(pages: DataFrame) -> DataFrame:
    """Host, path, query and fragment by pattern, and how deep the path goes."""
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    path = part(r"^[a-z]+://[^/?#]*([^?#]*)")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return pages.select("page_id", part(r"^([a-z]+)://").alias("scheme"), part(r"^[a-z]+://([^/?#]*)").alias("host"), path.alias("path"), part(r"^[^?#]*\?([^#]*)").alias("query"), part(r"#(.*)$").alias("fragment"), F.size(segments).cast("long").alias("depth"))

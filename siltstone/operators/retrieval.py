"""Ranked retrieval: chunks, postings, BM25, vectors, rank fusion and diversity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions import paths as P
from siltstone.functions import values as V
from siltstone.functions.text import half_up, line_count, lines, term_counts, text_slices
from siltstone.operators.vectors import cosines

def windows(files: DataFrame) -> DataFrame:
    """``(path, start, end, kind)``: one chunk up to 60 lines, else 40-line windows every 30 lines."""
    n = line_count(F.col("text"))
    last = F.lit(1) + V.CHUNK_STRIDE * F.ceil((n - V.CHUNK_WINDOW) / V.CHUNK_STRIDE)
    starts = F.when(n <= V.CHUNK_LINES, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), last.cast("long"), F.lit(V.CHUNK_STRIDE).cast("long")))
    each = files.where(n > 0).select("path", n.alias("_n"), F.explode(starts).alias("start"))
    whole = F.col("_n") <= V.CHUNK_LINES
    end = F.when(whole, F.col("_n")).otherwise(F.least(F.col("start") + V.CHUNK_WINDOW - 1, F.col("_n")))
    return each.select("path", "start", end.alias("end"), F.when(whole, "file").otherwise("window").alias("kind"))


def _window_chunks(files: DataFrame) -> DataFrame:
    """``windows()`` with text, cut within the row, so that texts aren't joined and no window carries the whole file."""
    all_, n = F.col("_all"), F.size("_all")
    last = 1 + V.CHUNK_STRIDE * F.ceil((n - V.CHUNK_WINDOW) / V.CHUNK_STRIDE)
    whole = n <= V.CHUNK_LINES
    starts = F.when(whole, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), last.cast("int"), F.lit(V.CHUNK_STRIDE)))

    def window(start: Column) -> Column:
        end = F.when(whole, n).otherwise(F.least(start + V.CHUNK_WINDOW - 1, n))
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.array_join(F.slice(all_, start, end - start + 1), "\n").alias("body"))

    cut = files.select("path", lines(F.col("text")).alias("_all")).where(n > 0)
    each = cut.select("path", F.when(whole, "file").otherwise("window").alias("kind"), F.explode(F.transform(starts, window)).alias("w"))
    full = each.where(F.trim(F.translate(F.col("w")["body"], "\n\t", "  ")) != "")
    return full.select("path", F.col("w")["start"].alias("start"), F.col("w")["end"].alias("end"), "kind", F.lit(None).cast("string").alias("symbol"), F.concat_ws("\n", "path", F.col("w")["body"]).alias("text"))


def _regions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(path, start, end, kind, symbol)``: symbol spans, each up to where the next begins, and the gaps between.

    Files and symbols are read once: a span's row brings the gap before it, and the last one of a file that behind it.
    """
    n = files.select("path", line_count(F.col("text")).alias("_n")).where("_n > 0")
    w = Window.partitionBy("path").orderBy("start")
    spans = symbols.where(F.col("end_line").isNotNull()).groupBy("path", F.col("line").cast("long").alias("start")).agg(F.max(F.col("end_line").cast("long")).alias("end"), F.first("name").alias("symbol"))
    each = n.join(spans, "path", "left").withColumn("_next", F.lead("start").over(w)).withColumn("end", F.least("end", F.coalesce(F.col("_next") - 1, F.col("end"))))
    each = each.withColumn("_gap", F.coalesce(F.lag("end").over(w), F.lit(0).cast("long")) + 1)
    some, none = F.col("start").isNotNull(), F.lit(None).cast("string")

    def region(start: Column, end: Column, kind: Column, symbol: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), kind.alias("kind"), symbol.alias("symbol"))

    window = F.lit("window")
    file = F.when(~some & (F.col("_n") <= V.CHUNK_LINES), "file").otherwise(window)
    own = [
        F.when(some, region(F.col("start"), F.col("end"), F.lit("symbol"), F.col("symbol"))),
        F.when(some & (F.col("_gap") < F.col("start")), region(F.col("_gap"), F.col("start") - 1, window, none)),
        F.when(F.col("_next").isNull() & (F.coalesce("end", F.lit(0)) < F.col("_n")), region(F.coalesce("end", F.lit(0)) + 1, F.col("_n"), file, none)),
    ]
    return each.select("path", F.inline(F.array_compact(F.array(*own))))


def chunks(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Chunks with text. With an outline, each symbol's span is a chunk, and so are the gaps between; what is over 60
    lines is cut into windows, and a file of up to 60 lines without spans is one chunk.

    Blank bodies are dropped; the text begins with the path. It is whole: what a model takes is cut where it is embedded.
    """
    if symbols is None:
        return _window_chunks(files)
    else:
        regions = _regions(files, symbols)
        size = F.col("end") - F.col("start") + 1
        more = F.ceil((size - V.CHUNK_WINDOW) / V.CHUNK_STRIDE)
        offsets = F.when(size <= V.CHUNK_LINES, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (more * V.CHUNK_STRIDE).cast("long"), F.lit(V.CHUNK_STRIDE).cast("long")))
        each = regions.select("path", "kind", "symbol", F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(offsets).alias("_o"))
        start = F.col("_s") + F.col("_o")
        end = F.when(F.col("_e") - F.col("_s") < V.CHUNK_LINES, F.col("_e")).otherwise(F.least(F.col("_e"), start + V.CHUNK_WINDOW - 1))
        cut = each.select("path", start.alias("start"), end.alias("end"), "kind", "symbol")
    texts = files.select("path", lines(F.col("text")).alias("_all"))
    body = F.array_join(F.slice("_all", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    out = cut.join(texts, "path").withColumn("_body", body).where(F.trim(F.translate("_body", "\n\t", "  ")) != "")
    return out.select("path", "start", "end", "kind", "symbol", F.concat_ws("\n", "path", "symbol", "_body").alias("text"))


def postings(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, term, tf)``: terms are counted where a text is read, and only counts go over the network."""
    own = rows.select(F.col(id_col).alias("id"), text.cast("string").alias("_t"))
    schema = T.StructType([own.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            each = [term_counts(text or "") for text in batch.column(1).to_pylist()]
            at = pa.array([i for i, terms in enumerate(each) for _ in terms], pa.int64())
            term = pa.array([t for terms in each for t in terms], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), term, pa.array([n for terms in each for n in terms.values()], pa.int64())], names=schema.names)

    return own.mapInArrow(count, schema).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def dense(rows: DataFrame, query: list[float], id_col: str, vector_col: str = "embedding", eight_bit: bool = False) -> DataFrame:
    """``(id, score)``: cosine by brute force, on eight-bit rows if asked for."""
    return cosines(rows, query, id_col, vector_col, eight_bit)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def _ranked(scores: DataFrame, depth: int) -> DataFrame:
    """Ranks from 0 within the best ``depth``, so one task ranks ``depth`` rows and no more."""
    best = top_k(scores, depth)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def fused(dense_scores: DataFrame, lexical_scores: DataFrame, symbol_like: bool = False) -> DataFrame:
    """Reciprocal rank fusion of the best hundred of both lists; a symbol-like query leans on words."""
    w = (0.6, 1.4) if symbol_like else (1.0, 1.0)
    lists = [_ranked(s, V.RRF_DEPTH).select("id", (F.lit(x) / (V.RRF_K + F.col("rank"))).alias("part")) for s, x in zip((dense_scores, lexical_scores.where("score > 0")), w, strict=True)]
    return lists[0].unionByName(lists[1]).groupBy("id").agg(F.round(F.sum("part"), 8).alias("score"))


def boosted(hits: DataFrame, query_terms: list[str], docs_too: bool = True) -> DataFrame:
    """``hits`` has ``path, kind, symbol, score``."""
    path = F.col("path")
    factor = F.when(F.col("kind") == "symbol", V.SYMBOL_BOOST).otherwise(1.0) * F.when(P.is_test(path), V.TEST_BOOST).otherwise(1.0)
    named = F.lit(False)
    for term in query_terms:
        named = named | F.coalesce(F.contains(F.lower("symbol"), F.lit(term)), F.lit(False))
    factor = factor * F.when(named, V.SYMBOL_TERM_BOOST).otherwise(1.0)
    if docs_too:
        factor = factor * F.when(P.is_docs(path), V.DOCS_BOOST).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * factor)


def diverse_code(hits: DataFrame, per_file: int = 2, k: int = 10) -> DataFrame:
    """At most ``per_file`` hits a path, by score; planned as a group limit before the shuffle."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), "id")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_file).drop("_n").orderBy(F.desc("score"), "id").limit(k)


def diverse_docs(hits: DataFrame, per_file: int = 2, k: int = 10) -> DataFrame:
    """As above, and each 40-line region of a page counts once over all its translations.

    A file past its quota doesn't claim a region, so the rule is greedy: it runs over one page's hits. A page's
    best hit always stays, so the best ``k`` rows lie in the ``k`` pages of the best first hits.
    """

    def greedy(pdf):
        per, seen, keep = {}, set(), []
        for i, row in enumerate(pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples()):
            region = row.start // 40
            ok = per.get(row.path, 0) < per_file and region not in seen
            keep.append((row.Index, ok))
            if ok:
                per[row.path] = per.get(row.path, 0) + 1
                seen.add(region)
        return pdf.loc[[i for i, ok in keep if ok]]

    own = hits.withColumn("canonical", P.canonical_docs(F.col("path")))
    pages = own.groupBy("canonical").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("_first")).orderBy("_first").limit(k).select("canonical")
    best = own.join(F.broadcast(pages), "canonical", "left_semi").select(own.columns)
    return best.groupBy("canonical").applyInPandas(greedy, best.schema).orderBy(F.desc("score"), "id").limit(k)


def across_repos(hits: DataFrame, k: int, repo: str = "source") -> DataFrame:
    """Best hits over all repositories; with three or more of them each is capped at ``max(2, ceil(k / 2))`` and the overflow comes last."""
    w = Window.partitionBy(repo).orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # with three repositories or more each has a cap; the number of those with hits comes with the rows, as one row sent to them
    several = ranked.where("rank = 1").agg((F.count(F.lit(1)) >= 3).alias("_several")).withColumn("_one", F.lit(1))
    over = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(several), "_one")
    cap = F.when(F.col("_several"), max(2, math.ceil(k / 2))).otherwise(k)
    return over.withColumn("overflow", F.col("rank") > cap).drop("_one", "_several").orderBy("overflow", F.desc("score"), "id").limit(k)


def snippets(hits: DataFrame, files: DataFrame, n_lines: int = 10) -> DataFrame:
    """Adds the hit's first lines as ``n | line``; files are narrowed to the hits' first."""
    own = files.join(hits.select("path").distinct(), "path", "left_semi").select("path", lines(F.col("text")).alias("_all"))
    part = F.slice("_all", F.col("start").cast("int"), n_lines)
    shown = F.transform(part, lambda x, i: F.concat((i + F.col("start")).cast("string"), F.lit(" | "), x))
    return hits.join(own, "path", "left").withColumn("snippet", F.array_join(shown, "\n")).drop("_all")


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", half_up(F.col("score"), 5))

"""Judgement over candidates with a pluggable scorer: any function from a frame to a ``logit`` column.

The default scorer counts shared words, so results are deterministic and need no service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import line_count, lines, terms

Scorer = Callable[[Column], Column]

# fixed values: roles, and the rule that a path speaks for each of them
ROLE_RULES = [
    ("generated", r"(^|/)(dist|build|vendor|generated)/|lock(\.json|\.yaml)?$|\.lock$"),
    ("tests", r"(^|/)(tests?|__tests__|spec|fixtures?|bench)/|\.(test|spec)\.[a-z]+$"),
    ("ci", r"(^|/)\.(github|gitlab|circleci)/"),
    ("docs", r"(^|/)docs?/|\.(md|mdx|rst|adoc)$|(^|/)(LICENSE|CHANGELOG)"),
    ("examples", r"(^|/)examples?/"),
    ("types", r"\.d\.ts$|(^|/)types?/|\.proto$"),
    ("config", r"(^|/)config/|(package|tsconfig)\.json$|\.(toml|ya?ml|ini|env)$"),
    ("scripts", r"(^|/)scripts?/|\.sh$"),
    ("ui", r"(^|/)(components?|views?|pages?)/|\.(css|scss|vue|svelte|tsx|jsx)$"),
    ("api", r"(^|/)(api|routes?|handlers?)/"),
    ("util", r"(^|/)(utils?|helpers?|lib)/"),
    ("assets", r"\.(png|jpe?g|svg|gif|woff2?|ico)$"),
    ("data", r"(^|/)(data|migrations|seeds)/|\.(csv|sql|jsonl)$"),
    ("entrypoint", r"(^|/)(main|index|app|cli|server)\.[a-z]+$"),
]


def word_scorer(question: str) -> Scorer:
    """Two for each word of the question that the text has, less two."""
    wanted = sorted({w for w in question.lower().split() if len(w) > 2})

    def score(text: Column) -> Column:
        return sum((F.when(F.contains(F.lower(text), F.lit(w)), 2.0).otherwise(0.0) for w in wanted), F.lit(-2.0))

    return score


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def choice(rows: DataFrame, keys: list[str], logit: str = "logit") -> DataFrame:
    """Adds ``p``: softmax over the options of a question (the rows of equal keys)."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return rows.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def rerank(matches: DataFrame, scorer: Scorer, text_col: str = "text", most: int | None = None) -> DataFrame:
    """All matches by relevance, then path and line; of a short report the best ``most``, once all are scored."""
    ranked = matches.withColumn("relevance", F.round(probability(scorer(F.col(text_col))), 3)).orderBy(F.desc("relevance"), "path", "line")
    return ranked if most is None else ranked.limit(most)


def classify(rows: DataFrame, labels: dict[str, Scorer], id_col: str, text_col: str = "text") -> DataFrame:
    """The likeliest of 2 to 20 labels for each row, with its probability; other numbers of labels classify nothing."""
    if not 2 <= len(labels) <= 20:
        return rows.withColumns({"label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    logits = F.array(*[F.struct(s(F.col(text_col)).alias("logit"), F.lit(n).alias("label")) for n, s in labels.items()])
    best = F.array_max(F.col("_all"))
    total = F.aggregate("_all", F.lit(0.0), lambda t, x: t + F.exp(x["logit"] - best["logit"]))
    return rows.withColumn("_all", logits).withColumns({"label": best["label"], "confidence": 1 / total}).drop("_all")


def locate(files: DataFrame, scorer: Scorer, window: int = 150, per_window: int = 5) -> DataFrame:
    """Lines by ``P(window) * P(line in window)``, the best five of each window of the whole text."""
    each = files.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "text"))
    each = each.select("path", (F.col("pos") + 1).alias("line"), F.floor(F.col("pos") / window).alias("window"), "text").withColumn("logit", scorer(F.col("text")))
    inside = choice(each, ["path", "window"]).withColumnRenamed("p", "_in")
    of_window = choice(inside.groupBy("path", "window").agg(F.max("logit").alias("logit")), ["path"]).select("path", "window", F.col("p").alias("_w"))
    scored = inside.join(of_window, ["path", "window"]).withColumn("score", F.round(F.col("_w") * F.col("_in"), 6))
    best = F.row_number().over(Window.partitionBy("path", "window").orderBy(F.desc("score"), "line"))
    return scored.withColumn("_n", best).where(F.col("_n") <= per_window).select("path", "line", "score")


def roles(paths: DataFrame) -> DataFrame:
    """What a path is for, by the first rule that speaks for it; else the core."""
    out = F.lit("core")
    for role, pattern in reversed(ROLE_RULES):
        out = F.when(F.col("path").rlike(pattern), role).otherwise(out)
    return paths.select("path", out.alias("role"))


def verify(rows: DataFrame, claim: str, text_col: str = "text") -> DataFrame:
    """How far each row supports a claim, and a verdict of three."""
    support = F.round(probability(word_scorer(claim)(F.col(text_col))), 3)
    return rows.withColumn("support", support).withColumn("verdict", F.when(F.col("support") >= 0.8, "supports").when(F.col("support") >= 0.5, "partly").otherwise("unrelated"))


def path_hits(files: DataFrame, question: list[str], limit: int = 12) -> DataFrame:
    """Two for a term in the base name, one for one elsewhere in the path."""
    path, base = F.lower("path"), F.lower(F.substring_index("path", "/", -1))
    score = sum((F.when(F.contains(base, F.lit(t)), 2).when(F.contains(path, F.lit(t)), 1).otherwise(0) for t in question), F.lit(0))
    return files.select("path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.length("path"), "path").limit(limit)


def candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """``(path, via, score)`` of the union of several ``(path, score)`` frames: each path once, with the score of the first
    source that has it and the names of all that do."""
    out = None
    for i, (name, df) in enumerate(sources.items()):
        own = df.select("path", "score", F.lit(name).alias("via"), F.lit(i).alias("_at"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("via")), ",").alias("via"), F.min_by("score", F.struct("_at", -F.col("score"))).alias("score"))


def assembled(symbols: DataFrame, chunks: DataFrame, matches: DataFrame, per_file: int = 40, most: int = 255) -> DataFrame:
    """``(path, line, end, kind, text, priority, ord)``: what may answer a question, each place once.

    ``symbols`` has ``path, line, end_line, signature``, ``chunks`` ``path, start, end, kind, text``, ``matches``
    ``path, line, text``. A match on a symbol's line makes that symbol surer (priority 0) and goes, a symbol's
    chunk that begins where the symbol does goes. Symbols come first, the first ``per_file`` of a file, then
    chunks, then matches; ``most`` of them stay.
    """
    places = symbols.select("path", "line").distinct()
    hit = matches.join(places, ["path", "line"], "left_semi").select("path", "line", F.lit(True).alias("_hit")).distinct()
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    own = symbols.join(hit, ["path", "line"], "left").withColumn("_n", rank).where(F.col("_n") <= per_file)
    rows = own.select("path", "line", F.col("end_line").alias("end"), F.lit("symbol").alias("kind"), F.col("signature").alias("text"), F.when(F.col("_hit"), 0).otherwise(1).alias("priority"))
    begins = places.withColumnRenamed("line", "start")
    others = chunks.where("kind <> 'symbol'").unionByName(chunks.where("kind = 'symbol'").join(begins, ["path", "start"], "left_anti"))
    rows = rows.unionByName(others.select("path", F.col("start").alias("line"), "end", "kind", "text", F.lit(2).alias("priority")))
    lone = matches.join(places, ["path", "line"], "left_anti")
    rows = rows.unionByName(lone.select("path", "line", F.col("line").alias("end"), F.lit("match").alias("kind"), "text", F.lit(3).alias("priority")))
    return best_candidates(rows.withColumn("ord", F.struct("path", "line", "kind")), most)


def judged(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Candidates with ``p``, the softmax over all of them; there are few."""
    return choice(rows.withColumn("logit", scorer(F.col("text"))).withColumn("_q", F.lit(1)), ["_q"]).drop("_q", "logit")


def deepened(rows: DataFrame, files: DataFrame, scorer: Scorer, sure: float = 0.75, least: float = 0.3, most_files: int = 3, most_lines: int = 1200, read: float = 0.8) -> DataFrame:
    """``(path, line, end, kind, text, p, read)``: judged candidates, and where none is sure but some may be, with located lines
    of the best files as further ones, judged again. ``read`` marks what is sure enough to be read at once.

    Files over ``most_lines`` aren't looked into. ``rows`` are bounded (``assembled``), so one row with the best
    ``p`` decides on the driver.
    """
    first = judged(rows, scorer)
    top = first.agg(F.max("p")).first()[0]
    if top is not None and least <= top < sure:
        paths = first.groupBy("path").agg(F.max("p").alias("p")).orderBy(F.desc("p"), "path").limit(most_files).select("path")
        own = files.join(F.broadcast(paths), "path", "left_semi").where(line_count(F.col("text")) <= most_lines)
        known = first.where("kind <> 'file'").select("path", "line").distinct()
        each = own.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")
        new = locate(own, scorer).join(known, ["path", "line"], "left_anti").join(each, ["path", "line"])
        more = new.select("path", "line", F.col("line").alias("end"), F.lit("located").alias("kind"), "text")
        first = judged(first.select("path", "line", "end", "kind", "text").unionByName(more), scorer)
    return first.select("path", "line", "end", "kind", "text", "p", (F.col("p") >= read).alias("read"))


def reranked(hits: DataFrame, texts: DataFrame, scorer: Scorer, k: int = 10) -> DataFrame:
    """The best ``k`` of ``max(k, 30)`` hits by the scorer's relevance; ``hits`` has ``id, score``, ``texts`` ``id, text``."""
    best = hits.orderBy(F.desc("score"), "id").limit(max(k, 30))
    own = texts.join(F.broadcast(best.select("id", "score")), "id").withColumn("relevance", F.round(probability(scorer(F.col("text"))), 3))
    return own.select("id", "score", "relevance").orderBy(F.desc("relevance"), F.desc("score"), "id").limit(k)


def best_candidates(rows: DataFrame, most: int = 255) -> DataFrame:
    """The best rows by priority, in their first order; the global rank sees only what a top-k has left."""
    return rows.orderBy("priority", "ord").limit(most).orderBy("ord")


def prefix_table(files: DataFrame) -> DataFrame:
    """``(parent, name, path, kind, n)``: every entry of every directory, with the number of files in it or below."""
    parts = F.split("path", "/")
    entry = lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("parent"), F.get(parts, i - 1).alias("name"), F.array_join(F.slice(parts, 1, i), "/").alias("path"), F.when(i == F.size(parts), "file").otherwise("dir").alias("kind"))
    each = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), entry)).alias("e")).select("e.*")
    return each.groupBy("parent", "name", "path", "kind").agg(F.count(F.lit(1)).alias("n"))


# fixed values: paths that are judged at once, options of a choice, beam: entries taken of a directory, their least
# probability, directories kept open, levels, and files kept
SINGLE_PASS, MOST_OPTIONS, BEAM_WIDTH, BEAM_LEAST, BEAM_OPEN, BEAM_LEVELS, PATHS_KEPT = 220, 255, 4, 0.06, 6, 8, 10


def beam(entries: DataFrame, scorer: Scorer, width: int = BEAM_WIDTH, least: float = BEAM_LEAST, kept_open: int = BEAM_OPEN, levels: int = BEAM_LEVELS, keep: int = PATHS_KEPT, options: int = MOST_OPTIONS) -> DataFrame:
    """``(path, joint)``: files by joint probability down the directory tree.

    ``entries`` has ``parent, name, path, kind``. At each level the entries of every open directory are a choice of their own
    (directories first, ``options`` at most); the best ``width`` of each go on that have at least the probability
    ``least`` there, and the ``kept_open`` best directories of all stay open. A level is one job, which gives the
    driver ``width * kept_open`` rows at most; ties go by order of the listing, then by path.
    """
    spark, open_, leaves = entries.sparkSession, [("", 1.0)], []
    for _ in range(levels):
        up = spark.createDataFrame(open_, "parent string, _joint double")
        own = entries.join(F.broadcast(up), "parent")
        listed = own.withColumn("_n", F.row_number().over(Window.partitionBy("parent").orderBy("kind", "name"))).where(F.col("_n") <= options)
        judged_ = choice(listed.withColumn("logit", scorer(F.col("path"))), ["parent"])
        place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("p"), "_n"))
        taken = judged_.withColumn("_r", place).where((F.col("_r") <= width) & (F.col("p") >= least))
        rows = taken.select("path", "kind", (F.col("_joint") * F.col("p")).alias("joint")).collect()
        leaves += [(r["path"], r["joint"]) for r in rows if r["kind"] == "file"]
        open_ = sorted(((r["path"], r["joint"]) for r in rows if r["kind"] == "dir"), key=lambda d: (-d[1], d[0]))[:kept_open]
        if not open_:
            break
    best = sorted(leaves, key=lambda f: (-f[1], f[0]))[:keep]
    return spark.createDataFrame(best, "path string, joint double")


def path_stage(files: DataFrame, scorer: Scorer, single_pass: int = SINGLE_PASS, keep: int = PATHS_KEPT) -> DataFrame:
    """``(path, joint)``: the files whose paths answer best. Up to ``single_pass`` paths are one choice; more are searched by
    ``beam``. The prefix table tells which, before a path is judged."""
    table = prefix_table(files)
    total = table.where("parent = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > single_pass:
        return beam(table, scorer, keep=keep)
    one = files.select("path", F.lit(1).alias("_q"), scorer(F.col("path")).alias("logit"))
    return choice(one, ["_q"]).select("path", F.col("p").alias("joint")).orderBy(F.desc("joint"), "path").limit(keep)


def term_overlap(text: Column, question: list[str]) -> Column:
    return F.size(F.array_intersect(terms(text), F.array(*[F.lit(t) for t in question])))

"""The operators with production parameters over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.embedding_dedup import near_vectors
from siltstone.llm.filter_audit import filter_audit, marked, repetitive, short, shouting
from siltstone.llm.importance import resampled
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.jaccard_join import jaccard_components
from siltstone.llm.license_scan import license_scan
from siltstone.llm.mixing import Target, count_words, mix
from siltstone.llm.quality_classifier import fit_quality, quality_scores
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.suffix_dedup import suffix_dedup
from siltstone.llm.token_counts import token_counts
from siltstone.llm.url_filter import UrlRule, url_filter
from siltstone.sources.storage import spread

MAX_TOKENS = 4096
KEEP_SCORE = 0.3
URL_RULES = [UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]
MIX = Target(entropy=0.95, repeats=4.0)
#: At most so many rows go to a Python worker at once.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in ("documents", "pages") else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, numerator=90, denominator=100)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    out = decontaminate(documents.select("doc_id", "text"), benchmark, window=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit_quality(documents, labels.where(~held_out()))
    scored = quality_scores(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= KEEP_SCORE, 1).otherwise(0).alias("predicted"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("n_tokens"))
    return mix(documents, MIX)


#: Failure conditions by letter; E, the copies, is the audit's own.
AUDITED = {"A": short(200), "B": repetitive(50), "C": shouting(3), "D": marked("#$%&*|")}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return filter_audit(documents, labels, AUDITED, copies="E", part_col="lang")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resampled(documents, benchmark, percent=5, min_words=20)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95, recall=0.99)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filters": op9_url_filters,
    "op10_source_mixing": op10_source_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_dedup": op13_embedding_dedup,
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        overlap AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM overlap JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id
            WHERE 100 * k >= 90 * (s.n + t.n - k)),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.y) AS component_id
        FROM documents d JOIN reach r ON d.doc_id = r.x LEFT JOIN sizes ON d.doc_id = sizes.doc_id
        GROUP BY d.doc_id""",
    "op2_decontamination": f"""
        WITH item_words AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
        cut AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size,
                   array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS key
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
        doc_words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
        doc_cut AS (
            SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS key
            FROM (SELECT d.*, s.size, unnest(range(1, len(w) - s.size + 2)) AS i
                  FROM doc_words d CROSS JOIN (SELECT DISTINCT size FROM cut) s)),
        found AS (SELECT doc_id, i, size, item_id FROM doc_cut JOIN cut USING (size, key)),
        hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_quality_rules": r"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        grams AS (
            SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
        again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
        often AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM split) GROUP BY ALL) GROUP BY doc_id),
        m AS (
            SELECT doc_id, t, lines, coalesce(most, 0) AS most, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN often USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
                    OR n_symbols * 10 > n_words
                    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                    OR (n_dup_lines >= 3 AND 2 * n_dup_lines > len(regexp_extract_all(t, chr(10))) + 1)
                    OR len(regexp_extract_all(t, '!')) * 10 > n_words
                    OR (len(lines) >= 5 AND len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•] '))) * 10 > len(lines) * 9)
                    OR (len(lines) >= 5 AND len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[ \t]*$'))) * 10 > len(lines) * 5)
                    OR most * 5 > n_words * 2
                    OR len(regexp_extract_all(t, '[A-Z]')) * 2 > word_chars
                    OR len(regexp_extract_all(t, '\pL')) * 2 < word_chars) AS kept
        FROM m""",
    "op5_suffix_dedup": """
        WITH raw AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (
            SELECT doc_id, s, md5(substring(h, 2 * s + 1, 200)) AS k
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM raw)),
        again AS (SELECT doc_id, s FROM starts QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
        bytes AS (
            SELECT b.doc_id, b.p, b.x,
                   max(a.s) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
            FROM (SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS x
                  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM raw)) b
            LEFT JOIN again a ON a.doc_id = b.doc_id AND a.s = b.p),
        turned AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS turn FROM bytes),
        cut AS (
            SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE turn) AS n_spans,
                   string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept
            FROM turned GROUP BY doc_id)
        SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM raw LEFT JOIN cut USING (doc_id)""",
    "op6_line_dedup": r"""
        WITH pieces AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents),
        keyed AS (
            SELECT doc_id, i, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM pieces),
        repeated AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT k.doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN repeated r ON k.key = r.key
        GROUP BY k.doc_id""",
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        f AS (
            SELECT doc_id, part,
                   CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
            FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (
            SELECT filter_order, step, substring(filter_order, step, 1) AS own, substring(filter_order, 1, step - 1) AS earlier
            FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
        r AS (
            SELECT part, filter_order, step, own,
                   CAST(coalesce(sum(n) FILTER (WHERE alive AND NOT failing), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (WHERE alive AND failing), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (WHERE NOT alive AND failing), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (WHERE alive AND failing), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(toxic) FILTER (WHERE alive AND failing), 0) AS BIGINT) AS toxic_lost
            FROM (SELECT *, translate(fails, earlier, '') = fails AS alive, contains(fails, own) AS failing FROM c, s) GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
    "op12_importance_resampling": rf"""
        WITH RECURSIVE steps(i, c, k) AS (
            SELECT i, i, 0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
            UNION ALL
            SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
        texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
        split AS (SELECT side, id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM texts),
        runs AS (
            SELECT side, id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS f
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS k))),
        hashed AS (
            SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda p: CAST('0x' || substring(h, p, 2) AS BIGINT))),
                          lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM runs), crc),
        counts AS (SELECT side, id, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
        sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM counts GROUP BY bucket),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE))) AS BIGINT) AS gain
            FROM sums),
        weighed AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM counts JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
        scored AS (
            SELECT id AS doc_id, len(w) >= 20 AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
            FROM split LEFT JOIN weighed USING (id) WHERE side = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE fit) THEN place END AS rank
        FROM ranked""",
    "op13_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION
            SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN n ON x = vec_id""",
}

"""Each stage of the pipeline against a brute-force version on its own input."""

import os
import sys
from collections import Counter

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402
from siltstone.llm.queries import KEEP_SCORE, MIX, held_out  # noqa: E402
from siltstone.llm.quality_classifier import fit_quality, quality_scores  # noqa: E402

DATA = "/root/testdata/sf0.001"


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    quality, lines, near, leaks, mixing = (f for _, f in corpus_pipeline.STAGES)

    kept = quality(spark, docs, DATA).cache()
    model = fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(~held_out()))
    want = quality_scores(docs, model).where(F.col("score") >= KEEP_SCORE)
    assert sorted(pairs(kept)) == sorted(pairs(want)) and kept.columns == columns
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()

    clean = lines(spark, kept, DATA).cache()
    assert sorted(pairs(clean)) == sorted((d, t) for d, _, _, t in H.line_drop(pairs(kept), 10))
    assert clean.columns == columns and clean.where("n_chars <> length(text)").count() == 0

    single = near(spark, clean, DATA).cache()
    assert sorted(single.select("doc_id").toPandas()["doc_id"]) == sorted(d for d, _, c in H.jaccard(pairs(clean), 5, 80, 100) if d == c)

    free = leaks(spark, single, DATA).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(r[0] for r in pairs(free)) == sorted(d for d, _, hit, _ in H.leaks(pairs(single), items) if not hit)

    mixed = mixing(spark, free, DATA)
    assert set(r.doc_id for r in mixed.select("doc_id").collect()) <= {d for d, _ in pairs(free)}
    assert MIX.repeats >= mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] - 1
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, mixed.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_goes_by_rows(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    docs = [(1, a), (1, a), (None, a), (0, c), (2, b), (2, c), (None, d), (None, d), (None, ""), (3, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), DATA)
    assert sorted(map(repr, pairs(got))) == sorted(map(repr, [(1, a), (0, c), (2, b), (None, d), (None, ""), (3, None)]))


def test_stages_on_edge_cases(spark):
    """Nulls, empty and long texts, repeated rows, empty tables and clashing names, in every stage."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = H.edge_texts() + [(None, "a text of no id " * 5), (None, None), (3, H.edge_texts()[3][1])]
    docs = H.clashing(H.frame(spark, rows), "doc_id")
    for stage in stages[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for c in H.CLASH) and (r["score"], r["n_tokens"]) == (0.5, 4)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert stages[1](spark, docs, DATA).count() == len(rows)
    near = Counter((r.doc_id, r.text) for r in stages[2](spark, docs, DATA).collect())
    assert near[(3, rows[3][1])] == 1 and near[(None, None)] == 1 and near[(201, "")] == 1
    mixed = stages[4](spark, docs.drop("n_tokens"), DATA)
    texts = {t for _, t in rows}
    assert mixed.count() > 0 and all(r.text in texts and r.n_tokens == len(H.SPACED.findall(r.text)) for r in mixed.select("text", "n_tokens").collect())
    assert stages[4](spark, docs.limit(0), DATA).count() == 0

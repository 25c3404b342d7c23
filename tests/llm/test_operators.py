import hashlib
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as H  # noqa: E402

from siltstone.llm import jaccard_join, quality_classifier  # noqa: E402
from siltstone.llm.components import components  # noqa: E402
from siltstone.llm.decontaminate import RESULTS as leak_results  # noqa: E402
from siltstone.llm.decontaminate import decontaminate  # noqa: E402
from siltstone.llm.jaccard_join import jaccard_components  # noqa: E402
from siltstone.llm.license_scan import CONFIDENCE, GATE, GATE_PAIR, PHRASE_CONFIDENCE, PHRASES, Signature, license_scan, signatures  # noqa: E402
from siltstone.llm.license_scan import RESULTS as license_results  # noqa: E402
from siltstone.llm.line_dedup import line_dedup  # noqa: E402
from siltstone.llm.mixing import Target, mix, mixing_weights  # noqa: E402
from siltstone.llm.perfect_hash import Shards, shard_arrays  # noqa: E402
from siltstone.llm.quality_rules import RESULTS as quality_results  # noqa: E402
from siltstone.llm.quality_rules import Rule, ordered_rules, quality_cascade, quality_rules  # noqa: E402
from siltstone.llm.suffix_dedup import suffix_dedup  # noqa: E402
from siltstone.llm.token_counts import token_counts  # noqa: E402
from siltstone.llm.url_filter import RESULTS as url_filter_results  # noqa: E402
from siltstone.llm.url_filter import UrlRule, url_filter  # noqa: E402


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("n,share,block", [(3, 90, 512), (5, 80, 512), (2, 50, 3)])
def test_jaccard(spark, monkeypatch, n, share, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    data = H.edge_texts()
    got = jaccard_components(H.frame(spark, data), n=n, numerator=share, denominator=100)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(H.jaccard(data, n, share, 100), key=repr)


@pytest.mark.parametrize("meeting", [0, 4])
def test_jaccard_hot_keys(spark, monkeypatch, meeting):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "MEETING_BLOCKS", meeting)
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 3)
    words = [f"w{i}" for i in range(40)]
    near = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(0, 40, 3)]
    data = list(enumerate([*near, *[f"{' '.join(words[:9])} own{i} tail{i} end{i}" for i in range(9)], "a b c d e f g h", "a b c d e f g i", *["many equal rows"] * 5, "", None]))
    hot = spark.createDataFrame([(1, d, True) for d in range(5)] + [(2, d, False) for d in (4, 7)], "h long, doc long, hot boolean")
    assert rows(jaccard_join.by_key(hot, spark.createDataFrame([(1, True, 8), (3, False, 9)], "h long, hot boolean, k int")), "doc", "k") == [(d, 8) for d in range(5)]
    got = jaccard_components(H.frame(spark, data), n=2, numerator=80, denominator=100)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(H.jaccard(data, 2, 80, 100), key=repr)
    assert got.where("component_id = 0").count() > 4


@pytest.mark.parametrize("size", [2, 8, 512])
def test_key_tiles_let_all_pairs_of_components_meet(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", size)
    data = [(h, h == 1, d, d % 7, 0 if d % 3 else d) for h in (1, 2) for d in range(30)] + [(3, False, d, d % 2, 5) for d in range(9)] + [(4, False, d, 1, d) for d in range(4)]
    placed = spark.createDataFrame(data, "h long, hot boolean, doc long, block long, component long")
    keys = jaccard_join.open_keys(placed)
    assert rows(keys, "h", "wide", "common") == [(1, True, 0), (2, True, 0)]
    tiles = {}
    for t, d in jaccard_join.key_tiles(placed.join(keys, ["h", "hot"])).collect():
        tiles.setdefault(t, []).append(d)
    assert all(len(t) == len(set(t)) for t in tiles.values())
    met = {(a, b) for t in tiles.values() for a in t for b in t}
    component = {d: c for h, _, d, _, c in data if h == 1}
    assert all((a, b) in met for a in component for b in component if component[a] != component[b])
    if size == 512:
        assert len(tiles) == 2


def test_ids_of_any_type(spark):
    data = [(f"k{r[0]:03d}" if r[0] is not None else None, r[1]) for r in H.edge_texts() + [(None, "one")]]
    docs = spark.createDataFrame(data, "key string, body string")
    number = {k: i for i, k in enumerate(sorted(d for d, _ in data if d is not None))}
    name = {i: k for k, i in number.items()}
    got = jaccard_components(docs, n=3, numerator=90, denominator=100, id_col="key", text_col="body")
    want = [(name[d], n, name[c]) for d, n, c in H.jaccard([(number[d], t) for d, t in data if d is not None], 3, 90, 100)]
    assert rows(got.where("key IS NOT NULL"), "key", "n_shingles", "component_id") == sorted(want, key=repr)
    assert rows(got.where("key IS NULL"), "n_shingles", "component_id") == [(1, None)]
    removed = suffix_dedup(docs, length=100, id_col="key", text_col="body")
    plain = suffix_dedup(spark.createDataFrame([(number.get(d), t) for d, t in data], "doc_id long, text string"), length=100)
    assert rows(removed, "key", "n_removed", "kept") == sorted(((name.get(r.doc_id), r.n_removed, r.kept) for r in plain.collect()), key=repr)


def test_components_with_hot_centres(spark, monkeypatch):
    monkeypatch.setattr("siltstone.llm.components.HOT_ROWS", 5)
    monkeypatch.setattr("siltstone.llm.components.HOT_VALUES", 10**6)
    links = [(7, i) for i in range(10, 60)] + [(59, 3), (100, 101), (101, 102), (5, 6)] + [(i, i + 1) for i in range(200, 230)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = {n: 3 for n in (3, 7, *range(10, 60))} | {n: 100 for n in (100, 101, 102)} | {5: 5, 6: 5} | {n: 200 for n in range(200, 231)}
    assert {r.node: r.component for r in got.collect()} == want


def test_line_shards_are_bounded_by_the_lines_asked(spark, monkeypatch):
    from siltstone.llm import line_dedup as module

    monkeypatch.setattr(module, "LINES_A_SHARD", 100)
    asked = []
    plain = module._asked
    monkeypatch.setattr(module, "_asked", lambda *args: asked.append(plain(*args)) or asked[-1])
    data = [(i, "\n".join([f"own line {i} {k}" for k in range(200)] + ["a line of many", f"a line of few {i % 9}"])) for i in range(30)]
    got = line_dedup(H.frame(spark, data), min_docs=3, max_broadcast=1)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == H.line_drop(data, 3)
    sizes = [r.n // 28 for r in asked[0].groupBy("shard").agg(F.sum(F.length("lines")).alias("n")).collect()]
    assert sum(sizes) >= 6000 and max(sizes) < 200


def test_jaccard_edges(spark):
    data = [(1, "a b c d"), (1, "p q r s"), (2, "a b c d"), (3, "p q r s"), (None, "a b c d"), (4, None)]
    got = rows(jaccard_components(H.frame(spark, data), n=2, numerator=90), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (None, 3, None), (4, 0, 4)], key=repr)
    assert jaccard_components(H.frame(spark, []), n=3).count() == 0


def test_overlaps_of_many_sets():
    r = np.random.default_rng(3)
    common = r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(common, 30, replace=False), r.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(60)]
    got = jaccard_join.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60) if i != j)


def test_components_of_a_long_path(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert set(rows(components(links), "component")) == {(1,)}


@pytest.mark.parametrize("a_round", [1000, 4])
def test_decontaminate(spark, a_round):
    data = H.edge_texts()
    text = {d: t for d, t in data}
    items = [(1, text[3]), (2, text[100]), (2, text[100]), (3, None), (4, ""), (5, "ONE"), (None, text[5]), (6, " ".join(text[208].split(" ")[500:560]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(H.frame(spark, data), benchmark, most_sent=a_round)
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == H.leaks(data, items)
    assert got.columns.count("items") == 1 and "lang" in got.columns
    H.assert_clashing_came_back(decontaminate(H.clashing(H.frame(spark, data), "doc_id", leak_results), benchmark, most_sent=a_round), "doc_id", leak_results)
    assert decontaminate(H.frame(spark, []), benchmark).count() == 0
    assert decontaminate(H.frame(spark, data), benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_quality_rules(spark):
    filler = lambda k: " ".join(f"word{i}of{k}" for i in range(60))
    junk = {400: "\n".join(f"- {filler(k)}" for k in range(5)), 401: "\n".join(f"{filler(k)} ..." for k in range(6)), 402: " ".join(f"same w{i}" for i in range(80)), 403: filler(3)}
    data = H.edge_texts() + [(300, "a b c a b c x a b c\n" * 30), (301, "w " * 400), (302, "!! ## " * 60), (None, "null id"), *junk.items()]
    own = H.clashing(H.frame(spark, data), "doc_id", quality_results)
    got = quality_rules(own)
    H.assert_clashing_came_back(got, "doc_id", quality_results)
    assert {r.doc_id: r.failed_rule for r in got.where("doc_id BETWEEN 400 AND 403").collect()} == {400: "bullets", 401: "ellipses", 402: "one_word", 403: None}
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert rows(got, "doc_id", *measures) == sorted([(d, *H.rules(t)) for d, t in data], key=repr)
    for r in got.collect():
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and (not base or not r.kept) and (r.failed_rule is None) == r.kept
    assert quality_rules(H.frame(spark, [])).count() == 0


def test_cascade_stops_at_the_first_failure(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    got = quality_cascade(df.where("v > 0"), [Rule("all", F.col("v") > 0)])
    assert {r.failed_rule for r in got.collect()} == {"all"}
    boom = Rule("boom", F.raise_error("evaluated").isNotNull())
    lazy = quality_cascade(df, [boom], first=Rule("first", F.col("v") >= 0), sample=df.limit(0))
    assert {r.failed_rule for r in lazy.collect()} == {"first"}


def test_cascade_puts_cheap_strict_rules_first(spark):
    df = spark.range(400).withColumn("text", F.repeat(F.lit("word "), 400))
    slow = Rule("slow", F.size(F.filter(F.split("text", " "), lambda w: w.rlike("x.*y"))) > 0)
    order = ordered_rules(df, [slow, Rule("never", F.col("id") < 0), Rule("strict", F.col("id") >= 0)])
    assert order[0].name == "strict"


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    data = H.edge_texts()
    got = token_counts(H.frame(spark, data), path)
    assert rows(got, "doc_id", "n_bytes", "n_tokens") == sorted([(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in data], key=repr)
    assert token_counts(H.frame(spark, []), path).count() == 0


@pytest.mark.parametrize("length", [64, 100])
def test_suffix_dedup(spark, length):
    data = H.edge_texts() + [(300, "ab" * 400), (301, "zz" + "ab" * 90), (302, "é" * 80), (303, "aé" * 80 + "x" + "aé" * 80), (7, "q" * 150), (7, "q" * 150), (None, "q" * 120)]
    got = suffix_dedup(H.frame(spark, data), length)
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got.collect()), key=repr)
    want = H.suffixes(data, length)
    assert have == want and all(r.n_spans == len(r.spans) for r in got.collect())
    assert suffix_dedup(H.frame(spark, []), length).count() == 0


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    a, b = "AaAaBB" + "the same tail " * 12, "BBBBBB" + "the same tail " * 12
    texts = [f"{x} {i} " + t for i in range(40) for x, t in (("one", a), ("two", b))]
    # pairs of texts with equal 32-bit hashes, found among many short ones
    seen, equal = {}, []
    for i, h in enumerate(r[0] for r in spark.range(400_000).select(F.hash(F.concat(F.lit("t"), F.col("id").cast("string")))).collect()):
        if h in seen:
            equal += [f"t{seen[h]}", f"t{i}"]
        seen[h] = i
    long = "a passage of more than a hundred bytes that two texts share, and that stands in each of them more than once; "
    data = [(None, t) for t in equal[:6]] + [(None, long + t) for t in equal[:6]] + [(9, t + long + long) for t in equal[:6]] + [(9, long), (9, long), (9, long)] + [(None, t) for t in texts]
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(H.frame(spark, data)).collect()), key=repr)
    assert len(equal) >= 6 and have == H.suffixes(data, 100)


def test_suffix_dedup_over_pieces(spark):
    r = np.random.default_rng(1)
    long = "".join(r.choice(list("abcdefgh "), 300_000).tolist())
    data = [(1, long), (2, long[1000:290_000] + "x" + long[5:400]), (3, "y" + long[131_000:131_500])]
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup(H.frame(spark, data)).collect()}
    assert got == {d: hashlib.sha256(kept).hexdigest() for d, _, _, _, kept in H.suffixes(data, 100)}


@pytest.mark.parametrize("bytes_", [1 << 26, 1])
def test_line_dedup(spark, monkeypatch, bytes_):
    monkeypatch.setattr("siltstone.llm.line_dedup.KEYS_A_SHARD", 3)
    data = H.edge_texts()
    got = line_dedup(H.frame(spark, data), min_docs=3, max_broadcast=bytes_)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == H.line_drop(data, 3)
    assert got.columns.count("n_lines") == 1 and "source" in got.columns
    H.assert_clashing_came_back(line_dedup(H.clashing(H.frame(spark, data), "doc_id"), min_docs=3, max_broadcast=bytes_), "doc_id")
    monkeypatch.setattr("siltstone.llm.line_dedup.HOT_KEYS", 4)
    assert rows(line_dedup(H.frame(spark, data), min_docs=3, max_broadcast=bytes_), "doc_id", "n_lines", "n_dropped", "text") == H.line_drop(data, 3)
    assert line_dedup(H.frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    r = np.random.default_rng(2)
    h1, h2 = (r.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    h1[:50] = h1[0]  # keys that share a half
    shards = Shards(1, [{"shard": 0, **shard_arrays(h1, h2, np.arange(5000))}])
    assert (shards.count(h1, h2) == np.arange(5000)).all()
    ph = shards.of[0][0]
    assert sorted(ph.index(h1, h2).tolist()) == list(range(5000))
    assert not shards.count(h2, h1).any()


def test_license_scan(spark):
    data = [
        (1, "Released under the MIT License. GNU general-public LICENSE"), (2, "SPDX-License-Identifier: Apache-2.0"), (3, "cc by cc by-nc-sa 4.0"), (4, None), (5, ""), (6, "acc by"),
        (7, "under the Apache License, Version 2.0, or the mit license or mit license"), (8, "GNU Lesser General Public License version 2.1 or later"), (9, "plain words only"), (10, "mit license " * 3000),
    ]
    got = {r.doc_id: r for r in license_scan(H.frame(spark, data)).collect()}
    assert [(i, got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) for i in (1, 3, 4, 6, 7, 9)] == [
        (1, 9, 2, 3, 5, ["gpl", "mit"]), (3, 8, 2, 0, 2, ["cc-by"]), (4, 0, 0, None, None, []), (6, 2, 0, None, None, []), (7, 14, 3, 2, 12, ["apache", "mit"]), (9, 3, 0, None, None, []),
    ]
    assert got[2].labels == ["apache-2.0"] and got[2].score == 1.0
    assert "cc-by-nc-sa-4.0" in got[3].labels
    assert "apache-2.0" in got[7].labels
    assert got[8].labels == ["lgpl-2.1-or-later"]
    assert got[10].n_base == 3000 and got[10].labels == ["mit"]
    assert got[9].score == 0.0
    assert license_scan(H.frame(spark, [])).count() == 0


def test_signatures_are_many_and_suppress(spark):
    assert len(signatures()) >= 200
    rules = [Signature("outer", 2, "licen", "the x licen[sc]e text"), Signature("inner", 2, "licen", "x licen[sc]e"), Signature("surer", 3, "licen", "licen[sc]e text"), Signature("late", 2, "licen", "licen[sc]e text more")]
    got = license_scan(H.frame(spark, [(1, "the x license text more")]), rules=rules).first()
    assert got.labels == ["late", "outer", "surer"]


def test_quality_classifier(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = quality_classifier.fit_quality(texts, labels.where(own))
    got = quality_classifier.quality_scores(texts, model).join(labels.where(~own), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([x >= 0.3 for x in good]) > 0.95
    edges = quality_classifier.quality_scores(H.frame(spark), model).collect()
    assert len(edges) == len(H.edge_texts()) and all(0 <= r.score <= 1 for r in edges)
    assert quality_classifier.quality_scores(H.frame(spark, []), model).count() == 0


def test_classifier_against_plain_versions(spark):
    """Features as sets of strings, ratios by counting, the descent with dense vectors and a loop over all weights."""
    texts = [(i, t) for i, t in H.edge_texts() if i < 150]
    data = texts + [(3, "another text of the id three"), (None, "no id"), (100, texts[0][1])]
    docs = H.clashing(H.frame(spark, data), "doc_id", ["score"])
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts] + [(4, 1), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.fit_quality(docs, labels)
    again = quality_classifier.fit_quality(docs.repartition(5), labels.repartition(3))
    assert (model.weights == again.weights).all() and model.slope == again.slope
    scored = quality_classifier.quality_scores(docs, model)
    H.assert_clashing_came_back(scored, "doc_id", ["score"])

    def buckets(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return quality_classifier.features(raw, np.array([0, len(raw)]))[1]

    own = {}
    for i, t in data:
        if i is not None and i < 150:
            own.setdefault(i, []).append(buckets(t).astype(np.int32).tobytes())
    rows_ = [np.frombuffer(min(own[i]), np.int32).astype(np.int64) for i in sorted(own)]
    y = np.array([1 if (0 if i == 4 else i % 2) else -1 for i in sorted(own)])
    keep = [k for k, i in enumerate(sorted(own))]
    used = sorted({int(b) for r in rows_ for b in r})
    at = {b: k for k, b in enumerate(used)}
    dense = np.zeros((len(rows_), len(used)))
    for k, r in enumerate(rows_):
        dense[k, [at[int(b)] for b in r]] = 1
    counts = {c: 1.0 + dense[y == c].sum(axis=0) for c in (-1, 1)}
    rest = quality_classifier.BUCKETS - len(used)  # features that no text has are smoothed as well
    ratio = np.log(counts[1] / (counts[1].sum() + rest)) - np.log(counts[-1] / (counts[-1].sum() + rest))
    got = quality_classifier._ratios(rows_, y)
    assert np.allclose(got[used], ratio)
    x = dense * ratio / np.sqrt(dense.sum(axis=1, keepdims=True))
    w, bias = quality_classifier._descend(rows_, y, got, 1.0, 200)
    share = {c: len(y) / (2 * (y == c).sum()) for c in (-1, 1)}
    v = np.zeros(len(used))
    v[:] = w[used] / np.where(ratio == 0, 1, ratio)
    loss = lambda u, b: 0.5 * (u @ u + b * b) + sum(share[c] * np.maximum(0, 1 - c * (x[y == c] @ u + b)).sum() for c in (-1, 1))
    best = loss(v, bias)
    r = np.random.default_rng(0)
    assert best < loss(np.zeros(len(used)), 0.0)
    assert all(best <= 1.001 * loss(v + step * r.standard_normal(len(used)), bias + step * r.standard_normal()) for step in (1e-3, 1e-2, 0.1) for _ in range(100))
    assert keep and {q.score for q in scored.where("text IS NULL").collect()} == {q.score for q in scored.where("text = ''").collect()}


def test_classifier_without_labels(spark):
    model = quality_classifier.fit_quality(H.frame(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality_classifier.quality_scores(H.frame(spark), model).collect()} == {0.5}


URLS = ["http://a.net/x", "https://sub.example.net/en/1", "http://example.com/de/2?x", "http://org/fr/", "http://Example.NET/de#f", "http://a.org/fr", "no scheme", "", None, "x://", "http://badnet/q", "http://h.org?a/b", "http://my.example.com/de/"]


def test_url_filter(spark):
    rules = [UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, rules).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][:3] == ("example.com", "/de/2", "example.com/de/")
    assert got[3][2:] == ("org/fr/", "allow")
    assert got[4] == ("example.net", "/de", "net/", "block")
    assert got[5][2] is None and got[11][:3] == ("h.org", "", None)
    assert all(got[i][:2] == ("", "") for i in (6, 7, 8, 9)) and got[10][2] is None
    assert all(v[3] in ("allow", "block") for v in got.values()) and url_filter(pages, rules).count() == len(URLS) + 1
    assert url_filter(pages.limit(0), rules).count() == 0


def test_url_filter_against_brute_force(spark):
    rules = [UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]
    r = np.random.default_rng(4)
    made = [f"http{'s' * (i % 2)}://{'www.' * (i % 3 == 0)}{r.choice(['a', 'b9', 'ex-ample', 'É'])}.{r.choice(['net', 'org', 'com', 'example.net', 'example.com'])}/{r.choice(['en', 'fr', 'de', ''])}/{r.choice(['p', 'Q=1', 'x_y', '日本'])}{i % 17}{r.choice(['', '?k=v', '#z', '%20'])}" for i in range(150)]
    urls = URLS + made + made[:20] + ["http://a.net/" + "long/" * 3000]
    pages = H.clashing(spark.createDataFrame([(i if i % 9 else None, u) for i, u in enumerate(urls)], "page_id long, url string"), "page_id", url_filter_results)
    got = url_filter(pages, rules)
    H.assert_clashing_came_back(got, "page_id", url_filter_results)
    want = Counter((i if i % 9 else None, u, *x[:3], x[4]) for i, (u, x) in enumerate(zip(urls, H.url_verdicts(urls, rules), strict=True)))
    assert Counter(tuple(x) for x in got.select("page_id", "url", "host", "path", "rule", "verdict").collect()) == want
    llr = {u: x[3] for u, x in zip(urls, H.url_verdicts(urls, rules), strict=True)}
    assert all(abs(x.llr - llr[x.url]) < 1e-4 for x in got.select("url", "llr").collect())
    one_sided = [u for u in urls if u and ".net/" in u and "example" not in u]
    assert {x.llr for x in url_filter(spark.createDataFrame(list(enumerate(one_sided)), "page_id long, url string"), rules).collect()} == {None}


def test_license_scan_against_brute_force(spark):
    phrases = ["Licensed under the {}", "SPDX-License-Identifier: {}", "{} or any later version", "see the {} license", "{}"]
    names = ["GNU General Public License version 2", "GNU Lesser General Public License, v2.1", "MIT License", "Apache License, Version 2.0", "MIT", "apache-2.0", "CC BY-SA 4.0", "gplv3", "BSD", "3-clause BSD", "mozilla public license 2.0", "Redistribution and use in source and binary forms", "all rights reserved", "Copyright (c) 2019"]
    made = [f"Ünder {p.format(n)}; {q.format(m)}." for p in phrases for q in phrases[:3] for n, m in zip(names, names[3:] + names[:3], strict=True)]
    data = H.edge_texts() + [(1000 + i if i % 7 else None, t) for i, t in enumerate(made + made[:40])] + [(5000, "gnu general public license version 2 or later " * 2000)]
    docs = H.clashing(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", license_results)
    got = license_scan(docs)
    H.assert_clashing_came_back(got, "doc_id", license_results)
    rules = signatures()
    brute = {t: H.license_rows(t, rules, PHRASES, CONFIDENCE, PHRASE_CONFIDENCE) for t in {t for d, t in data if d != 5000}}
    brute[data[-1][1]] = (16000, 2000, 0, 15992, ["gpl"], ["gpl", "gpl-2.0-or-later"], 1.0)
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows(got, "doc_id", "text", *columns) == sorted(((d, t, *brute[t]) for d, t in data), key=repr)


def test_url_model_learns(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'good'}-site{i}.{'net' if i % 2 else 'org'}/{'pills' if i % 2 else 'fr'}/{i}") for i in range(200)] + [(1000, "http://spam-pills.com/pills/9"), (1001, "http://good-site.com/fr/9")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(pages, [UrlRule("block", "net"), UrlRule("allow", "org", "/fr/")]).where("page_id >= 1000").collect()}
    assert got == {1000: "block", 1001: "allow"}


def test_mixing_weights(spark):
    data = [(i, "big" if i < 600 else "mid" if i < 660 else "small", 10) for i in range(670)]
    docs = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    plan = {r.source: r for r in mixing_weights(docs, Target(entropy=0.8, repeats=None), None, "source", "n_tokens").collect()}
    w = np.array([r.weight for r in plan.values()])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - 0.8 * np.log(3)) < 1e-6
    limited = mixing_weights(docs, Target(entropy=0.99, repeats=2.0), None, "source", "n_tokens").collect()
    assert max(r.source_budget / r.tokens for r in limited) == pytest.approx(2.0, rel=1e-6)


def test_mixing_weights_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 97) AS source", "(id * id) % 1013 + 1 AS n_tokens")
    plans = [{r.source: r.asDict() for r in mixing_weights(d, Target(entropy=0.999, repeats=None), None, "source", "n_tokens").collect()} for d in (docs, docs.repartition(13), docs.orderBy(F.desc("doc_id")))]
    assert plans[0] == plans[1] == plans[2] and len(plans[0]) == 97


@pytest.mark.parametrize("sent", [0, 1])
def test_mix_with_more_sources_than_are_sent(spark, monkeypatch, sent):
    data = [(i, None if i % 7 == 0 else f"s{i % 4}", 1 + i % 5) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    want = rows(mix(docs, Target(entropy=0.9, repeats=3.0), block_tokens=8), "doc_id", "source", "copy", "block", "shuffle_key")
    monkeypatch.setattr("siltstone.llm.mixing.SENT_SOURCES", sent)
    assert rows(mix(docs, Target(entropy=0.9, repeats=3.0), block_tokens=8), "doc_id", "source", "copy", "block", "shuffle_key") == want


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_mix_is_whole_passes_and_a_part(spark, block):
    data = [(i, "big" if i < 600 else "small" if i < 650 else None, 5 + i % 7) for i in range(700)] + [(800, "small", 0), (801, "small", None)]
    docs = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    target = Target(entropy=0.9, repeats=5.0)
    got = mix(docs, target, block_tokens=block).collect()
    again = mix(docs.repartition(7), target, block_tokens=block).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    for r in mixing_weights(docs, target, None, "source", "n_tokens").collect():
        own = [x for x in got if x.source == r.source]
        ids = {d for d, s, n in data if s == r.source and n}
        for copy in range(r.passes):
            assert sorted(x.doc_id for x in own if x.copy == copy) == sorted(ids)
        part = [x.doc_id for x in own if x.copy == r.passes]
        assert len(part) == len(set(part)) and set(part) <= ids
        total = sum(x.n_tokens for x in own)
        assert r.source_budget - 12 <= total <= r.source_budget + 1e-6
    assert mix(docs.limit(0), target).count() == 0


def test_mix_against_brute_force(spark):
    import math

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long_ = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed & (2**64 - 1))
    int_ = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(4, "little", signed=True), seed & (2**64 - 1))
    hash_ = lambda lit, *xs: signed(__import__("functools").reduce(lambda h, x: h if x is None else long_(x, h), xs, int_(lit, 42)))
    data = [(i if i % 13 else None, ["big", "big", "big", "mid", None][i % 5] if i % 40 else "small", 3 + i * 7 % 11) for i in range(400)] + [(5, "big", 0), (6, None, None)]
    docs = H.clashing(spark.createDataFrame(data, "doc_id long, source string, n_tokens long"), "doc_id")
    target, block_tokens = Target(entropy=0.97, repeats=2.7), 60
    got = mix(docs, target, block_tokens=block_tokens)
    H.assert_clashing_came_back(got, "doc_id")

    rows_ = [(d, s, n) for d, s, n in data if n]
    tokens = Counter()
    for _, s, n in rows_:
        tokens[s] += n
    budget, most = sum(tokens.values()), max(tokens.values())

    def weights(x):
        p = {s: (n / most) ** x for s, n in tokens.items()}
        return {s: v / sum(p.values()) for s, v in p.items()}

    entropy = lambda w: -sum(v * math.log(v) for v in w.values())
    repeats = lambda w: max(v * budget / tokens[s] for s, v in w.items())
    x = 1.0
    if entropy(weights(1.0)) < target.entropy * math.log(len(tokens)):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(weights(mid)) >= target.entropy * math.log(len(tokens)) else (lo, mid)
        x = lo
    if repeats(weights(x)) > target.repeats:
        lo, hi = x, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if repeats(weights(mid)) > target.repeats else (lo, mid)
        x = hi
    want = Counter()
    for s, w in weights(x).items():
        own = [(d, n) for d, t, n in rows_ if t == s]
        n_blocks = math.ceil(tokens[s] / block_tokens)
        block = lambda d: hash_(1, d) % n_blocks
        passes = math.floor(w * budget / tokens[s])
        rest = w * budget - passes * tokens[s]
        for copy in range(passes):
            want.update((d, s, n, copy, block(d)) for d, n in own)
        used = 0
        for b in sorted({block(d) for d, _ in own}, key=lambda b: (hash_(1, b, passes), b)):
            inside = [(d, n) for d, n in own if block(d) == b]
            size = sum(n for _, n in inside)
            if used + size <= rest:
                want.update((d, s, n, passes, b) for d, n in inside)
            elif used < rest:
                upto = used
                for d, n in sorted(inside, key=lambda r: (hash_(2, r[0], passes), (r[0] is not None, r[0] or 0), r[1])):
                    upto += n
                    if upto <= rest:
                        want[(d, s, n, passes, b)] += 1
            used += size
    have = Counter((r.doc_id, r.source, r.n_tokens, r.copy, r.block) for r in got.collect())
    assert have == want


def example(parsed):
    """The shortest text that a parsed pattern matches, with the first of its alternatives."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            kind, value = arg[0]
            out += ("1" if "DIGIT" in str(value) else "x") if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else value[0])
        elif name == "BRANCH":
            out += example(arg[1][0])
        elif name == "SUBPATTERN":
            out += example(arg[-1])
        else:
            out += example(arg[2]) * arg[0]
    return out


def test_every_signature_can_match(spark):
    for rule in signatures():
        joined = f" {' '.join(example(re._parser.parse(rule.pattern)).split())} x "
        assert re.search(rf"(?<= ){rule.pattern}(?= )", joined), rule
        assert (rule.keyword if rule.keyword[0] == "l" else f" {rule.keyword}") in joined, rule
        assert any(g in joined for g in GATE) or re.search(GATE_PAIR, joined), rule
    got = license_scan(H.frame(spark, [(1, "Licensed under the terms of Foo"), (2, "licenced under Foo"), (3, "licensed under the Foo")])).collect()
    assert [(r.labels, r.score) for r in got] == [(["licensed"], 0.6)] * 3

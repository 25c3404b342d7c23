"""Filter audit, importance resampling and vector near-dedup against brute force."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers as H  # noqa: E402

from siltstone.llm import embedding_dedup, importance  # noqa: E402
from siltstone.llm.embedding_dedup import near_vectors  # noqa: E402
from siltstone.llm.filter_audit import COUNTS, filter_audit, marked  # noqa: E402
from siltstone.llm.importance import joined_crc, resampled, word_crc  # noqa: E402
from siltstone.llm.queries import AUDITED, ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_importance_resampling", "op13_embedding_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


# ---- filter audit


def audit(rows, labels):
    """``rows`` of (doc_id, text, lang); every order is played through."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang in rows:
        text = text or ""
        words = H.SPACED.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and least[text] < d,
        }
        parts[lang or ""].append(({f for f, x in fails.items() if x}, d in good, d in toxic))
    out, removed = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                alive = [x for x in docs if not x[0] & before]
                gone = [x for x in alive if f in x[0]]
                removed[part, f] += len(gone)
                out[part, "".join(order), step + 1] = [len(alive) - len(gone), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited_rows():
    r = random.Random(3)
    texts = [t for _, t in H.edge_texts()]
    texts += [" ".join(r.choice(["aa", "Bb", "cc#"] if i % 3 else [f"w{k}" for k in range(900)]) for _ in range(r.choice([40, 250]))) for i in range(30)]
    rows = [(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts + texts[::3])]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), rows[5], rows[5], (7, "another text of id 7", "en")]
    return rows


def test_filter_audit(spark):
    rows, r = audited_rows(), random.Random(4)
    labels = [(d if r.random() < 0.9 else None, r.choice([0, 1, None]), r.choice([0, 1, None])) for d, _, _ in rows[::2] for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS part", "1 AS step", "0 AS mask", "'y' AS same", "2 AS id", "3 AS `a.b`")
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS salt"), AUDITED)
    assert got.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]
    want = audit(rows, labels)
    found = {(x.part, x.filter_order, x.step): (*[x[c] for c in COUNTS], x.shapley) for x in got.collect()}
    assert found == want and got.count() == len(want)
    assert {p for p, _, _ in want} == {"en", "de", ""}


def test_filter_audit_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels, AUDITED).count() == 0
    one = spark.createDataFrame([("k", "a#", "en"), ("k", "b", "en")], "key string, body string, own string")
    got = filter_audit(one, labels.withColumnRenamed("doc_id", "key"), {"X": marked("#")}, copies=None, part_col="own", id_col="key", text_col="body").collect()
    assert [tuple(r) for r in got] == [("en", "X", 1, 1, 1, 0, 1, 0, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit(docs, labels, {"long name": marked("#")})


# ---- importance resampling


def importances(rows, target, percent=5, min_words=20):
    def features(text):
        w = H.ALNUM.findall(H.lower(text))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))

    own = [(d, *features(t)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    n, m = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)}
    scored = []
    for d, words, f in own:
        weight = sum(gain[b] * k for b, k in f.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append([d, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((x for x in scored if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return Counter(tuple(x[:5]) for x in scored)


@pytest.mark.parametrize("percent,block", [(5, 1 << 20), (50, 64), (100, 1000)])
def test_importance_resampling(spark, monkeypatch, percent, block):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    r = random.Random(percent)
    rows = H.edge_texts() + [(300, "ab " * 30), (300, "ab " * 30), (None, "cd " * 40), (None, None), (301, f"{'y' * 70} {'z' * 1000} Z{'é' * 90}x {'q' * 64} {'q' * 65}" * 9)]
    rows += [(400 + i, " ".join(r.choice("abcdefgh") for _ in range(25))) for i in range(40)]
    target = ["ab ab CD", "the abc é d e f", None, "", "a b c d e f g h " * 5]
    got = resampled(H.frame(spark, rows).withColumnRenamed("score", "rank"), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(x) for x in got.collect()) == importances(rows, target, percent)


def test_importance_edges(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert resampled(none, none).count() == 0
    docs = spark.createDataFrame([("k", "a b"), ("l", "c")], "doc_id string, text string")
    got = resampled(docs, none, percent=100, min_words=1).collect()
    assert sorted(r["rank"] for r in got) == [1, 2] and {r.weight for r in got} != {0}


def test_checksums_of_words():
    r = random.Random(1)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 3, 63, 64, 65, 66, 127, 128, 129, 1000, 4097)]
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    crc = word_crc(np.frombuffer(b"".join(words), np.uint8), start, end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    both = joined_crc(crc[:-1], crc[1:], np.array([len(w) for w in words[1:]]))
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:], strict=False)]


# ---- vectors


def linked(rows, least=0.95):
    """n_links and component of each row; the length that most usable vectors have counts."""
    usable = [(i, d, np.array(v, np.float64)) for i, (d, v) in enumerate(rows) if d is not None and v is not None and v and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.any(np.array(v, np.float64))]
    sizes = Counter(len(v) for _, _, v in usable)
    width = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    usable = [(i, d, v / np.linalg.norm(v)) for i, d, v in usable if len(v) == width]
    n, parent = Counter(), {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, d, v) in enumerate(usable):
        for j, e, w in usable[:k]:
            if v @ w >= least:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return Counter((d, n[i], None if d is None else root(d), None if d is None else root(d) == d) for i, (d, _) in enumerate(rows))


def vectors(seed, groups=(40, 3, 2, 25), alone=120, width=8, noise=0.12):
    r = np.random.default_rng(seed)
    out = []
    for size in groups:
        centre = r.normal(size=width)
        out += [(centre / np.linalg.norm(centre) + r.normal(size=width) * noise / math.sqrt(width)) for _ in range(size)]
    out += list(r.normal(size=(alone, width)))
    out += [out[0], out[0], 3 * out[1]]
    out = [np.float32(v).tolist() for v in out]
    r.shuffle(out)
    return [(int(i) + 10, [float(x) for x in v]) for i, v in enumerate(out)]


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return Counter(tuple(r) for r in df.collect())


# all cells are visited, so that every link must be found
@pytest.mark.parametrize("dense,tile,cell,noise", [(10**6, 1024, 16, 0.12), (10**6, 3, 16, 0.12), (5, 1024, 16, 0.12), (5, 3, 4, 0.2), (3, 2, 4, 0.4), (5, 2, 10**6, 0.5)])
def test_vectors_against_brute_force(spark, monkeypatch, dense, tile, cell, noise):
    for name, value in (("DENSE_ROWS", dense), ("DENSE_CELLS", 10**6), ("TILE_ROWS", tile), ("VISITOR_ROWS", tile), ("CELL_ROWS", cell)):
        monkeypatch.setattr(embedding_dedup, name, value)
    monkeypatch.setattr(embedding_dedup, "needed_visits", lambda rows, index, *_: len(index.codes[0]) ** 2)
    rows = vectors(dense % 97 + tile, noise=noise)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS row", "2 AS n_links", "3 AS id", "'x' AS vec")
    want = linked(rows)
    assert sum(n for _, n, _, _ in want) > 100
    assert result(near_vectors(df)) == want


def test_vectors_recall_and_no_false_links(spark):
    rows = vectors(5, groups=(60, 40, 30, 20, 10) + (2,) * 80, alone=600, width=16, noise=0.2)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {d: n for d, n, _, _ in linked(rows)}
    assert all(got[d].n_links <= n for d, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(want.values())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_edges(spark, kind):
    one, other = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(1, one), (2, [2.0, 0.0, 1.0]), (2, one), (3, other), (4, None), (5, [0.0] * 3), (6, [1.0, None, 0.5]), (7, [1.0, float("nan"), 0.5]), (8, [float("inf"), 0.0, 0.0])]
    rows += [(9, []), (10, [1.0, 0.0]), (11, [1.0, 0.0]), (None, one), (None, None), (-4, one), (12, other), (12, [5.0, 0.0, -9.0])]
    df = spark.createDataFrame(rows, f"vec_id int, embedding array<{kind}>")
    assert result(near_vectors(df)) == linked(rows)
    assert near_vectors(df.limit(0)).count() == 0
    assert result(near_vectors(df.where("vec_id = 3"))) == {(3, 0, 3, True): 1}
    assert result(near_vectors(df.where("vec_id IN (4, 5)"))) == {(4, 0, 4, True): 1, (5, 0, 5, True): 1}
    narrow = [(1, [0.5]), (2, [-0.5]), (3, [7.0])]
    assert result(near_vectors(spark.createDataFrame(narrow, f"vec_id int, embedding array<{kind}>"))) == linked(narrow)
    with pytest.raises(ValueError):
        near_vectors(df.selectExpr("CAST(vec_id AS string) AS vec_id", "embedding"))

import math
import os
import re
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import embedding, paths, patterns, text
from siltstone.functions import paths as P
from siltstone.operators import evaluation, grep, index, judge, listing, metrics, outline, retrieval, shell
from siltstone.plans import samples
from siltstone.sources import snapshots


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_logical_lines(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("a\n\n",), ("\n",), ("a\r\nb",)], "t string")
    got = values(df.select(text.lines(F.col("t")), text.line_count(F.col("t"))))
    assert [g[0] for g in got] == [[], ["a"], ["a"], ["a", "b"], ["a", ""], [""], ["a\r", "b"]]
    assert [g[1] for g in got] == [len(g[0]) for g in got]


@pytest.mark.parametrize("glob,want", [("**/*.md", "*.md"), ("src/**/*.ts", "src/*.ts"), ("docs/**", "docs/*"), ("a/**/b/**/c", "a/b/c"), ("a**b", "a*b"), ("", "")])
def test_normalize_glob(glob, want):
    assert patterns.normalize_glob(glob) == want


@settings(max_examples=100, deadline=None)
@given(st.text("ab/.[]*?", max_size=8), st.text("ab/.[]", max_size=8))
def test_glob_regex_is_a_pattern(glob, path):
    import re

    pattern = re.compile(patterns.glob_regex(glob)) if not re.search(r"\[[^\]]*$", glob) else None
    if pattern and not set(glob) & set("*?["):
        assert bool(pattern.match(path)) == (glob == path)


def test_terms(spark):
    df = spark.createDataFrame([("const parseConfig = (max_lines) => the httpServer 42",)], "t string")
    got = values(df.select(text.terms(F.col("t"))))[0][0]
    assert got == ["parseconfig", "parse", "config", "max_lines", "max", "lines", "httpserver", "http", "server", "42"]


def test_paths(spark):
    paths = ["docs/fr/a.md", "README.zh-CN.md", "i18n/de/x.txt", "a.b/c", ".env", "x/lib.test.ts", "node_modules/a.js", "yarn.lock", "a.PNG"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    c = F.col("path")
    got = values(df.select(P.canonical_docs(c), P.extension(c), P.language(c), P.is_test(c), P.skip_reason(c, F.lit(1))))
    assert [g[0] for g in got] == ["docs/a.md", "README.md", "x.txt", "a.b/c", ".env", "x/lib.test.ts", "node_modules/a.js", "yarn.lock", "a.PNG"]
    assert [g[1] for g in got] == ["md", "md", "txt", "", "", "ts", "js", "lock", "png"]
    assert got[5][2:4] == ("typescript", True)
    assert [g[4] for g in got][-3:] == ["skip-dir", "skip-file", "skip-binary"]


def test_outline_spans(spark):
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in values(outline.outline(samples.sources(spark)), "path", "name", "kind", "line", "end_line")}
    assert got[("src/box.ts", "Box")] == ("class", 4, 9)
    assert got[("src/box.ts", "make")] == ("function", 11, 16)
    assert got[("src/box.ts", "LIMIT")] == ("const", 18, None)
    assert got[("lib/tool.py", "Tool")] == ("class", 5, 7)
    assert got[("lib/tool.py", "main")] == ("function", 10, 13)
    assert got[("cmd/main.go", "Point")] == ("class", 5, 7)
    assert got[("cmd/main.go", "Show")] == ("function", 9, 11)
    assert got[("src/util.c", "twice")] == ("function", 8, 11)
    assert not [k for k in got if k[0] == "lib/empty.rb"]
    assert dict(values(outline.imports(samples.sources(spark))))["src/box.ts"] == ["./a", "./side"]


def test_enclosing_symbol(spark):
    code = samples.sources(spark)
    got = {(r.path, r.line): r.symbol for r in grep.enclosing_symbols(grep.grep(code, "return"), outline.outline(code)).collect()}
    assert got[("src/box.ts", 13)] == "make"
    assert got[("lib/tool.py", 13)] == "main"


def test_windows_cover_all_lines(spark):
    df = spark.createDataFrame([(f"f{n}", "\n".join(f"line {i}" for i in range(n))) for n in (1, 40, 60, 61, 70, 71, 300)], "path string, text string")
    for path, in values(df, "path"):
        own = sorted(values(retrieval.windows(df).where(F.col("path") == path), "start", "end"))
        covered = {i for a, b in own for i in range(a, b + 1)}
        assert covered == set(range(1, int(path[1:]) + 1))
        assert all(b - a < 60 for a, b in own)


def test_shell(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "b", "10 x", "a", "9 y", "b"])], "ord long, line string")
    assert [r[1] for r in values(shell.uniq(df).orderBy("ord"), "ord", "line")] == ["b", "10 x", "a", "9 y", "b"]
    assert [r[0] for r in values(shell.sort_lines(df, numeric=True), "line")] == ["b", "b", "a", "b", "9 y", "10 x"]
    assert [r[0] for r in values(shell.sort_lines(df, unique=True), "line")] == ["10 x", "9 y", "a", "b"]
    assert [r[0] for r in values(shell.tail(df, 2), "line")] == ["9 y", "b"]
    assert values(shell.wc(df)) == [(6, 8, 17)]
    numbered = df.withColumn("line_no", F.col("ord") + 1)
    assert [r[0] for r in values(shell.sed_print(numbered, 4), "line")] == ["a"]
    assert [r[0] for r in values(shell.sed_print(numbered, 5, to_end=True), "line")] == ["9 y", "b"]


def test_line_slice_limits(spark):
    df = spark.createDataFrame([("p", "a\nb\nc")], "path string, text string")
    assert [r[1] for r in values(listing.line_slice(df, "p", 2, 99), "line", "text")] == ["b", "c"]
    assert values(listing.line_slice(df, "p", 7, 9)) == []
    with pytest.raises(ValueError):
        listing.line_slice(df, "p", 3, 2)
    assert values(listing.path_kind(df, "p")) == [("file",)]
    assert values(listing.path_kind(df, "q")) == [("none",)]


def test_choice_sums_to_one(spark):
    df = spark.createDataFrame([(k, float(x)) for k in (1, 2) for x in (-1000, 0, 3, 1000)], "k int, logit double")
    got = judge.choice(df, ["k"]).groupBy("k").agg(F.sum("p")).collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in got)


def test_per_file_cap(spark):
    hits = spark.createDataFrame([("a.md", "a.md:1", 1, 9.0), ("a.md", "a.md:41", 41, 8.0), ("docs/fr/b.md", "1", 1, 7.0), ("docs/b.md", "2", 1, 6.0), ("docs/b.md", "3", 50, 5.0)], "path string, id string, start long, score double")
    assert [r[0] for r in values(retrieval.diverse_code(hits, 1, 10), "id")] == ["a.md:1", "1", "2"]
    assert [r[0] for r in values(retrieval.diverse_docs(hits, 2, 10), "id")] == ["a.md:1", "a.md:41", "1", "3"]


def test_grading_and_reasons(spark):
    df = spark.createDataFrame([("It is 42.", ("exact", "42", None, None)), ("x9", ("regex", None, "^x[0-9]$", None)), ("a and b", ("all", None, None, ["A", "c"]))], "answer string, expected struct<type string, value string, pattern string, values array<string>>")
    assert [r.passed for r in evaluation.graded(df).collect()] == [True, True, False]
    e = spark.createDataFrame([("403", "API rate limit"), ("403", "no"), ("404", ""), ("503", ""), ("200", "")], "s string, b string")
    assert [r[0] for r in values(e.select(metrics.error_reason(F.col("s"), F.col("b"))))] == ["rate_limited", "forbidden", "not_found", "upstream_down", None]


def test_snapshot_reader(spark, tmp_path):
    from siltstone.sources import snapshots

    for name, body in {"src/a.py": "x\ny\n", "node_modules/b.js": "no", "logo.png": "no", "README": "r"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: (r.size, r.mime, r.lines) for r in snapshots.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": (4, "text/x-python", 2), "README": (1, "text/plain", 1)}


def test_embedding(spark):
    import numpy as np


    vocabulary = {w: i for i, w in enumerate(["const", "a", "##b", "=", "cafe", "日"])}
    assert embedding.pieces("Const ab= café 日 zzz", vocabulary) == [0, 1, 2, 3, 4, 5]
    model = embedding.StaticModel.quantized(vocabulary, np.eye(6))
    df = spark.createDataFrame([("const ab",), ("",), (None,)], "text string")
    got = [r.embedding for r in embedding.embedded(df, model).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and not any(got[1]) and not any(got[2])


def test_stream_equals_batch(spark):
    from siltstone.streaming import metrics as stream

    d = "/root/testdata/sf0.001"
    live = stream.replayed(stream.windowed(stream.event_stream(spark, d), "1 hour"), "append")
    batch = stream.windowed(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    assert set(map(tuple, live.collect())) < set(map(tuple, batch.collect()))


def test_symbol_chunks_cover_each_line_once(spark):
    code = samples.sources(spark)
    got = retrieval.chunks(code, outline.outline(code)).collect()
    for path, body in samples.SOURCES.items():
        own = sorted((r.start, r.end) for r in got if r.path == path)
        covered = [i for a, b in own for i in range(a, b + 1)]
        assert len(covered) == len(set(covered))
        assert {i for i, x in enumerate(body.split("\n"), 1) if x.strip()} <= set(covered)
    assert [r.kind for r in got if r.path == "lib/empty.rb"] == ["file"]
    assert all(r.text.startswith(r.path) for r in got)


def test_question_parts(spark):
    from siltstone.functions.questions import question_parts

    got = [r[0] for r in samples.asked(spark).select(question_parts(F.col("question"))).collect()]
    assert (got[0].literals, got[0].identifiers, got[0].words) == (["max_retries = 3"], ["parseConfig"], [])
    assert (got[1].literals, got[1].identifiers) == (["hello world"], ["src/util/math.ts"])
    assert got[2].words == ["snapshots", "evicted", "after", "seven", "days"]
    assert got[3] == ([], [], [])


def test_repository_parts(spark):
    from siltstone.functions.questions import freshness, repository_parts

    paths = ["/o/r", "/o/r.git@v1.2/file/x", "https://host.com/o/r/tree/main/src", "/only", "/o/b@d!x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r[0]) for r in df.select(repository_parts(F.col("p"))).collect()]
    assert got[:3] == [("o", "r", None, ""), ("o", "r", "v1.2", "file/x"), ("o", "r", "main", "src")]
    assert got[3][:2] == ("-", "-")
    ages = spark.createDataFrame([("tag", 10), ("branch", 301), ("branch", 4000), ("sha", 9999)], "k string, a long")
    assert [r[0] for r in ages.select(freshness(F.col("k"), F.col("a"))).collect()] == ["fresh", "stale", "expired", "fresh"]


def test_stream_throttle(spark):
    from siltstone.plans.catalogue import QUERIES

    got = QUERIES["stream_throttle"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 999  # one is within the watermark's delay
    for _, own in got[got.allowed].groupby("user_id"):
        times = sorted(own.ts.astype("int64") // 1000)
        assert all(c - a >= 3_600_000_000 for a, c in zip(times, times[2:]))
    assert (got[~got.allowed].retry_after > 0).all()


def test_streams_read_the_whole_table(spark, tmp_path):
    from siltstone.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/parts/events.parquet")
    (tmp_path / "single").mkdir()
    (tmp_path / "single/events.parquet").write_bytes(open(f"{d}/events.parquet", "rb").read())
    events.write.parquet(f"{tmp_path}/single/older/events.parquet")
    (tmp_path / "single/copy").mkdir()
    (tmp_path / "single/copy/events.parquet").write_bytes(open(f"{d}/events.parquet", "rb").read())
    for name, column, own in (("stream_tumbling", "n", 1), ("stream_sliding", "n", 4), ("stream_throttle", None, 1)):
        for folder in ("parts", "single"):
            got = QUERIES[name](spark, str(tmp_path / folder))
            assert (got.agg(F.sum(column)).first()[0] if column else got.count() + 1) == own * events.count(), (name, folder)


def test_replays_stay_off_the_driver(spark, tmp_path):
    from siltstone.sources.storage import shared_folder
    from siltstone.streaming import metrics as stream

    own = f"{shared_folder(spark)}/siltstone/replay-".removeprefix("file://")
    events = stream.event_stream(spark, "/root/testdata/sf0.001")
    for live, mode in ((stream.sessions(events), "append"), (stream.windowed(events, "1 hour"), "complete")):
        got = stream.replayed(live, mode)
        parts = [f.removeprefix("file://") for f in got.inputFiles()]
        assert parts and all(f.startswith(own) for f in parts) and got.dtypes == live.dtypes
        assert os.path.isdir(f"{os.path.dirname(os.path.dirname(parts[0]))}/checkpoint/state")
    (tmp_path / "events.parquet").mkdir()
    none = stream.sessions(stream.event_stream(spark, str(tmp_path)))
    assert stream.replayed(none, "append").count() == 0


def test_rerank_judges_all_matches(spark):
    rows = [(f"f{i:03}", 1, "license") for i in range(300)] + [("z", 7, "apache public license")]
    df = spark.createDataFrame(rows, "path string, line int, text string")
    ranked = judge.rerank(df, judge.word_scorer("apache public license"))
    got = values(ranked, "path", "line")
    assert got == [("z", 7)] + [(p, n) for p, n, _ in rows[:-1]]
    assert values(judge.rerank(df, judge.word_scorer("apache public license"), most=2), "path", "line") == got[:2]


def test_locate_sees_whole_texts(spark):
    body = ["x"] * 6000
    body[5899] = "public license"
    df = spark.createDataFrame([("long", "\n".join(body)), ("short", "x")], "path string, text string")
    got = {(r.path, r.line): r.score for r in judge.locate(df, judge.word_scorer("public license")).collect()}
    assert len(got) == 40 * 5 + 1 and got[("short", 1)] == 1
    e = math.exp(4)
    assert abs(got[("long", 5900)] - e / (e + 39) * e / (e + 149)) < 1e-6
    assert abs(got[("long", 1)] - 1 / (e + 39) / 150) < 1e-6


def test_diverse_docs_looks_past_long_files(spark):
    rows = [("long.md", f"long.md:{i:04}", i * 40, 10.0 - i / 1000) for i in range(1000)] + [(f"d{i:02}.md", f"d{i:02}.md:1", 1, 1.0 - i / 100) for i in range(30)]
    hits = spark.createDataFrame(rows, "path string, id string, start long, score double")
    assert [r[0] for r in values(retrieval.diverse_docs(hits, 2, 20), "id")] == ["long.md:0000", "long.md:0001"] + [f"d{i:02}.md:1" for i in range(18)]


def test_members_and_comments(spark):
    ts = "/* A box.\n * For things. */\n\nexport class Box {\n  size: number = 3\n  static of<T>(x: T) {\n    if (x) { return x }\n    const y = `{\n    `\n  }\n  /* not a\n  brace { */\n  async open() {\n  }\n}\n\n// Makes one.\nfunction make() { return 1 }\nfunction bare() {\n}\n"
    py = "# Top.\nclass Tool:\n    def run(self):\n        def inner():\n            pass\n\n    async def stop(self):\n        return 1\n\n\ndef main():\n    pass\n"
    files = spark.createDataFrame([("a.ts", ts), ("b.py", py), ("c.py", ""), ("d.txt", "class X {")], "path string, text string")
    items = {(r.path, r.name): (r.line, r.end_line) for r in outline.outline(files).collect()}
    assert items == {("a.ts", "Box"): (4, 15), ("a.ts", "make"): (18, 18), ("a.ts", "bare"): (19, 20), ("b.py", "Tool"): (2, 8), ("b.py", "main"): (11, 12)}
    own = sorted((r.path, r.parent, r.kind, r.name, r.line, r.end_line) for r in outline.members(files).where("kind = 'method'").collect())
    assert own == [("a.ts", "Box", "method", "of", 6, 10), ("a.ts", "Box", "method", "open", 13, 14), ("b.py", "Tool", "method", "inner", 4, 5), ("b.py", "Tool", "method", "run", 3, 5), ("b.py", "Tool", "method", "stop", 7, 8)]
    assert [(r.name, r.line) for r in outline.members(files).where("kind = 'property'").collect()] == [("size", 5)]
    comments = {r.name: r.comment for r in outline.leading_comments(files, outline.outline(files)).collect()}
    assert comments == {"Box": "A box.\nFor things.", "make": "Makes one.", "bare": None, "Tool": "Top.", "main": None}


def test_uniq_over_ranges(spark):
    from itertools import groupby

    data = [(i, "aabbbca"[i * i % 7] if i % 50 else "long") for i in range(400)] + [(1000 + i, "same") for i in range(300)]
    got = shell.uniq(spark.createDataFrame(data, "ord long, line string").repartition(7))
    want = [(g[0][0], k, len(g)) for k, g in ((k, list(g)) for k, g in groupby(data, key=lambda x: x[1]))]
    assert sorted((r.ord, r.line, r.n) for r in got.collect()) == want
    one = shell.uniq(spark.createDataFrame([(i, "x") for i in range(200)], "ord long, line string")).collect()
    assert [tuple(r) for r in one] == [(0, "x", 200)]


def test_throttle_over_stretches(spark):
    at = [0, 5, 59, 60, 61, 119, 120, 1190, 1199, 1200, 1201, 1255, 1261]
    log = spark.createDataFrame([("k", i) for i in at], "key string, s long").select("key", "s", F.timestamp_seconds("s").alias("ts"))
    for stretch in (1, 3, 20):
        got = {r.s: (r.in_window, r.throttled) for r in metrics.throttle(log, "key", 60, 3, stretch).collect()}
        assert got == {t: (n, n > 3) for t in at for n in [sum(t - 60 <= u <= t for u in at)]}


def test_paths_and_grading(spark):
    df = spark.createDataFrame([("/a/./b//../c/",), ("../../x",), ("",), ("a/b/../../..",)], "p string")
    assert [r[0] for r in df.select(paths.normalized(F.col("p"))).collect()] == ["a/c", "x", "", ""]
    answers = spark.createDataFrame([("uses foo and a+b", ("all", None, None, ["foo", "a+b"])), ("food a+b", ("all", None, None, ["foo"]))], "answer string, expected struct<type:string,value:string,pattern:string,values:array<string>>")
    assert [r.passed for r in evaluation.graded(answers).collect()] == [True, False]


def test_archives_and_model_files(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "one.tar.gz", "w:gz") as tar:
        for name, data in [("top/src/a.ts", b"let a = 1\n"), ("top/node_modules/x.js", b"no"), ("top/logo.png", b"no"), ("top/src/a.ts", b"let a = 2\n"), ("top/empty.md", b"")]:
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    got = {r.path: (r.size, r.lines, r.text) for r in snapshots.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": (10, 1, "let a = 2\n"), "empty.md": (0, 0, "")}
    with pytest.raises(Exception, match="one.tar.gz has more than 10 bytes"):
        snapshots.read_archives(spark, str(tmp_path), max_archive=10).count()

    import numpy as np

    model = embedding.StaticModel.quantized({"a": 0, "##b": 1}, np.array([[1.0, -2.0, 0.5], [0.0, 0.0, 0.0]]))
    (tmp_path / "m.bin").write_bytes(embedding.model_bytes(model))
    back = embedding.read_model(spark, str(tmp_path / "m.bin"))
    assert back.vocabulary == model.vocabulary and (back.weights == model.weights).all() and np.allclose(back.scales, model.scales)
    (tmp_path / "m.bin").write_bytes(b"else")
    with pytest.raises(ValueError):
        embedding.read_model(spark, str(tmp_path / "m.bin"))


def test_deepened_candidates(spark):
    import math

    files = spark.createDataFrame([("a", "public license\nplain\npublic"), ("b", "nothing\nlicense"), ("c", "public license version")], "path string, text string")
    few = spark.createDataFrame([("a", 2, 2, "match", "plain"), ("b", 1, 1, "match", "nothing")], "path string, line int, end int, kind string, text string")
    scorer = judge.word_scorer("public license version")
    got = {(r.path, r.line, r.kind): r.p for r in judge.deepened(few, files, scorer).collect()}
    logits = {("a", 2, "match"): -2, ("b", 1, "match"): -2, ("a", 1, "located"): 2, ("a", 3, "located"): 0, ("b", 2, "located"): 0}
    total = sum(math.exp(x) for x in logits.values())
    assert got.keys() == logits.keys() and all(abs(got[k] - math.exp(x) / total) < 1e-9 for k, x in logits.items())
    sure = few.where("path = 'a'")
    assert [(r.p, r.read) for r in judge.deepened(sure, files, scorer).collect()] == [(1.0, True)]


def _chunked(calls, failing=()):
    from siltstone.operators import retrieval

    def build(rows):
        calls.append(rows.count())
        if len(calls) in failing:
            raise RuntimeError("killed")
        return retrieval.chunks(rows).withColumn("id", F.concat_ws(":", "path", "start"))

    return build


def _terms(kept):
    return sorted((r.id, r.term, r.tf, r.len) for r in kept.postings.collect())


def _scores(kept, *terms):
    from siltstone.operators import index

    return sorted((r.id, r.score) for r in index.bm25(kept, list(terms), ["path"]).collect())


def test_index_is_kept_until_the_table_changes(spark, tmp_path):
    from siltstone.operators import index

    files = spark.createDataFrame([("src/parseConfig.ts", "const maxRetries = 3"), ("docs/a.md", "max retries of a thing")], "path string, text string")
    table, calls = str(tmp_path / "t"), []
    files.coalesce(1).write.parquet(table)
    for _ in range(2):
        kept = index.kept_index(spark, table, _chunked(calls), ["path"])
    assert calls == [2] and kept.n_chunks == 2
    terms = {(r.path, r.term): r.tf for r in kept.postings.collect()}
    assert terms[("src/parseConfig.ts", "parseconfig")] == 2 and terms[("src/parseConfig.ts", "config")] == 2 and terms[("src/parseConfig.ts", "retries")] == 1
    assert [r.path for r in index.bm25(kept, ["parse"], ["path"]).collect()] == ["src/parseConfig.ts"]
    spark.createDataFrame([("b.py", "parse me")], "path string, text string").coalesce(1).write.mode("append").parquet(table)
    kept = index.kept_index(spark, table, _chunked(calls), ["path"])
    assert calls == [2, 1] and kept.segments == ["s000000", "s000001"] and kept.n_chunks == 3
    # what a build makes is part of the index's name
    other = index.kept_index(spark, table, lambda rows: _chunked(calls)(rows).withColumn("text", F.lit("same")), ["path"], "other")
    assert calls == [2, 1, 3] and {r.term for r in other.postings.collect()} >= {"same"} and "parse" not in {r.term for r in other.postings.where("path = 'b.py'").collect()}
    files.limit(1).coalesce(1).write.mode("overwrite").parquet(table)
    kept = index.kept_index(spark, table, _chunked(calls), ["path"])
    assert calls == [2, 1, 3, 1] and kept.n_chunks == 1


def test_index_of_long_chunks_and_of_none(spark, tmp_path):
    from siltstone.operators import index

    none, table = str(tmp_path / "none"), str(tmp_path / "t")
    empty = spark.createDataFrame([], "path string, text string")
    empty.write.parquet(none)
    kept = index.kept_index(spark, none, _chunked([]), ["path"])
    assert kept.n_chunks == 0 and _scores(kept, "a") == []
    spark.createDataFrame([("a.py", "word " * 5000 + "lastOne")], "path string, text string").write.parquet(table)
    kept = index.kept_index(spark, table, _chunked([]), ["path"])
    assert {r.term: r.tf for r in kept.postings.collect()}["word"] == 5000 and len(_scores(kept, "lastone")) == 1


def test_a_killed_build_goes_on_and_segments_merge(spark, tmp_path, monkeypatch):
    from siltstone.operators import index

    table = str(tmp_path / "t")
    rows = [(f"src/f{i}.py", f"alpha{i % 3} beta{i % 5} commonWord x{i}") for i in range(12)]
    for i in range(6):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], "path string, text string").coalesce(1).write.mode("append").parquet(table)
    calls = []
    with pytest.raises(Exception, match="killed"):
        index.kept_index(spark, table, _chunked(calls, failing={3}), ["path"], files_at_once=1)
    path = f"{index.index_root(spark, table, ['path'], '')}/1".replace("file:", "")
    path = path if os.path.exists(path) else path[:-1] + "0"
    before = {n: os.stat(f"{path}/segments/{n}/postings/_SUCCESS").st_mtime_ns for n in ("s000000", "s000001")}
    kept = index.kept_index(spark, table, _chunked(calls), ["path"], files_at_once=1)
    assert calls == [2] * 7 and kept.segments == [f"s{i:06d}" for i in range(6)]
    assert before == {n: os.stat(f"{path}/segments/{n}/postings/_SUCCESS").st_mtime_ns for n in before}
    whole = index.kept_index(spark, table, _chunked([]), ["path"], "at once")
    assert len(whole.segments) == 1 and _terms(whole) == _terms(kept) and (whole.n_chunks, whole.mean_terms) == (kept.n_chunks, kept.mean_terms)
    assert _scores(kept, "common", "alpha1") == _scores(whole, "common", "alpha1") and len(_scores(kept, "common")) == 12
    monkeypatch.setattr(index, "MOST_SEGMENTS", 4)
    index.merge_segments(spark, path, 4)
    merged = index.read_index(spark, path)
    assert len(merged.segments) == 3 and sum(n[0] == "m" for n in merged.segments) == 1 and _terms(merged) == _terms(whole)
    assert index.kept_index(spark, table, _chunked(calls), ["path"], files_at_once=1).segments == merged.segments and len(calls) == 7
    spark.createDataFrame([("new.py", "alpha1")], "path string, text string").coalesce(1).write.mode("append").parquet(table)
    again = index.kept_index(spark, table, _chunked(calls), ["path"], files_at_once=1)
    assert len(again.segments) == 4 and again.n_chunks == 13 and ("new.py:1", "alpha1", 1, 2) in _terms(again)


def test_nearest_over_blocks(spark, monkeypatch):
    import numpy as np

    from siltstone.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    r = np.random.default_rng(2)
    x = np.float32(r.normal(size=(120, 6)))
    x = np.float32(x / np.linalg.norm(x, axis=1)[:, None])
    x[5], x[9], x[30] = 0, x[8], x[8]
    rows = spark.createDataFrame([(f"k{i:03d}", i % 4, [float(c) for c in v]) for i, v in enumerate(x)], "id string, part int, embedding array<float>").repartition(3)
    queries = r.normal(size=(3, 6)).tolist() + [x[8].tolist(), [0.0] * 6]
    w, scales = vectors.eight_bits(x.astype(np.float64))
    scores = np.round((w @ vectors.unit_rows(queries).T) * scales[:, None], 4)
    want = {(q, f"k{i:03d}", i % 4, float(scores[i, q])) for q in range(5) for i in sorted(range(120), key=lambda i: (-scores[i, q], i))[:9]}
    blocks = vectors.vector_blocks(rows, ["id", "part"])
    assert {(a, b, c, d) for a, b, c, d in map(tuple, vectors.nearest(blocks, queries, 9).collect())} == want
    some = vectors.nearest(blocks, queries, 4, only=lambda k: k["part"] == 2).collect()
    inside = {(q, f"k{i:03d}") for q in range(5) for i in sorted(range(2, 120, 4), key=lambda i: (-scores[i, q], i))[:4]}
    assert {(r["query"], r.id) for r in some} == inside
    assert blocks.count() >= 120 // 7 and vectors.nearest(blocks.limit(0), queries, 3).count() == 0


def test_enclosing_symbols_of_nested_and_crossing_spans(spark):
    import random

    r = random.Random(8)
    symbols = [(f"f{i % 3}", f"s{i:02d}", r.randint(1, 30), None) for i in range(40)]
    symbols = [(p, n, line, None if r.random() < 0.1 else line + r.randint(0, 12)) for p, n, line, _ in symbols] + [(None, "none", 1, 40)]
    matches = [(f"f{i % 4}", r.randint(1, 45), f"t{i}") for i in range(120)] + [(None, 3, "x")]
    got = grep.enclosing_symbols(spark.createDataFrame(matches, "path string, line int, text string"), spark.createDataFrame(symbols, "path string, name string, line int, end_line int"))
    want = []
    for path, line, t in matches:
        around = [(s, n) for p, n, s, e in symbols if path is not None and p == path and s <= line <= (e or 2**31)]
        want.append((path, line, t, max(around)[1] if around else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_quantiles_against_percentile(spark):
    import random

    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.choice([0.0, 5.0, -3.0, None, r.expovariate(0.01), 1e12 * r.random()]), r.randint(0, 3)) for _ in range(700)]
    rows += [("c", 7.5, 4), ("d", None, 1), ("e", 2.0, 0)] + [("hot", 42.0, 1)] * 500 + [("hot", 1.0, 1), ("hot", 99.0, 1)]
    log = spark.createDataFrame(rows, "k string, duration_ms double, weight long")
    shares = (0.0, 0.1, 0.5, 0.95, 1.0)
    exact = [F.expr(f"percentile(duration_ms, {q}, weight)").alias(f"p{round(q * 100)}") for q in shares]
    for keys in (["k"], []):
        groups = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        got = metrics.with_quantiles(groups, log, keys, *shares)
        want = log.where("weight > 0").groupBy(*keys).agg(*exact)
        names = [*keys, *[f"p{round(q * 100)}" for q in shares]]
        cell = lambda x: round(x, 6) if isinstance(x, float) else x
        have = {tuple(map(cell, row)) for row in values(got, *names)}
        assert have >= {tuple(map(cell, row)) for row in values(want, *names)} and got.count() == groups.count()
        assert "percentile" not in got._jdf.queryExecution().toString()


def test_timers_on_a_hot_key_and_rows_out_of_order(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from siltstone.streaming import eviction, metrics as stream, throttle, timers

    r, start = random.Random(6), datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 11}", start + timedelta(seconds=r.choice([0, 1, 7]) * i * 20, microseconds=r.choice([0, 1500, 999])) ) for i in range(600)]
    rows += rows[:20] + [("end", start + timedelta(days=30))]
    r.shuffle(rows)
    spark.createDataFrame(rows, "k string, ts timestamp").repartition(3).write.parquet(str(tmp_path / "log"))
    live = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "log"))
    got = timers.with_state_on_disk(spark, lambda: stream.replayed(throttle.throttled(live, "k", seconds=600, limit=3), "append"))
    want = []
    for key in {k for k, _ in rows} - {"end"}:
        recent = []
        for t in sorted(t for k, t in rows if k == key):
            recent = [x for x in recent if x > t - timedelta(seconds=600)]
            want.append((key, t, len(recent) < 3, 0.0 if len(recent) < 3 else (recent[0] + timedelta(seconds=600) - t).total_seconds()))
            recent += [t] if len(recent) < 3 else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and {x[2] for x in want} == {True, False}
    gone = timers.with_state_on_disk(spark, lambda: stream.replayed(eviction.evictions(live, "k", days=0.01), "append"))
    ttl, want = timedelta(days=0.01), []
    for key in {k for k, _ in rows} - {"end"}:
        times = sorted(t for k, t in rows if k == key)
        want += [(key, t) for t, n in zip(times, [*times[1:], None], strict=True) if n is None or n >= t + ttl]
    assert sorted(map(tuple, gone.collect())) == sorted(want)
    # the last evictions of keys that weren't used again are the batch's answer
    batch = metrics.evicted(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], days=1)
    final = gone.groupBy("k").agg(F.max("last_access").alias("ts")).join(spark.createDataFrame(rows, "k string, ts timestamp").groupBy("k").agg(F.max("ts").alias("ts")), ["k", "ts"])
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, batch.collect()))


def test_archives_are_streamed(spark, tmp_path):
    import io
    import tarfile

    from siltstone.sources import archives

    noise = os.urandom(3_000_000)
    for name, top in (("a", "x"), ("b", "y")):
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as tar:
            for path, data in ((f"{top}/src/one.py", b"first"), (f"{top}/src/two.py", b"two"), (f"{top}/src/one.py", b"last"), (f"{top}/docs/a.md", b"text\n"), (f"{top}/big.bin", noise)):
                entry = tarfile.TarInfo(path)
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
    got = archives.archived_files(spark, str(tmp_path))
    assert sorted((r.path, bytes(r.content)) for r in got.where("path <> 'big.bin'").collect()) == sorted([("docs/a.md", b"text\n"), ("src/one.py", b"last"), ("src/two.py", b"two")] * 2)
    below = got.where("path LIKE 'src/%' AND path IN ('src/one.py', 'docs/a.md')").select("archive", "path")
    assert [r.path for r in below.collect()] == ["src/one.py"] * 2
    assert "StartsWith" not in below._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            data = super().read(size)
            Counted.n += len(data)
            return data

    stream = archives._Limited(Counted((tmp_path / "a.tar.gz").read_bytes()), "a.tar.gz", 100_000)
    with pytest.raises(ValueError, match="a.tar.gz has more than 100000 bytes"), tarfile.open(fileobj=stream, mode="r|gz") as tar:
        for _ in tar:
            pass
    assert Counted.n < 300_000
    with pytest.raises(Exception, match="has more than 100000 bytes"):
        archives.archived_files(spark, str(tmp_path), max_archive=100_000).count()
    files = spark.createDataFrame([(f"p{i}.py", "x" * i) for i in range(20)], "path string, text string").repartition(3)
    back = archives.archived_files(spark, archives.write_archives(files, str(tmp_path / "written")))
    assert sorted((r.path, r.size) for r in back.collect()) == sorted((f"p{i}.py", i) for i in range(20))


def test_pretty_json_and_markdown(spark):
    rows = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert {r.value for r in snapshots.as_pretty_json(rows).collect()} == {'{\n  "name" : "a|b",\n  "n" : 1\n}', '{\n  "name" : null,\n  "n" : 2\n}'}
    got = [r.value for r in snapshots.as_markdown(rows, "Report").orderBy("ord", "value").collect()]
    assert got == ["# Report", "", "| name | n |", "| --- | --- |", "|  | 2 |", "| a\\|b | 1 |"]


@pytest.mark.parametrize(
    "language,code,want",
    [
        ("typescript", "a = `x${f(`}`, {b: '}'})}y{` + 1", "a = f(, {b: }) + 1"),
        ("typescript", "a = b / c / d // e {", "a = b / c / d "),
        ("typescript", "x = /[/{]\\/'/g.test(y) /* { \n } */ { }", "x = .test(y) \n { }"),
        ("typescript", "return /{/; a = (1) / 2; '\\'{' {", "return ; a = (1) / 2;  {"),
        ("typescript", "`a\n${ {x: 1} }\nb` {", "\n {x: 1} \n {"),
        ("typescript", "'open { \n}", "\n}"),
        ("typescript", "/* open {\n{", "\n"),
        ("python", 'a = """x { \n " { """ + "{" # { \n b // c', "a = \n + \n b // c"),
        ("python", "a = '''{\n{''' + '#'", "a = \n + "),
        ("go", "a := `{\n\\` + '{' + \"{\\\"\" {", "a := \n +  +  {"),
        ("rust", "fn f<'a>(x: &'a str) -> char { '{' } // '", "fn f<'a>(x: &'a str) -> char {  } "),
        ("c", "#define A '{' \n x = a / b; \"{\"", "#define A  \n x = a / b; "),
        (None, "", ""),
    ],
)
def test_lexer(language, code, want):
    from siltstone.functions.lexer import blanked

    assert blanked(code, language).replace("  ", " ") == want.replace("  ", " ")
    assert blanked(code, language).count("\n") == code.count("\n")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab{}'\"`$/*\\\n#[]= ", max_size=60), st.sampled_from(["typescript", "python", "go", "rust", "c", None]))
def test_lexer_keeps_lines(code, language):
    from siltstone.functions.lexer import blanked

    got = blanked(code, language)
    assert got.count("\n") == code.count("\n") and len(got) <= len(code)
    plain = re.sub(r"[{}'\"`$/*\\#]", "", code)
    assert blanked(plain, language) == plain


def test_plain_texts_need_no_lexer(spark):
    from siltstone.functions.lexer import blanked

    texts = ["a = 1 // {\n b { 'x' }", 'c "}" /* \n{ */ d', "x`{\n}` y", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", outline.bare(F.col("t")).alias("b")).collect()
    assert all(r.b == blanked(r.t, "typescript") for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB-1 \u017f\u212ak", max_size=25), st.sampled_from(["abA", "a[ab]b|b1+a", "(ab|ba)-", "a?b{2,3}A", "[^a]bA", "ab.*ba", "^abA$", "(a(b|1)b)+", "\\\\babb", "a\\d1", "[a-b1]{3}", "(?:aab)?bba", "kkk", "sab", "a\\p{L}b", "ab("]), st.booleans())
def test_trigrams_never_exclude_a_match(text_, pattern, ignore_case):
    from siltstone.functions import trigrams

    condition = trigrams.required(pattern, ignore_case)
    try:
        matches = re.search(pattern, text_, re.IGNORECASE if ignore_case else 0) is not None
    except re.error:
        assert condition is None
        return
    own = trigrams.trigrams(trigrams.folded(text_))
    assert not matches or trigrams.holds(condition, lambda g: g in own)


def test_trigrams_that_patterns_need():
    from siltstone.functions.trigrams import required

    assert required("abc") == "abc" and required("ab") is None and required("a.c") is None
    assert required("abcd") == ("and", ["abc", "bcd"])
    assert required("abc|de") is None and required("abc|xyz") == ("or", ["abc", "xyz"])
    assert required("[Ll]ic") == "lic" and required("(abc)?xyz") == "xyz" and required("(abc)+xyz") == ("and", ["abc", "xyz"])


def test_line_index_reads_candidate_blocks(spark, tmp_path, monkeypatch):
    from siltstone.operators import line_index

    monkeypatch.setattr(line_index, "BLOCK_FILES", 4)
    rows = [(f"d{i % 5}/f{i:03d}.txt", f"line {i}\nplain words here\n" + ("Licensed under x{i}\n" if i % 37 == 0 else "") + ("kelvin \u212aey" if i == 50 else "")) for i in range(200)] + [("n", None), ("e", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    path = str(tmp_path / "lines")
    line_index.write_line_index(files, path)
    own = files.where("text IS NOT NULL")
    for needle, how in (("[Ll]icensed? under", {"regex": True}), ("under", {"word": True}), ("KEY", {"ignore_case": True}), ("kEY", {"regex": True, "ignore_case": True}), ("licensed", {}), ("a.", {"regex": True}), ("plain", {}), ("nowhere at all", {})):
        got, want = (sorted(map(tuple, df.collect())) for df in (line_index.indexed_grep(spark, path, needle, **how), grep.grep(own, needle, **how)))
        assert got == want, (needle, how)
    some = line_index.candidates(spark, path, "[Ll]icensed? under", regex=True)
    assert 6 <= some.count() <= 60 and line_index.candidates(spark, path, "plain").count() == 200
    monkeypatch.setattr(line_index, "MOST_RANGES", 1)
    assert line_index.candidates(spark, path, "[Ll]icensed? under", regex=True).count() == some.count()


def _traced_peak(monkeypatch, rows, build, batch):
    """Bytes of Python objects at once while the function that ``build`` sends to the workers goes over one Arrow batch."""
    sent = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: sent.append(f) or self.sparkSession.createDataFrame([], schema))
    build()
    monkeypatch.undo()
    tracemalloc.start()
    n = sum(part.num_rows for part in sent[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak


def test_terms_are_counted_in_bounded_memory(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(2000)] + [""] * 3
    ids = pa.array([str(i) for i in range(len(texts))])
    files = spark.createDataFrame([], "id string, path string, symbol string, text string")
    indexed = _traced_peak(monkeypatch, files, lambda: index.counted_terms(files, []), pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["id", "_t"]))
    posted = _traced_peak(monkeypatch, files, lambda: retrieval.postings(files, "id", F.col("text")), pa.RecordBatch.from_arrays([ids, pa.array([*texts[:-1], None])], names=["id", "_t"]))
    assert indexed[0] == posted[0] == 400_000
    # the whole batch at once takes 40 MB in the index
    assert indexed[1] < 20 << 20 and posted[1] < 20 << 20


def test_outline_reads_files_once(spark, tmp_path):
    samples.sources(spark).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    reads = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    symbols = outline.outline(files)
    assert reads(symbols) == 1 and reads(outline.members(files)) == 2
    assert reads(outline.leading_comments(files, symbols)) == 2 and reads(retrieval.chunks(files, symbols)) == 3


def test_regions_between_symbols(spark):
    files = spark.createDataFrame([("a.ts", "x\n" * 9), ("b.ts", "x\n" * 3), ("c.ts", "x\n" * 70), ("d.ts", "")], "path string, text string")
    symbols = spark.createDataFrame([("a.ts", "F", 2, 4), ("a.ts", "G", 4, 6), ("a.ts", "H", 8, None), ("b.ts", "K", 1, 3), ("e.ts", "L", 1, 2)], "path string, name string, line int, end_line int")
    got = sorted((r.path, r.start, r.end, r.kind, r.symbol) for r in retrieval._regions(files, symbols).collect())
    assert got == [("a.ts", 1, 1, "window", None), ("a.ts", 2, 3, "symbol", "F"), ("a.ts", 4, 6, "symbol", "G"), ("a.ts", 7, 9, "window", None), ("b.ts", 1, 3, "symbol", "K"), ("c.ts", 1, 70, "window", None)]

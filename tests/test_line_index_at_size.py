"""The line index: texts are shuffled once, in parts of bounded size."""

import glob

from siltstone.operators import grep, line_index


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    rows = [(f"d{i:03}/f", "\n".join([f"word{i % 7} the"] * (i % 3) + [f"x{i} lathe {i}", "public" if i % 10 == 0 else "y"])) for i in range(300)] + [("none", None), ("empty", "")]
    files, path = spark.createDataFrame(rows, "path string, text string"), str(tmp_path / "index")
    monkeypatch.setattr(line_index, "BLOCK_FILES", 4)
    monkeypatch.setattr(line_index, "TASK_BYTES", 800)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 400)  # blocks are cut
        line_index.write_line_index(files, path)
        assert len(glob.glob(f"{path}/texts/part-*")) > 4
        assert "Exchange" not in _plan(line_index._filters(spark.read.parquet(f"{path}/texts")))
        for ranges, sent in ((64, 1 << 20), (1, 1 << 20), (1, 0)):
            monkeypatch.setattr(line_index, "MOST_RANGES", ranges)
            monkeypatch.setattr(line_index, "MOST_SENT", sent)
            for needle, how in (("the", {"word": True}), ("public", {}), ("word[35] the|public", {"regex": True}), ("zebra", {})):
                got, want = line_index.indexed_grep(spark, path, needle, **how), grep.grep(files, needle, **how)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (ranges, sent, needle)
                assert "SortMergeJoin" not in _plan(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_block_read_by_two_tasks_has_two_filters(spark, monkeypatch):
    own = spark.createDataFrame([(7, "alpha"), (7, None), (7, "gamma"), (8, "")], "block long, text string").repartition(1)
    halves = own.union(own)
    got = sorted((r.block, bytes(r.filter)) for r in line_index._filters(halves).collect())
    assert [b for b, _ in got] == [7, 7, 8, 8] and got[0] == got[1]

"""Line dedup: documents probe perfect-hashed fingerprint and count arrays instead of joining lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.columns import kept_names, map_in_arrow, quoted, spare
from siltstone.llm.perfect_hash import Shards, shard_arrays, shard_of
from siltstone.llm.repeats import dealt
from siltstone.llm.storage import written

BLANK = b" \t\n\x0b\x0c\r"
KEYS_A_SHARD = 1 << 18
#: Lines that one shard is asked about, about: 28 bytes each, in one Python worker.
LINES_A_SHARD = 1 << 20
SHARD_SCHEMA = "shard long, n long, sizes binary, bits binary, rest binary, fingerprints binary, counts binary"


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """A 16-byte key for each line, b"" for those that stay anyway."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(BLANK).lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if key and long_enough else b"")
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``(h1 long, h2 long, n long)``: for each distinct line key, in how many rows it stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                found.update({k for k in _keys(text, min_chars) if k})
            h1, h2 = _halves(list(found))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(list(found.values()), pa.int64())], names=["h1", "h2", "n"])

    once = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "h1 long, h2 long, n long")
    return once.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def shard_table(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row of arrays for each shard of the line keys."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h1, h2, n = (table[c].to_numpy() for c in ("h1", "h2", "n"))
        arrays = shard_arrays(h1.view(np.uint64), h2.view(np.uint64), n)
        return pa.table({"shard": [key[0].as_py()], "n": [len(n)], **{k: pa.array([v], pa.binary()) for k, v in arrays.items()}})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column(0).to_numpy().view(np.uint64), n_shards)), *b.columns], names=["shard", "h1", "h2", "n"])

    return counts.mapInArrow(deal, "shard long, h1 long, h2 long, n long").groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", max_broadcast: int = 64 << 20) -> DataFrame:
    """Every row of ``docs`` with ``text_col`` rid of repeated lines, and ``n_lines`` and ``n_dropped`` (long).

    Lines are what ``\\n`` separates (a null or empty text is one empty line). A line's key is the line with
    ASCII white space stripped at both ends and A-Z lower-cased. A key of at least ``min_chars`` code points
    that stands in at least ``min_docs`` rows loses all its lines. Rows of equal id count as rows of their own.
    The other lines stay as they are, joined by ``\\n``; a null text comes back empty. Other columns stay, whatever
    their names; one named ``n_lines`` or ``n_dropped`` is replaced. An empty table gives an empty table.

    Keys are 128-bit hashes. Those of two rows or more go into shards: a minimal perfect hash on one half,
    behind it the other half as fingerprint and the count. The arrays are sent to the workers if they have
    at most ``max_broadcast`` bytes. Beyond that, lines are sent to the shards instead (28 bytes a line), in one
    pass whatever their number; but for the most frequent keys, whose arrays still go to all workers, so that no
    shard gets more than its share: there are as many shards as both the keys and the lines ask for.
    """
    counts = written(line_counts(docs, text_col, min_chars).where(F.col("n") >= min(2, min_docs)), "line-counts")
    size = counts.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    n_shards = max(1, -(-size["keys"] // KEYS_A_SHARD))
    shards = written(shard_table(counts, n_shards), "line-shards")
    total = shards.agg(F.coalesce(F.sum(F.length("bits") + F.length("rest") + F.length("fingerprints") + F.length("counts")), F.lit(0))).first()[0]
    names = kept_names(docs, ("n_lines", "n_dropped"))
    row, flags = spare(docs, "row", "flags")
    text = quoted([text_col])[0].cast("string").alias(text_col)
    rows = docs.select(*[text if c.lower() == text_col.lower() else quoted([c])[0] for c in names])
    spark = docs.sparkSession
    if total <= max_broadcast:
        sent = spark.sparkContext.broadcast((n_shards, [r.asDict() for r in shards.collect()]))
        return _cut(rows, text_col, None, min_docs, min_chars, sent)
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "line-rows")
    whole = F.coalesce(quoted([text_col])[0], F.lit(""))
    n_lines = rows.agg(F.coalesce(F.sum(1 + F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))), F.lit(0))).first()[0]
    if (asked_shards := -(-n_lines // LINES_A_SHARD)) > n_shards:
        n_shards = asked_shards
        shards = written(shard_table(counts, n_shards), "line-shards")
    # at most HOT_KEYS keys have so many rows
    hot = shard_table(counts.where(F.col("n") >= max(min_docs, size["rows"] // HOT_KEYS)), 1)
    sent = spark.sparkContext.broadcast((1, [r.asDict() for r in hot.collect()]))
    asked = _asked(rows.select(F.col(row).alias("row"), F.col(text_col).alias("text")), min_chars, n_shards, sent)
    found = asked.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(_answers(n_shards, min_docs), "row long, lines binary")
    found = found.groupBy(F.col("row").alias(row)).agg(F.collect_list("lines").alias(flags))
    return _cut(rows.join(found, row, "left").drop(row), text_col, flags, min_docs, min_chars, sent)


#: Keys with a larger share of all rows than one in so many are looked up by every worker.
HOT_KEYS = 50_000
_LINE = np.dtype([("h1", np.uint64), ("h2", np.uint64), ("row", np.int64), ("line", np.int32)])


def _asked(rows: DataFrame, min_chars: int, n_shards: int, hot) -> DataFrame:
    """``(shard, lines)``: blobs of the lines that a shard must tell about."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shards(*hot.value)
        for batch in batches:
            own = [(k, r, i) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, k in enumerate(_keys(t, min_chars)) if k]
            lines = np.zeros(len(own), _LINE)
            lines["h1"], lines["h2"] = _halves([k for k, _, _ in own])
            lines["row"], lines["line"] = [r for _, r, _ in own], [i for _, _, i in own]
            lines = lines[known.count(lines["h1"], lines["h2"]) == 0]
            blobs = dealt(lines, shard_of(lines["h1"], n_shards), 0)
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[2] for b in blobs], pa.binary())], names=["shard", "lines"])

    return rows.mapInArrow(ask, "shard long, lines binary")


def _answers(n_shards: int, min_docs: int):
    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        lines = np.frombuffer(b"".join(asked["lines"].to_pylist()), _LINE)
        if shard.num_rows:
            lines = lines[Shards(n_shards, shard.to_pylist()).count(lines["h1"], lines["h2"]) >= min_docs]
        else:
            lines = lines[:0]
        lines = lines[np.argsort(lines["row"], kind="stable")]
        first = np.flatnonzero(np.append(True, lines["row"][1:] != lines["row"][:-1])) if len(lines) else np.zeros(0, np.int64)
        each = [x.tobytes() for x in np.split(lines["line"], first[1:])] if len(lines) else []
        return pa.table({"row": pa.array(lines["row"][first], pa.int64()), "lines": pa.array(each, pa.binary())})

    return answer


def _cut(rows: DataFrame, text_col: str, flags: str | None, min_docs: int, min_chars: int, sent) -> DataFrame:
    """The rows without the lines that the sent arrays count ``min_docs`` times, or that ``flags`` has (lists of line numbers)."""
    at = rows.columns.index(text_col)
    at_flags = rows.columns.index(flags) if flags else None
    kept = [f for f in rows.schema.fields if f.name != flags]
    schema = T.StructType([*kept, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(*sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keys = [_keys(t, min_chars) for t in texts]
            some = [k for ks in keys for k in ks if k]
            repeated = iter((shards.count(*_halves(some)) >= min_docs).tolist())
            drop = [[bool(k) and next(repeated) for k in ks] for ks in keys]
            if at_flags is not None:
                for own, lists in zip(drop, batch.column(at_flags).to_pylist(), strict=True):
                    for i in np.frombuffer(b"".join(lists or []), np.int32).tolist():
                        own[i] = True
            columns = list(batch.columns)
            columns[at] = pa.array(["\n".join(x for x, d in zip(t.split("\n"), own, strict=True) if not d) if any(own) else t for t, own in zip(texts, drop, strict=True)], pa.string())
            if at_flags is not None:
                del columns[at_flags]
            columns += [pa.array([len(f) for f in drop], pa.int64()), pa.array([sum(f) for f in drop], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_in_arrow(rows, cut, schema)

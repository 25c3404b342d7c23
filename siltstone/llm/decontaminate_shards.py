"""Decontamination by more windows than can be sent to every worker: one pass over the documents, whatever their number.

Windows are dealt into shards by their prefix shingle. Where a text has a shingle that the filter of all prefixes lets
pass, the words around it go to that shard, and are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels
from siltstone.llm.jaccard_join import COUNTER_PART, n_gram_ranks
from siltstone.llm.repeats import dealt, repeat_filter
from siltstone.llm.storage import text_size, written

#: Counters of shingles, as bits: 16 MB in a worker that counts, 4 MB in one that reads.
COUNTER_BITS = 22
#: A prefix's places are dealt over so many shards, so that one that many texts hold isn't one task's.
SALTS = 16
BUCKET_BYTES, BUCKET_TEXT = 16 << 20, 256 << 20
_SHARD = "bucket int, kind int, rows binary, items array<string>"


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, word hashes, where each text's begin)`` of blocks of texts."""
    data, at = kernels.laid_out(column)
    for a, b in kernels.blocks(at):
        _, _, h, first = kernels.words(data[at[a] : at[b]], at[a : b + 1] - at[a], kernels.ALNUM)
        yield a, h, first


def _places(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shingle, position, text)`` of shingles that lie within a text."""
    s = kernels.shingles(h, width)
    text = np.searchsorted(first, np.arange(len(s)), side="right") - 1
    ok = np.flatnonzero(np.arange(len(s)) + width <= first[text + 1])
    return s[ok], ok, text[ok]


def _ranks(rows: DataFrame, widths: list[int]) -> np.ndarray:
    """About how often a shingle stands in all texts: a byte for each hashed counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            for _, h, first in _words(batch.column(0)):
                for w in widths:
                    np.add.at(counts, (_places(h, first, w)[0] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        parts = counts.reshape(-1, 1 << COUNTER_PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x.tobytes() for x in parts[some]], pa.binary())], names=["part", "counts"])

    return n_gram_ranks(rows.select("text").mapInArrow(count, "part int, counts binary"), COUNTER_BITS)


def _window_rows(size: int) -> np.dtype:
    return np.dtype([("h", np.uint64), ("offset", np.int32), ("size", np.int32), ("words", np.uint64, (size,))])


def _context_rows(size: int) -> np.dtype:
    return np.dtype([("h", np.uint64), ("row", np.int64), ("pos", np.int64), ("after", np.int64), ("words", np.uint64, (2 * size - 1,))])


def _bucket(h: np.ndarray, salt: np.ndarray | int, n_buckets: int) -> np.ndarray:
    return (kernels.mix(h + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(salt).astype(np.uint64) + np.uint64(1))) % np.uint64(n_buckets)).astype(np.int64)


def shard_hits(rows: DataFrame, windows: DataFrame, window: int, shingle: int) -> DataFrame:
    """``(row, n_hit, items)`` of the ``(row, text)`` rows that hold any of the ``(items, words)`` windows."""
    spark = rows.sparkSession
    n_windows, (_, n_bytes) = windows.count(), text_size(rows)
    widths = list(range(1, min(window, shingle) + 1))
    own, around = _window_rows(window), _context_rows(window)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_windows * SALTS * own.itemsize // BUCKET_BYTES, n_bytes // BUCKET_TEXT)
    ranks = spark.sparkContext.broadcast(_ranks(rows, widths))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, out = [], []
            for blob in batch.column("words").to_pylist():
                words = np.frombuffer(blob, np.uint64)
                s = kernels.shingles(words, min(len(words), shingle))
                at = int(np.lexsort((s, ranks.value[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))[0])  # by rarity, ties by hash
                row = np.zeros(1, own)
                row["h"], row["offset"], row["size"], row["words"][0, : len(words)] = s[at], at, len(words), words
                h.append(int(s[at]))
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(out, pa.binary()), batch.column("items")], names=["h", "rows", "items"])

    prefixes = written(windows.select("words", "items").mapInArrow(chosen, "h long, rows binary, items array<string>"), "prefixes")
    doubled = lambda batch: np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)
    passing = spark.sparkContext.broadcast(repeat_filter(prefixes.select("h"), doubled, 8 * n_windows, n_buckets))

    def dealt_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            for salt in range(SALTS):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(h, salt, n_buckets), pa.int32()), pa.array(np.zeros(len(h)), pa.int32()), batch.column("rows"), batch.column("items")], names=["bucket", "kind", "rows", "items"])

    def dealt_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for a, h, first in _words(batch.column(1)):
                padded = np.concatenate([np.zeros(window - 1, np.uint64), h, np.zeros(window - 1, np.uint64)])
                for w in widths:
                    s, pos, text = _places(h, first, w)
                    ok = passing.value.passes(s)
                    s, pos, text = s[ok], pos[ok], text[ok]
                    out = np.zeros(len(s), around)
                    out["h"], out["row"], out["pos"], out["after"] = s, number[a + text], pos - first[text], first[text + 1] - pos
                    out["words"] = padded[pos[:, None] + np.arange(2 * window - 1)]
                    blobs = dealt(out, _bucket(s, kernels.mix(out["row"].view(np.uint64)) % np.uint64(SALTS), n_buckets), 1)
                    if blobs:
                        bucket, kind, blob = zip(*blobs, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary()), pa.nulls(len(blob), pa.list_(pa.string()))], names=["bucket", "kind", "rows", "items"])

    def verified(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        blobs, items = table["rows"].to_pylist(), table["items"].to_pylist()
        wanted = np.frombuffer(b"".join(b for b, k in zip(blobs, kind, strict=True) if k == 0), own)
        of = [i for i, k in zip(items, kind, strict=True) if k == 0]
        places = np.frombuffer(b"".join(b for b, k in zip(blobs, kind, strict=True) if k == 1), around)
        order = np.argsort(wanted["h"], kind="stable")
        keys = wanted["h"][order]
        lo, hi = np.searchsorted(keys, places["h"], "left"), np.searchsorted(keys, places["h"], "right")
        p = np.repeat(np.arange(len(places)), hi - lo)
        w = order[np.repeat(lo, hi - lo) + np.arange(len(p)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        begin, size = places["pos"][p] - wanted["offset"][w], wanted["size"][w]
        ok = (begin >= 0) & (size - wanted["offset"][w] <= places["after"][p])
        for k in range(window):
            i = np.flatnonzero(ok & (k < size))
            ok[i] = places["words"][p[i], window - 1 - wanted["offset"][w[i]] + k] == wanted["words"][w[i], k]
        p, w = p[ok], w[ok]
        return pa.table({"row": pa.array(places["row"][p], pa.int64()), "start": pa.array(begin[ok], pa.int64()), "size": pa.array(size[ok], pa.int64()), "items": pa.array([of[i] for i in w], pa.list_(pa.string()))})

    both = prefixes.mapInArrow(dealt_windows, _SHARD).unionByName(rows.select("row", "text").mapInArrow(dealt_places, _SHARD))
    hits = both.groupBy("bucket").applyInArrow(verified, "row long, start long, size long, items array<string>")
    each = hits.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for spans in batch.column(1).to_pylist():
                upto = total = 0
                for start, end in sorted((s["start"], s["start"] + s["size"]) for s in spans):
                    total += max(0, end - max(start, upto))
                    upto = max(upto, end)
                n.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["row", "n_hit", "items"])

    return each.mapInArrow(covered, "row long, n_hit long, items array<string>")

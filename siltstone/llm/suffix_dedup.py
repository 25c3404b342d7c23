"""Suffix-array dedup: a radix sort of suffixes by most significant digits, no deeper than the threshold.

A window is ``length`` bytes from a suffix's start. Equal windows are found in passes, each over a longer
digit, and what stands alone after a pass takes no part in the next:

1. The suffixes at anchors alone are sorted by their first ``GRAM`` bytes. An anchor is the place of a
   window's smallest gram hash, so equal windows have equal anchors at equal offsets, and one suffix in
   forty stands for all others. Consecutive windows with one anchor are a run.
2. Runs of repeated anchors are sorted by all bytes that their windows cover. Where a run is equal to that
   of a smaller document, all of its windows are repeats. The first of equal runs goes on if its anchor has
   other runs as well.
3. Their windows are sorted by the bytes that eight neighbours share, and by the few that set them apart.

No pass keeps positions of all suffixes; passes 1 and 2 see at most two rows of a key from each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernels
from siltstone.llm.columns import quoted
from siltstone.llm.ids import are_numbers, id_numbers, with_numbers
from siltstone.llm.repeats import DEALT, RepeatFilter, blob_batch, dealt, read_blobs, repeat_filter
from siltstone.llm.storage import text_size, written

GRAM = 24
NEIGHBOURS = 8
BUCKET_BYTES = 16 << 20
BLOCK = 1 << 17
_PLACE = np.uint64((1 << 21) - 1)
_ROW = np.dtype([("ga", np.uint64), ("hs", np.uint64), ("doc", np.int64), ("row", np.int64), ("run", np.int32)])
_FLAG = np.dtype([("row", np.int64), ("run", np.int32)])
_CORE = np.dtype([("core", np.uint64), ("doc", np.int64), ("row", np.int64), ("at", np.int32), ("mask", np.uint8), ("near", np.uint8, 2 * (NEIGHBOURS - 1))])
#: Rows that a task brings together before it sends on the first of equal ones.
COMBINED = 1 << 18
LAST_ID = 2**63 - 1


class Runs:
    """Runs of one batch: text, number in the text, first and last window start, anchor (all in the text's bytes), and both keys."""

    def __init__(self, text, lo, hi, anchor, ga, hs):
        self.text, self.lo, self.hi, self.anchor, self.ga, self.hs = text, lo, hi, anchor, ga, hs
        first = np.searchsorted(text, text, side="left")
        self.number = np.arange(len(text)) - first

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray, length: int) -> Runs:
        found = []
        for a, b in kernels.blocks(at, BLOCK):
            if b == a + 1 and at[b] - at[a] > 2 * BLOCK:
                for p in range(0, int(at[b] - at[a]) - length + 1, BLOCK):
                    piece = data[at[a] + p : min(at[a] + p + BLOCK + length - 1, at[b])]
                    found.append(_block_runs(piece, np.array([0, len(piece)]), length, a, p))
            else:
                found.append(_block_runs(data[at[a] : at[b]], at[a : b + 1] - at[a], length, a, 0))
        return cls(*[np.concatenate(c) for c in zip(*found, strict=True)]) if found else cls(*[np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2])


def _block_runs(data: np.ndarray, at: np.ndarray, length: int, first_text: int, shift: int) -> tuple[np.ndarray, ...]:
    n = len(data) - length + 1
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    if n <= 0:
        return none
    sums = kernels.prefix_hash(data)
    places = np.arange(len(data) - GRAM + 1)
    gram = kernels.mix((sums[GRAM:] - sums[:-GRAM]) * kernels.powers(places, inverse=True))
    least = (gram & ~_PLACE) | places.astype(np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a >= length] or [np.zeros(0, np.int64)])
    if not len(start):
        return none
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, anchor = start[first], start[np.append(first[1:], len(start)) - 1], anchor[first]
    hs = kernels.mix(kernels.substring_hash(sums, lo, hi + length) + (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
    text = np.searchsorted(at, lo, side="right") - 1
    base = at[text] - shift
    ga = kernels.mix(gram[anchor] ^ np.uint64(0xD6E8FEB86659FD93))
    return text + first_text, lo - base, hi - base, anchor - base, ga, hs


def sorted_runs(texts: DataFrame, length: int, n_buckets: int, repeated: RepeatFilter) -> DataFrame:
    """``kind`` 0: blobs of runs that a smaller document has; else a row ``(ga, row, run)`` for a first run."""
    sent = texts.sparkSession.sparkContext.broadcast(repeated)
    schema = "kind int, bucket int, rows binary, ga long, row long, run int"

    def own_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            r = Runs.of(*kernels.laid_out(batch.column(2)), length)
            some = np.flatnonzero(sent.value.passes(r.ga))
            rows = np.zeros(len(some), _ROW)
            rows["ga"], rows["hs"], rows["run"] = r.ga[some], r.hs[some], r.number[some]
            rows["doc"], rows["row"] = batch.column(0).to_numpy()[r.text[some]], batch.column(1).to_numpy()[r.text[some]]
            yield rows

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(own_runs(batches)):
            rows = rows[np.lexsort((rows["run"], rows["row"], rows["doc"], rows["hs"], rows["ga"]))]
            rows = rows[_starts(rows, "ga", "hs", "doc", "row")]  # a text's later equal runs are its own affair
            yield blob_batch(_split_first(rows, n_buckets))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = read_blobs(table, _ROW, 1)
        rows = rows[np.lexsort((rows["doc"], rows["hs"], rows["ga"]))]
        least = rows["doc"][_group_start(_starts(rows, "ga", "hs"))]
        first, later = rows[rows["doc"] == least], rows[rows["doc"] > least]
        flags = np.concatenate([read_blobs(table, _FLAG, 0), _flags(later)])
        blobs = dealt(flags, _bucket_of_row(flags["row"], n_buckets), 0)
        n = len(blobs)
        empty = lambda t, k: pa.nulls(k, t)
        return pa.table(
            {
                "kind": pa.array([0] * n + [1] * len(first), pa.int32()),
                "bucket": pa.concat_arrays([pa.array([b[0] for b in blobs], pa.int32()), empty(pa.int32(), len(first))]),
                "rows": pa.concat_arrays([pa.array([b[2] for b in blobs], pa.binary()), empty(pa.binary(), len(first))]),
                "ga": pa.concat_arrays([empty(pa.int64(), n), pa.array(first["ga"].view(np.int64) if len(first) else [], pa.int64())]),
                "row": pa.concat_arrays([empty(pa.int64(), n), pa.array(first["row"], pa.int64())]),
                "run": pa.concat_arrays([empty(pa.int32(), n), pa.array(first["run"], pa.int32())]),
            }
        )

    return texts.select("_doc", "_row", "_text").mapInArrow(runs, DEALT).groupBy("bucket").applyInArrow(compare, schema)


def _together(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same rows in arrays of about ``COMBINED``."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(len(x) for x in held) >= COMBINED:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _starts(rows: np.ndarray, *keys: str) -> np.ndarray:
    """Where a new key begins in sorted rows."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return new


def _group_start(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


def _flags(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), _FLAG)
    for k in _FLAG.names:
        out[k] = rows[k]
    return out


def _bucket_of_row(row: np.ndarray, n_buckets: int) -> np.ndarray:
    return (kernels.mix(row.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def _split_first(rows: np.ndarray, n_buckets: int) -> list[tuple[int, int, bytes]]:
    """Of a task's equal runs the smallest document's go on; the others are repeats already."""
    least = rows["doc"][_group_start(_starts(rows, "ga", "hs"))]
    on, later = rows[rows["doc"] == least], _flags(rows[rows["doc"] > least])
    key = kernels.mix(on["ga"] + kernels.mix(on["hs"]))
    return dealt(on, (key % np.uint64(n_buckets)).astype(np.int64), 1) + dealt(later, _bucket_of_row(later["row"], n_buckets), 0)


def _cores(r: Runs, chosen: np.ndarray, data: np.ndarray, at: np.ndarray, doc: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """For the chosen runs: a row for each aligned group of neighbouring windows."""
    far, near = r.anchor[chosen] - r.lo[chosen], r.anchor[chosen] - r.hi[chosen]
    n = far // NEIGHBOURS - near // NEIGHBOURS + 1
    run = np.repeat(chosen, n)
    j = np.repeat(near // NEIGHBOURS, n) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.zeros(len(run), _CORE)
    rows["doc"], rows["row"] = doc[r.text[run]], row[r.text[run]]
    begin = r.anchor[run] - j * NEIGHBOURS  # the core's first byte in its text; it is length - NEIGHBOURS + 1 bytes long
    rows["at"] = begin
    offsets = r.anchor[run][:, None] - begin[:, None] + np.arange(NEIGHBOURS)
    valid = (offsets >= (r.anchor[run] - r.hi[run])[:, None]) & (offsets <= (r.anchor[run] - r.lo[run])[:, None])
    rows["mask"] = np.packbits(valid, axis=1, bitorder="little")[:, 0]
    absolute, size = at[r.text[run]] + begin, length - NEIGHBOURS + 1
    core = np.zeros(len(run), np.uint64)
    for a in range(0, len(run), 1 << 14):
        part = absolute[a : a + (1 << 14)]
        core[a : a + len(part)] = _hash_rows(data[part[:, None] + np.arange(size)])
    rows["core"] = kernels.mix(core + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    side = NEIGHBOURS - 1
    around = np.concatenate([absolute[:, None] - side + np.arange(side), absolute[:, None] + size + np.arange(side)], axis=1)
    rows["near"] = data[np.clip(around, 0, len(data) - 1)]
    return rows


def _hash_rows(b: np.ndarray) -> np.ndarray:
    return (kernels.BYTE_VALUE[b] * kernels.powers(np.arange(b.shape[1]))).sum(axis=1, dtype=np.uint64)


def _later_windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags for windows that an earlier row has; and the mask of windows, by row, that none has."""
    side, found, left = NEIGHBOURS - 1, [], rows["mask"].copy()
    for i in range(NEIGHBOURS):
        own = np.flatnonzero(rows["mask"] & np.uint8(1 << i))
        if not len(own):
            continue
        part = rows[own]
        # i bytes before the core, and the rest behind it
        key = kernels.mix(_hash_rows(part["near"][:, side - i : 2 * side - i]) + part["core"])
        order = np.lexsort((part["at"], part["row"], part["doc"], key))
        key, doc, row = key[order], part["doc"][order], part["row"][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part["core"][order][1:] != part["core"][order][:-1])
        own_first = new.copy()
        own_first[1:] |= row[1:] != row[:-1]
        later = (doc > doc[_group_start(new)]) | ~own_first
        at = own[order[later]]
        left[at] &= np.uint8(0xFF ^ (1 << i))
        flags = np.zeros(len(at), _FLAG)
        flags["row"], flags["run"] = rows["row"][at], rows["at"][at] - i
        found.append(flags)
    return np.concatenate(found) if found else np.zeros(0, _FLAG), left


def _flag_lists(flags: DataFrame, name: str) -> DataFrame:
    """Blobs of flags, each of one bucket of rows, as a list of runs or window starts for each row."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), _FLAG)
            rows = rows[np.lexsort((rows["run"], rows["row"]))]
            first = np.flatnonzero(_starts(rows, "row"))
            each = [x.tobytes() for x in np.split(rows["run"], first[1:])] if len(rows) else []
            yield pa.RecordBatch.from_arrays([pa.array(rows["row"][first]), pa.array(each, pa.binary())], names=["_row", name])

    parts = flags.select("rows").mapInArrow(lists, f"_row long, {name} binary")
    return parts.groupBy("_row").agg(F.collect_list(name).alias(name))


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, spans, kept)`` for every row.

    Every byte goes that a string of ``length`` bytes covers which also starts earlier: in a row of smaller id,
    or before in the same text. ``spans`` are the maximal removed runs as byte offsets (array of
    ``start, end``), ``kept`` the remaining bytes; removal can cut a character, so they are binary. Null and
    empty texts and those under ``length`` bytes are kept whole. A null id counts as larger than all others.
    Rows of equal id do not count against each other, whether their texts are equal or not. An empty table
    gives an empty table; other columns are not read. ``length`` is at least 64. Ids may be of any type that has an
    order; those that aren't integers are numbered in that order first.
    """
    if length < 64:
        raise ValueError("length must be at least 64 bytes")
    spark = docs.sparkSession
    given = docs.select(quoted([id_col])[0].alias("id"), quoted([text_col])[0].alias("text"))
    given = given.withColumn("number", F.col("id").cast("long")) if are_numbers(docs, id_col) else with_numbers(given, id_numbers(docs, id_col))
    own_id, text = F.coalesce("number", F.lit(LAST_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A number of its own for each row, fixed by the table that it is written to; ids may be null or repeated.
    texts = given.select(F.col("id").alias("_id"), own_id.alias("_doc"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    texts = written(texts, "suffix-texts")
    _, n_bytes = text_size(texts, "_text")
    expected = max(1, n_bytes * 2 // (length - GRAM + 2))
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected * _ROW.itemsize // BUCKET_BYTES))

    repeated = repeat_filter(texts.select("_text"), lambda batch: Runs.of(*kernels.laid_out(batch.column(0)), length).ga, expected, n_buckets)
    runs = written(sorted_runs(texts, length, n_buckets, repeated), "runs")
    firsts = runs.where("kind = 1").select("ga", F.col("row").alias("_row"), "run")
    several = firsts.groupBy("ga").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ga")
    on = firsts.join(several, "ga").groupBy("_row").agg(F.collect_list("run").alias("_check"))
    later = _flag_lists(runs.where("kind = 0"), "_later")

    def own_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            data, at = kernels.laid_out(batch.column(2))
            r = Runs.of(data, at, length)
            first = np.searchsorted(r.text, np.arange(len(batch)))
            chosen = np.concatenate([first[i] + np.array(c, np.int64) for i, c in enumerate(batch.column(3).to_pylist())]) if len(batch) else np.zeros(0, np.int64)
            yield _cores(r, np.sort(chosen), data, at, batch.column(0).to_numpy(), batch.column(1).to_numpy(), length)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(own_cores(batches)):
            flags, rows["mask"] = _later_windows(rows)
            rows = rows[rows["mask"] != 0]
            yield blob_batch(dealt(rows, (rows["core"] % np.uint64(n_buckets)).astype(np.int64), 1) + dealt(flags, _bucket_of_row(flags["row"], n_buckets), 0))

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = read_blobs(table, _CORE, 1)
        _, group, n = np.unique(rows["core"], return_inverse=True, return_counts=True)
        flags = np.concatenate([read_blobs(table, _FLAG, 0), _later_windows(rows[n[group] > 1])[0]])
        blobs = dealt(flags, _bucket_of_row(flags["row"], n_buckets), 0)
        return pa.table({"rows": pa.array([b[2] for b in blobs], pa.binary())})

    # Both joins ask for the same columns and rows of the texts, so that one shuffle of them serves both.
    texts = texts.where(F.col("_row").isNotNull())
    open_ = texts.join(on, "_row").select("_doc", "_row", "_text", "_check", "_id")
    checked = open_.mapInArrow(cores, DEALT).groupBy("bucket").applyInArrow(windows, "rows binary")
    singles = _flag_lists(checked, "_windows")
    rows = texts.join(later, "_row", "left").join(singles, "_row", "left").select("_id", "_text", "_later", "_windows", "_doc")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = kernels.laid_out(batch.column(1))
            r = Runs.of(data, at, length)
            first = np.searchsorted(r.text, np.arange(len(batch) + 1))
            n, spans, kept = [], [], []
            for i, (later_, windows_) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = slice(first[i], first[i + 1])
                size = int(at[i + 1] - at[i])
                gone = _removed(r.ga[own], r.hs[own], _joined(later_))
                lo, hi = np.append(r.lo[own][gone], s := _joined(windows_)), np.append(r.hi[own][gone], s)
                edge = np.zeros(size + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
                n.append((size, int(covered.sum()), len(turn) // 2))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                kept.append(data[at[i] : at[i + 1]][~covered].tobytes())
            counts = [pa.array([x[k] for x in n], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=schema.names)

    return rows.mapInArrow(cut, schema)


def _joined(lists: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(lists or []), np.int32).astype(np.int64)


def _removed(ga: np.ndarray, hs: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Which of a text's runs go: those equal to a flagged run, and all but the first of equal ones."""
    if not len(ga):
        return np.zeros(0, bool)
    _, first, group = np.unique(kernels.mix(ga + kernels.mix(hs)), return_index=True, return_inverse=True)
    gone = np.arange(len(ga)) != first[group]
    flagged = np.zeros(len(first), bool)
    flagged[group[later]] = True
    return gone | flagged[group]

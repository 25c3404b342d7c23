"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Containment of a whole window asks for all of its shingles, so one necessary shingle is prefix enough:
the rarest over all documents. Documents are joined on these alone, positions bound where a window can
begin, and what is left is verified word by word over the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import kernels
from siltstone.llm.columns import kept_names, map_in_arrow, quoted, spare
from siltstone.llm.decontaminate_shards import shard_hits
from siltstone.llm.storage import written

#: Windows that every worker may get (about 200 bytes each).
MOST_SENT = 200_000
_SIEVE = np.uint64((1 << 22) - 1)


def _shingle_width(length: int, shingle: int) -> int:
    return min(length, shingle)


def _sieve(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(_SIEVE) + 1, bool)
    out[(hashes & _SIEVE).astype(np.int64)] = True
    return out


def _looked_up(h: np.ndarray, table: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of what the sorted ``table`` has, and the table's indices."""
    at = np.flatnonzero(sieve[(h & _SIEVE).astype(np.int64)])
    i = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
    ok = table[i] == h[at]
    return at[ok], i[ok]


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``(items array<string>, words binary)``: distinct windows, as word hashes, and the items that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            data, at = kernels.laid_out(batch.column(1))
            _, _, h, first = kernels.words(data, at, kernels.ALNUM)
            for item, a, b in zip(batch.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                if item is not None and b > a:
                    size = min(window, b - a)
                    cuts = {h[i : i + size].tobytes() for i in range(a, b - size + 1)}
                    items += [item] * len(cuts)
                    windows += cuts
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], names=["item", "words"])

    cuts = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(cut, "item string, words binary")
    return cuts.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _each_shingle(words: np.ndarray, shingle: int) -> np.ndarray:
    return kernels.shingles(words, _shingle_width(len(words), shingle))


def shingle_frequencies(docs: DataFrame, text_col: str, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each wanted shingle (sorted hashes by width) stands in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {w: np.zeros(len(t), np.int64) for w, t in sent.value.items()}
        sieves = {w: _sieve(t) for w, t in sent.value.items()}
        for batch in batches:
            data, at = kernels.laid_out(batch.column(0))
            for a, b in kernels.blocks(at):
                _, _, h, first = kernels.words(data[at[a] : at[b]], at[a : b + 1] - at[a], kernels.ALNUM)
                for w, t in sent.value.items():
                    pos, i = _looked_up(kernels.shingles(h, w), t, sieves[w])
                    text = np.searchsorted(first, pos, side="right") - 1
                    i = i[pos + w <= first[text + 1]]
                    sums[w] += np.bincount(i, minlength=len(t))
        for w, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), w)), pa.array(some), pa.array(n[some])], names=["w", "i", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "w long, i long, n long").groupBy("w", "i").agg(F.sum("n").alias("n"))
    out = {w: np.zeros(len(t), np.int64) for w, t in wanted.items()}
    for r in found.toLocalIterator():  # at most one row for each shingle sent
        out[r["w"]][r["i"]] = r["n"]
    return out


@dataclass
class Prefixes:
    """Windows of one length, in order of their prefix shingle."""

    width: int
    shingles: np.ndarray  # distinct prefix shingles, sorted
    first: np.ndarray  # where each one's windows begin
    offset: np.ndarray  # of the prefix shingle in its window
    words: np.ndarray  # windows x length
    items: list[list[str]]


def _prefixes(windows: list[tuple[np.ndarray, list[str]]], shingle: int, wanted: dict[int, np.ndarray], frequency: dict[int, np.ndarray]) -> list[Prefixes]:
    out = []
    for length in sorted({len(w) for w, _ in windows}):
        own = [(w, items) for w, items in windows if len(w) == length]
        width = _shingle_width(length, shingle)
        keyed = []
        for w, items in own:
            h = _each_shingle(w, shingle)
            n = frequency[width][np.searchsorted(wanted[width], h)]
            at = int(np.lexsort((h, n))[0])  # by rarity, ties by hash
            keyed.append((int(h[at]), at, w, items))
        keyed.sort(key=lambda x: x[:2])
        h = np.array([k[0] for k in keyed], np.uint64)
        distinct, first = np.unique(h, return_index=True)
        out.append(Prefixes(width, distinct, np.append(first, len(h)), np.array([k[1] for k in keyed]), np.stack([k[2] for k in keyed]), [k[3] for k in keyed]))
    return out


def _occurrences(h: np.ndarray, first: np.ndarray, p: Prefixes, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of each occurrence."""
    pos, i = _looked_up(kernels.shingles(h, p.width), p.shingles, sieve)
    n = p.first[i + 1] - p.first[i]
    pos, before = np.repeat(pos, n), np.repeat(np.cumsum(n) - n, n)
    window = np.repeat(p.first[i], n) + np.arange(len(pos)) - before
    start, length = pos - p.offset[window], p.words.shape[1]
    text = np.searchsorted(first, pos, side="right") - 1
    ok = (start >= first[text]) & (start + length <= first[text + 1])
    text, start, window = text[ok], start[ok], window[ok]
    for k in range(length):
        same = h[start + k] == p.words[window, k]
        text, start, window = text[same], start[same], window[same]
    return text, start, window


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit`` (long) and ``items`` (array of strings, sorted).

    Words are runs of ASCII letters, digits and non-ASCII text, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or all words of a shorter item. ``n_hit`` counts the words of a row that
    lie inside any occurrence of a window, ``items`` names the items with such windows. A null or empty text
    has no words; an item of null id, null text or no words has no windows; an item given twice counts once.
    Equal documents are rows of their own. Other columns stay, whatever their names; columns named as a new one
    are replaced. Empty tables on either side give no hits.

    Up to ``most_sent`` windows are sent to the workers. More are dealt into shards, to which the documents' words around
    their prefix shingles go, in one pass over a numbered copy of the rows; what is hit meets the copy at the end.
    """
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, window, item_col, item_text_col), "windows")
    names = kept_names(docs, RESULTS)
    row, text = spare(docs, "row", "text")
    rows = docs.select(*quoted(names), F.coalesce(quoted([text_col])[0].cast("string"), F.lit("")).alias(text))
    if windows.count() > most_sent:
        rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "leak-rows")
        found = shard_hits(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), windows, window, shingle)
        out = rows.join(found.select(F.col("row").alias(row), "n_hit", "items"), row, "left")
        return out.select(*quoted(names), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    own = [(np.frombuffer(r["words"], np.uint64), r["items"]) for r in windows.collect()]  # most_sent rows at most
    wanted: dict[int, np.ndarray] = {}
    for width in {_shingle_width(len(w), shingle) for w, _ in own}:
        wanted[width] = np.unique(np.concatenate([_each_shingle(w, shingle) for w, _ in own if _shingle_width(len(w), shingle) == width]))
    frequency = shingle_frequencies(rows, text, wanted) if wanted else {}
    return _marked(rows, text, spark.sparkContext.broadcast(_prefixes(own, shingle, wanted, frequency))).drop(text)


RESULTS = ("n_words", "n_hit", "items")
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _marks(column: pa.Array, prefixes: list[tuple[Prefixes, np.ndarray]]) -> Iterator[tuple[np.ndarray, set[str]]]:
    """For each text which of its words are hit, and the items whose windows occur in it."""
    data, at = kernels.laid_out(column)
    for a, b in kernels.blocks(at):
        _, _, h, first = kernels.words(data[at[a] : at[b]], at[a : b + 1] - at[a], kernels.ALNUM)
        edge, items = np.zeros(len(h) + 1, np.int64), [set() for _ in range(b - a)]
        for p, sieve in prefixes:
            text, start, window = _occurrences(h, first, p, sieve)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + p.words.shape[1], -1)
            for t, w in np.unique(np.stack([text, window]), axis=1).T.tolist():
                items[t].update(p.items[w])
        hit = np.cumsum(edge[:-1]) > 0
        for i in range(b - a):
            yield hit[first[i] : first[i + 1]], items[i]


def _marked(docs: DataFrame, text: str, sent) -> DataFrame:
    at_text = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = [(p, _sieve(p.shingles)) for p in sent.value]
        for batch in batches:
            marks = list(_marks(batch.column(at_text), prefixes))
            columns = [pa.array([len(x) for x, _ in marks], pa.int64()), pa.array([int(x.sum()) for x, _ in marks], pa.int64()), pa.array([sorted(i) for _, i in marks], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return map_in_arrow(docs, mark, schema)

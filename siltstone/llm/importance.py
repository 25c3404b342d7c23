"""Importance resampling towards a target: n-gram counts by bucket as a sparse matrix kept in row blocks.

The matrix is written once, as blocks in compressed sparse row form. Its column sums are the distribution of the
corpus over buckets; its product with the vector of gains is every document's weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm import kernels
from siltstone.llm.columns import quoted
from siltstone.llm.storage import written

#: Bytes of text in a block of the matrix; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Rows that a task ranks, about.
RANKED_ROWS = 1 << 20
BLOCK_NAMES = ["ids", "n_words", "offsets", "gaps", "counts"]


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()
_BYTE = np.arange(256, dtype=np.uint32)


def _step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))


def _moved(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by a table for each byte."""
    return tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


def _zero_maps() -> list[np.ndarray]:
    """What 1, 2, 4, ... zero bytes do to a checksum."""
    out = [np.stack([_step(_BYTE << np.uint32(8 * k), 0) for k in range(4)])]
    for _ in range(39):
        out.append(np.stack([_moved(t, out[-1]) for t in out[-1]]))
    return out


_ZEROS = _zero_maps()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, from those of both and the second's length in bytes."""
    out = left.copy()
    for j in range(int(length.max()).bit_length() if len(length) else 0):
        some = np.flatnonzero((length >> j) & 1)
        out[some] = _moved(out[some], _ZEROS[j])
    return out ^ right


def word_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: all words' first bytes, then their second ones, ...; by halves where words are long."""
    size = end - start
    if len(size) and size.max() > 64:
        out = np.zeros(len(size), np.uint32)
        short = size <= 64
        out[short] = word_crc(data, start[short], end[short])
        middle = (start + size // 2)[~short]
        out[~short] = joined_crc(word_crc(data, start[~short], middle), word_crc(data, middle, end[~short]), end[~short] - middle)
        return out
    order = np.argsort(-size, kind="stable")
    first, left = start[order], np.searchsorted(-size[order], -np.arange(1, 66), side="right")
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for p in range(int(size.max()) if len(size) else 0):
        n = left[p]
        crc[:n] = _step(crc[:n], data[first[:n] + p])
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _packed(x: np.ndarray) -> bytes:
    """Small numbers, compressed: all first bytes, then all second ones, ..., most of which are zero."""
    planes = np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(len(x), 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(n).astype(np.int64)


def sparse_rows(data: np.ndarray, at: np.ndarray, longest: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(n_words, offsets, buckets, counts)`` of some texts' runs of 1 to ``longest`` words."""
    data = kernels.LOWER[data]
    start, end, _, first = kernels.words(data, at, kernels.ALNUM, lower=False)
    n_words, row = np.diff(first), np.repeat(np.arange(len(at) - 1), np.diff(first))
    word, size = word_crc(data, start, end), end - start
    run, cells = word, [row * n_buckets + word % np.uint32(n_buckets)]
    for k in range(1, min(longest, len(word))):
        spaced = _step(run[:-1] ^ np.uint32(0xFFFFFFFF), 0x20) ^ np.uint32(0xFFFFFFFF)
        run = joined_crc(spaced, word[k:], size[k:])
        cells.append((row[: len(run)] * n_buckets + run % np.uint32(n_buckets))[row[: len(run)] == row[k:]])
    cell, counts = np.unique(np.concatenate(cells), return_counts=True)
    return n_words, np.searchsorted(cell, np.arange(len(at)) * n_buckets), cell % n_buckets, counts


def count_matrix(docs: DataFrame, name: str, longest: int, n_buckets: int, id_col: str, text_col: str) -> DataFrame:
    """The written document by bucket count matrix: a row of the table is a block of rows of the matrix. Buckets of a
    row ascend, and are kept as the gaps between them."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.LongType())), *[T.StructField(n, T.BinaryType()) for n in BLOCK_NAMES[2:]]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = kernels.laid_out(batch.column(1))
            for a, b in kernels.blocks(at, BLOCK_BYTES):
                n_words, offsets, buckets, counts = sparse_rows(data[at[a] : at[b]], at[a : b + 1] - at[a], longest, n_buckets)
                gaps = np.diff(buckets, prepend=0)
                filled = offsets[:-1][np.diff(offsets) > 0]
                gaps[filled] = buckets[filled]
                whole = pa.array([0, b - a], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(whole, batch.column(0).slice(a, b - a)),
                        pa.ListArray.from_arrays(whole, pa.array(n_words, pa.int64())),
                        pa.array([offsets.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([_packed(gaps)], pa.binary()),
                        pa.array([_packed(counts)], pa.binary()),
                    ],
                    names=BLOCK_NAMES,
                )

    rows = docs.select(*quoted([id_col]), quoted([text_col])[0].cast("string").alias("_text")).toDF("c0", "c1")
    return written(rows.mapInArrow(build, schema), name)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(place, offsets, buckets, counts)`` of each block in a batch of ``(.., offsets, gaps, counts)``."""
    for i in range(batch.num_rows):
        offsets, gaps, counts = (batch.column(n)[i].as_py() for n in ("offsets", "gaps", "counts"))
        offsets = np.frombuffer(offsets, np.int64)
        gaps, counts = (_unpacked(x, int(offsets[-1])) for x in (gaps, counts))
        size, total = np.diff(offsets), np.cumsum(gaps)
        filled = offsets[:-1][size > 0]
        yield i, offsets, total - np.repeat(total[filled] - gaps[filled], size[size > 0]), counts


def column_sums(matrix: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, buckets, counts in _blocks(batch):
                np.add.at(out, buckets, counts)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(out[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    each = matrix.select(*BLOCK_NAMES[2:]).mapInArrow(summed, "bucket long, n long")
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # n_buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target, with one more of each bucket in both."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """``(id, n_words, n_features, weight)``: the matrix times the vector of gains."""
    id_type = matrix.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])
    sent = matrix.sparkSession.sparkContext.broadcast(gain)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, offsets, buckets, counts in _blocks(batch):
                n_words = batch.column("n_words")[i].values.to_numpy()
                weight, filled = np.zeros(len(n_words), np.int64), np.diff(offsets) > 0
                if filled.any():
                    weight[filled] = np.add.reduceat(sent.value[buckets] * counts, offsets[:-1][filled])
                n_features = sum(np.maximum(n_words - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]], names=schema.names)

    return matrix.mapInArrow(product, schema)


def noise(seed: int, id_: Column) -> Column:
    """Thousandths of a Gumbel variate that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, longest: int = 3, n_buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``(id_col, n_features long, weight long, score long, rank long)`` for every row of ``docs``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Features are all runs of 1 to
    ``longest`` words, repeats counted; a feature's bucket is the CRC-32 of its words joined by a space, modulo
    ``n_buckets``. A bucket's gain says how much likelier it is in ``target`` than in ``docs``; ``weight`` is the sum of
    a row's gains and ``score`` the weight with Gumbel noise that ``seed`` and id decide. Of the rows with ``min_words``
    words or more, ``percent`` in a hundred (rounded down) are drawn, by highest score and then smallest id; ``rank`` is
    their place from 1 on, null for all others.

    Null and empty texts have no features, weight 0, and are not drawn (unless ``min_words`` is 0). Rows of equal id are
    rows of their own with equal noise; a null id takes the noise of an empty one and comes after others of its score.
    Ties of score and id are broken anyhow, so such rows trade ranks only with their equals in both. An empty ``docs``
    gives an empty table; an empty ``target`` has no counts. Other columns are not read.

    The matrix is written in the shared folder. Ranks come from a range partitioning by score: what stands before a
    partition is the sum of earlier partitions' sizes, so nothing is sorted in one task.
    """
    matrix = count_matrix(docs, "bucket-counts", longest, n_buckets, id_col, text_col)
    aim = target.select(F.lit(0).alias("id"), quoted([target_text_col])[0].alias("text"))
    aim = count_matrix(aim, "bucket-counts-target", longest, n_buckets, "id", "text")
    gain = gains(column_sums(matrix, n_buckets), column_sums(aim, n_buckets))
    scored = weights(matrix, gain, longest).withColumn("score", F.col("weight") + noise(seed, F.col("id")))
    n_rows = matrix.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANKED_ROWS))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    out = scored.withColumn("out", F.col("n_words") < min_words)
    placed = written(out.repartitionByRange(n_parts, F.col("out").asc(), *order).withColumn("part", F.spark_partition_id()), "scores")
    sizes = sorted(placed.groupBy("part").agg(F.count_if(~F.col("out")).alias("n")).collect())  # n_parts rows
    n_drawn = percent * sum(r["n"] for r in sizes) // 100
    before, offsets = 0, []
    for r in sizes:
        if r["n"] and before < n_drawn:
            offsets.append((r["part"], before))
        before += r["n"]
    offsets = docs.sparkSession.createDataFrame(offsets, "part int, before long")
    reached = placed.join(F.broadcast(offsets), "part", "left")
    drawn = reached.where("before IS NOT NULL AND NOT out")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = drawn.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    rest = reached.where("before IS NULL OR out").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

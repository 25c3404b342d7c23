"""A snapshot kept for line search: texts in blocks by path, and for each block a filter of its trigrams."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.trigrams import Condition, folded, holds, required
from siltstone.operators.grep import grep
from siltstone.sources.storage import file_states, new_folder, point, pointed, shared_folder, written

FORMAT = 2
#: Files of a block; Parquet rows of a block stand together, so that others aren't read.
BLOCK_FILES = 32
#: Bits of a filter for each trigram in it, and at most.
BITS, MOST_BITS = 16, 1 << 22
#: Text that a task sorts, in bytes, so that it is sorted in memory.
TASK_BYTES = 64 << 20
#: Ranges of blocks that a query names; beyond that the blocks' numbers go to all workers, at most so many (eight bytes each);
#: beyond these all texts are read.
MOST_RANGES, MOST_SENT = 64, 1 << 20


def _places(grams: set[str] | list[str], bits: int) -> np.ndarray:
    h = np.array([int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for g in grams], np.uint64)
    return (h % np.uint64(bits)).astype(np.int64)


def _filter(grams: set[str]) -> bytes:
    bits = min(MOST_BITS, max(64, BITS * len(grams)))
    filter_ = np.zeros(-(-bits // 8), np.uint8)
    if grams:
        place = _places(list(grams), len(filter_) * 8)
        np.bitwise_or.at(filter_, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
    return filter_.tobytes()


def _filters(rows: DataFrame) -> DataFrame:
    """``(block, filter)`` of rows that lie in blocks, as they are read; a text's trigrams do not cross its lines. A block whose
    rows are read by two tasks has a filter of either's: a match lies within one text, so one of them lets it through."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams = None, None
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                if (own := batch.column(0)[i].as_py()) != block:
                    if grams is not None:
                        done.append((block, _filter(grams)))
                    block, grams = own, set()
                t = folded(batch.column(1)[i].as_py() or "")
                grams |= {t[j : j + 3] for j in range(len(t) - 2)}
            yield _of(done)
            done = []
        if grams is not None:
            yield _of([(block, _filter(grams))])

    return rows.select("block", "text").mapInArrow(build, "block long, filter binary")


def _of(filters: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in filters], pa.int64()), pa.array([f for _, f in filters], pa.binary())], names=["block", "filter"])


def write_line_index(files: DataFrame, path: str) -> None:
    """``files`` (``path, text``) sorted by path in blocks of ``BLOCK_FILES``, and the blocks' filters. Texts are shuffled once."""
    own = files.select("path", F.col("text").cast("string"))
    n_bytes = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    number = own.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("_n", F.monotonically_increasing_id())
    block = F.shiftright("_n", 33) * (1 << 33) + F.floor(F.col("_n").bitwiseAND((1 << 33) - 1) / BLOCK_FILES)
    number.select(block.alias("block"), "path", "text").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/texts")
    kept = files.sparkSession.read.parquet(f"{path}/texts")
    _filters(kept.select("block", "text")).write.mode("overwrite").parquet(f"{path}/filters")


def kept_line_index(spark: SparkSession, table: str, build: Callable[[], DataFrame], build_id: str = "") -> str:
    """The folder of the line index of a table as its files are now; written once, and found once it is whole."""
    state = hashlib.sha256(repr((FORMAT, BLOCK_FILES, BITS, table, build_id, file_states(spark, table))).encode()).hexdigest()
    pointer = f"{shared_folder(spark)}/siltstone/lines-{state}"
    if path := pointed(spark, pointer):
        return path
    draft = new_folder(spark, "lines")
    write_line_index(build(), draft)
    return point(spark, pointer, draft)


def candidate_blocks(spark: SparkSession, path: str, condition: Condition) -> DataFrame:
    """``(block)``: blocks of which a filter lets the condition hold; one may come twice."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filter_ = np.frombuffer(blob, np.uint8)

                def has(gram: str, filter_=filter_) -> bool:
                    p = int(_places([gram], len(filter_) * 8)[0])
                    return bool(filter_[p >> 3] >> (p & 7) & 1)

                if holds(condition, has):
                    found.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["block"])

    return spark.read.parquet(f"{path}/filters").mapInArrow(test, "block long")


def candidates(spark: SparkSession, path: str, needle: str, regex: bool = False, word: bool = False, ignore_case: bool = False) -> DataFrame:
    """The kept files of blocks that can hold a match. Where these make few ranges, the ranges are conditions that the scan
    skips row groups by; a block outside is dropped, or where blocks are too many to name, read like any other."""
    texts = spark.read.parquet(f"{path}/texts")
    condition = required(needle if regex else re.escape(needle), ignore_case)
    if condition is None:
        return texts.select("path", "text")
    blocks = candidate_blocks(spark, path, condition)
    # neighbours make a range; one row for each range. Blocks are numbered within the task that wrote them.
    of_task = Window.partitionBy(F.shiftright("block", 33)).orderBy("block")
    runs = blocks.withColumn("_run", F.col("block") - F.dense_rank().over(of_task)).groupBy("_run").agg(F.min("block").alias("a"), F.max("block").alias("b"))
    ranges = runs.limit(MOST_RANGES + 1).collect()
    if not ranges:
        return texts.where(F.lit(False)).select("path", "text")
    if len(ranges) <= MOST_RANGES:
        inside = F.lit(False)
        for r in ranges:
            inside = inside | F.col("block").between(r["a"], r["b"])
        return texts.where(inside).select("path", "text")
    sent = written(blocks, "blocks")
    if sent.count() > MOST_SENT:
        return texts.select("path", "text")
    return texts.join(F.broadcast(sent), "block", "left_semi").select("path", "text")


def indexed_grep(spark: SparkSession, path: str, needle: str, *, regex: bool = False, word: bool = False, ignore_case: bool = False, **options) -> DataFrame:
    """``grep`` over the files of a line index; the same rows, read from candidate blocks only."""
    own = candidates(spark, path, needle, regex, word, ignore_case)
    return grep(own, needle, regex=regex, word=word, ignore_case=ignore_case, **options)

"""A kept index over the chunks of a table: immutable segments, a manifest that names them, and merges.

The table's files are read as a stream, so that what is indexed and what isn't is the checkpoint's business: a build
that was killed goes on with the files it had not finished, and a later call indexes the files that have come since.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import values as V
from siltstone.functions.embedding import StaticModel, embedded
from siltstone.functions.text import CAMEL, IDENTIFIER, term_counts, text_slices
from siltstone.operators.retrieval import document_frequencies
from siltstone.operators.vectors import vector_blocks
from siltstone.sources.storage import children, exists, file_states, is_folder, shared_folder

#: Goes up whenever a segment's columns or meaning change: an index of another format isn't read.
FORMAT = 4
#: A term's postings are dealt over so many partitions, so that a frequent term isn't one task's.
SALTS = 16
#: Beyond so many segments the smaller half is merged into one.
MOST_SEGMENTS = 8
#: Characters of a chunk that its vector is made of.
EMBEDDED_CHARS = 2400
_ENTRY = "segment string, n_chunks long, pairs long, files array<struct<name string, size long, changed long>>"


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` has ``term, id, tf, len`` and the keys of its chunk, sorted by term within files, so that a term's rows
    are found by row group. ``vectors`` has blocks of the chunks' vectors, if the index keeps them."""

    postings: DataFrame
    n_chunks: int
    mean_terms: float
    segments: list[str] = field(default_factory=list)
    vectors: DataFrame | None = None


def counted_terms(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``(id, *keys, term, tf, len, first)``: within each chunk its tokens are counted, and a compound one is cut up once.
    ``len`` is the number of distinct terms, ``first`` is true for one of them."""
    # path and symbol stand in the text's head already; they count twice
    text = F.concat_ws(" ", F.translate("path", "/.", "  "), "symbol", "text")
    own = chunks.select("id", *keys, text.alias("_t"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("len", T.LongType()), T.StructField("first", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, whole.num_columns - 1)):
            each = [term_counts(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            n = np.array([len(t) for t in each], np.int64)
            at = np.repeat(np.arange(len(each)), n)
            first = np.zeros(len(at), bool)
            first[(np.cumsum(n) - n)[n > 0]] = True
            columns = [c.take(pa.array(at)) for c in batch.columns[:-1]]
            columns += [pa.array([t for terms in each for t in terms], pa.binary()).cast(pa.string()), pa.array([k for terms in each for k in terms.values()], pa.int64()), pa.array(n[at]), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(count, schema)


def _write_postings(rows: DataFrame, path: str) -> None:
    rows.repartition("term", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def _write_segment(chunks: DataFrame, path: str, keys: list[str], model: StaticModel | None) -> tuple[int, int]:
    """Number of chunks and of (chunk, term) pairs."""
    _write_postings(counted_terms(chunks, keys), path)
    if model is not None:
        own = chunks.select("id", *keys, F.substring("text", 1, EMBEDDED_CHARS).alias("text"))
        vector_blocks(embedded(own, model).drop("text"), ["id", *keys]).write.mode("overwrite").parquet(f"{path}/vectors")
    n = chunks.sparkSession.read.parquet(f"{path}/postings").agg(F.count_if("first").alias("n_chunks"), F.count(F.lit(1)).alias("pairs")).first()
    return n["n_chunks"], n["pairs"]


def _manifest(spark: SparkSession, root: str) -> tuple[int, list]:
    """Number and rows of the newest whole version; 0 and none where there isn't any."""
    versions = sorted(int(n) for n in children(spark, f"{root}/manifest") if exists(spark, f"{root}/manifest/{n}/_SUCCESS"))
    return (versions[-1], sorted(spark.read.schema(_ENTRY).parquet(f"{root}/manifest/{versions[-1]}").collect())) if versions else (0, [])


def _publish(spark: SparkSession, root: str, version: int, entries: list) -> None:
    """A version is a folder of its own that no other builder has written, and counts once it is whole."""
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("error").parquet(f"{root}/manifest/{version}")


def _table_stream(spark: SparkSession, table: str, files_at_once: int) -> DataFrame:
    source = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", files_at_once)
    if is_folder(spark, table):
        return source.parquet(table)
    folder, name = table.rsplit("/", 1)
    return source.option("pathGlobFilter", name).parquet(folder)


def _number(entry) -> int:
    """Of the newest batch that a segment holds."""
    return int(entry["segment"][1:7])


def _recorded(entries: list) -> set[tuple[str, int, int]]:
    return {(f["name"], f["size"], f["changed"]) for e in entries for f in e["files"]}


def update_index(spark: SparkSession, table: str, root: str, build: Callable[[DataFrame], DataFrame], keys: list[str], files_at_once: int = 1000, model: StaticModel | None = None) -> str:
    """Indexes what files of ``table`` have no segment yet, ``files_at_once`` in a segment; returns the index's folder.

    ``build`` makes chunks (``id, path, symbol, text`` and ``keys``) of a table's rows. A segment that a killed build left
    half written is written anew; whole ones stay as they are. A file of the table that was changed or taken away makes
    the index begin again, in a new folder. Files without rows are asked for at each call, and cost nothing.
    """
    states = {s for s in file_states(spark, table) if s[1]}
    generation = max([int(n) for n in children(spark, root)], default=0)
    if not _recorded(_manifest(spark, f"{root}/{generation}")[1]) <= states:
        generation += 1
    path = f"{root}/{generation}"
    if _recorded(_manifest(spark, path)[1]) == states:
        return path

    def add(batch: DataFrame, batch_id: int) -> None:
        version, entries = _manifest(spark, path)
        name = f"s{batch_id:06d}"
        if batch_id <= max((_number(e) for e in entries), default=-1):
            return  # published by a run that ended before the checkpoint knew
        seen = batch.select("_file.*").distinct().collect()  # files_at_once at most
        n_chunks, pairs = _write_segment(build(batch.drop("_file")), f"{path}/segments/{name}", keys, model)
        _publish(spark, path, version + 1, [*entries, (name, n_chunks, pairs, [tuple(r) for r in seen])])

    meta = F.struct(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.unix_millis("_metadata.file_modification_time").alias("changed"))
    stream = _table_stream(spark, table, files_at_once).withColumn("_file", meta)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not _manifest(spark, path)[1]:  # a table without files
        name = f"s{-1:06d}"
        n_chunks, pairs = _write_segment(build(spark.read.parquet(table).limit(0)), f"{path}/segments/{name}", keys, model)
        _publish(spark, path, 1, [(name, n_chunks, pairs, [])])
    return path


def merge_segments(spark: SparkSession, path: str, most: int = MOST_SEGMENTS) -> None:
    """Merges the smaller segments into one while there are more than ``most``. Readers of an older manifest keep theirs:
    no file is deleted."""
    version, entries = _manifest(spark, path)
    if len(entries) <= most:
        return
    by_size = sorted(entries, key=lambda e: (e["pairs"], e["segment"]))
    old, kept = by_size[: len(entries) - most // 2], by_size[len(entries) - most // 2 :]
    # named after the newest it holds
    name = f"m{max(map(_number, old)):06d}v{version + 1}"
    target = f"{path}/segments/{name}"
    _write_postings(spark.read.parquet(*[f"{path}/segments/{e['segment']}/postings" for e in old]), target)
    vectors = [f"{path}/segments/{e['segment']}/vectors" for e in old]
    if exists(spark, vectors[0]):
        spark.read.parquet(*vectors).write.mode("overwrite").parquet(f"{target}/vectors")
    merged = (name, sum(e["n_chunks"] for e in old), sum(e["pairs"] for e in old), [tuple(f) for e in old for f in e["files"]])
    _publish(spark, path, version + 1, [*kept, merged])


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    _, entries = _manifest(spark, path)
    names = [f"{path}/segments/{e['segment']}" for e in entries]
    n_chunks, pairs = sum(e["n_chunks"] for e in entries), sum(e["pairs"] for e in entries)
    vectors = spark.read.parquet(*[f"{n}/vectors" for n in names]) if names and exists(spark, f"{names[0]}/vectors") else None
    return LexicalIndex(spark.read.parquet(*[f"{n}/postings" for n in names]).drop("first"), n_chunks, pairs / max(1, n_chunks), [e["segment"] for e in entries], vectors)


def index_root(spark: SparkSession, table: str, keys: list[str], build_id: str, model: StaticModel | None = None) -> str:
    """The folder of all generations of an index: by table, format, and all that decides what a build makes."""
    values = (FORMAT, table, keys, build_id, IDENTIFIER, CAMEL, V.STOP_WORDS, V.CHUNK_LINES, V.CHUNK_WINDOW, V.CHUNK_STRIDE)
    digest = hashlib.sha256(repr(values).encode())
    if model is not None:
        digest.update(repr((EMBEDDED_CHARS, sorted(model.vocabulary.items()))).encode() + model.scales.tobytes() + model.weights.tobytes())
    return f"{shared_folder(spark)}/siltstone/index-{digest.hexdigest()}"


def kept_index(spark: SparkSession, table: str, build: Callable[[DataFrame], DataFrame], keys: list[str], build_id: str = "", files_at_once: int = 1000, model: StaticModel | None = None) -> LexicalIndex:
    """The index of the table at ``table``, brought up to date first. ``build_id`` names what ``build`` does: another one
    is another index, as are other keys, chunk sizes, term rules, models and formats."""
    path = update_index(spark, table, index_root(spark, table, keys, build_id, model), build, keys, files_at_once, model)
    merge_segments(spark, path)
    return read_index(spark, path)


def bm25(index: LexicalIndex, query: list[str], keys: list[str] | None = None, only: Column | None = None) -> DataFrame:
    """``(id, *keys, score)`` of chunks with a query term. A chunk's length is its number of distinct terms.

    Only the query's postings are read; their number by term is collected, one row a term. ``only`` is a condition on
    the keys that stand with the postings (a path's prefix, code or documents): chunks outside aren't scored, but a
    term is as rare as in the whole index.
    """
    hits = index.postings.where(F.col("term").isin(sorted(set(query))))
    idf = F.lit(0.0)
    for r in document_frequencies(hits).collect():
        idf = F.when(F.col("term") == r["term"], math.log(1 + (index.n_chunks - r["df"] + 0.5) / (r["df"] + 0.5))).otherwise(idf)
    hits = hits if only is None else hits.where(only)
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / index.mean_terms)
    part = idf * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("id", *(keys or [])).agg(F.round(F.sum(part), 6).alias("score"))

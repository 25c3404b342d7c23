"""Kept vectors: eight-bit rows in blocks, and the nearest rows of many queries by one matrix product a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK_ROWS = 1024
_PAYLOAD = [T.StructField(n, T.BinaryType()) for n in ("weights", "scales", "low", "high")]


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow array of vectors of one length as a matrix in double precision; null vectors are zero."""
    if column.null_count or (len(column) and column.flatten().null_count):
        rows = column.to_pylist()
        width = max((len(r) for r in rows if r), default=0)
        return np.array([[x or 0.0 for x in r] if r else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def eight_bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as eight-bit numbers with a scale each."""
    top = np.abs(x).max(axis=1, initial=0)
    scales = np.where(top > 0, top / 127, 1.0)
    return np.floor(x / scales[:, None] + 0.5).astype(np.int8), scales


def vector_blocks(rows: DataFrame, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """``(rows array<struct of keys>, weights, scales, low, high)``: blocks of up to ``BLOCK_ROWS`` vectors.

    Vectors are dealt by the component that is largest in them, so that a block's components keep within narrow
    bounds (``low`` and ``high``, of the values that the eight bits stand for). A null vector is a zero vector.
    """
    kept = T.StructType([rows.schema[k] for k in keys])
    schema = T.StructType([T.StructField("rows", T.ArrayType(kept)), *_PAYLOAD])
    size = F.transform(vector_col, lambda x: F.abs(x))
    largest = F.array_position(size, F.array_max(size))
    own = rows.select(F.struct(*keys).alias("k"), F.col(vector_col).alias("v"), (largest * F.signum(F.element_at(vector_col, F.greatest(F.coalesce(largest, F.lit(1)).cast("int"), F.lit(1))))).alias("largest"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                weights, scales = eight_bits(matrix(part.column(1)))
                values = weights * scales[:, None]
                blobs = [weights.tobytes(), scales.tobytes(), values.min(axis=0, initial=np.inf).tobytes(), values.max(axis=0, initial=-np.inf).tobytes()]
                whole = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([whole, *[pa.array([b], pa.binary()) for b in blobs]], names=schema.names)

    return own.repartition("largest").sortWithinPartitions("largest").select("k", "v").mapInArrow(pack, schema)


def unit_rows(queries: list[list[float]]) -> np.ndarray:
    q = np.array(queries, np.float64)
    norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
    return q / np.where(norm > 0, norm, 1)


class _Best:
    """The best ``k`` rows of each query so far, ties by id."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n_queries)]

    def least(self, q: int) -> float:
        return self.rows[q][-1][0] if len(self.rows[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, rows: list[dict]) -> None:
        some = np.flatnonzero(scores >= max(self.least(q), np.partition(scores, -self.k)[-self.k] if len(scores) > self.k else -np.inf))
        both = self.rows[q] + [(float(scores[i]), rows[i]) for i in some if scores[i] > -np.inf]
        self.rows[q] = sorted(both, key=lambda r: (-r[0], r[1]["id"]))[: self.k]


def nearest(blocks: DataFrame, queries: list[list[float]], k: int, digits: int = 4, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(query int, *keys, score)``: for each of the queries the ``k`` rows of largest cosine with the eight-bit vectors,
    which are of length one as stored; ties by ``id``, one of the keys. ``only`` is a condition on a row's keys (given as a
    struct): rows outside aren't ranked.

    A task multiplies a block with all queries at once, and passes over blocks whose bound is below what each query has
    already; it gives back ``k`` rows a query, of which the best are taken.
    """
    kept = blocks.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.IntegerType()), *kept.fields, T.StructField("score", T.DoubleType())])
    sent = blocks.sparkSession.sparkContext.broadcast(unit_rows(queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best = _Best(len(q), k)
        for batch in batches:
            for i in range(batch.num_rows):
                weights, scales, low, high = (batch.column(n)[i].as_py() for n in ("weights", "scales", "low", "high"))
                low, high = np.frombuffer(low), np.frombuffer(high)
                bound = np.where(q > 0, q * high, q * low).sum(axis=1) + 10.0**-digits
                open_ = [j for j in range(len(q)) if bound[j] >= best.least(j)]
                if open_:
                    w = np.frombuffer(weights, np.int8).reshape(-1, q.shape[1]).astype(np.float64)
                    scores = np.round((w @ q[open_].T) * np.frombuffer(scales)[:, None], digits)
                    keep = batch.column("keep")[i].as_py()
                    if keep is not None:
                        scores[~np.array([bool(x) for x in keep])] = -np.inf
                    rows = batch.column("rows")[i].as_py()
                    for n, j in enumerate(open_):
                        best.add(j, scores[:, n], rows)
        found = [(j, *row.values(), score) for j, rows in enumerate(best.rows) for score, row in rows]
        columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
        types = [pa.int32(), *pa_types, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_types = [to_arrow_type(f.dataType) for f in kept.fields]
    keep = F.transform("rows", only) if only else F.lit(None).cast("array<boolean>")
    each = blocks.select("rows", "weights", "scales", "low", "high", keep.alias("keep")).mapInArrow(scan, schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return each.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def cosines(rows: DataFrame, query: list[float], id_col: str, vector_col: str = "embedding", eight_bit: bool = False, digits: int = 4) -> DataFrame:
    """``(id, score)`` of every row: a matrix product for each Arrow batch. 0 where either is a zero vector."""
    sent = rows.sparkSession.sparkContext.broadcast(unit_rows([query])[0])
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            if eight_bit:
                w, scales = eight_bits(x)
                out = (w.astype(np.float64) @ sent.value) * scales
            else:
                norm = np.sqrt((x * x).sum(axis=1))
                out = (x @ sent.value) / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=schema.names)

    return rows.select(id_col, vector_col).mapInArrow(score, schema).withColumn("score", F.round("score", digits))

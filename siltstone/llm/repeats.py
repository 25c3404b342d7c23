"""A filter of keys that occur twice or more in a whole table, in a bounded number of bits.

Keys that are repeated always pass; a key that isn't passes by chance, so an exact step must follow. The
filter costs eight bytes of shuffle for each key and batch and is never larger than ``2 ** MOST_BITS`` bits:
on tables that outgrow it, it lets more of the unrepeated keys pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BITS = 28
DEALT = "bucket int, kind int, rows binary"


@dataclass
class RepeatFilter:
    bits: int
    words: np.ndarray

    def __contains__(self, key) -> bool:
        return bool(self.passes(np.array([key], np.uint64))[0])

    def passes(self, keys: np.ndarray) -> np.ndarray:
        place = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def dealt(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """The rows of each bucket as one blob."""
    if not len(rows):
        return []
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    found, first = np.unique(bucket, return_index=True)
    return [(int(k), kind, rows[a:b].tobytes()) for k, a, b in zip(found, first, [*first[1:], len(rows)], strict=True)]


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "rows"])


def read_blobs(table: pa.Table, dtype: np.dtype, kind: int | None = None) -> np.ndarray:
    return np.frombuffer(b"".join(x for x, k in zip(table["rows"].to_pylist(), table["kind"].to_pylist(), strict=True) if kind is None or k == kind), dtype)


def repeat_filter(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], expected: int, n_buckets: int) -> RepeatFilter:
    """``keys`` gives the evenly spread 64-bit keys of a batch, in any order and number; about ``expected`` in all."""
    bits = min(MOST_BITS, max(10, (2 * max(1, expected)).bit_length()))
    shift = np.uint64(64 - bits)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = np.unique(keys(batch), return_counts=True)
            own = np.repeat(own, np.minimum(n, 2))
            yield blob_batch(dealt(own, ((own >> shift).astype(np.int64) * n_buckets) >> bits, 0))

    def repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.sort(read_blobs(table, np.uint64))
        place = np.unique((own[1:][own[1:] == own[:-1]] >> shift).astype(np.int64))
        word, first = np.unique(place >> 6, return_index=True)
        value = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if len(place) else np.zeros(0, np.uint64)
        return pa.table({"words": pa.array([word.astype(np.int64).tobytes()], pa.binary()), "values": pa.array([value.tobytes()], pa.binary())})

    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    found = rows.mapInArrow(gathered, DEALT).groupBy("bucket").applyInArrow(repeated, "words binary, values binary")
    for r in found.toLocalIterator():  # bounded by the filter's size
        out[np.frombuffer(r["words"], np.int64)] |= np.frombuffer(r["values"], np.uint64)
    return RepeatFilter(bits, out)

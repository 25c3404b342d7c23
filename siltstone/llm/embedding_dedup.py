"""Embedding near-dedup: an inverted multi-index over the halves of vectors.

Each half has a codebook of its own; a vector's home is the cell of its two nearest codewords. A vector visits the
cells nearest to it by the sum of both halves' distances, in that order, as many as a sample of links needs for the
target recall, and is compared with the vectors at home there. Dense groups are taken out first: vectors
around one centre, any two of which must be linked by the triangle inequality, are counted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.columns import quoted
from siltstone.llm.components import components
from siltstone.llm.kernels import mix
from siltstone.llm.storage import written

#: Rows of a cell that the codebooks' size aims at, and the largest codebook of a half (2^22 cells).
CELL_ROWS, MOST_CODEWORDS = 16, 2048
#: Vectors that a codeword is fitted on, at most.
FIT_ROWS = 32
FIT_ROUNDS = 8
#: Vectors whose links are looked for by brute force, and vectors that get a partner made for them.
RECALL_ROWS = 1024
#: Longest traversal; where it isn't enough for the target recall, codebooks are halved.
MOST_VISITS = 256
#: A cell is dense beyond so many rows, and beyond one in so many of all: there can't be more dense cells than that.
DENSE_ROWS, DENSE_CELLS = 512, 1024
#: Rows of a tile at home, and visiting.
TILE_ROWS, VISITOR_ROWS = 1024, 4096
BUCKET_BYTES = 16 << 20
#: Room for rounding in angles.
SLACK = 1e-7


@dataclass
class MultiIndex:
    codes: tuple[np.ndarray, np.ndarray]
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.codes[0].shape[1]
        return tuple((c * c).sum(1) - 2 * x[:, a:b] @ c.T for c, a, b in ((self.codes[0], 0, half), (self.codes[1], half, x.shape[1])))

    def traversed(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells nearest to each vector, nearest first. The ``v`` best sums lie in the ``i``-th and ``j``-th codewords
        with ``i * j <= v``, so only those are formed."""
        n = len(self.codes[0])
        visits = min(visits or self.visits, n * n)
        near, both = min(n, visits), self.distances(x)
        first, second = (np.argsort(d, axis=1, kind="stable")[:, :near] if near > 1 else d.argmin(1)[:, None] for d in both)
        d1, d2 = (np.take_along_axis(d, p, 1) for d, p in zip(both, (first, second), strict=True))
        i, j = np.array([(i, j) for i in range(near) for j in range(min(near, visits // (i + 1)))]).T
        best = np.argsort(d1[:, i] + d2[:, j], axis=1, kind="stable")[:, :visits]
        cells = first[:, i] * n + second[:, j]
        return np.take_along_axis(cells, best, 1).astype(np.int32)


def _vectors(column: pa.Array, dtype: type) -> np.ndarray:
    """Binary vectors of one length, with norm 1 in double precision."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    x = np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def packed(rows: DataFrame, dtype: type) -> DataFrame:
    """``(row, id, vec)`` from ``(row, id, vec)``: vectors as bytes, those that can't be compared as null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, i in zip(batch.column(2), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and i.is_valid and not v.values.null_count and len(v.values) else None
                # components may be so small or large that their squares leave the range of numbers
                usable = x is not None and np.isfinite(x).all() and 0 < np.linalg.norm(x.astype(np.float64)) < np.inf
                out.append(x.astype(dtype).tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "id", "vec"])

    return rows.mapInArrow(pack, "row long, id long, vec binary")


def _codebook(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """K-means over a bounded sample."""
    codes = x[rng.choice(len(x), n, replace=len(x) < n)].copy()
    for _ in range(FIT_ROUNDS if n > 1 else 0):
        own = np.concatenate([((codes * codes).sum(1) - 2 * part @ codes.T).argmin(1) for part in np.array_split(x, -(-len(x) // 4096))])
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(codes)
        np.add.at(total, own, x)
        codes[size > 0] = total[size > 0] / size[size > 0, None]
    return codes


def _partners(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """For each vector another one with a cosine between ``least`` and 1, in a random direction."""
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1)[:, None] * x
    norm = np.linalg.norm(aside, axis=1)[:, None]
    cos = rng.uniform(least, 1, (len(x), 1))
    return np.where(norm > 0, cos * x + np.sqrt(1 - cos * cos) * aside / np.where(norm > 0, norm, 1), x)


def _meeting(x_cells: np.ndarray, y_cells: np.ndarray) -> np.ndarray:
    """After how many visits of both one of two vectors finds the other at home; ``MOST_VISITS`` where neither does."""
    ranks = [np.where((m := p == q[:, :1]).any(1), m.argmax(1), MOST_VISITS) for p, q in ((x_cells, y_cells), (y_cells, x_cells))]
    return np.minimum(*ranks)


def needed_visits(rows: DataFrame, index: MultiIndex, sample: np.ndarray, least: float, recall: float, dtype: type, rng: np.random.Generator) -> int | None:
    """How many cells the traversal must visit for the target recall: over all links of a sample of vectors, found by
    comparing them with all rows, and over partners made for them. None if the longest traversal isn't enough."""
    if not len(sample):
        return 1
    cells = index.traversed(sample, MOST_VISITS)
    made = np.bincount(_meeting(cells, index.traversed(_partners(sample, least, rng), MOST_VISITS)), minlength=MOST_VISITS + 1)
    sent = rows.sparkSession.sparkContext.broadcast((index, sample, cells))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sample, cells = sent.value
        out = np.zeros(MOST_VISITS + 1, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), dtype)
            if len(x):
                own, other = np.nonzero(sample @ x.T >= least)
                for a in range(0, len(own), 2048):
                    i, j = own[a : a + 2048], other[a : a + 2048]
                    found, place = np.unique(j, return_inverse=True)
                    rank = _meeting(cells[i], index.traversed(x[found], MOST_VISITS)[place])
                    np.add.at(out, rank[~(sample[i] == x[j]).all(1)], 1)  # a vector and its copy always share their home
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some], pa.int64())], names=["rank", "n"])

    real = np.zeros(MOST_VISITS + 1, np.int64)
    for r in rows.select("vec").mapInArrow(ranked, "rank int, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect():  # MOST_VISITS + 1 rows at most
        real[r["rank"]] = r["n"]
    visits = 1
    for n in (made, real):
        if n.sum():
            enough = int(np.flatnonzero(np.cumsum(n) >= recall * n.sum())[0])
            if enough == MOST_VISITS:
                return None
            visits = max(visits, enough + 1)
    return visits


def _sample(rows: DataFrame, n: int, n_rows: int, dtype: type) -> np.ndarray:
    """About ``n`` vectors, ``n`` at most, that a hash of their row number picks."""
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.2 * n / max(1, n_rows)))
    return _vectors(pa.array([r["vec"] for r in rows.where(share).select("vec").limit(n).collect()], pa.binary()), dtype)


def fitted_codes(rows: DataFrame, n_rows: int, n_codes: int, dtype: type, rng: np.random.Generator) -> MultiIndex:
    """A codebook for each half of the vectors, of a bounded sample (``FIT_ROWS`` for each codeword)."""
    sample = _sample(rows, max(FIT_ROWS * n_codes, RECALL_ROWS), n_rows, dtype)
    half = max(1, sample.shape[1] // 2)
    codes = tuple(_codebook(x, n_codes, rng) if x.size else np.zeros((n_codes, x.shape[1])) for x in (sample[:, :half], sample[:, half:]))
    return MultiIndex(codes, 1)


def _sums(rows: DataFrame, place, width: int, dtype: type) -> dict[int, tuple[int, np.ndarray]]:
    """Number and sum of the vectors at each place; ``place`` gives those of a batch, -1 for none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _vectors(batch.column(0), dtype)
            if len(x):
                own = place(x)
                for k in np.unique(own[own >= 0]).tolist():
                    mine = x[own == k]
                    total[k] = total.get(k, 0) + np.append(mine.sum(0), len(mine))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "total"])

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([sum(np.frombuffer(b) for b in table["total"].to_pylist()).tobytes()], pa.binary())})

    found = rows.select("vec").mapInArrow(add, "k long, total binary").groupBy("k").applyInArrow(summed, "k long, total binary").collect()  # DENSE_CELLS rows at most
    out = {r["k"]: np.frombuffer(r["total"]) for r in found}
    return {k: (round(v[width]), v[:width]) for k, v in out.items()}


@dataclass
class Balls:
    """Centres of dense groups; members lie within half the linking angle, so that any two of them are linked. Of each
    ball: the number of members, the largest angle between one and the centre, the smallest id."""

    centres: np.ndarray
    half: float
    size: np.ndarray | None = None
    radius: np.ndarray | None = None
    least_id: np.ndarray | None = None

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.centres.T, -1, 1))

    def member(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ball of each vector, -1 for none, and the angle to its centre."""
        if not len(self.centres) or not len(x):
            return np.full(len(x), -1), np.zeros(len(x))
        angle = self.angles(x)
        least = angle.min(1)
        return np.where(least <= self.half, angle.argmin(1), -1), least

    def outside(self, x: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of vectors and balls that they don't belong to: which are linked with all members, and which may be with some.
        Of two balls, members of the later one ask."""
        angle, full = self.angles(x), 2 * (self.half + SLACK)
        asks = (ball[:, None] < 0) | (np.arange(len(self.centres)) < ball[:, None])
        all_ = asks & (angle + self.radius <= full - SLACK)
        return all_, asks & ~all_ & (angle - self.radius <= full + SLACK)


def dense_balls(rows: DataFrame, index: MultiIndex, n_rows: int, width: int, least: float, dtype: type) -> Balls:
    """Balls around the means of dense cells, moved once to the means of their members."""
    half = math.acos(least) / 2 - SLACK
    none = Balls(np.zeros((0, width)), half)
    homes = _cell_counts(rows, index, dtype, max(DENSE_ROWS, n_rows // DENSE_CELLS), 1 << 62)
    if not len(homes) or half <= 0:
        return none
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((index, np.sort(homes["cell"].to_numpy())))

    def home(x: np.ndarray) -> np.ndarray:
        index, dense = sent.value
        own = index.traversed(x, 1)[:, 0]
        at = np.minimum(np.searchsorted(dense, own), len(dense) - 1)
        return np.where(dense[at] == own, at, -1)

    def balls(sums: dict[int, tuple[int, np.ndarray]]) -> Balls:
        """Largest first; centres that a larger ball already holds give way."""
        out: list[np.ndarray] = []
        for _, total in sorted(sums.values(), key=lambda v: -v[0]):
            if (norm := np.linalg.norm(total)) > 0 and all(float(total @ c) / norm < math.cos(half) for c in out):
                out.append(total / norm)
        return Balls(np.array(out).reshape(-1, width), half)

    first = spark.sparkContext.broadcast(balls(_sums(rows, home, width, dtype)))
    moved = _sums(rows, lambda x: first.value.member(x)[0], width, dtype)
    return balls({k: v for k, v in moved.items() if v[0] > DENSE_ROWS // 4})


def _in_balls(rows: DataFrame, balls: Balls, dtype: type) -> tuple[DataFrame, Balls]:
    """``rows`` with ``ball``, written, and the balls with what is known of their members."""
    sent = rows.sparkSession.sparkContext.broadcast(balls)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball, angle = sent.value.member(_vectors(batch.column(2), dtype))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball, pa.int32()), pa.array(angle, pa.float64())], names=["row", "id", "vec", "ball", "angle"])

    placed = written(rows.mapInArrow(place, "row long, id long, vec binary, ball int, angle double"), "in-balls")
    n = len(balls.centres)
    out = Balls(balls.centres, balls.half, np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64))
    for r in placed.where("ball >= 0").groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("id").alias("id")).collect():  # a row for each ball
        out.size[r["ball"]], out.radius[r["ball"]], out.least_id[r["ball"]] = r["n"], r["angle"], r["id"]
    return placed, out


def _cell_counts(rows: DataFrame, index: MultiIndex, dtype: type, homes: int, visits: int):
    """``(cell, homes, visits)`` of cells with more vectors at home than ``homes``, or more visitors than ``visits``."""
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(0), dtype)
            if len(x):
                cells = sent.value.traversed(x)
                own, each = np.unique(cells[:, 0], return_counts=True), np.unique(cells[:, 1:], return_counts=True)
                found = np.union1d(own[0], each[0])
                n = np.zeros((2, len(found)), np.int64)
                for k, (c, m) in enumerate((own, each)):
                    n[k, np.searchsorted(found, c)] = m
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[pa.array(v, pa.int64()) for v in n]], names=["cell", "homes", "visits"])

    each = rows.select("vec").mapInArrow(count, "cell long, homes long, visits long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
    return each.where((F.col("homes") > homes) | (F.col("visits") > visits)).toPandas()  # MOST_CODEWORDS ** 2 rows at most


_TILE = {"tile": pa.int64(), "side": pa.int8(), "own": pa.bool_(), "row": pa.int64(), "id": pa.int64(), "home": pa.int64(), "cells": pa.binary(), "vec": pa.binary()}
_TILES = "tile long, side byte, own boolean, row long, id long, home long, cells binary, vec binary"
_FOUND = "row long, id long, n long, root long"
#: Tiles of visitors are numbered from here on.
_VISITORS = 1 << 32


def _mixed(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.int64).view(np.uint64))


def _part(row: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (_mixed(row) % parts.astype(np.uint64)).astype(np.int64)


def _tile(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(_mixed(group).view(np.int64) + i).view(np.int64) + j).view(np.int64)


class _Dealer:
    """Deals vectors into tiles. Those at home in a group are dealt in parts; a part meets itself, each other part and each
    part of the group's visitors, in a tile for each such pair (the first part of the visitors where it meets itself)."""

    def __init__(self, batch: pa.RecordBatch):
        self.row, self.id = batch.column("row").to_numpy(), batch.column("id").to_numpy()
        self.vec, self.out = batch.column("vec"), {n: [] for n in _TILE}

    def _add(self, some: np.ndarray, tile: np.ndarray, side: int, own: bool, home: np.ndarray, cells: np.ndarray | None) -> None:
        if len(some):
            n = len(some)
            lists = pa.nulls(n, pa.binary()) if cells is None else pa.array([c.tobytes() for c in cells[some]], pa.binary())
            values = [tile, np.full(n, side), np.full(n, own), self.row[some], self.id[some], home[some], lists, self.vec.take(pa.array(some))]
            for (name, kind), v in zip(_TILE.items(), values, strict=True):
                self.out[name].append(v if isinstance(v, pa.Array) else pa.array(v, kind))

    def at_home(self, some: np.ndarray, group: np.ndarray, parts: np.ndarray, visitors: np.ndarray, home: np.ndarray, cells: np.ndarray | None) -> None:
        """With ``cells`` (those that each visits) they meet each other too, without only visitors."""
        own = _part(self.row[some], parts)
        self._add(some, _tile(group, own, own), 0, cells is not None, home, cells)
        for k in range(int(parts.max(initial=1)) if cells is not None else 0):
            low, high = (own < k) & (k < parts), own > k
            self._add(some[low], _tile(group[low], own[low], k), 0, False, home, None)
            self._add(some[high], _tile(group[high], k, own[high]), 1, False, home, None)
        for k in range(1, int(visitors.max(initial=1))):
            more = k < visitors
            self._add(some[more], _tile(group[more], own[more], _VISITORS + k), 0, False, home, cells)

    def visiting(self, some: np.ndarray, group: np.ndarray, parts: np.ndarray, visitors: np.ndarray, home: np.ndarray, own: bool) -> None:
        """``own``: they have a home where the same pair may meet."""
        mine = _part(self.row[some], visitors)
        for k in range(int(parts.max(initial=1))):
            at = k < parts
            self._add(some[at], _tile(group[at], k, np.where(mine[at] > 0, _VISITORS + mine[at], k)), 1, own, home, None)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(v) if v else pa.nulls(0, _TILE[n]) for n, v in self.out.items()], names=list(_TILE))


def _parts(counts: np.ndarray, rows: int) -> np.ndarray:
    return np.maximum(1, -(-counts // rows)).astype(np.int32)


def cell_tiles(loose: DataFrame, index: MultiIndex, dtype: type) -> DataFrame:
    """Every vector in the tiles of its home and of the cells that it visits."""
    large = _cell_counts(loose, index, dtype, TILE_ROWS, VISITOR_ROWS)
    parts = np.ones((2, len(index.codes[0]) ** 2), np.int32)  # a number for each cell
    parts[0, large["cell"]], parts[1, large["cell"]] = _parts(large["homes"].to_numpy(), TILE_ROWS), _parts(large["visits"].to_numpy(), VISITOR_ROWS)
    sent = loose.sparkSession.sparkContext.broadcast((index, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (parts, visitors) = sent.value
        for batch in batches:
            dealer, x = _Dealer(batch), _vectors(batch.column("vec"), dtype)
            if len(x):
                cells, every = index.traversed(x), np.arange(len(x))
                home = cells[:, 0].astype(np.int64)
                dealer.at_home(every, home, parts[home], visitors[home], home, cells)
                for k in range(1, cells.shape[1]):
                    dealer.visiting(every, cells[:, k], parts[cells[:, k]], visitors[cells[:, k]], home, True)
            yield dealer.batch()

    return loose.select("row", "id", "vec").mapInArrow(deal, _TILES)


def ball_links(placed: DataFrame, balls: Balls, dtype: type) -> tuple[DataFrame, DataFrame]:
    """``(row, id, n, root)`` of members and of vectors linked with a whole ball; tiles of those linked with a part."""
    n_balls, spark = len(balls.centres), placed.sparkSession
    known = spark.sparkContext.broadcast(balls)

    def asked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, ball = _vectors(batch.column("vec"), dtype), batch.column("ball").to_numpy()
        return (ball, *(known.value.outside(x, ball) if len(x) else (np.zeros((0, n_balls), bool),) * 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, n_balls), np.int64)
        for batch in batches:
            _, all_, some = asked(batch)
            n += np.stack([all_.sum(0), some.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_balls), pa.int32()), *[pa.array(v, pa.int64()) for v in n]], names=["ball", "whole", "part"])

    whole, part = np.zeros(n_balls, np.int64), np.zeros(n_balls, np.int64)
    for r in placed.mapInArrow(count, "ball int, whole long, part long").groupBy("ball").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part")).collect():  # a row for each ball
        whole[r["ball"]], part[r["ball"]] = r["whole"], r["part"]
    counts = spark.sparkContext.broadcast((whole, part))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls, (whole, _) = known.value, counts.value
            ball, all_, _ = asked(batch)
            member = np.flatnonzero(ball >= 0)
            own = ball[member]
            i, b = np.nonzero(all_)
            at = np.concatenate([member, i])
            n = np.concatenate([balls.size[own] - 1 + whole[own], balls.size[b]])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(n, pa.int64()), pa.array(balls.least_id[np.concatenate([own, b])], pa.int64())], names=["row", "id", "n", "root"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, (_, part) = known.value, counts.value
        parts, visitors = _parts(balls.size, TILE_ROWS), _parts(part, VISITOR_ROWS)
        for batch in batches:
            dealer = _Dealer(batch)
            ball, _, some = asked(batch)
            member = np.flatnonzero((ball >= 0) & (part[ball] > 0))
            own, home = ball[member], ball.astype(np.int64)
            dealer.at_home(member, -1 - own, parts[own], visitors[own], home, None)
            for b in np.flatnonzero(some.any(0)):
                i = np.flatnonzero(some[:, b])
                dealer.visiting(i, np.full(len(i), -1 - b), np.full(len(i), parts[b]), np.full(len(i), visitors[b]), home, False)
            yield dealer.batch()

    return placed.mapInArrow(found, _FOUND), placed.mapInArrow(deal, _TILES)


def _smallest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the smallest id that it reaches over the links ``(i, j)``."""
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), np.int64)
    root[order] = np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = np.minimum(root, root[order[root]])
        if (before == root).all():
            return ids[order[root]]


def tile_links(tiles: DataFrame, least: float, dtype: type, n_buckets: int) -> DataFrame:
    """``(row, id, n, root)``: how many links a row has in a tile, and the smallest id that it reaches there.

    Rows of side 0 are at home; they meet those of side 1, and each other where both have ``own``. Two rows that would
    meet at the homes of both are counted at that of the smaller number.
    """

    def links(x: np.ndarray, n_home: int, own: np.ndarray, home: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for p in range(0, len(x), TILE_ROWS):
            i, j = np.nonzero(x[p : p + TILE_ROWS] @ x[:n_home].T >= least)
            i = i + p
            ok = np.where(i < n_home, (i < j) & own[i], True)
            away = np.flatnonzero(ok & (i >= n_home) & own[i])
            for h in np.unique(j[away]).tolist():
                mine = away[j[away] == h]
                ok[mine] = (home[h] < home[i[mine]]) | ~np.isin(home[i[mine]], np.frombuffer(lists[h], np.int32))
            out.append((i[ok], j[ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("tile", "ascending"), ("side", "ascending")])
        tile, side, own, row, id_, home = (table[c].to_numpy() for c in list(_TILE)[:6])
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(tile)], strict=False):
            n_home = int((side[a:b] == 0).sum())
            if n_home and b - a > 1:
                i, j = links(_vectors(table["vec"][a:b], dtype), n_home, own[a:b], home[a:b], table["cells"][a : a + n_home].to_pylist())
                if len(i):
                    n = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                    some = n > 0
                    found.append((row[a:b][some], id_[a:b][some], n[some], _smallest(id_[a:b], i, j)[some]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(_FOUND.split(", "), columns, strict=True)})

    dealt = tiles.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(n_buckets)))
    return dealt.groupBy("bucket").applyInArrow(link, _FOUND)


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """``(id_col, n_links long, component_id long, kept boolean)`` for every row.

    Two vectors are linked where their cosine in double precision is ``least`` or more (above 0, below 1). ``n_links``
    counts the other rows that a row is linked with, ``component_id`` is the smallest id reachable over links, the row's
    own without any, and ``kept`` says that both ids are one. No link is given that isn't one. Of the links, those within
    dense groups and between them and the rest are all found; of the others, the traversal is as long as ``recall`` of
    them asks for, measured on up to ``RECALL_ROWS`` vectors against all rows and on partners made for these.

    Vectors that are null, zero or hold a null or non-finite component link with nothing, nor do those whose length isn't
    the most frequent one. Rows of equal id are rows of their own, in one component if they are linked with anything. A row
    of null id links with nothing, and its ``component_id`` and ``kept`` are null. Ids must be integers (``ValueError``).
    Other columns are not read. An empty table gives an empty table.

    Codebooks are fitted on a bounded sample (``FIT_ROWS`` for each of at most ``MOST_CODEWORDS`` codewords); every vector
    is indexed. A group of many vectors is dealt in parts that meet in tiles, of which only counts and spanning links come
    back.
    """
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    element = vectors.schema[vector_col].dataType.elementType
    dtype = np.float32 if isinstance(element, T.FloatType) else np.float64
    vec = quoted([vector_col])[0].cast("array<float>" if dtype is np.float32 else "array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), quoted([id_col])[0].cast("long").alias("id"), vec.alias("vec"))
    every = written(packed(rows, dtype), "vectors")
    lengths = every.where("vec IS NOT NULL").groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bytes").limit(1).collect()
    n_rows, n_bytes = (lengths[0]["n"], lengths[0]["bytes"]) if lengths else (0, 0)
    usable = every.where(F.octet_length("vec") == n_bytes)
    found = None
    if n_rows > 1:
        rng, width = np.random.default_rng(seed), n_bytes // np.dtype(dtype).itemsize
        n_codes = min(MOST_CODEWORDS, 1 << max(0, round(math.log2(n_rows / CELL_ROWS) / 2))) if n_rows > CELL_ROWS else 1
        index = fitted_codes(usable, n_rows, n_codes, dtype, rng)
        balls = dense_balls(usable, index, n_rows, width, least, dtype)
        loose, tiles, n_loose = usable, None, n_rows
        if len(balls.centres):
            placed, balls = _in_balls(usable, balls, dtype)
            found, tiles = ball_links(placed, balls, dtype)
            loose, n_loose = placed.where("ball < 0"), n_rows - int(balls.size.sum())
        sample = _sample(loose, RECALL_ROWS, n_loose, dtype)
        while not (visits := needed_visits(loose, index, sample, least, recall, dtype, rng)):
            n_codes //= 2
            index = fitted_codes(usable, n_rows, n_codes, dtype, rng)
        index.visits = visits
        of_cells = cell_tiles(loose, index, dtype)
        tiles = tiles.unionByName(of_cells) if tiles is not None else of_cells
        n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows * visits * (n_bytes + 8 * visits + 48) // BUCKET_BYTES)
        linked = tile_links(tiles, least, dtype, n_buckets)
        found = written(found.unionByName(linked) if found is not None else linked, "links")
    own = every.where("id IS NOT NULL").select("row", "id")
    none = every.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    if found is not None:
        sums = found.groupBy("row").agg(F.sum("n").alias("n"))
        reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "id"})
        own = own.join(sums, "row", "left").join(reached, "id", "left")
        own = own.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    else:
        own = own.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

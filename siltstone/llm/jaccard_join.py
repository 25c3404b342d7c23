"""N-gram Jaccard join: a sparse product of the document by n-gram incidence matrix, block by block.

Only blocks of the product that can hold a link are formed. With n-grams ordered from rare to frequent, two
documents whose similarity reaches the threshold share an n-gram in their first few (their prefixes), so
documents are dealt into blocks by shared prefix n-grams, and blocks meet only where they share one. In a
block, overlaps are accumulated over groups of columns, and pairs below the bound that their sizes set are
discarded. Equal sets are one row of the matrix from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels
from siltstone.llm.columns import quoted
from siltstone.llm.components import components, hot_values, looked_up
from siltstone.llm.ids import are_numbers, id_numbers, with_numbers
from siltstone.llm.repeats import repeat_filter
from siltstone.llm.storage import text_size, written

#: Counters for the order of n-grams, as bits: at least and at most. Any order is correct; this one is nearly by rarity.
LEAST_COUNTERS, MOST_COUNTERS = 18, 22
#: Counters are summed in parts of so many bits.
COUNTER_PART = 15
#: Rows of the matrix in a block.
BLOCK_ROWS = 512
COLUMNS = 4096
#: Columns of the coarse product: n-grams by the first eight bits of their hash.
COARSE = 256
#: Rounds in which documents take the smallest label of those they share a prefix n-gram with.
LABEL_ROUNDS = 3
#: A key is hot beyond so many rows, and beyond one in so many of all: there can't be more hot keys than that.
HOT_ROWS, HOT_KEYS = 256, 4096
#: Blocks that share a key meet in pairs up to so many; a key of more has tiles of its own.
MEETING_BLOCKS = 4
BUCKET_BYTES = 32 << 20


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, at = kernels.laid_out(column)
    for a, b in kernels.blocks(at, 1 << 18):
        _, _, h, first = kernels.words(data[at[a] : at[b]], at[a : b + 1] - at[a], kernels.SPACED)
        for i in range(b - a):
            yield kernels.shingle_set(h[first[i] : first[i + 1]], n)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    h1 = int(np.bitwise_xor.reduce(kernels.mix(s * np.uint64(0x9E3779B97F4A7C15) + place))) if len(s) else 0
    h2 = int(kernels.mix(s ^ kernels.mix(place)).sum(dtype=np.uint64)) if len(s) else 0
    return h1 - (h1 >> 63 << 64), h2 - (h2 >> 63 << 64)


def counter_bits(n_bytes: int) -> int:
    """A table of counters that grows with the input, up to 4 million (16 MB in a worker that counts, 4 MB in one that reads)."""
    return min(max((n_bytes // 512).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)


def _counter(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(23)).astype(np.int64) & ((1 << bits) - 1)


def _bins(s: np.ndarray) -> bytes:
    """How many of a set's n-grams fall into each of the coarse columns."""
    n = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=COARSE)
    return n.astype(np.uint16 if n.max() < 1 << 16 else np.uint32).tobytes()


def least_overlap(size: np.ndarray | int, numerator: int, denominator: int):
    """The smallest overlap that a set of this size needs with any set at all."""
    return -(-numerator * size // denominator)


def size_class(size: int, numerator: int, denominator: int) -> int:
    """Sets of similar size, as a link needs, are of one class or of neighbouring ones."""
    width = math.log(denominator / numerator) * 1.000001
    return int(math.log(size) / width) if width else size


def _keys(prefixes: list[np.ndarray], owners: list[tuple[int, int, int]], numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Where links can be found: each prefix n-gram with the set's size class, and with the next; and whose it is."""
    if not prefixes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = [len(x) for x in prefixes]
    gram, owner = np.concatenate(prefixes), np.repeat(np.arange(len(owners)), n)
    own = np.repeat(np.array([size_class(o[2], numerator, denominator) for o in owners], np.uint64), n)
    return np.concatenate([kernels.mix(gram + kernels.mix(own + np.uint64(k))) for k in (1, 2)]), np.concatenate([owner, owner])


def document_sets(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """``(doc, size, h1, h2, bins)`` for every row, and rows ``(part, counts)`` with each task's n-gram counts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            sizes, h1, h2, bins = [], [], [], []
            for s in _sets(batch.column(1), n):
                np.add.at(counts, _counter(s, bits), 1)
                a, b = _signature(s)
                sizes.append(len(s))
                h1.append(a)
                h2.append(b)
                bins.append(_bins(s))
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bins, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        parts = counts.reshape(-1, 1 << COUNTER_PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), t) for t in (pa.int64(),) * 4 + (pa.binary(),)] + [pa.array(some, pa.int32()), pa.array([x.tobytes() for x in parts[some]], pa.binary())], names=names)

    names = ["doc", "size", "h1", "h2", "bins", "part", "counts"]
    return docs.mapInArrow(measure, "doc long, size long, h1 long, h2 long, bins binary, part int, counts binary")


def n_gram_ranks(measured: DataFrame, bits: int) -> np.ndarray:
    """A byte for each counter: the logarithm of its count over all documents."""

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(1 << COUNTER_PART, np.int64)
        for blob in table["counts"].to_pylist():
            total += np.frombuffer(blob, np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ranks": pa.array([np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.uint8)
    each = measured.where("part IS NOT NULL").select("part", "counts")
    for r in each.groupBy("part").applyInArrow(summed, "part int, ranks binary").collect():  # a byte for each counter
        out[r["part"] << COUNTER_PART : (r["part"] + 1) << COUNTER_PART] = np.frombuffer(r["ranks"], np.uint8)
    return out


def _prefixes(batch: pa.RecordBatch, n: int, counts: np.ndarray, numerator: int, denominator: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """Prefix n-grams of the batch's distinct sets, and ``(doc, h1, size)`` with the smallest document of each."""
    known: dict[tuple[int, int], int] = {}
    prefixes: list[np.ndarray] = []
    owners: list[tuple[int, int, int]] = []
    for doc, s in zip(batch.column(0).to_pylist(), _sets(batch.column(1), n), strict=True):
        if not len(s) or doc is None:
            continue
        signature = _signature(s)
        if (i := known.get(signature)) is not None:
            owners[i] = (min(doc, owners[i][0]), *owners[i][1:])
            continue
        known[signature] = len(owners)
        p = len(s) - least_overlap(len(s), numerator, denominator) + 1
        rank = counts[_counter(s, len(counts).bit_length() - 1)]
        if p < len(s):
            some = np.flatnonzero(rank <= np.partition(rank, p - 1)[p - 1])
            some = some[np.lexsort((s[some], rank[some]))[:p]]
        else:
            some = np.arange(len(s))
        prefixes.append(s[some])
        owners.append((doc, signature[0], len(s)))
    return prefixes, owners


def postings(docs: DataFrame, n: int, counts: np.ndarray, numerator: int, denominator: int, expected: int, n_buckets: int) -> DataFrame:
    """``(h, doc, hot)``: keys of prefix n-gram and size class that different sets share; ``doc`` is the smallest document
    of a set. ``hot`` keys have many documents, and there are ``HOT_KEYS`` at most."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return _keys(*_prefixes(batch, n, sent.value, numerator, denominator), numerator, denominator)[0]

    repeated = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, keys, 2 * expected, n_buckets))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = _prefixes(batch, n, sent.value, numerator, denominator)
            h, owner = _keys(found, owners, numerator, denominator)
            some = np.flatnonzero(repeated.value.passes(h))
            doc, signature = (np.array([o[k] for o in owners], np.int64)[owner[some]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(signature), pa.array(doc)], names=["h", "sig", "doc"])

    raw = docs.mapInArrow(shared, "h long, sig long, doc long")
    by_set = written(raw.groupBy("h", "sig").agg(F.min("doc").alias("doc")).select("h", "doc"), "postings")
    many = max(HOT_ROWS, by_set.count() // HOT_KEYS)
    # Near copies share many keys; of keys with the very same documents (128 bits of their set) one is enough.
    lists = by_set.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).where("k > 1")
    lists = written(lists.withColumn("hot", F.col("k") > many), "lists")
    one = lists.groupBy("k", "x", "y", "hot").agg(F.min("h").alias("h")).select("h", "hot")
    marked = by_set.join(F.broadcast(lists.where("hot").select("h", "hot")), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return by_key(marked, one)


def by_key(rows: DataFrame, keys: DataFrame, key: list[str] | str = "h") -> DataFrame:
    """``rows`` of ``(key, hot, ...)`` beside what ``keys`` of ``(key, hot, ...)`` has once for each key. Hot keys go to
    every worker, so that their rows stay where they are; the rest meet by key."""
    cold = rows.where("NOT hot").join(keys.where("NOT hot").drop("hot"), key)
    return cold.unionByName(rows.where("hot").join(F.broadcast(keys.where("hot").drop("hot")), key))


def labelled(shared: DataFrame) -> DataFrame:
    """``(doc, label)``: the smallest document that can be reached over shared n-grams in a few rounds."""
    labels = None
    for _ in range(LABEL_ROUNDS):
        own = shared.withColumn("label", F.col("doc")) if labels is None else shared.join(labels, "doc")
        least = own.groupBy("h", "hot").agg(F.min("label").alias("label"))
        labels = written(by_key(shared, least).groupBy("doc").agg(F.min("label").alias("label")), "block-labels")
    return labels


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the sets' incidence matrix with its transpose, over groups of columns."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    gram, row = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    size = np.diff(np.append(first, len(gram)))
    for k in np.unique(size[size > 1]).tolist():
        rows = row[first[size == k][:, None] + np.arange(k)]  # columns that k sets have
        if k * 16 > m and m > 16:
            for a in range(0, len(rows), COLUMNS):
                part = rows[a : a + COLUMNS]
                dense = np.zeros((m, len(part)), np.float32)
                dense[part, np.arange(len(part))[:, None]] = 1
                out += np.rint(dense @ dense.T).astype(np.int64)
        else:
            step = max(1, (1 << 20) // (k * k))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                pair = (part[:, :, None] * m + part[:, None, :]).reshape(-1)
                out += np.bincount(pair, minlength=m * m).reshape(m, m) if len(pair) * 4 > m * m else _added(pair, m)
    return out


def _added(pair: np.ndarray, m: int) -> np.ndarray:
    found, n = np.unique(pair, return_counts=True)
    out = np.zeros(m * m, np.int64)
    out[found] = n
    return out.reshape(m, m)


def block_links(docs: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links enough to connect what the block's links connect: from each row to the smallest document it reaches."""
    order = np.argsort(docs)
    docs, sets = docs[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets)
    linked = denominator * both >= numerator * (size[:, None] + size[None, :] - both)
    forest = _Forest(len(docs))
    for i, j in np.argwhere(np.triu(linked & (both > 0), 1)).tolist():
        forest.join(i, j)
    return [(int(docs[r]), int(docs[i])) for i in range(len(docs)) if (r := forest.root(i)) != i]


def may_link(bins: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which rows have a partner whose overlap, bounded by the coarse columns, is enough for their sizes."""
    size, out = bins.sum(axis=1), np.zeros(len(bins), bool)
    for i in range(len(bins) - 1):
        near = i + 1 + np.flatnonzero((denominator * size[i + 1 :] >= numerator * size[i]) & (denominator * size[i] >= numerator * size[i + 1 :]))
        most = np.minimum(bins[near], bins[i]).sum(axis=1)
        found = near[denominator * most >= numerator * (size[near] + size[i] - most)]
        out[found] = True
        out[i] |= len(found) > 0
    return out


def _runs(tile: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, np.int64)
    return list(zip(first.tolist(), [*first[1:].tolist(), len(tile)][: len(first)], strict=True))


def _coarse(tiles: DataFrame, bins: DataFrame, numerator: int, denominator: int, n_buckets: int) -> DataFrame:
    """Of the ``(tile, doc)`` rows those that the coarse product can't discard."""

    def keep(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        tile, doc, raw = table["tile"].to_numpy(), table["doc"].to_numpy(), table["bins"]
        kept = np.zeros(len(tile), bool)
        for a, b in _runs(tile):
            if b - a > 1:
                own = [x.as_py() for x in raw[a:b]]
                kept[a:b] = may_link(np.stack([np.frombuffer(x, np.uint16 if len(x) == 2 * COARSE else np.uint32) for x in own]).astype(np.int64), numerator, denominator)
        return pa.table({"tile": tile[kept], "doc": doc[kept]})

    rows = tiles.join(bins, "doc").select("tile", "doc", "bins").withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(n_buckets)))
    return rows.groupBy("bucket").applyInArrow(keep, "tile long, doc long")


def _tile_links(tiles: DataFrame, texts: DataFrame, n: int, numerator: int, denominator: int, n_buckets: int) -> DataFrame:
    """Links in tiles of ``(tile, doc)``. A text goes over the network once, its set to each of its tiles; tiles are
    small, and many share a task."""

    def dealt_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tile, grams = [], [], []
            for d, tiles_, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _sets(batch.column(1), n), strict=True):
                doc += [d] * len(tiles_)
                tile += tiles_
                grams += [s.tobytes()] * len(tiles_)
            yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(doc, pa.int64()), pa.array(grams, pa.binary())], names=["tile", "doc", "grams"])

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        tile, doc, grams = table["tile"].to_numpy(), table["doc"].to_numpy(), table["grams"]
        found: list[tuple[int, int]] = []
        for a, b in _runs(tile):
            if b - a > 1:
                found += block_links(doc[a:b], [np.frombuffer(x.as_buffer(), np.uint64) for x in grams[a:b]], numerator, denominator)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    of_doc = tiles.groupBy("doc").agg(F.collect_set("tile").alias("tiles"))
    dealt = texts.join(of_doc, "doc").select("doc", "text", "tiles").mapInArrow(dealt_sets, "tile long, doc long, grams binary")
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(n_buckets))).groupBy("bucket").applyInArrow(link, "a long, b long")


def open_keys(placed: DataFrame) -> DataFrame:
    """``(h, hot, wide, common, commons, others)`` of keys that can still bring a link between components: the component
    most frequent among a key's documents, and in how many parts of half a tile its documents and all others go."""
    half = F.lit(BLOCK_ROWS // 2 or 1)
    each = placed.groupBy("h", "hot", "block", "component").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("h", "hot", "component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    keys = each.groupBy("h", "hot").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.sum("places").alias("places"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    own = F.col("most")["n"]
    keys = keys.where((F.col("b0") != F.col("b1")) & (own < F.col("n")))
    return keys.select("h", "hot", (F.col("places") > MEETING_BLOCKS).alias("wide"), F.col("most")["component"].alias("common"), F.ceil(own / half).alias("commons"), F.ceil((F.col("n") - own) / half).alias("others"))


def meeting_blocks(placed: DataFrame) -> DataFrame:
    """``(tile, doc)``: the documents of two blocks that share keys of few blocks, in one tile for each pair of blocks."""
    left = placed.groupBy("h", "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    right = left.select("h", F.col("block").alias("other"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    # two blocks that hold one component, the same, have nothing left to find
    meet = left.join(right, "h").where("block < other AND NOT (c0 = c1 AND d0 = d1 AND c0 = d0)")
    ends = meet.select("h", F.xxhash64("block", "other").alias("tile"), F.explode(F.array("block", "other")).alias("block"))
    return ends.join(placed.select("h", "block", "doc"), ["h", "block"]).select("tile", "doc").distinct()


def key_tiles(placed: DataFrame) -> DataFrame:
    """``(tile, doc)``: a key's documents outside its most frequent component in parts, each part in a tile with every
    part of that component, and with every other part of its own kind."""
    is_common = F.col("component") == F.col("common")
    part = F.pmod(F.xxhash64("doc"), F.when(is_common, F.col("commons")).otherwise(F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_common = lambda other, common: F.xxhash64("h", F.lit(0), other, common)
    both = F.transform(upto("commons"), lambda j: with_common(part, j))
    rest = F.transform(F.filter(upto("others"), lambda j: j != part), lambda j: F.xxhash64("h", F.lit(1), F.least(part, j), F.greatest(part, j)))
    tiles = F.when(is_common, F.transform(upto("others"), lambda i: with_common(i, part))).otherwise(F.concat(both, rest))
    return placed.select(F.explode(tiles).alias("tile"), "doc")


def jaccard_components(docs: DataFrame, n: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles long, component_id long)`` for every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A row's set is its distinct ``n``-word
    shingles, with fewer words the whole sequence as one, without words nothing. Rows are linked where
    ``denominator * intersection >= numerator * union`` and the intersection isn't empty. ``component_id`` is
    the smallest id reachable over links, the row's own without any.

    Null and empty texts have 0 shingles and link with nothing. Rows of equal id are taken as one document:
    what one links with, all do. A row of null id has its shingles counted and a null component. Other columns
    are not read. An empty table gives an empty table. Words and shingles are compared by 64-bit hashes. Ids may be of any
    type that has an order; those that aren't integers are numbered in that order first.
    """
    spark = docs.sparkSession
    if not are_numbers(docs, id_col):
        numbers = id_numbers(docs, id_col)
        given = docs.select(quoted([id_col])[0].alias("id"), quoted([text_col])[0].alias("text"))
        found = jaccard_components(with_numbers(given, numbers), n, numerator, denominator, "number", "text")
        named = found.join(numbers, "number", "left").select("id", "n_shingles", F.col("component_id").alias("number"))
        placed = looked_up(named, numbers.select("number", F.col("id").alias("component_id")), "number", hot_values(named, "number"))
        return placed.select(F.col("id").alias(id_col), "n_shingles", "component_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    n_rows, n_bytes = text_size(rows)
    least_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    expected = max(1, n_bytes // 6 * (denominator - numerator) // denominator)
    n_buckets = max(least_buckets, -(-expected * 8 // BUCKET_BYTES))

    bits = counter_bits(n_bytes)
    measured = written(document_sets(rows, n, bits), "sets")
    counts = n_gram_ranks(measured, bits)
    shared = written(postings(rows, n, counts, numerator, denominator, expected, n_buckets), "shared")
    labels = labelled(shared)
    size = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    nodes = labels.join(size, "label").select("doc", "label", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"), "parts")
    nodes = written(nodes.withColumn("block", F.xxhash64("label", "part")), "nodes")

    bins = measured.where("size > 0").select("doc", "bins")

    def found(tiles: DataFrame, name: str) -> DataFrame:
        near = written(_coarse(tiles, bins, numerator, denominator, n_buckets), f"near-{name}")
        return written(_tile_links(near, rows, n, numerator, denominator, n_buckets), f"links-{name}")

    # A label's own document goes into each of its blocks, and so ties together what is like it.
    hub = nodes.where((F.col("doc") == F.col("label")) & (F.col("parts") > 1))
    hub = hub.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.xxhash64("label", "part").alias("tile"), "doc")
    links = found(nodes.select(F.col("block").alias("tile"), "doc").unionByName(hub).distinct(), "inside")
    joined = written(components(links), "components-inside")

    # Across blocks, only keys that more than one component and block still share can bring a new link, and only
    # between the documents that share them.
    placed = shared.join(nodes.select("doc", "block"), "doc").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("h", "hot", "doc", "block", F.coalesce("component", "doc").alias("component"))
    open_ = written(open_keys(placed), "open-keys")
    placed = written(by_key(placed, open_), "open")
    tiles = meeting_blocks(placed.where("NOT wide")).unionByName(key_tiles(placed.where("wide")))
    across = found(tiles, "across")
    final = components(links.unionByName(across)) if across.limit(1).count() else joined

    members = measured.where("part IS NULL").select("doc", "size", "h1", "h2")
    # equal sets are one node under their smallest document; rows of equal id tie their sets together
    of_set = members.where("size > 0").groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("k"))
    of_set = of_set.withColumn("hot", F.col("k") > max(HOT_ROWS, n_rows // HOT_KEYS)).join(final, "node", "left")
    of_set = written(of_set.select("h1", "h2", "hot", F.coalesce("component", "node").alias("component")), "sets-placed")
    marked = members.where("size > 0").join(F.broadcast(of_set.where("hot").select("h1", "h2", "hot")), ["h1", "h2"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    placed = by_key(marked, of_set, ["h1", "h2"]).select("doc", "size", "component").unionByName(members.where("size = 0").select("doc", "size", F.lit(None).cast("long").alias("component")))
    placed = placed.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    repeated_ids = members.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1 AND doc IS NOT NULL").select("doc")
    if repeated_ids.limit(1).count():
        placed = _tied(placed, repeated_ids, id_col)
    return placed.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))


def _tied(placed: DataFrame, repeated_ids: DataFrame, id_col: str) -> DataFrame:
    """Components that rows of one id lie in become one."""
    placed = written(placed, "placed")
    ties = placed.join(repeated_ids.withColumnRenamed("doc", id_col), id_col).select(F.col(id_col).alias("a"), F.col("component_id").alias("b"))
    merged = components(ties).withColumnsRenamed({"node": "component_id", "component": "_merged"})
    return placed.join(merged, "component_id", "left").select(id_col, "n_shingles", F.coalesce("_merged", "component_id").alias("component_id"))

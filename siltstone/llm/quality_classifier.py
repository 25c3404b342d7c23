"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios."""

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

#: Labelled rows that a model is fitted on, at most; of more, those with the smallest hash of the id.
MAX_FIT = 6000
#: Of these only texts with at most so many distinct features teach, so that what the driver holds is bounded (40 KB a text).
MAX_FEATURES = 10_000
BUCKETS = 1 << 18
#: Shapes: letters of either case, digits, and each other character as itself; runs of one shape become one.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B] = ord("A")
SHAPE[0x61:0x7B] = ord("a")
SHAPE[0x80:] = ord("a")
SHAPE[0x30:0x3A] = ord("0")


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return (kernels.mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(BUCKETS)).astype(np.int64)


def _bigrams(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    together = text[:-1] == text[1:]
    return kernels.shingles(h, 2)[together], text[:-1][together]


def _shaped(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shape = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    edge = at[:-1]
    keep[edge[edge < len(data)]] = True
    return shape[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``(text, bucket)``: words, word pairs, shapes, shape pairs, and how far three-word runs repeat."""
    n = len(at) - 1
    found = []
    _, _, h, first = kernels.words(data, at, kernels.SPACED)
    text = np.repeat(np.arange(n), np.diff(first))
    found.append(text * BUCKETS + _salted(h, 1))
    pair, owner = _bigrams(h, text)
    found.append(owner * BUCKETS + _salted(pair, 2))
    if len(h) >= 3:
        inside = text[:-2] == text[2:]
        runs, owner = kernels.shingles(h, 3)[inside], text[:-2][inside]
        order = np.lexsort((runs, owner))
        again = (runs[order][1:] == runs[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        share = np.bincount(owner[order][1:][again], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    else:
        share = np.zeros(n)
    found.append(np.arange(n) * BUCKETS + _salted(np.ceil(share * 10).astype(np.uint64), 3))
    shape, shape_at = _shaped(data, at)
    _, _, h, first = kernels.words(shape, shape_at, kernels.SPACED, lower=False)
    text = np.repeat(np.arange(n), np.diff(first))
    found.append(text * BUCKETS + _salted(h, 4))
    pair, owner = _bigrams(h, text)
    found.append(owner * BUCKETS + _salted(pair, 5))
    both = np.unique(np.concatenate(found))
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        margin = np.bincount(text, self.weights[bucket], n) / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([x for x, label in zip(rows, y, strict=True) if label == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + smoothing for k in (-1, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the smaller class weighs as much as the larger."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    share = {k: len(y) / (2 * max(1, int((y == k).sum()))) for k in (-1, 1)}
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    norms = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v, label = rows[i], values[i], y[i]
            gradient = label * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost * share[label])
            if (step := new - alpha[i]) != 0:
                w[x] += step * label * v
                bias += step * label
                alpha[i] = new
                moved += abs(step)
        if moved < 1e-4 * len(rows):
            break
    return w * ratio, bias


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little weight decay."""
    a, b, target = 1.0, 0.0, np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([np.sum((p - target) * margin) + 1e-3 * a, np.sum(p - target)])
        v = p * (1 - p)
        hess = np.array([[np.sum(v * margin**2) + 1e-3, np.sum(v * margin)], [np.sum(v * margin), np.sum(v) + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, passes: int = 10) -> Model:
    """A model of the rows' buckets. Margins for calibration come from two models, each fitted on the other half."""
    y = np.where(labels > 0, 1, -1)
    if not len(y) or len(set(y.tolist())) < 2:
        share = min(max((np.sum(y > 0) + 1) / (len(y) + 2), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    half, margin = np.arange(len(y)) % 2 == 0, np.zeros(len(y))
    for own in (half, ~half):
        chosen = np.flatnonzero(own)
        part, own_y = [rows[i] for i in chosen], y[chosen]
        w, bias = _descend(part, own_y, _ratios(part, own_y), cost, passes)
        for i in np.flatnonzero(~own):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias
    w, bias = _descend(rows, y, _ratios(rows, y), cost, passes)
    return Model(w, bias, *_calibrated(margin, y))


def _per_block(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, at = kernels.laid_out(column)
    for a, b in kernels.blocks(at):
        yield b - a, *features(data[at[a] : at[b]], at[a : b + 1] - at[a])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit: int = MAX_FIT, max_features: int = MAX_FEATURES) -> Model:
    """Fits on at most ``max_fit`` of the labelled documents, of at most ``max_features`` distinct features each.

    Of several labels of an id the smallest counts, of several texts of an id the one with the smallest
    features, so the model depends on the rows alone and not on their order. Null ids and labels teach nothing;
    null and empty texts are texts without words. Without labels of both kinds every text gets one score. Other
    columns aren't read.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_fit)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col).select(id_col, "_text", F.col("_label").cast("int"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, text, bucket in _per_block(batch.column(1)):
                rows += np.split(bucket.astype(np.int32), np.searchsorted(text, np.arange(1, n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in rows], pa.binary())], names=["id", "label", "buckets"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.BinaryType())])
    few = texts.mapInArrow(featured, schema).where(F.length("buckets") <= 4 * max_features)
    got = few.groupBy("id").agg(F.min(F.struct("buckets", "label")).alias("t")).select("id", "t.*").collect()  # bounded by max_fit and max_features
    got.sort(key=lambda r: r["id"])
    return fit([np.frombuffer(r["buckets"], np.int32).astype(np.int64) for r in got], np.array([r["label"] for r in got]))


def quality_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (double, 0 to 1; higher: label 1 is likelier); a column of that name is replaced, all others stay.

    Whole texts are scored; a null or empty text gets the score of no words. Rows are independent of each
    other, so ties and repeated rows get equal scores. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = kept_names(docs, ["score"])
    (text,) = spare(docs, "text")
    rows = docs.select(*quoted(names), quoted([text_col])[0].cast("string").alias(text))
    schema = T.StructType([*docs.select(*quoted(names)).schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.scores(text, bucket, n) for n, text, bucket in _per_block(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=schema.names)

    return map_in_arrow(rows, score, schema)

"""Static word-piece embedding in Arrow batches, over a vocabulary and a matrix that are sent to the workers once."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PIECES, MAX_WORD = 512, 100
# fixed value: how a model file begins
MODEL_MAGIC = b"M2V1"


@dataclass(frozen=True)
class StaticModel:
    """``vocabulary`` maps pieces to rows; rows are eight-bit with a scale each."""

    vocabulary: dict[str, int]
    scales: np.ndarray
    weights: np.ndarray

    @classmethod
    def quantized(cls, vocabulary: dict[str, int], vectors: np.ndarray) -> StaticModel:
        top = np.abs(vectors).max(axis=1)
        scales = np.where(top > 0, top / 127, 1.0).astype(np.float32)
        return cls(vocabulary, scales, np.floor(vectors / scales[:, None] + 0.5).astype(np.int8))


def read_model(spark: SparkSession, path: str) -> StaticModel:
    """A model file: the magic, the header's length (32 bits, little-endian), a JSON header with ``vocab`` (pieces in order of their
    rows) and ``dim``, a scale for each row as 32-bit floats, and eight-bit weights. It is read once, on the driver."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    if data[:4] != MODEL_MAGIC:
        raise ValueError(f"{path} is no model file")
    size = int.from_bytes(data[4:8], "little")
    header, at = json.loads(data[8 : 8 + size]), 8 + size
    n, dim = len(header["vocab"]), header["dim"]
    scales = np.frombuffer(data, "<f4", n, at)
    weights = np.frombuffer(data, np.int8, n * dim, at + 4 * n).reshape(n, dim)
    return StaticModel({piece: i for i, piece in enumerate(header["vocab"])}, scales, weights)


def model_bytes(model: StaticModel) -> bytes:
    """What ``read_model`` reads."""
    header = json.dumps({"vocab": sorted(model.vocabulary, key=model.vocabulary.get), "dim": int(model.weights.shape[1])}).encode()
    return MODEL_MAGIC + len(header).to_bytes(4, "little") + header + model.scales.astype("<f4").tobytes() + model.weights.astype(np.int8).tobytes()


def words(text: str) -> list[str]:
    """Without accents and case; marks and punctuation, and each ideograph, stand alone."""
    out, word = [], ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or (kind.startswith("C") and not c.isspace()):
            continue
        alone = kind[0] in "PS" or "一" <= c <= "鿿"
        if c.isspace() or alone:
            out += [word] if word else []
            out += [c] if alone else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def pieces(text: str, vocabulary: dict[str, int]) -> list[int]:
    """Longest match first; a word with a part that has no piece is left out."""
    ids: list[int] = []
    for word in words(text):
        if len(word) > MAX_WORD:
            continue
        own, start = [], 0
        while start < len(word):
            end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocabulary), None)
            if end is None:
                own = []
                break
            own.append(vocabulary[("##" if start else "") + word[start:end]])
            start = end
        ids += own
        if len(ids) >= MAX_PIECES:
            break
    return ids[:MAX_PIECES]


def text_vector(text: str | None, model: StaticModel) -> np.ndarray:
    """The mean of the pieces' vectors at length one; a zero vector for a text without pieces."""
    ids = pieces(text or "", model.vocabulary)
    v = (model.weights[ids].astype(np.float64) * model.scales[ids, None].astype(np.float64)).sum(axis=0) if ids else np.zeros(model.weights.shape[1])
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).astype(np.float32)


def embedded(rows: DataFrame, model: StaticModel, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Adds the vector of a text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_vector(text, sent.value) for text in texts])

    return rows.withColumn(out, embed(F.col(text_col)))

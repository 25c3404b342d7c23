"""Lines, terms and numbers as native expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import STOP_WORDS

# fixed values: what a term is, and where compound ones are cut
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+"
CAMEL = r"_+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def lines(text: Column) -> Column:
    """Logical lines: none in an empty text; a final line feed ends the last line and begins none."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def line_count(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).when(F.endswith(text, F.lit("\n")), feeds).otherwise(feeds + 1).cast("long")


def _kept(words: Column, least: int) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(STOP_WORDS))


def terms(text: Column) -> Column:
    """Lower-cased identifiers and numbers of two characters or more, and the parts (three or more) of those that are compound."""

    def of_token(token: Column) -> Column:
        whole = F.lower(token)
        parts = F.filter(F.transform(F.split(token, CAMEL), F.lower), lambda p: p != whole)
        parts = F.when(token.rlike(r"[a-z][A-Z]|_"), _kept(parts, 3)).otherwise(F.array().cast("array<string>"))
        return F.concat(_kept(F.array(whole), 2), parts)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0), of_token))


_TOKEN, _CAMEL, _COMPOUND = re.compile(IDENTIFIER.encode()), re.compile(CAMEL.encode()), re.compile(rb"[a-z][A-Z]|_")
_STOP = {w.encode() for w in STOP_WORDS}


def term_counts(text: str) -> dict[bytes, int]:
    """How often each term stands in a text. Terms are ASCII, so bytes do; a compound token is cut up once."""
    data = text.encode()
    out = {t: n for t, n in Counter(_TOKEN.findall(data.lower())).items() if len(t) >= 2 and t not in _STOP}
    if _COMPOUND.search(data):
        for token, n in Counter(t for t in _TOKEN.findall(data) if _COMPOUND.search(t)).items():
            whole = token.lower()
            for part in map(bytes.lower, _CAMEL.split(token)):
                if len(part) >= 3 and part != whole and part not in _STOP:
                    out[part] = out.get(part, 0) + n
    return out


#: Terms of about so many bytes of text are held at once; as Python objects they take a hundred times as much.
SLICE_BYTES = 1 << 18


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of ``SLICE_BYTES`` of a text column, or of one longer text and what stands beside it."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def half_up(x: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.2) + 1


def compact_number(x: Column) -> Column:
    """12.3M, 4.5k or the number itself."""
    scaled = lambda n, unit: F.concat(F.format_string("%.1f", x / n), F.lit(unit))
    return F.when(x >= 1_000_000, scaled(1_000_000, "M")).when(x >= 1_000, scaled(1_000, "k")).otherwise(x.cast("string"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quantized(vector: Column) -> Column:
    """``struct(q array<tinyint>, scale double)``: eight bits a component, scaled by the largest."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return _let(scale, lambda k: F.struct(F.transform(vector, lambda x: F.floor(x.cast("double") / k + 0.5).cast("tinyint")).alias("q"), k.alias("scale")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return _let(F.sqrt(dot(vector, vector)), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))

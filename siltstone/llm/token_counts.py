"""Token counts: pieces are counted once per distinct pre-token, then summed over each document's pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pre-token ends where no piece can go on: a piece holds the space mark only in front, and never a line feed.
PRE_TOKEN = re.compile(r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+")
#: A worker forgets its counts beyond so many pre-tokens; they are then counted anew, so this bounds memory and nothing else.
REMEMBERED = 1_000_000


def _counter(model_file: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for i in range(model.get_piece_size()):
        if not model.is_byte(i) and ("\n" in (p := model.id_to_piece(i)) or "▁" in p.lstrip("▁")):
            raise ValueError(f"piece {p!r} crosses the borders of pre-tokens")
    return model


def count_pieces(model, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts a space mark before what it is given: that is the
    token's own first space, or else it stands before a line feed, apart from the token, and isn't counted."""
    given = [t[1:] if t[0] in " ▁" else f"\n{t}" for t in tokens]
    alone = len(model.encode("\n"))
    empty = len(model.encode("\n ")) - alone  # a lone space mark, for which the text given would be empty
    sizes = [len(x) for x in model.encode(given, num_threads=1)]
    return [(n if g else empty) if t[0] in " ▁" else n - alone for t, g, n in zip(tokens, given, sizes, strict=True)]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes long, n_tokens long)`` for every row, repeated rows and ids included.

    ``n_tokens`` is what the library's ``encode`` gives for the whole text without begin or end tokens.
    A null or empty text has no bytes and no tokens. Columns other than the two named are not read.

    Each Arrow batch finds its distinct pre-tokens, counts pieces for those not yet known to the worker,
    and joins the counts to the documents' frequencies. A global join would shuffle every
    (document, pre-token) pair, more bytes than the texts hold, to save a count that takes microseconds.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = _counter(model_file), {}
        for batch in batches:
            frequencies, n_bytes = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                # the library's mark in front of the text joins the first pre-token
                frequencies.append(Counter(PRE_TOKEN.findall(f" {text}" if text else "")))
            if len(pieces) > REMEMBERED:
                pieces = {}
            if new := list({t for f in frequencies for t in f if t not in pieces}):
                pieces.update(zip(new, count_pieces(model, new), strict=True))
            n_tokens = [sum(n * pieces[t] for t, n in f.items()) for f in frequencies]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(count, schema)

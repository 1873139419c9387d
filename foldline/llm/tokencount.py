"""Tokens of whole texts under public tokenizers, counted by the libraries that run them."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import text_batches, texts_of, with_columns


def rank_table(path: str) -> bytes:
    """The content of a file of ranks: a token in Base64 and its rank on each line."""
    with open(path, "rb") as file:
        return file.read()


def counter(table: bytes, pattern: str):
    """An encoding of the tiktoken library; special tokens' strings are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, table.splitlines()) if token}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, tokenizers: dict[str, str], pattern: str, text_col: str = "text") -> DataFrame:
    """`df` without its text, with tokenizer_version string and n_tokens long: one row for each row and tokenizer.

    `tokenizers` names a file of ranks for each version; files are read on the driver and broadcast. Null and empty texts have no
    tokens; whole texts are counted. Rows, repeats included, stay as they are; an empty table gives none. Columns of `df` with the
    names made here, in whatever case, are an error (ValueError).
    """
    added = ("tokenizer_version", "n_tokens")
    if clash := set(added) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    shared = df.sparkSession.sparkContext.broadcast({v: rank_table(path) for v, path in sorted(tokenizers.items())})
    names = [f"c{i}" for i in range(len(df.columns))]
    body = names[df.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = None
        for batch in batches:
            encodings = encodings or {v: counter(table, pattern) for v, table in shared.value.items()}
            texts = [t or "" for t in texts_of(batch, body)]
            for version, encoding in encodings.items():
                counts = np.fromiter((len(encoding.encode_ordinary(t)) for t in texts), np.int64, len(texts))
                versions = pa.array([version] * len(texts), pa.string())
                yield with_columns(batch, {"tokenizer_version": versions, "n_tokens": pa.array(counts)}, (body,))

    fields = [f"{n} {t}" for n, (_, t) in zip(names, df.dtypes, strict=True) if n != body]
    out = text_batches(df).toDF(*names).mapInArrow(run, ", ".join([*fields, "tokenizer_version string", "n_tokens long"]))
    return out.toDF(*[c for c in df.columns if c != text_col], *added)

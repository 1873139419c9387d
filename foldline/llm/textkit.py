"""Word and shingle helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Words of the near-duplicate operators: anything but ASCII white space.
SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes of a text with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingle_hashes(data: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `width` words, repeats included.

    Fewer words than `width`: one shingle, the whole sequence. No words: an empty array.
    """
    words = SPACE_WORD.findall(data)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    # The shingles are slices of the joined words, found by offsets: no join for each shingle.
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.zeros(n, np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[width - 1 :]
    spans = zip(starts[: n - width + 1].tolist(), ends.tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n - width + 1)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """An Arrow batch without the columns `drop` and with further ones behind."""
    kept = [n for n in batch.schema.names if n not in drop]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept]
    return pa.RecordBatch.from_arrays([*arrays, *columns.values()], [*kept, *columns])


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


#: Rows of an Arrow batch of texts. Batches are whole in memory on both sides, and their longest texts may be very long.
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session sends no more than TEXT_ROWS rows at once to Python from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if not 0 < now <= TEXT_ROWS:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df

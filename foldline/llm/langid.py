"""Language identification by compression with a raw-content zstandard dictionary for each language.

A text is cut into blocks; every block is compressed with each language's dictionary at two levels, and the language
whose dictionary gives the smallest sum wins. The margin to the next is the score; narrow margins
are marked as rejected. Dictionaries are whole texts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import text_batches, texts_of, with_columns

UNKNOWN = "und"
#: Different labelled texts of each language that a dictionary is made of, each of them whole.
SAMPLE_ROWS = 100
#: Languages at most; more in the labelled rows are an error.
MOST_LANGUAGES = 200
#: Characters of a block. A dictionary helps from the first byte on, so blocks are short.
BLOCK = 1024
#: Sizes are summed over these levels: they look for matches in different ways, and whole bytes of one are coarse for short texts.
LEVELS = (3, 6)
#: Least margin, as a part of the second-best size, for a prediction to be accepted.
MARGIN = 0.005


def held_out(key: Column) -> Column:
    """The rows kept from fitting: those whose key's CRC-32 is divisible by 5. Null keys are never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Languages, most frequent first, and their dictionaries' content."""

    languages: list[str]
    contents: list[bytes]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Dictionaries from rows with a label and a text; an empty table gives a model of no languages.

    A language's dictionary is its `sample_rows` different texts with the smallest hashes, each of them whole, or all where it has fewer: the sample
    is the same however the rows are stored and however often a text is repeated, and no language is left out. At most
    `sample_rows` x `most_languages` texts go to the driver; more languages are an error (ValueError).
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("place", F.xxhash64("text"))
    # Different texts are counted to within some hundredths: that is enough to choose a range of hashes that holds somewhat more than asked for.
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place", 0.02).alias("texts"), F.min("place").alias("least"))
    found = {r["lang"]: r for r in seen.limit(most_languages + 1).collect()}
    if len(found) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not found:
        return Model([], [])
    kept = F.lit(False)
    for lang, r in found.items():
        share = (2 * sample_rows + 40) / r["texts"]
        bound = max(r["least"], -(1 << 63) + int(share * (1 << 64))) if share < 1 else (1 << 63) - 1
        kept = kept | ((F.col("lang") == lang) & (F.col("place") <= bound))
    sample = rows.where(kept).distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    texts: dict[str, list[str]] = {}
    for r in sample.withColumn("order", order).where(F.col("order") <= sample_rows).orderBy("lang", "order").toLocalIterator():
        texts.setdefault(r["lang"], []).append(prepared(r["text"]))
    languages = sorted(texts, key=lambda x: (-found[x]["n"], x))
    return Model(languages, [" ".join(texts[x]).encode("utf-8", "surrogatepass") for x in languages])


#: What is neither a letter nor a mark: case, digits and signs don't tell languages apart.
OTHER = re.compile(r"[\W\d_]+")


def prepared(text: str) -> str:
    """Lower case, with anything but letters as single spaces; empty if no letter is left."""
    clean = OTHER.sub(" ", text.lower()).strip()
    return clean if any(map(str.isalpha, clean)) else ""


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """Tables and window are sized so that all of the content can be found, however long it is."""
    size = (len(content) + 4 * BLOCK).bit_length()
    base = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content))
    made = zstandard.ZstdCompressionParameters(
        window_log=max(base.window_log, size), hash_log=max(base.hash_log, size), chain_log=max(base.chain_log, size), search_log=base.search_log,
        min_match=base.min_match, target_length=base.target_length, strategy=base.strategy, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=made)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=made)


class Classifier:
    def __init__(self, model: Model):
        self.languages = model.languages
        self.compressors = [[_compressor(c, level) for level in LEVELS] for c in model.contents]

    def sizes(self, text: str) -> np.ndarray | None:
        """Compressed bytes of the whole text with each dictionary, over all levels; None without letters."""
        clean = prepared(text)
        if not clean:
            return None
        data = [f" {clean[i : i + BLOCK]} ".encode("utf-8", "surrogatepass") for i in range(0, len(clean), BLOCK)]
        return np.array([sum([len(c.compress(b)) for c in own for b in data]) for own in self.compressors])

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is what the best dictionary saves of the size with the second best, 0 to 1.

        Ties go to the language with more labelled rows, then the first by name.
        """
        sizes = self.sizes(text) if text and self.languages else None
        if sizes is None:
            return UNKNOWN, 0.0
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.languages[0], 1.0
        second = np.partition(sizes, 1)[1]
        return self.languages[best], float(second - sizes[best]) / float(second)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, margin: float = MARGIN) -> DataFrame:
    """`df`, without its text unless `keep_text`, with lang_pred string, lang_score double and lang_rejected boolean.

    Null and empty texts, and texts without a letter, are `und` with score 0 and rejected; so is all where the
    model has no languages. Others get a learned language, and are rejected if the score is under `margin`.
    Rows, repeats included, stay as they are; an empty table gives none. Columns of `df` with the names made here, in whatever
    case, are an error (ValueError).
    """
    added = ("lang_pred", "lang_score", "lang_rejected")
    if clash := set(added) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    names = [f"c{i}" for i in range(len(df.columns))]
    body = names[df.columns.index(text_col)]
    gone = () if keep_text else (body,)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value)
        for batch in batches:
            found = [own.classify(t) for t in texts_of(batch, body)]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            rejected = pa.array([x == UNKNOWN or s < margin for x, s in found], pa.bool_())
            yield with_columns(batch, {"lang_pred": lang, "lang_score": score, "lang_rejected": rejected}, gone)

    fields = [f"{n} {t}" for n, (_, t) in zip(names, df.dtypes, strict=True) if n not in gone]
    schema = ", ".join([*fields, "lang_pred string", "lang_score double", "lang_rejected boolean"])
    out = text_batches(df).toDF(*names).mapInArrow(run, schema)
    return out.toDF(*[c for n, c in zip(names, df.columns, strict=True) if n not in gone], *added)

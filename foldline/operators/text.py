"""Text features: token counts, fold-local TF-IDF, signed hashing, and chunks for an encoder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.scalars import words
from foldline.operators.settled import sent


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, token, tf) of every row, whose keys are unique; null and empty texts give none.

    A row's words are sorted and counted by runs inside the row, so nothing is shuffled.
    """
    sorted_ = docs.select(F.col(key), F.sort_array(words(F.col(text))).alias("_w"))
    at = F.sequence(F.lit(0), F.size("_w") - 1)
    first = F.filter(at, lambda k: (k == 0) | (F.get("_w", k) != F.get("_w", k - 1)))
    runs = sorted_.where(F.size("_w") > 0).select(key, "_w", first.alias("_f"))
    ends = F.transform("_f", lambda a, k: F.struct(F.get("_w", a).alias("token"), (F.coalesce(F.get("_f", k + 1), F.size("_w")) - a).cast("long").alias("tf")))
    return runs.select(key, F.inline(ends))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(token, df): documents with each token, from (doc, token) rows that are unique."""
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def expanding_frequency(counts: DataFrame, entries: DataFrame, min_df: int, series: str = "series") -> DataFrame:
    """(series, fold, token, df) of each fold's training origins, where df is `min_df` at least.

    `counts` is (series, j, token), in which a row may come many times, and `entries` as `folds.entry_folds` gives them. Frequencies only grow from fold to
    fold, so they are running sums over the folds at which origins enter, each of which holds until the next; training sets are never written out.
    A token's origins are bits, 64 to a word, put together before anything is moved: what is shuffled is bounded by tokens and origins, not by texts.
    """
    word, bit = F.floor(F.col("j") / 64).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("j") % 64).cast("int"))
    found = counts.groupBy(series, "token", word).agg(F.bit_or(bit).alias("_bits")).repartition(series, "token")
    often = F.sum(F.bit_count("_bits")).over(Window.partitionBy(series, "token"))
    found = found.withColumn("_often", often).where(F.col("_often") >= min_df)
    masks = entries.groupBy(series, word, "entry").agg(F.bit_or(bit).alias("_mask"), F.max("last").alias("last"))
    both = F.col("_bits").bitwiseAND(F.col("_mask"))
    entered = found.join(sent(masks), [series, "_w"]).where(both != 0)
    steps = entered.groupBy(series, "token", "entry").agg(F.sum(F.bit_count(both)).alias("n"), F.max("last").alias("last"))
    order = Window.partitionBy(series, "token").orderBy("entry")
    held = steps.select(
        series, "token", "entry", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("df"), F.coalesce(F.lead("entry").over(order) - 1, F.col("last")).alias("until")
    )
    return held.where(F.col("df") >= min_df).select(series, F.explode(F.sequence("entry", "until")).alias("fold"), "token", "df")


def top_tokens(frequency: DataFrame, most: int, by: Sequence[str] = ("fold",)) -> DataFrame:
    """(by, token, df, rank): the `most` tokens of largest df of each group, ties by token."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("df"), "token"))
    return frequency.select(*by, "token", "df").withColumn("rank", rank).where(F.col("rank") <= most)


def fold_vocabulary(counts: DataFrame, train: DataFrame, min_df: int, max_features: int, key: str = "doc_id", by: Sequence[str] = ("fold",)) -> DataFrame:
    """(by, token, df, rank): the most frequent tokens of each fold's training documents, ties by token.

    `train` is (by, key). Frequencies are aggregated before the ranking, whose window holds a fold's distinct tokens.
    """
    df = train.join(counts.select(key, "token"), key).groupBy(*by, "token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return top_tokens(df, max_features, by)


def tfidf(counts: DataFrame, sizes: DataFrame, rows: DataFrame, vocabulary: DataFrame, keys: Sequence[str] = ("doc_id",), by: Sequence[str] = ("fold",)) -> DataFrame:
    """(rows' columns, token, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each row of `rows` scaled to length 1.

    `rows` is (by, keys, ...), unique; `counts` (keys, token, tf); `sizes` (by, n) of each fold's training set; `vocabulary` (by, token, df).
    """
    cells = rows.join(counts, list(keys)).join(vocabulary.select(*by, "token", "df"), [*by, "token"]).join(sizes, list(by))
    idf = F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    cells = cells.withColumn("raw", (1.0 + F.ln(F.col("tf").cast("double"))) * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*rows.columns)))
    return cells.select(*rows.columns, "token", (F.col("raw") / F.greatest(norm, F.lit(1e-15))).alias("weight"))


def hash_buckets(docs: DataFrame, dimension: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, bucket, value): signed sums of hashed tokens, documents scaled to length 1; buckets that cancel to 0 are left out."""
    digest = F.sha2(F.col("token").cast("binary"), 256)
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, F.col("tf")).otherwise(-F.col("tf"))
    cells = token_counts(docs, text, key).select(key, bucket.alias("bucket"), sign.alias("s"))
    sums = cells.groupBy(key, "bucket").agg(F.sum("s").alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(key)).cast("double"))
    return sums.select(key, "bucket", (F.col("s") / norm).alias("value"))


def hash_embeddings(docs: DataFrame, dimension: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, embedding array<double>): `hash_buckets` made dense; zeros for a document without words."""
    cells = hash_buckets(docs, dimension, text, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), dimension)
    return docs.select(key).distinct().join(cells, key, "left").select(key, F.coalesce(dense, none).alias("embedding"))


def chunks(ids: Column, content: int, overlap: int) -> Column:
    """Overlapping chunks of an array: starts every content - overlap up to its end, also where nothing new is in the last."""
    stride = content - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than content")
    return F.transform(F.sequence(F.lit(0), F.size(ids) - 1, F.lit(stride)), lambda s: F.slice(ids, s + 1, content))


def prepared(chunk: Column, cls: int, sep: int) -> Column:
    """A chunk with its end marks."""
    return F.concat(F.array(F.lit(cls)), chunk, F.array(F.lit(sep)))


def padded(ids: Column, width: Column, pad: int) -> Column:
    """Right-padded to a width: struct(input_ids, attention_mask, token_type_ids)."""
    short = F.greatest(width - F.size(ids), F.lit(0))
    mask = F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), short))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), short)).alias("input_ids"), mask.alias("attention_mask"), F.array_repeat(F.lit(0), F.greatest(width, F.size(ids))).alias("token_type_ids"))


def mean_vector(rows: DataFrame, by: list[str], vector: str, normalise: bool = True) -> DataFrame:
    """(by, vector): the mean of each group's vectors position by position, scaled to length 1 unless told otherwise."""
    cells = rows.select(*by, F.posexplode(vector).alias("p", "x")).groupBy(*by, "p").agg(F.avg("x").alias("x"))
    out = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda c: c["x"]).alias(vector))
    if not normalise:
        return out
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-15))
    return out.withColumn("_norm", norm).withColumn(vector, F.transform(vector, lambda x: x / F.col("_norm"))).drop("_norm")

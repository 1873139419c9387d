"""The driver's tables seen as series, targets, statements, labels and predictions.

A series is an event type, its origins are six-hour buckets, and its rate the bucket's mean value. Sums are of whole
hundredths, so that rates and changes are the same doubles in whatever order rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions.classes import CLASSES, choose_class, direction
from foldline.functions.scalars import half_up
from foldline.operators import folds as fold_ops
from foldline.operators import series
from foldline.operators.settled import sent

#: Seconds of a bucket; changes within this many bp are a hold; origins from this position on are evaluated.
BUCKET, WIDTH, EVALUATED = 21_600, 300, 80


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, i, origin_id, bucket, rate, change_bp)."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.floor(epoch_seconds(F.col("ts")) / BUCKET).alias("bucket"), "value")
    rates = events.groupBy("series", "bucket").agg((F.sum(half_up(F.col("value") * 100)) / (F.count("*") * 100.0)).alias("rate"))
    placed = series.indexed(rates)
    order = F.lag("rate").over(series.Window.partitionBy("series").orderBy("bucket"))
    change = half_up((F.col("rate") - order) * 100)
    return placed.select("series", "i", F.concat_ws("-", "series", "bucket").alias("origin_id"), "bucket", "rate", change.alias("change_bp"))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`origins` with their targets, all rows: the last of a series is unobserved."""
    return series.targets(origins(spark, sf_dir), WIDTH, F.col("i") % 3)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir).where("label_status = 'observed'")


def folds(data: DataFrame) -> DataFrame:
    return fold_ops.evaluation_folds(data, F.col("i") >= EVALUATED)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, fold, i, bucket, arm, true_class, predicted_class, p_cut, p_hold, p_hike, true_bp, predicted_bp) of four simple arms.

    persistence repeats the current direction, reversal turns it round, base_rate takes the training shares, shrunk is midway between
    persistence and base_rate.
    """
    data = observed(spark, sf_dir)
    at = folds(data)
    sums = {f"n_{c}": (F.col("direction") == c).cast("long") for c in CLASSES} | {"total_bp": F.col("action_bp")}
    known = fold_ops.expanding_sums(at, data, sums)
    rows = known.join(data.select("series", "i", "change_bp", "action_bp", F.col("direction").alias("true_class")), ["series", "i"])
    now, back = direction(F.col("change_bp"), WIDTH), direction(-F.col("change_bp"), WIDTH)
    base = [(F.col(f"n_{c}") + 1.0) / (F.col("n") + 3.0) for c in CLASSES]
    same = [F.when(now == c, 0.6).otherwise(0.2) for c in CLASSES]
    turned = [F.when(back == c, 0.5).otherwise(0.25) for c in CLASSES]
    mean = F.col("total_bp") / F.col("n")
    arms = {
        "base_rate": (base, mean),
        "persistence": (same, F.col("change_bp") * 1.0),
        "reversal": (turned, F.col("change_bp") * -1.0),
        "shrunk": ([(b + s) / 2.0 for b, s in zip(base, same, strict=True)], (mean + F.col("change_bp")) / 2.0),
    }
    cells = [
        F.struct(F.lit(a).alias("arm"), choose_class(*p).alias("predicted_class"), *[x.alias(f"p_{c}") for c, x in zip(CLASSES, p, strict=True)], bp.alias("predicted_bp"))
        for a, (p, bp) in arms.items()
    ]
    return rows.select("series", "fold", "i", "bucket", "true_class", F.col("action_bp").alias("true_bp"), F.inline(F.array(*cells)))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents; `dealt_documents` says whose statements they are."""
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def hashed(key: Column, first: int, n: Column) -> Column:
    """A number in [0, n) from 12 hex digits, from place `first` on, of the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(key.cast("string")), first, 12), 16, 10).cast("long") % n


def dealt_documents(spark: SparkSession, sf_dir: str, data: DataFrame) -> DataFrame:
    """(doc_id, series, i): every document dealt by its id's MD5 to one origin of `data`, whose i count from 0 in each series."""
    return dealt(read(spark, sf_dir, "documents").select("doc_id").distinct(), data)


def dealt(docs: DataFrame, data: DataFrame) -> DataFrame:
    """`docs` (doc_id, ...), row by row, beside the (series, i) that their ids are dealt to; where series are few, no row of `docs` is moved."""
    lengths = data.groupBy("series").agg((F.max("i") + 1).alias("n"))
    numbered = lengths.withColumn("no", F.row_number().over(series.Window.orderBy("series")) - 1)  # a row a series
    to = docs.withColumn("no", hashed(F.col("doc_id"), 1, F.lit(max(1, lengths.count()))))
    return to.join(sent(numbered), "no").select(*docs.columns, "series", hashed(F.col("doc_id"), 13, F.col("n")).alias("i"))


def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, split, first, second, first_repeat): labels as scores, missing ones null.

    quality and toxic become -1 or 1, and 0 where the document's id is divisible by 4; a second rating of quality turns some round.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id")
    given = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    zero = F.col("doc_id") % 4 == 0

    def score(c: str) -> Column:
        return F.when(F.col(c).isNull(), None).when(zero, 0).otherwise(2 * F.col(c) - 1).cast("int")

    again = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, -score("quality")).otherwise(score("quality"))
    split = series.split_name(F.col("doc_id"), [(80, "train"), (98, "validation")], "test")
    return given.select("doc_id", split.alias("split"), score("quality").alias("first"), score("toxic").alias("second"), again.cast("int").alias("first_repeat"))

"""Rolling-origin folds: a target may be learned from once it is published, never before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.classes import CLASSES


def evaluation_folds(data: DataFrame, eligible: Column, series: str = "series") -> DataFrame:
    """(series, fold, i, bucket): the origins that are forecast, numbered from 1 in each series."""
    picked = data.where(eligible)
    number = F.row_number().over(Window.partitionBy(series).orderBy("i"))
    return picked.select(series, number.cast("long").alias("fold"), "i", "bucket")


def training_pairs(folds: DataFrame, data: DataFrame, series: str = "series") -> DataFrame:
    """(series, fold, i, j): the earlier rows whose target was published by the fold's time.

    An equi-join on the series with the order as a further condition, so it hashes and never compares series.
    """
    past = data.select(F.col(series).alias("_s"), F.col("i").alias("j"), F.col("target_pub").alias("_pub"))
    at = folds.select(series, "fold", "i", "bucket")
    known = (F.col(series) == F.col("_s")) & (F.col("j") < F.col("i")) & (F.col("_pub") <= F.col("bucket"))
    return at.join(past, known).select(series, "fold", "i", "j")


def entry_folds(folds: DataFrame, data: DataFrame, series: str = "series") -> DataFrame:
    """(series, j, entry, last): the first fold that may learn from row j, and the series' last fold, which then all others up to it may, too.

    Training sets only grow, so this says all that `training_pairs` says, in one row for each row of `data`. Both ends come from one order by
    time: a row enters at the next question at or after its target's publication. It needs targets published after their origin (`leakage` checks it).
    """
    ins = data.where("target_pub IS NOT NULL").select(series, F.col("target_pub").alias("_t"), F.lit(0).alias("_ask"), F.col("i").alias("j"), F.lit(None).cast("long").alias("fold"))
    asks = folds.select(series, F.col("bucket").alias("_t"), F.lit(1).alias("_ask"), F.lit(None).cast("long").alias("j"), "fold")
    order = Window.partitionBy(series).orderBy("_t", "_ask")
    entry = F.min("fold").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = ins.unionByName(asks).select(series, "j", entry.alias("entry"), F.max("fold").over(Window.partitionBy(series)).alias("last"))
    return placed.where("j IS NOT NULL AND entry IS NOT NULL")


def expanding_sums(folds: DataFrame, data: DataFrame, sums: dict[str, Column], series: str = "series") -> DataFrame:
    """(series, fold, i, bucket, n, *sums) over each fold's training rows, without making the pairs.

    Rows enter at the time their target is published, folds ask at their own time, and running sums over one order
    answer. That order needs targets of rows at or after an origin to be published after it (`leakage` checks it).
    """
    ins = data.where("target_pub IS NOT NULL").select(
        series, F.col("target_pub").alias("_t"), F.lit(0).alias("_ask"), F.lit(None).cast("long").alias("fold"), F.lit(None).cast("long").alias("i"),
        F.lit(1).cast("long").alias("_n"), *[c.alias(f"_{n}") for n, c in sums.items()],
    )
    kinds = {f.name: f.dataType for f in ins.schema}
    asks = folds.select(
        series, F.col("bucket").alias("_t"), F.lit(1).alias("_ask"), "fold", "i", F.lit(None).cast("long").alias("_n"),
        *[F.lit(None).cast(kinds[f"_{n}"]).alias(f"_{n}") for n in sums],
    )
    order = Window.partitionBy(series).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    total = [F.coalesce(F.sum(f"_{n}").over(order), F.lit(0).cast(kinds[f"_{n}"])).alias(n) for n in ("n", *sums)]
    return ins.unionByName(asks).select(series, "fold", "i", F.col("_t").alias("bucket"), "_ask", *total).where("_ask = 1").drop("_ask")


def fold_summary(folds: DataFrame, data: DataFrame, pairs: DataFrame, minimum: int, series: str = "series") -> DataFrame:
    """Each fold's training size, classes and latest target; complete says that all classes and `minimum` rows are there."""
    learned = pairs.join(data.select(series, F.col("i").alias("j"), "direction", "target_pub"), [series, "j"])
    counts = [F.count_if(F.col("direction") == c).alias(f"n_{c}") for c in CLASSES]
    stats = learned.groupBy(series, "fold").agg(F.count("*").alias("n_train"), F.max("target_pub").alias("latest_target"), *counts)
    out = folds.join(stats, [series, "fold"], "left").fillna(0, ["n_train", *[f"n_{c}" for c in CLASSES]])
    present = sum((F.col(f"n_{c}") > 0).cast("int") for c in CLASSES)
    return out.withColumn("complete", (present == len(CLASSES)) & (F.col("n_train") >= minimum))


def leakage(folds: DataFrame, data: DataFrame, pairs: DataFrame, series: str = "series") -> DataFrame:
    """(rule, violations): counts of what must not happen; all 0 in sound folds."""
    used = pairs.join(data.select(series, F.col("i").alias("j"), "target_pub", "label_status"), [series, "j"])
    used = used.join(folds.select(series, "fold", "bucket"), [series, "fold"])
    rules = {
        "future_index": F.col("j") >= F.col("i"),
        "unannounced_target": F.col("target_pub") > F.col("bucket"),
        "unobserved_target": F.col("label_status") != "observed",
    }
    found = used.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    early = data.where("target_pub <= bucket").agg(F.count("*").alias("target_not_after_origin"))
    named = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in (*rules, "target_not_after_origin")])
    return found.crossJoin(early).select(F.inline(named))

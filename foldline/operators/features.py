"""Fold-local feature transforms: whatever is fitted is fitted on a fold's training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("series", "fold")


def _sides(pairs: DataFrame, folds: DataFrame, data: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows (keyed by fold and j) and query rows (j = i) with the columns asked for."""
    rows = data.select("series", F.col("i").alias("j"), *columns)
    train = pairs.select(*KEYS, "j").join(rows, ["series", "j"])
    query = folds.select(*KEYS, F.col("i").alias("j")).join(rows, ["series", "j"])
    return train, query


def scaled(pairs: DataFrame, folds: DataFrame, data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(series, fold, column, mean, sd, query): z-scores of each fold's query under training mean and population deviation.

    A deviation of 0 counts as 1.
    """
    train, query = _sides(pairs, folds, data, columns)
    fit = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    both = query.join(train.groupBy(*KEYS).agg(*fit), list(KEYS))
    sd = {c: F.when(F.col(f"sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"sd_{c}")) for c in columns}
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"mean_{c}").alias("mean"), sd[c].alias("sd"), ((F.col(c) - F.col(f"mean_{c}")) / sd[c]).alias("query"))
        for c in columns
    ]
    return both.select(*KEYS, F.inline(F.array(*cells)))


def imputed(pairs: DataFrame, folds: DataFrame, data: DataFrame, columns: Sequence[str], indicators: bool = True) -> DataFrame:
    """(series, fold, j, is_query, column, value): training medians for missing values (0 where all are missing), then z-scores.

    With `indicators` each column also has one of whether it was missing, called missing_<column>, scaled likewise.
    """
    train, query = _sides(pairs, folds, data, columns)
    medians = train.groupBy(*KEYS).agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"med_{c}") for c in columns])
    rows = train.withColumn("is_query", F.lit(False)).unionByName(query.withColumn("is_query", F.lit(True))).join(medians, list(KEYS))
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")).alias("x")) for c in columns]
    if indicators:
        cells += [F.struct(F.lit(f"missing_{c}").alias("column"), F.col(c).isNull().cast("double").alias("x")) for c in columns]
    return standardised(rows.select(*KEYS, "j", "is_query", F.inline(F.array(*cells))))


def missing_only(pairs: DataFrame, folds: DataFrame, data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As `imputed`, of the missing indicators alone."""
    train, query = _sides(pairs, folds, data, columns)
    rows = train.withColumn("is_query", F.lit(False)).unionByName(query.withColumn("is_query", F.lit(True)))
    cells = [F.struct(F.lit(f"missing_{c}").alias("column"), F.col(c).isNull().cast("double").alias("x")) for c in columns]
    return standardised(rows.select(*KEYS, "j", "is_query", F.inline(F.array(*cells))))


def standardised(rows: DataFrame) -> DataFrame:
    """(series, fold, j, is_query, column, x) to z-scores `value` by each fold's training rows."""
    fit = rows.where(~F.col("is_query")).groupBy(*KEYS, "column").agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_sd"))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return rows.join(fit, [*KEYS, "column"]).select(*KEYS, "j", "is_query", "column", ((F.col("x") - F.col("_mean")) / sd).alias("value"))


def designs(rows: DataFrame, arms: dict[str, Sequence[str]]) -> DataFrame:
    """(series, fold, j, is_query, arm, features): each arm's columns as one array, in the arm's order.

    `rows` are long, as `standardised` gives them; the arms are a small table of constants, joined by column.
    """
    wanted = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(p).alias("position"), F.lit(c).alias("column")) for a, cs in arms.items() for p, c in enumerate(cs)])
    spark = rows.sparkSession
    table = spark.range(1).select(F.inline(wanted))
    joined = rows.join(F.broadcast(table), "column")
    cells = F.array_sort(F.collect_list(F.struct("position", "value")))
    return joined.groupBy(*KEYS, "j", "is_query", "arm").agg(F.transform(cells, lambda c: c["value"]).alias("features"))


def row_normalised(vector: str) -> Column:
    """A feature array scaled to length 1; zeros stay."""
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-15))
    return F.transform(vector, lambda x: x / norm)


def scalings(rows: DataFrame) -> DataFrame:
    """Design rows twice, as scaling row_only (each row to length 1) and column_standardized (as they come)."""
    both = F.array(
        F.struct(F.lit("row_only").alias("scaling"), row_normalised("features").alias("scaled")),
        F.struct(F.lit("column_standardized").alias("scaling"), F.col("features").alias("scaled")),
    )
    return rows.select("*", F.inline(both)).drop("features").withColumnRenamed("scaled", "features")

"""Choosing candidates by inner scores, with ties broken towards the stronger penalty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.scalars import general

#: Objectives and the order of candidates under each. Rows have macro_f1, brier, log_loss, mae_bp, lambda, scaling.
ROW_ONLY = "row_only"


def objectives() -> dict[str, list[Column]]:
    plain = (F.col("scaling") == ROW_ONLY).cast("int")
    return {
        "direction": [F.desc("macro_f1"), F.asc("brier"), F.desc("lambda"), plain.desc()],
        "magnitude": [F.asc("mae_bp"), F.desc("lambda"), plain.desc()],
        "probability": [F.asc("brier"), F.asc("log_loss"), F.desc("lambda"), plain.desc()],
    }


def select_candidates(inner: DataFrame, minimum: int, by: Sequence[str] = ("fold", "arm")) -> DataFrame:
    """(by, objective, lambda, scaling, inner_n): the winner under each objective among candidates with `minimum` inner rows.

    A group whose candidates all fall short has no row; `unselected` lists it.
    """
    enough = inner.where(F.col("inner_n") >= minimum)
    ranks = [F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.asc("scaling"))).alias(f"r_{name}") for name, order in objectives().items()]
    ranked = enough.select("*", *ranks)
    won = F.array(*[F.when(F.col(f"r_{name}") == 1, F.lit(name)) for name in objectives()])
    return ranked.select(*by, F.explode(F.filter(won, lambda x: x.isNotNull())).alias("objective"), "lambda", "scaling", "inner_n")


def unselected(inner: DataFrame, minimum: int, by: Sequence[str] = ("fold", "arm")) -> DataFrame:
    return inner.groupBy(*by).agg(F.max("inner_n").alias("most")).where(F.col("most") < minimum)


def selection_stability(choices: DataFrame) -> DataFrame:
    """(arm, objective, lambda, scaling, selections, share): how often each candidate won, of the arm's selections."""
    counts = choices.groupBy("arm", "objective", "lambda", "scaling").agg(F.count("*").alias("selections"))
    total = F.sum("selections").over(Window.partitionBy("arm", "objective"))
    return counts.withColumn("share", F.col("selections") / total)


def candidate_key(arm: Column, penalty: Column, scaling: Column) -> Column:
    """arm|lambda=...|scaling=..., the penalty with six digits as `scalars.general` writes it."""
    return F.concat(arm, F.lit("|lambda="), general(penalty), F.lit("|scaling="), scaling)


def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` sorted by `order`, with position, a row's place from 0: for reports, whose rows are few; equal keys are an error of the caller's."""
    return df.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).orderBy("position")


def rule_deltas(scored: DataFrame, base: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, rule, metric, delta): each selection rule's metric less that of the rule `base` within the same group; `scored` is (keys, rule, names)."""
    ref = scored.where(F.col("rule") == base).select(*keys, *[F.col(n).alias(f"base_{n}") for n in names])
    both = scored.where(F.col("rule") != base).join(ref, list(keys))
    return both.select(*keys, "rule", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(n) - F.col(f"base_{n}")).alias("delta")) for n in names])))


def assemble(choices: DataFrame, candidates: DataFrame, by: Sequence[str] = ("fold", "arm")) -> DataFrame:
    """Outer predictions: class and probabilities of the direction winner, size of the magnitude winner.

    `candidates` is (by, lambda, scaling, predicted_class, p_cut, p_hold, p_hike, predicted_bp).
    """
    won = choices.join(candidates, [*by, "lambda", "scaling"])
    of = lambda objective, c: F.max(F.when(F.col("objective") == objective, F.col(c))).alias(c)
    # A winner is one row a group and objective, so a maximum picks it, and the join is read once.
    picked = [of("direction", c) for c in ("predicted_class", "p_cut", "p_hold", "p_hike")] + [of("magnitude", "predicted_bp")]
    sides = F.count_if(F.col("objective").isin("direction", "magnitude")).alias("_sides")
    return won.groupBy(*by).agg(*picked, sides).where("_sides = 2").drop("_sides")

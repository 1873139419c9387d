"""Classification, size and probability metrics as grouped aggregates.

A class without any true or predicted row has F1 0, and macro-F1 is over all three classes always.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.classes import CLASSES, class_index
from foldline.functions.scalars import ratio


def confusion(truth: Column, predicted: Column, weight: Column | None = None) -> dict[str, Column]:
    """Aggregates tp_, true_ and pred_ for each class; `weight` counts a row that often."""
    one = F.lit(1).cast("long") if weight is None else weight
    out = {}
    for c in CLASSES:
        out[f"tp_{c}"] = F.sum(F.when((truth == c) & (predicted == c), one).otherwise(0))
        out[f"true_{c}"] = F.sum(F.when(truth == c, one).otherwise(0))
        out[f"pred_{c}"] = F.sum(F.when(predicted == c, one).otherwise(0))
    return out


def f1(c: str) -> Column:
    return ratio(2.0 * F.col(f"tp_{c}"), F.col(f"true_{c}") + F.col(f"pred_{c}"), 0.0)


def macro_f1() -> Column:
    """From the columns of `confusion`."""
    return (f1(CLASSES[0]) + f1(CLASSES[1]) + f1(CLASSES[2])) / F.lit(3.0)


def correct() -> Column:
    return sum((F.col(f"tp_{c}") for c in CLASSES), F.lit(0))


def brier(truth: Column, probabilities: Sequence[Column]) -> Column:
    """Sum over classes of (p - [class is true])^2, 0 to 2."""
    parts = [F.pow(p - F.when(truth == c, 1.0).otherwise(0.0), F.lit(2.0)) for c, p in zip(CLASSES, probabilities, strict=True)]
    return parts[0] + parts[1] + parts[2]


def log_loss(truth: Column, probabilities: Sequence[Column]) -> Column:
    """-ln of the true class's probability, which is kept in [1e-15, 1]."""
    p = F.when(truth == CLASSES[0], probabilities[0]).when(truth == CLASSES[1], probabilities[1]).otherwise(probabilities[2])
    return -F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-15)))


def arm_metrics(predictions: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """n, correct, accuracy, macro_f1, mae_bp, brier, log_loss and the classes' support, per group.

    Rows have true_class, predicted_class, p_cut, p_hold, p_hike, true_bp, predicted_bp. One aggregate over one scan.
    """
    truth, probabilities = F.col("true_class"), [F.col(f"p_{c}") for c in CLASSES]
    sums = confusion(truth, F.col("predicted_class"))
    stats = predictions.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[v.alias(k) for k, v in sums.items()],
        F.avg(F.abs(F.col("true_bp") - F.col("predicted_bp"))).alias("mae_bp"),
        F.avg(brier(truth, probabilities)).alias("brier"),
        F.avg(log_loss(truth, probabilities)).alias("log_loss"),
    )
    return stats.select(
        *by, "n", correct().alias("correct"), (correct() / F.col("n")).alias("accuracy"), macro_f1().alias("macro_f1"),
        "mae_bp", "brier", "log_loss", *[F.col(f"true_{c}").alias(f"{c}_n") for c in CLASSES],
    )


def confusion_table(predictions: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """(by, true_class, predicted_class, n) for all nine cells of each group."""
    pairs = F.array(*[F.struct(F.lit(t).alias("true_class"), F.lit(p).alias("predicted_class")) for t in CLASSES for p in CLASSES])
    cells = predictions.groupBy(*by, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    grid = cells.select(*by).distinct().select(*by, F.inline(pairs))
    return grid.join(cells, [*by, "true_class", "predicted_class"], "left").fillna(0, ["n"])


def leave_one_out(predictions: DataFrame, by: Sequence[str] = ("arm",), key: str = "i") -> DataFrame:
    """(by, key, macro_f1, mae_bp, macro_f1_without, mae_without): metrics of the group, and with each row left out.

    A group's totals are one aggregate, joined back to its rows, from which each row's own part is taken: no task holds a group.
    """
    truth, predicted = F.col("true_class"), F.col("predicted_class")
    error = F.abs(F.col("true_bp") - F.col("predicted_bp"))
    own = {}
    for c in CLASSES:
        own |= {f"tp_{c}": (truth == c) & (predicted == c), f"true_{c}": truth == c, f"pred_{c}": predicted == c}
    own = {n: v.cast("long") for n, v in own.items()}
    totals = predictions.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(error).alias("_e"), *[F.sum(v).alias(f"_{n}") for n, v in own.items()])
    rows = predictions.join(totals, list(by)).withColumn("_own_e", error)
    whole = rows.withColumns({n: F.col(f"_{n}") for n in own}).withColumn("macro_f1", macro_f1())
    rest = whole.withColumns({n: F.col(f"_{n}") - v for n, v in own.items()})
    return rest.select(
        *by, key, "macro_f1", (F.col("_e") / F.col("_n")).alias("mae_bp"),
        macro_f1().alias("macro_f1_without"), ((F.col("_e") - F.col("_own_e")) / (F.col("_n") - 1)).alias("mae_without"),
    )


def influence(left_out: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """(by, metric, full, low, high, max_abs_change) over a group's rows: how far a metric moves from the full sample when one is left out."""
    pairs = [("macro_f1", "macro_f1_without"), ("mae_bp", "mae_without")]
    long = left_out.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("full"), F.col(w).alias("x")) for n, w in pairs])))
    return long.groupBy(*by, "metric").agg(
        F.max("full").alias("full"), F.min("x").alias("low"), F.max("x").alias("high"), F.max(F.abs(F.col("x") - F.col("full"))).alias("max_abs_change")
    )


def periods(df: DataFrame, time: str, bounds: Sequence[tuple[str, int, int]]) -> DataFrame:
    """`df` with a column period, once for every named period (both ends in) that holds its time."""
    held = F.array(*[F.when(F.col(time).between(a, b), F.lit(n)) for n, a, b in bounds])
    return df.withColumn("period", F.explode(F.filter(held, lambda p: p.isNotNull())))


def label_support(rows: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(by, axis, documents, negative, neutral, positive, uncertain): labels -1, 0, 1 and null of each axis."""
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("int").alias("v")) for a in axes])))
    v = F.col("v")
    return long.groupBy(*by, "axis").agg(
        F.count("*").alias("documents"), F.count_if(v == -1).alias("negative"), F.count_if(v == 0).alias("neutral"),
        F.count_if(v == 1).alias("positive"), F.count_if(v.isNull()).alias("uncertain"),
    )


def kappa(rows: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Agreement of two raters on -1, 0, 1, rows with a null on either side apart.

    (by, paired_n, uncertain_first, uncertain_second, agreement, cohen_kappa, linear_weighted_kappa); a kappa is null where chance
    alone explains everything.
    """
    a, b = F.col(first), F.col(second)
    both = a.isNotNull() & b.isNotNull()
    cells = {f"c{x + 1}{y + 1}": F.count_if(both & (a == x) & (b == y)) for x in (-1, 0, 1) for y in (-1, 0, 1)}
    stats = rows.groupBy(*by).agg(
        F.count_if(both).alias("paired_n"), F.count_if(a.isNull()).alias("uncertain_first"), F.count_if(b.isNull()).alias("uncertain_second"),
        *[v.alias(k) for k, v in cells.items()],
    )
    n = F.col("paired_n")
    c = {(x, y): F.col(f"c{x}{y}") for x in range(3) for y in range(3)}
    row = [c[x, 0] + c[x, 1] + c[x, 2] for x in range(3)]
    col = [c[0, y] + c[1, y] + c[2, y] for y in range(3)]
    # Integers until the last division: observed and expected in units of 1/n and 1/n^2, distances in halves.
    same, chance = c[0, 0] + c[1, 1] + c[2, 2], row[0] * col[0] + row[1] * col[1] + row[2] * col[2]
    apart = sum((abs(x - y) * c[x, y] for x in range(3) for y in range(3) if x != y), F.lit(0))
    apart_by_chance = sum((abs(x - y) * row[x] * col[y] for x in range(3) for y in range(3) if x != y), F.lit(0))
    return stats.select(
        *by, "paired_n", "uncertain_first", "uncertain_second", ratio(same * 1.0, n).alias("agreement"),
        F.when(n * n > chance, (n * same - chance) / (n * n - chance)).alias("cohen_kappa"),
        F.when(apart_by_chance > 0, 1.0 - n * apart / apart_by_chance).alias("linear_weighted_kappa"),
    )


def agreement(rows: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """(by, documents, paired_n, agree, disagree, and each rater's counts of -1, 0 and 1 among pairs): the table beside `kappa`."""
    a, b = F.col(first), F.col(second)
    both = a.isNotNull() & b.isNotNull()
    names = {-1: "negative", 0: "neutral", 1: "positive"}
    margins = [F.count_if(both & (c == v)).alias(f"{side}_{n}") for side, c in (("first", a), ("second", b)) for v, n in names.items()]
    return rows.groupBy(*by).agg(
        F.count("*").alias("documents"), F.count_if(both).alias("paired_n"), F.count_if(both & (a == b)).alias("agree"), F.count_if(both & (a != b)).alias("disagree"), *margins
    )


def masked_scores(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro-F1 and accuracy of several runs on several axes against references of which some are missing.

    `rows`: (by, seed, axis, truth, predicted), labels -1, 0, 1 or null. A row without a truth counts nowhere; one without a
    prediction is wrong. Scores are taken per seed and axis, then averaged, predictions never are. seed_sd is the
    sample deviation over seeds of their mean over axes, null for one seed. (by, runs, macro_f1, accuracy, seed_sd)
    """
    t, p = F.col("truth"), F.col("predicted")
    valid = rows.where(t.isNotNull())
    counted = {v: (F.count_if((t == v) & (p == v)), F.count_if(t == v), F.count_if(p == v)) for v in (-1, 0, 1)}
    cells = [c.alias(f"{k}{v + 1}") for v, cs in counted.items() for k, c in zip("hta", cs, strict=True)]
    per = valid.groupBy(*by, "seed", "axis").agg(F.count("*").alias("n"), *cells)
    parts = [ratio(2.0 * F.col(f"h{v}"), F.col(f"t{v}") + F.col(f"a{v}"), 0.0) for v in range(3)]
    scored = per.select(*by, "seed", ((parts[0] + parts[1] + parts[2]) / 3.0).alias("f1"), ((F.col("h0") + F.col("h1") + F.col("h2")) / F.col("n")).alias("acc"))
    seeds = scored.groupBy(*by, "seed").agg(F.avg("f1").alias("f1"), F.avg("acc").alias("acc"))
    return seeds.groupBy(*by).agg(F.count("*").alias("runs"), F.avg("f1").alias("macro_f1"), F.avg("acc").alias("accuracy"), F.stddev_samp("f1").alias("seed_sd"))


def with_class_index(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_index", class_index(F.col(column)))

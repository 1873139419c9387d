"""Paired comparisons: discordance, exact tests, multiplicity, and shared block resampling."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions.scalars import mcnemar_exact, ratio
from foldline.operators import metrics

PAIR_COLUMNS = ("true_class", "true_bp")


def paired(predictions: DataFrame, benchmark: str, keys: Sequence[str] = ("series", "i")) -> DataFrame:
    """Every other arm's rows beside the benchmark's on the same origin: columns of the benchmark start with ref_."""
    ref = predictions.where(F.col("arm") == benchmark)
    ref = ref.select(*keys, *[F.col(c).alias(f"ref_{c}") for c in predictions.columns if c not in (*keys, "arm")])
    return predictions.where(F.col("arm") != benchmark).join(ref, list(keys))


def pairing_errors(predictions: DataFrame, benchmark: str, keys: Sequence[str] = ("series", "i")) -> DataFrame:
    """(arm, unmatched, differing): origins in one arm only, and those where truths differ."""
    ref = predictions.where(F.col("arm") == benchmark).select(*keys, *[F.col(c).alias(f"ref_{c}") for c in PAIR_COLUMNS], F.lit(1).alias("_r"))
    arms = predictions.where(F.col("arm") != benchmark).select("arm").distinct()
    left = predictions.where(F.col("arm") != benchmark).select("arm", *keys, *PAIR_COLUMNS, F.lit(1).alias("_l"))
    both = left.join(ref.join(F.broadcast(arms)), ["arm", *keys], "full_outer")  # arms are a handful of names
    same = [F.col(c).eqNullSafe(F.col(f"ref_{c}")) for c in PAIR_COLUMNS]
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.groupBy("arm").agg(F.count_if(~whole).alias("unmatched"), F.count_if(whole & ~(same[0] & same[1])).alias("differing"))


def changed(pairs: DataFrame) -> DataFrame:
    """The pairs whose predicted classes differ, with what each side got right."""
    out = pairs.where(F.col("predicted_class") != F.col("ref_predicted_class"))
    return out.withColumn("ref_correct", F.col("ref_predicted_class") == F.col("true_class")).withColumn("arm_correct", F.col("predicted_class") == F.col("true_class"))


def discordance(pairs: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """(by, b, c, p_value): b where only the benchmark is right, c where only the arm is, and the exact two-sided test."""
    ref, own = F.col("ref_predicted_class") == F.col("true_class"), F.col("predicted_class") == F.col("true_class")
    counts = pairs.groupBy(*by).agg(F.count_if(ref & ~own).alias("b"), F.count_if(own & ~ref).alias("c"))
    return counts.withColumn("p_value", mcnemar_exact(F.col("b"), F.col("c")))


def direct_contrast(predictions: DataFrame, first: str, second: str, draws: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, metric, difference, low, high, b, c, p_value): any two arms, `first` less `second`, with resampled intervals and the exact test.

    `predictions` are positioned (idx); b counts the origins that only `second` got right, c those that only `first` did.
    """
    two = predictions.where(F.col("arm").isin(first, second))
    names = ("macro_f1", "mae_bp")
    whole = metrics.arm_metrics(two, (*keys, "arm"))
    sign = F.when(F.col("arm") == first, 1.0).otherwise(-1.0)
    full = whole.groupBy(*keys).agg(*[F.sum(sign * F.col(n)).alias(n) for n in names])
    full = full.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("difference")) for n in names])))
    bounds = contrasts(resampled_metrics(two, draws, keys), second, keys, names).drop("arm")
    return full.join(bounds, [*keys, "metric"]).join(discordance(paired(two, second), keys), list(keys))


def holm(df: DataFrame, p: str = "p_value", by: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """`df` with holm_p, p-values adjusted within each family `by`, and reject at `level`. Ties get the same value.

    A family is a set of tests that is reported together, so its size is bounded by what is compared, not by data.
    """
    family = Window.partitionBy(*(by or [F.lit(0)]))
    order = family.orderBy(p)
    step = (F.count("*").over(family) - F.row_number().over(order) + 1) * F.col(p)
    ranked = df.withColumn("_step", F.least(F.lit(1.0), step))
    running = F.max("_step").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("holm_p", running).drop("_step").withColumn("reject", F.col("holm_p") <= level)


def arithmetic_draws(sizes: DataFrame, replicates: int, block: int, series: str = "series") -> DataFrame:
    """(series, rep, idx, times): circular blocks whose starts are (7919 rep + 104729 block) mod n, cut to n positions.

    `sizes` is (series, n). Positions drawn more than once are counted here, so joins see each once. These draws can be
    made anywhere; `random_draws` are those of a seeded generator.
    """
    reps = sizes.select(series, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    pos = reps.select(series, "n", "rep", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("pos"))
    start = (F.col("rep").cast("long") * 7919 + F.floor(F.col("pos") / block) * 104729) % F.col("n")
    drawn = pos.select(series, "rep", ((start + F.col("pos") % block) % F.col("n")).cast("long").alias("idx"))
    return drawn.groupBy(series, "rep", "idx").agg(F.count("*").alias("times"))


def arithmetic_times(idx: Column, rep: Column, n: int, block: int) -> Column:
    """How often `arithmetic_draws` draws a position in a replicate, from the two numbers alone: no table of draws, no join.

    Position idx is the k-th of block b where 104729 b = idx - k - 7919 rep (mod n). With g = gcd(104729, n) the blocks that solve it are b0, b0 + n / g, ...,
    of which those count whose k-th position is among the n.
    """
    if n <= 0:
        return F.lit(0).cast("long")
    g = math.gcd(104729, n)
    m = n // g
    inverse = pow(104729 // g, -1, m)
    found = F.lit(0).cast("long")
    for k in range(min(block, n)):
        d = F.pmod(idx.cast("long") - k - 7919 * rep.cast("long"), F.lit(n).cast("long"))
        first = F.floor(d / g).cast("long") if g > 1 else d
        first = (first * F.lit(inverse).cast("long")) % F.lit(m).cast("long")
        blocks = (n - k + block - 1) // block
        times = F.call_function("div", F.lit(blocks + m - 1).cast("long") - first, F.lit(m).cast("long"))
        found = found + (F.when(d % g == 0, times).otherwise(0) if g > 1 else times)
    return found


#: Starts that `random_draws` makes on the driver, at most.
DRIVER_STARTS = 10_000_000


def random_draws(spark: SparkSession, n: int, replicates: int, block: int, seed: int) -> DataFrame:
    """(rep, idx, times) of circular blocks with uniform starts from PCG64: the same for every arm.

    The generator is sequential, so the replicates x ceil(n / block) starts are drawn on the driver in one go and expanded by Spark; over
    DRIVER_STARTS of them are an error (ValueError): `hashed_draws` has no such bound.
    """
    blocks = -(-n // block)
    if replicates * blocks > DRIVER_STARTS:
        raise ValueError(f"{replicates} x {blocks} starts are too many for the driver; use hashed_draws")
    starts = np.random.default_rng(seed).integers(0, n, size=(replicates, blocks))
    rows = spark.createDataFrame([(r, s) for r, s in enumerate(starts.tolist())], "rep int, starts array<long>")
    pos = rows.select("rep", "starts", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    block_no = (F.floor(F.col("pos") / block) + 1).cast("int")
    idx = (F.element_at("starts", block_no) + F.col("pos") % block) % n
    return pos.select("rep", idx.cast("long").alias("idx")).groupBy("rep", "idx").agg(F.count("*").alias("times"))


def hashed_draws(sizes: DataFrame, replicates: int, block: int, seed: int, series: str = "series") -> DataFrame:
    """(series, rep, idx, times) of circular blocks whose starts come from a counter: the first 13 hex digits of MD5 over "seed:rep:block", mod n.

    Any task can make any block, so nothing is drawn on the driver, and all arms of a series share the draws. `sizes` is (series, n), n over 0. A
    start's odds differ from 1 / n by n / 2^52 at most. Positions drawn more than once are counted here.
    """
    reps = sizes.where("n > 0").select(series, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    last = F.ceil(F.col("n") / block).cast("int") - 1
    blocks = reps.select(series, "n", "rep", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("block").cast("string")))
    start = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.col("n")
    length = F.least(F.lit(block).cast("long"), F.col("n") - F.col("block").cast("long") * block)
    drawn = blocks.select(series, "n", "rep", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("k"))
    idx = (F.col("start") + F.col("k")) % F.col("n")
    return drawn.groupBy(series, "rep", idx.cast("long").alias("idx")).agg(F.count("*").alias("times"))


def resampled_metrics(positioned: DataFrame, draws: DataFrame, keys: Sequence[str], by: Sequence[str] = ("arm",)) -> DataFrame:
    """(keys, rep, by, macro_f1, mae_bp, brier, log_loss) of each replicate; `positioned` rows have idx beside their metrics' columns."""
    truth, probabilities = F.col("true_class"), [F.col(f"p_{c}") for c in metrics.CLASSES]
    times = F.col("times")
    sums = metrics.confusion(truth, F.col("predicted_class"), times)

    def mean(x: Column) -> Column:
        return F.sum(x * times) / F.sum(times)

    stats = positioned.join(draws, [*keys, "idx"]).groupBy(*keys, "rep", *by).agg(
        *[v.alias(k) for k, v in sums.items()],
        mean(F.abs(F.col("true_bp") - F.col("predicted_bp"))).alias("mae_bp"),
        mean(metrics.brier(truth, probabilities)).alias("brier"),
        mean(metrics.log_loss(truth, probabilities)).alias("log_loss"),
    )
    return stats.select(*keys, "rep", *by, metrics.macro_f1().alias("macro_f1"), "mae_bp", "brier", "log_loss")


def contrasts(resampled: DataFrame, benchmark: str, keys: Sequence[str], names: Sequence[str] = ("macro_f1", "mae_bp")) -> DataFrame:
    """(keys, arm, metric, low, high): 95 % percentile intervals of arm minus benchmark, replicate by replicate."""
    ref = resampled.where(F.col("arm") == benchmark).select(*keys, "rep", *[F.col(n).alias(f"ref_{n}") for n in names])
    both = resampled.where(F.col("arm") != benchmark).join(ref, [*keys, "rep"])
    long = both.select(*keys, "arm", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(n) - F.col(f"ref_{n}")).alias("d")) for n in names])))
    bounds = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy(*keys, "arm", "metric").agg(bounds.alias("q")).select(*keys, "arm", "metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def reality_check(positioned: DataFrame, draws: DataFrame, benchmark: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, arms, best_arm, best_advantage, statistic, p_value): is the best arm's 0-1 loss advantage over the benchmark real?

    Advantages are centred in the resamples; the best arm is the first by name among equals. Sums are of integers: an
    arm's resampled mean less its mean is (n * drawn - total * n) / n^2.
    """
    loss = (F.col("predicted_class") != F.col("true_class")).cast("long")
    rows = positioned.select(*keys, "idx", "arm", loss.alias("loss"))
    ref = rows.where(F.col("arm") == benchmark).select(*keys, "idx", F.col("loss").alias("ref"))
    diff = rows.where(F.col("arm") != benchmark).join(ref, [*keys, "idx"]).select(*keys, "idx", "arm", (F.col("ref") - F.col("loss")).alias("d"))
    total = diff.groupBy(*keys, "arm").agg(F.count("*").alias("n"), F.sum("d").alias("total"))
    best = total.groupBy(*keys).agg(
        F.max("n").alias("n"), F.count("*").alias("arms"), F.max("total").alias("top"), F.min_by("arm", F.struct(-F.col("total"), F.col("arm"))).alias("best_arm")
    )
    drawn = diff.join(draws, [*keys, "idx"]).groupBy(*keys, "rep", "arm").agg(F.sum(F.col("d") * F.col("times")).alias("drawn"))
    tops = drawn.join(total, [*keys, "arm"]).groupBy(*keys, "rep").agg(F.max(F.col("drawn") - F.col("total")).alias("centred"))
    counts = tops.join(best, list(keys)).groupBy(*keys).agg(F.count_if(F.col("centred") >= F.col("top")).alias("over"), F.count("*").alias("reps"))
    n = F.col("n")
    return best.join(counts, list(keys)).select(
        *keys, "n", "arms", "best_arm", (F.col("top") / n).alias("best_advantage"), (F.sqrt(n.cast("double")) * F.col("top") / n).alias("statistic"),
        ((1.0 + F.col("over")) / (F.col("reps") + 1.0)).alias("p_value"),
    )


def masked_resampled(rows: DataFrame, n: int, replicates: int, block: int, by: Sequence[str]) -> DataFrame:
    """(rep, by, macro_f1): `metrics.masked_scores` of every replicate; `rows` have idx, seed, axis, truth and predicted beside `by`.

    Counts are weighted by how often a replicate drew the row, as `arithmetic_times` says of `n` positions; scores are averaged over seeds and axes. Rows are
    added up where they are read: neither draws nor their counts of rows are sent anywhere.
    """
    t, p, times = F.col("truth"), F.col("predicted"), F.col("times")

    def total(c: Column) -> Column:
        return F.sum(F.when(c, times).otherwise(0))

    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    drawn = rows.where(t.isNotNull()).select(*by, "seed", "axis", "truth", "predicted", "idx", reps)
    valid = drawn.withColumn("times", arithmetic_times(F.col("idx"), F.col("rep"), n, block))
    cells = [x.alias(f"{k}{v + 1}") for v in (-1, 0, 1) for k, x in (("h", total((t == v) & (p == v))), ("t", total(t == v)), ("a", total(p == v)))]
    per = valid.groupBy("rep", *by, "seed", "axis").agg(*cells, F.sum(times).alias("drawn")).where("drawn > 0")
    parts = [ratio(2.0 * F.col(f"h{v}"), F.col(f"t{v}") + F.col(f"a{v}"), 0.0) for v in range(3)]
    return per.groupBy("rep", *by).agg(F.avg((parts[0] + parts[1] + parts[2]) / 3.0).alias("macro_f1"))


def named_contrasts(resampled: DataFrame, name: str, pairs: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by, contrast, low, high): 95 % intervals of one group's macro_f1 less another's, for named pairs (first, less)."""
    wanted = F.array(*[F.struct(F.lit(n).alias("contrast"), F.lit(a).alias("first"), F.lit(b).alias("less")) for n, (a, b) in pairs.items()])
    sign = F.when(F.col(name) == F.col("first"), 1.0).when(F.col(name) == F.col("less"), -1.0)
    rows = resampled.select("*", F.inline(wanted)).where(sign.isNotNull())
    diffs = rows.groupBy("rep", *by, "contrast").agg(F.sum(sign * F.col("macro_f1")).alias("d"), F.count("*").alias("k")).where("k = 2")
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return diffs.groupBy(*by, "contrast").agg(q.alias("q")).select(*by, "contrast", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def seeded_order(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(position, item): the order in which Python's generator shuffles 0 .. n-1, as a table to join with. For lists that people read."""
    items = list(range(n))
    random.Random(seed).shuffle(items)
    return spark.createDataFrame(list(enumerate(items)), "position long, item long")

"""Every query of the library by name, with the SQL that states its result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions import classes, scalars
from foldline.operators import features, folds, inference, metrics, selection, series, text, validate
from foldline.plans import arms, audits, oracles, oracles_arms, oracles_audits, tables  # noqa: F401
from foldline.plans.registry import DECIMALS, QUERIES, Query, query, rounded  # noqa: F401

ORACLES: dict[str, str] = oracles.ORACLES | oracles_arms.ORACLES | oracles_audits.ORACLES

PERIODS = (("early", 0, 78_920), ("middle", 78_900, 78_940), ("late", 78_941, 79_100), ("all", 0, 10**9))
AXES = ("first", "second")
LAMBDAS = (0.001, 0.01, 0.1, 1.0, 10.0)


# ---- series and folds


@query
def origin_series(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dataset(spark, sf)


@query
def history_features(spark: SparkSession, sf: str) -> DataFrame:
    made = series.history_features(tables.origins(spark, sf))
    return made.select("series", "i", "rate_now", "change_now", "change_before", "change_mean3", "steps_since", "has_before")


@query
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    named = series.split_name(F.col("i"), [(80, "train"), (98, "validation")], "test")
    return tables.origins(spark, sf).groupBy("series", named.alias("split")).agg(F.count("*").alias("n"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))


@query
def training_sets(spark: SparkSession, sf: str) -> DataFrame:
    data = tables.observed(spark, sf)
    return folds.training_pairs(tables.folds(data), data)


@query
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    data = tables.observed(spark, sf)
    at = tables.folds(data)
    return folds.fold_summary(at, data, folds.training_pairs(at, data), 40)


@query
def expanding_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    data = tables.observed(spark, sf)
    sums = {f"n_{c}": (F.col("direction") == c).cast("long") for c in classes.CLASSES}
    return folds.expanding_sums(tables.folds(data), data, sums)


@query
def leakage_violations(spark: SparkSession, sf: str) -> DataFrame:
    data = tables.observed(spark, sf)
    at = tables.folds(data)
    return folds.leakage(at, data, folds.training_pairs(at, data))


@query
def market_asof_prev_day(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders with the price of the last order on a day strictly before."""
    orders = tables.read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    last = orders.groupBy("o_custkey", "day").agg(F.max_by("o_totalprice", "o_orderkey").alias("prev_price"))
    return series.asof_before(orders, last, "o_custkey", "day", "prev_price").select("o_orderkey", "prev_price")


# ---- features


@query
def fold_scaled_history(spark: SparkSession, sf: str) -> DataFrame:
    data = series.history_features(tables.observed(spark, sf))
    at = tables.folds(data)
    made = features.scaled(folds.training_pairs(at, data), at, data, ["rate_now", "change_now", "change_mean3", "has_before"])
    return rounded(made.where("column <> 'change_now' OR mean IS NOT NULL"), "mean", "sd", "query")


# ---- text


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return text.token_counts(tables.statements(spark, sf))


@query
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return text.document_frequency(text.token_counts(tables.statements(spark, sf)))


@query
def hash_embedding_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.hash_buckets(tables.statements(spark, sf)), "value")


@query
def encoder_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Word hashes of every statement as ids, in overlapping, marked and padded chunks."""
    ids = F.transform(scalars.words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))
    rows = tables.statements(spark, sf).select("doc_id", ids.alias("ids")).where("size(ids) > 0")
    cut = rows.select("doc_id", F.posexplode(text.chunks(F.col("ids"), 62, 8)).alias("chunk", "ids"))
    made = cut.select("doc_id", "chunk", text.padded(text.prepared(F.col("ids"), 101, 102), F.lit(64), 0).alias("p")).select("doc_id", "chunk", "p.*")
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    held = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("input_ids").cast("long").alias("width"), held.alias("held"), total.alias("id_sum"))


@query
def pooled_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The mean embedding of each label, scaled to length 1."""
    rows = tables.read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    pooled = text.mean_vector(rows, ["label"], "embedding")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("pos", "value")), "value")


# ---- metrics


@query
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tables.predictions(spark, sf), "p_cut", "p_hold", "p_hike", "predicted_bp")


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_table(tables.predictions(spark, sf))


@query
def arm_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.arm_metrics(tables.predictions(spark, sf)), "accuracy", "macro_f1", "mae_bp", "brier", "log_loss")


@query
def subperiod_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.periods(tables.predictions(spark, sf), "bucket", PERIODS)
    made = metrics.arm_metrics(rows, ("period", "arm"))
    spans = rows.groupBy("period", "arm").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    return rounded(made.join(spans, ["period", "arm"]), "accuracy", "macro_f1", "mae_bp", "brier", "log_loss")


@query
def loo_influence(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.leave_one_out(tables.predictions(spark, sf), ("series", "arm")).select("series", "arm", "i", "macro_f1_without", "mae_without")
    return rounded(rows, "macro_f1_without", "mae_without")


@query
def loo_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.leave_one_out(tables.predictions(spark, sf), ("series", "arm"))
    made = rows.groupBy("series", "arm").agg(F.min("macro_f1_without").alias("low"), F.max("macro_f1_without").alias("high"))
    return rounded(made, "low", "high")


@query
def influence_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How far each arm's metrics move from the full sample when one origin is left out."""
    rows = metrics.leave_one_out(tables.predictions(spark, sf), ("series", "arm"))
    return rounded(metrics.influence(rows, ("series", "arm")), "full", "low", "high", "max_abs_change")


@query
def class_support(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_support(tables.axis_labels(spark, sf), ("split",), AXES)


@query
def kappa_by_axis(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.axis_labels(spark, sf)
    long = rows.select("split", F.inline(F.array(
        F.struct(F.lit("quality").alias("axis"), F.col("first").alias("a"), F.col("first_repeat").alias("b")),
        F.struct(F.lit("mixed").alias("axis"), F.col("first").alias("a"), F.col("second").alias("b")),
    )))
    return rounded(metrics.kappa(long, ("split", "axis"), "a", "b"), "agreement", "cohen_kappa", "linear_weighted_kappa")


def seeded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """(split, doc_id, seed, axis, truth, predicted) of three made-up runs on two axes."""
    long = tables.axis_labels(spark, sf).select("split", "doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed"), F.inline(F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(a).alias("truth")) for a in AXES])))
    said = F.when((F.col("doc_id") + F.col("seed")) % 11 == 0, None).otherwise(((F.col("doc_id") * 7 + F.col("seed") * 3) % 3 - 1).cast("int"))
    return long.withColumn("predicted", said)


@query
def masked_multirun_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.masked_scores(seeded_runs(spark, sf), ("split",)), "macro_f1", "accuracy", "seed_sd")


@query
def common_support_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same on rows where both axes are labelled."""
    whole = tables.axis_labels(spark, sf).where("first IS NOT NULL AND second IS NOT NULL").select("doc_id")
    rows = seeded_runs(spark, sf).join(whole, "doc_id", "left_semi")
    return rounded(metrics.masked_scores(rows, ("split",)), "macro_f1", "accuracy", "seed_sd")


@query
def choose_class_ties(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.range(27).select(*[(F.floor(F.col("id") / 3**k) % 3).cast("double").alias(f"p_{c}") for k, c in enumerate(classes.CLASSES)])
    return rows.withColumn("chosen", classes.choose_class(*[F.col(f"p_{c}") for c in classes.CLASSES]))


# ---- paired inference


@query
def changed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = inference.changed(inference.paired(tables.predictions(spark, sf), "persistence"))
    return rows.select("series", "i", "arm", "true_class", "ref_predicted_class", "predicted_class", "ref_correct", "arm_correct")


@query
def pairing_errors(spark: SparkSession, sf: str) -> DataFrame:
    return inference.pairing_errors(tables.predictions(spark, sf), "persistence")


@query
def mcnemar_holm(spark: SparkSession, sf: str) -> DataFrame:
    tests = inference.discordance(inference.paired(tables.predictions(spark, sf), "persistence"), ("series", "arm"))
    return rounded(inference.holm(tests), "p_value", "holm_p")


def positioned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Predictions with idx, their position among a series' folds from 0, and arithmetic draws of 200 replicates of blocks of 4."""
    rows = tables.predictions(spark, sf).withColumn("idx", F.col("fold") - 1)
    sizes = rows.groupBy("series").agg(F.max("fold").alias("n"))
    return rows, inference.arithmetic_draws(sizes, 200, 4)


@query
def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    return positioned(spark, sf)[1]


@query
def block_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows, draws = positioned(spark, sf)
    made = inference.contrasts(inference.resampled_metrics(rows, draws, ("series",)), "persistence", ("series",))
    return rounded(made, "low", "high")


@query
def probability_selection_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows, draws = positioned(spark, sf)
    made = inference.contrasts(inference.resampled_metrics(rows, draws, ("series",)), "base_rate", ("series",), ("brier", "log_loss"))
    return rounded(made, "low", "high")


@query
def reality_check(spark: SparkSession, sf: str) -> DataFrame:
    rows, draws = positioned(spark, sf)
    return rounded(inference.reality_check(rows, draws, "persistence", ("series",)), "best_advantage", "statistic", "p_value")


def sizes_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series").agg(F.max("fold").alias("n"))


@query
def seeded_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals under 500 seeded replicates, whose starts come from a counter: any task can make any block."""
    rows, _ = positioned(spark, sf)
    draws = inference.hashed_draws(sizes_of(rows), 500, 4, 20260923)
    made = inference.contrasts(inference.resampled_metrics(rows, draws, ("series",)), "persistence", ("series",))
    return rounded(made, "low", "high")


@query
def generator_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The same under draws of a sequential generator, PCG64, made on the driver: shared by all arms of a series, and by all series of one length."""
    rows, _ = positioned(spark, sf)
    sizes = sizes_of(rows)
    lengths = [r["n"] for r in sizes.select("n").distinct().orderBy("n").collect()]  # at most a series' length
    drawn = reduce(DataFrame.union, [inference.random_draws(spark, n, 500, 4, 20260923).withColumn("n", F.lit(n)) for n in lengths])
    draws = sizes.join(drawn, "n").drop("n")
    return inference.contrasts(inference.resampled_metrics(rows, draws, ("series",)), "persistence", ("series",))


@query
def direct_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """One arm against another, neither of them the benchmark: differences, intervals and the exact test."""
    rows, draws = positioned(spark, sf)
    return rounded(inference.direct_contrast(rows, "shrunk", "reversal", draws), "difference", "low", "high", "p_value")


# ---- selection


def inner_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, arm, lambda, scaling, inner_n and four scores): made-up candidates with many ties, from the line items."""
    rows = tables.read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 37).alias("fold"), F.col("l_returnflag").alias("arm"),
        F.element_at(F.array(*map(F.lit, LAMBDAS)), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("lambda"),
        F.when(F.col("l_linestatus") == "O", "row_only").otherwise("column_standardized").alias("scaling"), "l_quantity", "l_discount", "l_tax",
    )
    cents = lambda c: F.sum(scalars.half_up(F.col(c) * 100))
    sums = rows.groupBy("fold", "arm", "lambda", "scaling").agg(F.count("*").alias("inner_n"), cents("l_quantity").alias("q"), cents("l_discount").alias("d"), cents("l_tax").alias("t"))
    return sums.select(
        "fold", "arm", "lambda", "scaling", "inner_n", (F.col("q") % 4 / 4.0).alias("macro_f1"), (F.col("d") % 3 / 2.0).alias("brier"),
        (F.col("t") % 5 / 3.0).alias("log_loss"), (F.col("q") % 7 * 1.0).alias("mae_bp"),
    )


@query
def candidate_selection(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_candidates(inner_scores(spark, sf), 20)


@query
def selection_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.selection_stability(selection.select_candidates(inner_scores(spark, sf), 20)), "share")


@query
def ordered_stability(spark: SparkSession, sf: str) -> DataFrame:
    """The same in stable order, each row with its place in it."""
    return selection.placed(rounded(selection.selection_stability(selection.select_candidates(inner_scores(spark, sf), 20)), "share"), ("arm", "objective", "lambda", "scaling"))


@query
def candidate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate's key and the parts it is made of."""
    rows = inner_scores(spark, sf).select("arm", "lambda", "scaling").distinct()
    wide = rows.withColumn("wide", F.col("lambda") * 1234567.0)
    return wide.select(selection.candidate_key(F.col("arm"), F.col("lambda"), F.col("scaling")).alias("candidate"), "arm", "lambda", "scaling", scalars.general(F.col("wide")).alias("shown"))


@query
def unselected_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose best candidate has too few inner rows: the limit lies between what groups have."""
    scores = inner_scores(spark, sf).withColumn("inner_n", F.col("inner_n") - F.col("fold") * 30)
    return selection.unselected(scores, 60)


# ---- validation, ids and lookups


@query
def opaque_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.origins(spark, sf)
    return rows.select("origin_id", scalars.opaque_id("T-", "salt", "|", F.col("origin_id")).alias("item_id"), scalars.opaque_id("B-", "20260923", ":", F.col("origin_id")).alias("blind_id"))


@query
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicate_keys(tables.read(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query
def key_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return validate.key_difference(tables.read(spark, sf, "documents"), tables.read(spark, sf, "labels"), ["doc_id"])


@query
def expected_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations of flag, status and key that line items should have and don't."""
    items = tables.read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    expected = validate.expected_identities(items, {"flag": ["A", "N", "R", "X"], "status": ["F", "O"]}, "line")
    return expected.join(items.distinct(), ["line", "flag", "status"], "left_anti").select("line", "flag", "status")


@query
def stored_metric_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals against their line items, as a stored and a recomputed metric."""
    items = tables.read(spark, sf, "lineitem")
    computed = items.groupBy(F.col("l_orderkey").alias("key")).agg((F.sum(scalars.half_up(F.col("l_quantity") * 100)) / 100.0).alias("amount"))
    orders = tables.read(spark, sf, "orders")
    stored = orders.select(F.col("o_orderkey").alias("key"), (scalars.half_up(F.col("o_totalprice")) % 100 * 1.0).alias("amount"))
    return validate.mismatches(computed, stored, ["key"], ["amount"])


@query
def json_extract_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties: the number inside, and whether the object is exactly {k: whole number}."""
    rows = tables.read(spark, sf, "events").select("event_id", "props")
    k = F.get_json_object("props", "$.k")
    keys = F.json_object_keys("props")
    valid = F.coalesce(keys.eqNullSafe(F.array(F.lit("k"))) & k.rlike(r"^-?\d+$"), F.lit(False))
    return rows.select("event_id", k.try_cast("long").alias("k"), F.when(valid, "valid").otherwise("invalid_output").alias("status"))


@query
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.axis_labels(spark, sf).select("split", F.when(F.col("first").isNull(), "invalid_output").otherwise("valid").alias("status"))
    return rows.groupBy("split").agg(F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") != "valid").alias("invalid"))


@query
def answer_validation(spark: SparkSession, sf: str) -> DataFrame:
    """JSON answers made of each document's first words, some broken on purpose, through the strict check."""
    return built_answers(spark, sf).select("doc_id", validate.answer_status(F.col("raw"), F.col("text"), F.col("ended"), ("demand", "prices")).alias("status"))


def built_answers(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("doc_id") % 9
    word = F.regexp_extract("text", r"[A-Za-z]+", 0)
    prices = F.concat(F.lit('"prices": {"score": 0, "evidence": ""}'))
    demand = F.concat(
        F.lit('"demand": {"score": '), F.when(kind == 1, "2").when(kind == 2, "1.0").when(kind == 3, "true").when(kind == 4, '"1"').otherwise("1"),
        F.lit(', "evidence": "'), F.when(kind == 5, F.lit("not in any text 0123")).when(kind == 6, F.lit(" ")).otherwise(word), F.lit('"}'),
    )
    raw = F.concat(F.lit("{"), demand, F.when(kind == 7, F.lit("")).otherwise(F.concat(F.lit(", "), prices)), F.lit("}"))
    docs = tables.statements(spark, sf)
    return docs.select("doc_id", "text", raw.alias("raw"), (kind != 8).alias("ended"))


@query
def lookup_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's segment and nation: keyed lookups of which the small ones may be broadcast by size."""
    orders, customers = tables.read(spark, sf, "orders"), tables.read(spark, sf, "customer")
    nations, regions = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    found = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    found = found.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return found.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), (F.sum(scalars.half_up(F.col("o_totalprice") * 100)) / 100.0).alias("total"))


@query
def text_hash_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text hash a later copy shares: (sha256, copies) of texts found more than once."""
    hashed = tables.statements(spark, sf).select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return validate.duplicate_keys(hashed, ["sha256"]).withColumnRenamed("n", "copies")


@query
def embedding_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings without a document, of another length, or with values that aren't finite."""
    rows = tables.read(spark, sf, "embeddings").select("vec_id", "embedding")
    docs = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("known")).distinct()
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    joined = rows.join(docs, "vec_id", "left")
    return joined.agg(
        F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("unknown"),
        F.count_if(F.size("embedding") != 64).alias("wrong_length"), F.count_if(bad).alias("not_finite"),
    )


@query
def answer_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Axis objects flattened to columns, valid or not."""
    axis = "struct<score:string,evidence:string>"
    rows = built_answers(spark, sf).select("doc_id", F.from_json("raw", f"demand {axis}, prices {axis}").alias("a"))
    return rows.select("doc_id", F.col("a.demand.score").alias("demand_score"), F.col("a.demand.evidence").alias("demand_evidence"), F.col("a.prices.score").alias("prices_score"))


@query
def union_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by arm and by series in one table."""
    rows = tables.predictions(spark, sf)
    by_arm = metrics.arm_metrics(rows).select(F.lit("arm").alias("analysis"), F.col("arm").alias("name"), "n", "correct")
    by_series = metrics.arm_metrics(rows, ("series",)).select(F.lit("series").alias("analysis"), F.col("series").alias("name"), "n", "correct")
    return by_arm.unionByName(by_series)


@query
def one_hot_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.observed(spark, sf).select("series", "i", classes.class_index(F.col("direction")).alias("class_index"), classes.one_hot(F.col("direction")).alias("h"), (F.col("action_bp") / 100.0).alias("points"))
    return rows.select("series", "i", "class_index", *[F.col("h")[k].alias(f"is_{c}") for k, c in enumerate(classes.CLASSES)], "points")


# ---- more


def labelled_positions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, idx) of all labelled documents, idx their position by doc_id from 0: numbered in ranges of ids, so no task holds all."""
    ids = tables.axis_labels(spark, sf).where("first IS NOT NULL OR second IS NOT NULL").select("doc_id").distinct()
    placed = ids.withColumn("part", F.floor(F.col("doc_id") / (1 << 16)))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range of ids
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    row = F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))
    return placed.withColumn("row", row).join(starts, "part").select("doc_id", (F.col("start") + F.col("row") - 1).alias("idx"))


@query
def masked_bootstrap_all(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of tuned less base runs (seeds 1 and 2 less seed 0) on all labelled documents: blocks of 3 positions drawn over their whole number."""
    at = labelled_positions(spark, sf)
    rows = seeded_runs(spark, sf).join(at, "doc_id").withColumn("family", F.when(F.col("seed") == 0, "base").otherwise("tuned"))
    scores = inference.masked_resampled(rows, at.count(), 200, 3, ("family",))
    return rounded(inference.named_contrasts(scores, "family", {"tuned_effect": ("tuned", "base")}), "low", "high")


@query
def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as text, U for uncertain, read back."""
    text_label = F.when(F.col("doc_id") % 6 == 0, "U").when(F.col("doc_id") % 6 == 1, " ").otherwise((F.col("quality") * 2 - 1).cast("string"))
    return tables.read(spark, sf, "labels").select("doc_id", scalars.label_code(text_label).alias("code"))


@query
def numeric_text(spark: SparkSession, sf: str) -> DataFrame:
    """Balances as text, some blank or broken, read as numbers."""
    raw = F.when(F.col("c_custkey") % 5 == 0, " ").when(F.col("c_custkey") % 5 == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".5 ")))
    return tables.read(spark, sf, "customer").select("c_custkey", scalars.number(raw).alias("x"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_metrics(spark, sf_dir)


FLAGSHIP = flagship

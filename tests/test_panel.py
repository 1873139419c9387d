"""Queries without SQL, and operators on the panel of all series, against plain versions."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from foldline.functions.classes import CLASSES
from foldline.operators import assembly, folds, lookups, models, text
from foldline.plans import arms, catalogue, tables


@pytest.fixture(scope="module")
def parts(spark):
    return arms.part_rows(spark, SMALL, market=True)


def test_entry_folds_say_what_the_pairs_say(spark):
    data = tables.observed(spark, SMALL)
    at = tables.folds(data)
    pairs = {tuple(r) for r in folds.training_pairs(at, data).select("series", "fold", "j").collect()}
    entries = folds.entry_folds(at, data).collect()
    assert {(r["series"], f, r["j"]) for r in entries for f in range(r["entry"], r["last"] + 1)} == pairs


def test_expanding_frequencies_equal_those_of_written_out_sets(spark):
    data = tables.observed(spark, SMALL)
    at = tables.folds(data)
    counts = arms.origin_counts(spark, SMALL, data)
    train = folds.training_pairs(at, data).select("series", "fold", "j")
    plain = train.join(counts, ["series", "j"]).groupBy("series", "fold", "token").agg(F.count("*").alias("df")).where("df >= 3")
    made = text.expanding_frequency(counts, folds.entry_folds(at, data), 3)
    assert sorted(map(tuple, made.select("series", "fold", "token", "df").collect())) == sorted(map(tuple, plain.collect()))


def test_words_that_come_many_times_count_once_an_origin(spark):
    told = [(s, j, t) for s in ("a", "b") for j in (0, 1, 63, 64, 127, 200) for t in ("x", "y", "z") if (t, j) not in (("y", 1), ("y", 127)) and (t != "z" or j < 2)]
    entries = spark.createDataFrame([("a", j, 1 + k, 7) for k, j in enumerate((0, 1, 63, 64, 127, 200))] + [("b", 200, 2, 3)], "series string, j long, entry long, last long")
    made = text.expanding_frequency(spark.createDataFrame(told * 3, "series string, j long, token string"), entries, 3)
    x = {("a", f, "x", min(f, 6)) for f in range(3, 8)}
    y = {("a", f, "y", n) for f, n in ((4, 3), (5, 3), (6, 4), (7, 4))}
    assert sorted(map(tuple, made.select("series", "fold", "token", "df").collect())) == sorted(x | y)


def test_weights_are_made_of_counts_of_vocabulary_words_alone(spark):
    data = tables.observed(spark, SMALL)
    at = tables.folds(data)
    counts, _, vocabulary = arms.panel_text(spark, SMALL, data, at)
    known = vocabulary.select("series", "token").distinct()
    whole = arms.origin_counts(spark, SMALL, data)
    assert sorted(map(tuple, counts.select("series", "j", "token", "tf").collect())) == sorted(map(tuple, whole.join(known, ["series", "token"], "left_semi").select("series", "j", "token", "tf").collect()))
    plain = text.token_counts(tables.statements(spark, SMALL)).join(tables.dealt_documents(spark, SMALL, data), "doc_id").groupBy("series", "i", "token").agg(F.sum("tf"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, whole.select("series", "j", "token", "tf").collect()))


def test_lsa_query_equals_a_plain_projection(spark):
    from test_functions import gram_projection

    data = tables.observed(spark, SMALL)
    at = tables.folds(data)
    rows = assembly.fold_rows(folds.training_pairs(at, data), at).where("fold <= 2")
    weights = arms.weights_of(rows, *arms.panel_text(spark, SMALL, data, at)).collect()
    cells = collections.defaultdict(dict)
    for r in weights:
        cells[r["series"], r["fold"]].setdefault((r["is_query"], r["j"]), {})[r["token"]] = r["weight"]
    made = {(r["series"], r["fold"], r["is_query"], r["i"]): r["features"] for r in catalogue.QUERIES["lsa_projection"](spark, SMALL).where("fold <= 2").collect()}
    assert len(made) == sum(map(len, cells.values()))
    for (series, fold), docs in cells.items():
        tokens = sorted({t for d in docs.values() for t in d})
        matrix = {k: np.array([d.get(t, 0.0) for t in tokens]) for k, d in docs.items()}
        train = np.array([v for (asked, _), v in sorted(matrix.items()) if not asked])
        order = [k for k in sorted(matrix) if not k[0]] + [k for k in sorted(matrix) if k[0]]
        a, q = gram_projection(train, np.array([matrix[k] for k in order if k[0]]).reshape(-1, len(tokens)), arms.COMPONENTS)
        for k, want in zip(order, np.vstack([a, q]), strict=True):
            assert np.allclose(made[series, fold, k[0], k[1]], want, atol=1e-6)


def descend(x, y, penalty, rounds=60_000):
    """Multinomial weights by plain accelerated descent from zero."""
    design = np.hstack([x, np.ones((len(x), 1))])
    weight = np.append(np.full(x.shape[1], penalty), 0.0)[:, None]
    hot = np.eye(3)[y]
    step = 1 / (np.linalg.norm(design, 2) ** 2 / (2 * len(x)) + penalty)
    w = v = np.zeros((design.shape[1], 3))
    for k in range(rounds):
        p = models.softmax_probabilities(design, v, np.zeros(3))
        g = design.T @ (p - hot) / len(x) + weight * v
        if np.abs(g).max() < 1e-9:
            break
        new = v - step * g
        v, w = new + k / (k + 3) * (new - w), new
    return w


def test_predictions_equal_plain_fits(spark, parts):
    data, _, rows = parts
    told = arms.with_truth(assembly.arms(rows, {"history": ("history",), "history_axes_first": ("history", "axes_first")}), data).where("fold IN (1, 9) AND series IN ('view', 'click')")
    made = {(r["series"], r["fold"], r["arm"]): r for r in models.fit_predict(told, (0.1,), audit=True).collect()}
    groups = collections.defaultdict(list)
    for r in told.collect():
        groups[r["series"], r["fold"], r["arm"]].append(r)
    assert made and set(made) <= set(groups)
    for key, r in made.items():
        train = sorted((g for g in groups[key] if not g["is_query"]), key=lambda g: g["j"])
        asked = next(g for g in groups[key] if g["is_query"])
        x, y = np.array([g["features"] for g in train]), np.array([CLASSES.index(g["direction"]) for g in train])
        w = descend(x, y, 0.1)
        q = np.append(asked["features"], 1.0)
        p = np.exp(q @ w) / np.exp(q @ w).sum()
        assert (r["p_cut"], r["p_hold"], r["p_hike"]) == pytest.approx(tuple(p), abs=1e-6)
        points = np.array([g["action_bp"] for g in train]) / 100
        c = x - x.mean(0)
        slope = np.linalg.solve(c.T @ c + len(x) * 0.1 * np.eye(x.shape[1]), c.T @ (points - points.mean()))
        assert r["predicted_bp"] == pytest.approx(100 * (points.mean() + slope @ (np.array(asked["features"]) - x.mean(0))), abs=1e-6)
        loss = -np.mean(np.log(models.softmax_probabilities(np.hstack([x, np.ones((len(x), 1))]), w, np.zeros(3))[np.arange(len(x)), y])) + 0.05 * (w[:-1] ** 2).sum()
        assert r["objective"] == pytest.approx(loss, abs=1e-8) and r["n_train"] == len(train) and len(r["weights_sha256"]) == 64


def test_arms_hold_their_parts_in_order(spark, parts):
    _, at, rows = parts
    wanted = assembly.NESTED_ARMS
    held = {(r["series"], r["fold"], r["j"], r["is_query"], r["part"]): r["features"] for r in rows.where("fold = 3 AND is_query").collect()}
    made = assembly.arms(rows.where("fold = 3 AND is_query"), wanted).collect()
    assert len(made) == len(wanted) * at.where("fold = 3").count()
    for r in made:
        key = r["series"], r["fold"], r["j"], r["is_query"]
        assert r["features"] == [x for p in wanted[r["arm"], r["scaling"]] for x in held[*key, p]]
        assert list(wanted)[r["arm_no"]] == (r["arm"], r["scaling"])
    with pytest.raises(Exception, match="parts are missing"):
        assembly.arms(rows.where("fold = 3 AND part <> 'lsa'"), wanted).collect()


def test_scaled_parts_have_mean_zero_and_deviation_one(parts):
    _, _, rows = parts
    cells = rows.where("part IN ('tfidf_scaled', 'lsa_scaled', 'encoder', 'market') AND NOT is_query").select("series", "fold", "part", F.posexplode("features").alias("p", "x"))
    stats = cells.groupBy("series", "fold", "part", "p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    assert stats and all(abs(r["m"]) < 1e-9 and (abs(r["s"] - 1) < 1e-9 or r["s"] < 1e-9) for r in stats)


def plain_metrics(rows):
    f = []
    for c in CLASSES:
        both = sum(r["true_class"] == c == r["predicted_class"] for r in rows)
        n = sum(r["true_class"] == c for r in rows) + sum(r["predicted_class"] == c for r in rows)
        f.append(2 * both / n if n else 0.0)
    p = [[r[f"p_{c}"] for c in CLASSES] for r in rows]
    at = [CLASSES.index(r["true_class"]) for r in rows]
    brier = sum(sum((x - (k == t)) ** 2 for k, x in enumerate(q)) for q, t in zip(p, at, strict=True)) / len(rows)
    loss = -sum(math.log(min(1.0, max(q[t], 1e-15))) for q, t in zip(p, at, strict=True)) / len(rows)
    return {"macro_f1": sum(f) / 3, "brier": brier, "log_loss": loss, "mae_bp": sum(abs(r["true_bp"] - r["predicted_bp"]) for r in rows) / len(rows), "n": len(rows)}


SOME = {k: assembly.NESTED_ARMS[k] for k in (("history", "fixed"), ("history_tfidf", "row_only"), ("history_tfidf", "column_standardized"))}


def test_nested_selection_and_grid_equal_plain_versions(spark, monkeypatch):
    monkeypatch.setattr(assembly, "NESTED_ARMS", SOME)
    monkeypatch.setattr(assembly, "GRID_ARMS", SOME)
    monkeypatch.setattr(arms, "LAMBDAS", (0.01, 1.0))
    data, at, grid = arms.nested_grid(spark, SMALL, SOME)
    fits = arms.scored_grid(data, at, grid).collect()
    origins = {(r["series"], r["fold"]): r["bucket"] for r in at.collect()}
    want = {}
    for (series, fold), bucket in origins.items():
        for arm in {a for a, _ in SOME}:
            own = [r for r in fits if r["series"] == series and r["arm"] == arm]
            by = collections.defaultdict(list)
            for r in own:
                if r["fold"] < fold and r["target_pub"] <= bucket:
                    by[r["scaling"], r["lambda"]].append(r)
            scored = {k: plain_metrics(v) for k, v in by.items() if len(v) >= 10}
            if not scored:
                continue
            first = max(scored, key=lambda k: (round(scored[k]["macro_f1"], 9), -round(scored[k]["brier"], 9), k[1], k[0] == "row_only"))
            size = min(scored, key=lambda k: (round(scored[k]["mae_bp"], 9), -k[1], k[0] != "row_only"))
            pick = lambda k: next((r for r in own if r["fold"] == fold and (r["scaling"], r["lambda"]) == k), None)  # noqa: E731, B023
            if pick(first) and pick(size):
                want[series, fold, arm] = (pick(first)["predicted_class"], pick(first)["p_hike"], pick(size)["predicted_bp"])
    made = {(r["series"], r["fold"], r["arm"]): (r["predicted_class"], r["p_hike"], r["predicted_bp"]) for r in arms.nested_selection(spark, SMALL).collect()}
    assert made and set(made) == set(want)
    for k, (label, p, bp) in made.items():
        assert label == want[k][0] and (p, bp) == pytest.approx(want[k][1:], abs=1e-9)
    groups = collections.defaultdict(list)
    for r in fits:
        groups[r["series"], r["arm"], r["scaling"], r["lambda"]].append(r)
    for r in arms.sensitivity_grid(spark, SMALL).collect():
        told = plain_metrics(groups.pop((r["series"], r["arm"], r["scaling"], r["lambda"])))
        assert all(r[k] == pytest.approx(v, abs=1e-9) for k, v in told.items())
    assert not groups


def test_lookups_refuse_what_does_not_fit(spark):
    left, right = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "p int, k string, x int"), spark.createDataFrame([(0, "a", 5), (1, "b", 6)], "p int, k string, y int")
    assert sorted(map(tuple, lookups.aligned(left, right, "k", "p").select("p", "k", "x", "y").collect())) == [(0, "a", 1, 5), (1, "b", 2, 6)]
    for other in (right.limit(1), right.withColumn("k", F.lit("a")), right.union(right.withColumn("p", F.col("p") + 2))):
        with pytest.raises(Exception, match="not aligned"):
            lookups.aligned(left, other, "k", "p").collect()
    proxy = spark.createDataFrame([("a", " 1.5 ", " ", "r"), ("b", "2", "3", "r")], "k string, f string, g string, rule string")
    made = lookups.proxy_numbers(left, proxy, "k", ["f", "g"], {"rule": "r"}).orderBy("p").collect()
    assert [(r["f"], r["g"]) for r in made] == [(1.5, None), (2.0, 3.0)]
    for broken in (proxy.limit(1), proxy.union(proxy), proxy.withColumn("rule", F.lit("s")), proxy.withColumn("f", F.lit("n/a"))):
        with pytest.raises(Exception, match="proxy row|timing rule|CAST_INVALID|cannot be cast"):
            lookups.proxy_numbers(left, broken, "k", ["f", "g"], {"rule": "r"}).collect()
    assert lookups.proxy_numbers(left.limit(0), proxy, "k", ["f"], {"rule": "r"}).count() == 0


def test_a_digest_does_not_hang_on_the_order_of_rows(spark):
    rows = [(k, f"o{k}", [k / 7, -1.0]) for k in range(50)]
    kind = "position int, origin_id string, vector array<double>"
    digest = lambda r: lookups.vector_digest(spark.createDataFrame(r, kind), ("position", "origin_id")).first()
    assert digest(rows) == digest(rows[::-1]) and digest(rows) != digest([(0, "o0", [0.5, -1.0]), *rows[1:]]) and digest(rows)["n"] == 50

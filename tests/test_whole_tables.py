"""Queries that must take in whole tables, not a part of fixed size."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from foldline.operators import inference
from foldline.plans import audits, catalogue, tables


def test_positions_cover_all_labelled_documents(spark):
    labelled = tables.axis_labels(spark, SMALL).where("first IS NOT NULL OR second IS NOT NULL").orderBy("doc_id").collect()
    made = catalogue.labelled_positions(spark, SMALL).orderBy("idx").collect()
    assert [(r["doc_id"], r["idx"]) for r in made] == [(r["doc_id"], k) for k, r in enumerate(labelled)]
    assert max(r["doc_id"] for r in made) >= 80


def test_masked_bootstrap_of_all_sees_later_documents(spark, tmp_path, monkeypatch):
    whole = catalogue.masked_bootstrap_all(spark, SMALL).collect()
    labels = tables.axis_labels
    monkeypatch.setattr(tables, "axis_labels", lambda s, d: labels(s, d).where("doc_id < 80"))
    assert len(whole) == 1 and whole != catalogue.masked_bootstrap_all(spark, SMALL).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 80, 83, 1024, 2 * 104729])
def test_times_of_arithmetic_draws_need_no_draws(spark, n):
    reps = 2 if n > 10_000 else 9
    sizes = spark.createDataFrame([("a", n)], "series string, n long")
    drawn = inference.arithmetic_draws(sizes, reps, 3).select("rep", "idx", "times")
    every = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), F.col("id").alias("idx"))
    told = every.withColumn("times", inference.arithmetic_times(F.col("idx"), F.col("rep"), n, 3)).where("times <> 0")
    assert drawn.exceptAll(told).count() == told.exceptAll(drawn).count() == 0


@pytest.mark.parametrize("made", [catalogue.masked_bootstrap_all, audits.named_reference_contrasts])
def test_resampled_rows_need_no_table_of_draws(spark, monkeypatch, made):
    monkeypatch.setattr(inference, "arithmetic_draws", None)
    assert made(spark, SMALL).count() > 0


def test_every_document_is_dealt_to_one_origin(spark):
    data = tables.observed(spark, SMALL)
    made = tables.dealt_documents(spark, SMALL, data)
    assert made.count() == made.select("doc_id").distinct().count() == tables.read(spark, SMALL, "documents").count()
    assert made.join(data, ["series", "i"], "left_anti").count() == 0


def test_panel_queries_answer_for_every_series(spark):
    known = {r["series"] for r in tables.folds(tables.observed(spark, SMALL)).select("series").distinct().collect()}
    assert len(known) > 1
    for name in ("panel_imputed_scores", "panel_vocabulary", "lsa_projection", "seeded_bootstrap", "market_proxy"):
        made = catalogue.QUERIES[name](spark, SMALL)
        assert {r["series"] for r in made.select("series").distinct().collect()} == known, name

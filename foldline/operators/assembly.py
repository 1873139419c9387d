"""Design rows: parts fitted within each fold, put together to arms.

A part is (series, fold, j, is_query, part, features): the vector of a fold's training row or query (j is the row's place in its series). An arm is
a list of parts in order, under a scaling. Nothing of a fold's query, and nothing later, enters what is fitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.operators import features
from foldline.operators.models import lsa

KEYS = ("series", "fold", "j", "is_query")

#: The parts of every arm of the rolling run, in order, and the scaling they are reported under.
RUN_ARMS: dict[str, tuple[str, ...]] = {
    "history": ("history",),
    "history_tfidf": ("history", "tfidf"),
    "history_lsa": ("history", "lsa"),
    "history_encoder": ("history", "encoder"),
    "history_axes_all": ("history", "axes_all"),
    "history_axes_first": ("history", "axes_first"),
    "history_axes_second": ("history", "axes_second"),
    "history_axes_third": ("history", "axes_third"),
    "history_axes_scores": ("history", "axes_scores"),
    "history_axes_missing": ("history", "axes_missing"),
}
#: Arms of the nested run beside those on axes: (arm, scaling) and its parts.
NESTED_ARMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("history", "fixed"): ("history",),
    ("history_tfidf", "row_only"): ("history", "tfidf"),
    ("history_tfidf", "column_standardized"): ("history", "tfidf_scaled"),
    ("history_lsa", "row_only"): ("history", "lsa"),
    ("history_lsa", "column_standardized"): ("history", "lsa_scaled"),
    ("market", "fixed"): ("history", "market"),
    ("market_lsa", "row_only"): ("history", "market", "lsa"),
    ("market_lsa", "column_standardized"): ("history", "market", "lsa_scaled"),
    ("history_encoder", "fixed"): ("history", "encoder"),
} | {(a, "fixed"): ps for a, ps in RUN_ARMS.items() if "axes" in a}
#: The sensitivity grid's arms.
GRID_ARMS = {k: v for k, v in NESTED_ARMS.items() if k[0] in ("history_tfidf", "history_lsa", "market_lsa")}


def fold_rows(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """(series, fold, j, is_query) of every fold's training rows and its query."""
    train = pairs.select("series", "fold", "j", F.lit(False).alias("is_query"))
    return train.unionByName(folds.select("series", "fold", F.col("i").alias("j"), F.lit(True).alias("is_query")))


def score_designs(axes: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The six ablation designs of three axes: all, each alone, scores without their missing marks, and the marks alone."""
    names = dict(zip(("first", "second", "third"), axes, strict=True))
    return {
        "axes_all": (*axes, *[f"missing_{a}" for a in axes]),
        **{f"axes_{n}": (a, f"missing_{a}") for n, a in names.items()},
        "axes_scores": tuple(axes),
        "axes_missing": tuple(f"missing_{a}" for a in axes),
    }


def named(rows: DataFrame, designs: dict[str, Sequence[str]]) -> DataFrame:
    """Parts from long standardised rows (series, fold, j, is_query, column, value): each design's columns in its order."""
    return features.designs(rows, designs).withColumnRenamed("arm", "part")


def scaled_vectors(rows: DataFrame) -> DataFrame:
    """Part rows with their vectors' positions z-scored by each fold's training rows (population deviation, 0 counts as 1)."""
    cells = rows.select(*KEYS, "part", F.posexplode("features").alias("p", "x"))
    fit = cells.where(~F.col("is_query")).groupBy("series", "fold", "part", "p").agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_sd"))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    scaled = cells.join(fit, ["series", "fold", "part", "p"]).select(*KEYS, "part", F.struct("p", ((F.col("x") - F.col("_mean")) / sd).alias("x")).alias("c"))
    full = scaled.groupBy(*KEYS, "part").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]).alias("features"))
    # Vectors without a position have no cell.
    return full.unionByName(rows.where(F.size("features") == 0).select(*KEYS, "part", "features"))


def tfidf_part(rows: DataFrame, weights: DataFrame, vocabulary: DataFrame, part: str = "tfidf") -> DataFrame:
    """Dense TF-IDF vectors in the order of the fold's vocabulary; zeros for rows without any of its words, empty where a fold has none.

    `weights` is (series, fold, j, is_query, token, weight), `vocabulary` (series, fold, token, rank).
    """
    width = vocabulary.groupBy("series", "fold").agg(F.max("rank").alias("width"))
    held = weights.join(vocabulary.select("series", "fold", "token", "rank"), ["series", "fold", "token"])
    maps = held.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("rank", "weight"))).alias("m"))
    dense = F.when(F.col("width").isNull(), F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.col("width")), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0.0)))
    )
    return rows.join(width, ["series", "fold"], "left").join(maps, list(KEYS), "left").select(*KEYS, F.lit(part).alias("part"), dense.alias("features"))


def lsa_part(tfidf: DataFrame, components: int, part: str = "lsa") -> DataFrame:
    """Projections of a part's vectors on each fold's leading directions; a group is one fold."""
    kinds = ", ".join(f"{n} {t}" for n, t in tfidf.select(*KEYS).dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["is_query", "j"])
        asked = group["is_query"].to_numpy(bool)
        m = np.array(group["features"].tolist(), float).reshape(len(group), -1)
        made = np.zeros((len(m), 0))
        if m.shape[1] and not asked.all():
            learned, told = lsa(m[~asked], m[asked], components)
            made = np.vstack([learned, told])
        return group[list(KEYS)].assign(features=made.tolist())

    made = tfidf.groupBy("series", "fold").applyInPandas(run, f"{kinds}, features array<double>")
    return made.select(*KEYS, F.lit(part).alias("part"), "features")


def vector_part(rows: DataFrame, vectors: DataFrame, dimension: int, part: str) -> DataFrame:
    """Stored vectors (series, i, vector) beside every row, z-scored within the fold; rows without one count as zeros before that."""
    found = rows.join(vectors.select("series", F.col("i").alias("j"), "vector"), ["series", "j"], "left")
    none = F.array_repeat(F.lit(0.0), dimension)
    return scaled_vectors(found.select(*KEYS, F.lit(part).alias("part"), F.coalesce("vector", none).alias("features")))


def arms(parts: DataFrame, wanted: dict[str, Sequence[str]] | dict[tuple[str, str], Sequence[str]]) -> DataFrame:
    """(series, fold, j, is_query, arm, scaling, arm_no, features): each arm's parts put side by side in its order; arm_no counts from 0 in the order asked for.

    Every part must be there for every row: an arm that lacks one is an error. `wanted` maps an arm, or an arm and its scaling, to its parts.
    """
    uses: dict[str, list] = {}
    for no, (name, parts_of) in enumerate(wanted.items()):
        arm, scaling = name if isinstance(name, tuple) else (name, "fixed")
        for position, part in enumerate(parts_of):
            cell = F.struct(
                F.lit(arm).alias("arm"), F.lit(scaling).alias("scaling"), F.lit(no).alias("arm_no"), F.lit(position).alias("position"), F.lit(len(parts_of)).alias("of")
            )
            uses.setdefault(part, []).append(cell)
    table = F.create_map(*[x for part, cells in uses.items() for x in (F.lit(part), F.array(*cells))])
    placed = parts.where(F.col("part").isin(list(uses))).select(*KEYS, "features", F.inline(F.try_element_at(table, F.col("part"))))
    made = placed.groupBy(*KEYS, "arm", "scaling", "arm_no", "of").agg(F.array_sort(F.collect_list(F.struct("position", "features"))).alias("c"))
    whole = F.when(F.size("c") == F.col("of"), F.flatten(F.transform("c", lambda c: c["features"])))
    return made.select(*KEYS, "arm", "scaling", "arm_no", F.coalesce(whole, F.raise_error(F.concat(F.lit("parts are missing of "), F.col("arm"))).cast("array<double>")).alias("features"))

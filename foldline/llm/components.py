"""Connected components of an edge list, by alternating large-star and small-star rounds.

The rounds are grouped minima and equi-joins, so no task holds a component: a hub's edges are
partially aggregated before the shuffle, and adaptive execution may split its join partition.
Each round is checkpointed. A first pass inside every partition keeps a spanning forest only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Edges that the first pass holds at once in a task.
FOREST_BATCH = 1 << 20


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining nodes a[i] and b[i]: each node's label is the smallest index it reaches.

    `label` must be flat on entry (label[label] == label), and is flat on return.
    """
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label = flat


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
        edges = pd.concat(parts)
        nodes, codes = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        codes = codes.reshape(-1, 2)
        label = merge_labels(np.arange(len(nodes)), codes[:, 0], codes[:, 1])
        leaf = label != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[leaf], "b": nodes[label[leaf]]})

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= FOREST_BATCH:
            yield stars(held)
            held, size = [], 0
    if held:
        yield stars(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long); root is the component's smallest node.

    Edges with a null end, loops and repeats change nothing. No edges: no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = durable(edges.mapInPandas(_forest, "a long, b long"))

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = signature(current)
    while before[0]:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = durable(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

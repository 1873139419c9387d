"""Near-duplicate vectors by an epsilon grid order join.

1. Equal vectors are one class, with a count, before anything is compared.
2. Classes are ordered by the cells of a grid of width epsilon over the leading principal dimensions, and
   the order is cut into intervals. Both the dimensions and the cuts come from a bounded sample of
   `SAMPLE` classes; they place the work, and results are exact for any.
3. The driver joins intervals with intervals recursively by their bounding boxes, and drops pairs that
   are provably farther apart than epsilon. Each pair that is left is one task's work; an interval of over
   `TILE` vectors is dealt into tiles, and each pair of tiles is a task, so what a task holds is bounded.
4. A task goes on with the recursion over its two sequences, and multiplies the blocks that are left: in
   single precision with a margin, then in double precision where that leaves doubt. It returns each
   class's number of links and a spanning forest, never the pairs.
5. Components of the forest are labelled by star rounds.

Cost at scale: boxes prune where vectors cluster along leading dimensions. Where they spread evenly
over 64 dimensions, nearly all pairs of blocks have to be multiplied.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merge_labels
from .durable import durable

SAMPLE = 4096
#: Principal dimensions that make the grid's cells, and that bounding boxes cover.
CELL_DIMS, BOX_DIMS = 6, 16
#: Vectors of an interval, at least, and rows of a block that is multiplied whole.
INTERVAL, BLOCK = 8192, 1024
#: Vectors of a tile, about: a task holds two tiles at most.
TILE = 1 << 16
#: Partitions at most; beyond, a partition has several tasks' work, one after the other.
MOST_PARTITIONS = 16_384
#: Single-precision cosines this near the limit are settled in double precision.
DOUBT = 1e-4


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, v): the vector, scaled, and a digest of its bytes, both null where it links with nothing.

    A vector is scaled by the power of two that brings its largest component to between 0.5 and 1. That changes no cosine, and
    neither its products nor its length can overflow or vanish, whatever its magnitude.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for v in batch.column(1).to_pylist():
                x = None if not v or None in v else np.array(v, np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    keys.append(None), vectors.append(None)
                else:
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
                    vectors.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["id", "key", "v"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "id long, key string, v array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


class Plan:
    """Grid and intervals, from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, epsilon: float, intervals: int):
        self.epsilon = epsilon
        centred = sample - sample.mean(0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, : max(CELL_DIMS, BOX_DIMS)])
        keys = self.keys(sample @ self.axes)
        order = np.lexsort(keys.T[::-1])
        at = order[(np.arange(1, intervals) * len(order)) // intervals]
        self.cuts = np.unique(keys[at], axis=0) if len(at) else keys[:0]

    def keys(self, projected: np.ndarray) -> np.ndarray:
        """Grid order: cells on the leading dimensions, then the projections themselves."""
        lead = projected[:, :CELL_DIMS]
        return np.hstack([np.floor(lead / self.epsilon), lead])

    def interval(self, projected: np.ndarray) -> np.ndarray:
        keys = self.keys(projected)
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.cuts))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            diff = keys[open_] - self.cuts[mid]
            first = diff[np.arange(len(open_)), (diff != 0).argmax(1)]
            low[open_[first >= 0]] = mid[first >= 0] + 1
            high[open_[first < 0]] = mid[first < 0]
        return low


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, epsilon: float) -> bool:
    """Whether two boxes are provably farther apart than epsilon."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) > (epsilon * (1 + 1e-6) + 1e-6) ** 2


def interval_pairs(lo: np.ndarray, hi: np.ndarray, epsilon: float) -> list[tuple[int, int]]:
    """Pairs a <= b of intervals that may hold a link, by recursion over sequences of intervals."""
    out = []
    stack = [((0, len(lo)), (0, len(lo)))] if len(lo) else []
    while stack:
        (a, b), (c, d) = stack.pop()
        if _apart(lo[a:b].min(0), hi[a:b].max(0), lo[c:d].min(0), hi[c:d].max(0), epsilon):
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
            continue
        left = [(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)]
        right = [(c, d)] if d - c == 1 else [(c, (c + d) // 2), ((c + d) // 2, d)]
        stack += [(x, y) for x in left for y in right if x[0] < y[1] and x[0] <= y[0]]
    return sorted(set(out))


class Tasks:
    """Numbers of the tasks: for each pair of intervals, one for each pair of their tiles."""

    def __init__(self, pairs: np.ndarray, tiles: np.ndarray):
        self.pairs, self.tiles = pairs, tiles
        n = tiles[pairs[:, 0]] * tiles[pairs[:, 1]]
        self.base = np.concatenate([[0], n.cumsum()])
        self.total = int(self.base[-1])

    def of(self, interval: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
        """(task, whether it is the second side there) of all tasks that need this tile of an interval."""
        task, second = [], []
        for k in np.flatnonzero((self.pairs == interval).any(1)).tolist():
            a, b = self.pairs[k].tolist()
            if a == interval:
                others = np.arange(tile if a == b else 0, self.tiles[b])
                task.append(self.base[k] + tile * self.tiles[b] + others)
                second.append(np.zeros(len(others), np.int64))
            if b == interval:
                others = np.arange(0, tile if a == b else self.tiles[a])
                task.append(self.base[k] + others * self.tiles[b] + tile)
                second.append(np.ones(len(others), np.int64))
        return np.concatenate(task), np.concatenate(second)

    def alone(self, task: int) -> bool:
        """Whether a task joins a tile with itself."""
        k = int(np.searchsorted(self.base, task, side="right")) - 1
        a, b = self.pairs[k].tolist()
        x, y = divmod(task - int(self.base[k]), int(self.tiles[b]))
        return a == b and x == y


def join_sequences(x: np.ndarray, y: np.ndarray | None, px: np.ndarray, py: np.ndarray | None, wx: np.ndarray, wy: np.ndarray | None, limit: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, labels) over the rows of x, then of y: other rows, by weight, with cosine >= limit, and merged labels.

    y None: pairs within x. p: projections in grid order of the rows; w: weights.
    """
    same = y is None
    n = len(x)
    both = x if same else np.vstack([x, y])
    proj = px if same else np.vstack([px, py])
    weight = (wx if same else np.concatenate([wx, wy])).astype(np.int64)
    norm = np.linalg.norm(both, axis=1)
    single = (both / norm[:, None]).astype(np.float32)
    links = np.zeros(len(both), np.int64)
    label = np.arange(len(both))
    whole = (0, n), ((0, n) if same else (n, len(both)))
    stack = [whole]
    while stack:
        (a, b), (c, d) = stack.pop()
        if a == b or c == d or _apart(proj[a:b].min(0), proj[a:b].max(0), proj[c:d].min(0), proj[c:d].max(0), epsilon):
            continue
        if b - a > BLOCK or d - c > BLOCK:
            left = [(a, b)] if b - a <= BLOCK else [(a, (a + b) // 2), ((a + b) // 2, b)]
            right = [(c, d)] if d - c <= BLOCK else [(c, (c + d) // 2), ((c + d) // 2, d)]
            stack += [(p, q) for p in left for q in right if not (same and p[0] > q[0])]
            continue
        cos = single[a:b] @ single[c:d].T
        i, j = np.nonzero(cos >= np.float32(limit - DOUBT))
        near = cos[i, j] < limit + DOUBT
        i, j = i + a, j + c
        keep = i < j if same and a == c else np.ones(len(i), bool)
        unsure = np.flatnonzero(near & keep)
        for k in np.array_split(unsure, -(-len(unsure) // 8192) or 1):
            keep[k] = np.einsum("kd,kd->k", both[i[k]], both[j[k]]) / (norm[i[k]] * norm[j[k]]) >= limit
        i, j = i[keep], j[keep]
        if i.size:
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = merge_labels(label, i, j)
    return links, label


def _known(valid: DataFrame, dim: int, limit: float) -> DataFrame:
    """(key, n_links, component_id) of the different vectors of `valid`, which all have `dim` components."""
    classes = valid.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = classes.count()
    epsilon = math.sqrt(max(0.0, 2 - 2 * limit))
    taken = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()
    sample = np.array([r["v"] for r in taken], np.float64).reshape(-1, dim or 1)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    plan = Plan(sample if len(sample) else np.zeros((1, 1)), epsilon, max(1, min(SAMPLE // 4, round(total / max(INTERVAL, 32 * math.sqrt(total or 1))))))
    boxes = plan.axes.shape[1]

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        v = _matrix(batch.column(batch.schema.get_field_index("v")), dim)
        return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ plan.axes

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full((len(plan.cuts) + 1, boxes), np.inf), np.full((len(plan.cuts) + 1, boxes), -np.inf)
        for batch in batches:
            p = projected(batch)
            at = plan.interval(p)
            np.minimum.at(lo, at, p)
            np.maximum.at(hi, at, p)
        used = np.flatnonzero(np.isfinite(lo[:, 0]))
        cells = np.repeat(used, boxes), np.tile(np.arange(boxes), len(used)), lo[used].ravel(), hi[used].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["interval", "dim", "lo", "hi"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(plan.cuts) + 1, np.int64)
        for batch in batches:
            n += np.bincount(plan.interval(projected(batch)), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["interval", "n"])

    # One row for each interval and dimension: at most SAMPLE / 4 x BOX_DIMS.
    found = classes.select("v").mapInArrow(bounds, "interval long, dim long, lo double, hi double")
    found = found.groupBy("interval", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    lo, hi = np.full((len(plan.cuts) + 1, boxes), np.inf), np.full((len(plan.cuts) + 1, boxes), -np.inf)
    for r in found:
        lo[r["interval"], r["dim"]], hi[r["interval"], r["dim"]] = r["lo"], r["hi"]
    used = np.flatnonzero(np.isfinite(lo[:, 0]))
    pairs = np.array([(used[a], used[b]) for a, b in interval_pairs(lo[used], hi[used], epsilon)], np.int64).reshape(-1, 2)
    tiles = np.ones(len(plan.cuts) + 1, np.int64)
    if total > TILE:
        for r in classes.select("v").mapInArrow(counted, "interval long, n long").groupBy("interval").agg(F.sum("n").alias("n")).collect():
            tiles[r["interval"]] = -(-r["n"] // TILE)
    tasks = Tasks(pairs, tiles)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            at = plan.interval(projected(batch))
            cid = batch.column(batch.schema.get_field_index("cid")).to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                own = ((cid * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % tiles[at].astype(np.uint64)
            units = list(zip(at.tolist(), own.tolist(), strict=True))
            for unit in set(units).difference(held):
                held[unit] = tasks.of(*unit)
            row = np.repeat(np.arange(len(units)), [len(held[u][0]) for u in units])
            task, second = (np.concatenate([held[u][k] for u in units]) if units else np.zeros(0, np.int64) for k in (0, 1))
            for i in range(0, len(row), 8192):
                part = pa.array(row[i : i + 8192])
                columns = [batch.column(batch.schema.get_field_index(n)).take(part) for n in ("cid", "n", "v")]
                yield pa.RecordBatch.from_arrays([pa.array(task[i : i + 8192]), pa.array(second[i : i + 8192]), *columns], ["task", "second", "cid", "n", "v"])

    def joined(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("v"), dim)
        p = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ plan.axes
        second = group.column("second").to_numpy()
        order = np.lexsort([*plan.keys(p).T[::-1], second])
        v, p = v[order], p[order]
        cid, n = group.column("cid").to_numpy()[order], group.column("n").to_numpy()[order]
        cut = int(np.searchsorted(second[order], 1))
        alone = tasks.alone(group.column("task")[0].as_py())
        parts = (v, None, p, None, n, None) if alone else (v[:cut], v[cut:], p[:cut], p[cut:], n[:cut], n[cut:])
        links, label = join_sequences(*parts, limit, epsilon)
        has, other = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        ends = np.concatenate([np.full(len(has), -1), cid[label[other]]])
        return pa.table({"a": np.concatenate([cid[has], cid[other]]), "b": ends, "n": np.concatenate([links[has], np.zeros(len(other), np.int64)])})

    out = (
        classes.select("cid", "n", "v")
        .mapInArrow(dealt, "task long, second long, cid long, n long, v array<double>")
        .repartition(max(1, min(tasks.total, MOST_PARTITIONS)), "task")
        .groupBy("task")
        .applyInArrow(joined, "a long, b long, n long")
    )
    out = durable(out)
    links = out.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = connected_components(out.where("b >= 0").select("a", "b")).withColumnRenamed("node", "cid")
    rooted = classes.select("cid", "key", "rep", "n").join(links, "cid", "left").join(roots, "cid", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(least, "root").select("key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of `df`: links are cosines >= `limit` in double precision.

    n_links counts other rows linked directly, equal vectors included; component_id is the smallest id reachable,
    kept says that it is the row's own. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, others, of whatever magnitude, with those of their own length: each length is a join of its own. Repeated ids are rows of their own; null ids are kept, and name no component that has another. An empty table gives no rows.
    """
    rows = durable(_rows(df, id_col, vector_col))
    valid = rows.where("key IS NOT NULL")
    dims = sorted(r["d"] for r in valid.select(F.size("v").alias("d")).distinct().collect())
    none = rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).limit(0)
    known = reduce(DataFrame.union, [_known(valid.where(F.size("v") == d), d, limit) for d in dims] or [none])
    linked = rows.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return linked.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )

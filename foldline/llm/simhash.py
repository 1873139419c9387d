"""SimHash near-duplicates, linked through vantage-point trees over the Hamming distance.

1. Every text gets a fingerprint; equal fingerprints are one class before anything is compared.
2. A top tree, built on the driver from a bounded sample of classes (`sample` of them: the sample
   only places the cuts, results are exact for any), sends each class to its home leaf, and as a
   query to every leaf that its ball overlaps by the triangle inequality. Of two leaves only the
   later one sees the pair. Leaves that hold much are tiled: homes and queries are dealt into blocks.
3. A leaf's task descends a local tree with all its queries at once, and compares whole blocks where
   a cut no longer prunes. It returns a spanning forest of the links, never the pairs.
4. Components of the forest are labelled by star rounds.

Cost at scale: a cut over 64 bits at radius 2 is crossed by about 4 of 10 queries, so rows grow a
little faster than the input; at a radius near 16 nothing is pruned and step 3 compares all classes
with all, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merge_labels
from .durable import durable
from .textkit import lower_ascii, shingle_hashes, text_batches, texts_of, with_columns

#: Shingles whose bits are counted at once.
BIT_BATCH = 1 << 15
#: Constants of the splitmix64 finaliser, which derives further words of a fingerprint. Fixed values.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + MIX[0] * np.uint64(word)
        z = (z ^ (z >> np.uint64(30))) * MIX[1]
        z = (z ^ (z >> np.uint64(27))) * MIX[2]
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """`words` 64-bit words; a bit is 1 if it is set in over half the hashes. No hashes: zeros.

    The first word counts the bits of the hashes themselves, further words those of mixed hashes.
    """
    out = np.zeros(words, np.uint64)
    for w in range(words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), BIT_BATCH):
            block = np.ascontiguousarray(_mixed(hashes[i : i + BIT_BATCH], w))
            bits = np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64)
            if len(bits) < 256:
                ones += np.add.reduce(bits, 0, np.int64)
                continue
            whole = len(bits) // 255 * 255  # 255 rows of bits fit a byte
            sums = np.add.reduce(bits[:whole].reshape(-1, 255, 64), 1, np.uint8)
            ones += np.add.reduce(sums, 0, np.int64) + np.add.reduce(bits[whole:], 0, np.int64)
        out[w] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """(id, f0, f1, ...) for every row: the fingerprint of the whole text as signed longs.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Null and empty texts, and
    texts of white space, have fingerprint 0. Null ids and repeated rows stay as they are.
    """
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, words), np.uint64)
            for i, text in enumerate(texts_of(batch, "text")):
                found[i] = fingerprint(shingle_hashes(lower_ascii(text), width), words)
            signed = np.ascontiguousarray(found.T).view(np.int64)
            yield with_columns(batch, {n: pa.array(signed[w]) for w, n in enumerate(names)}, ("text",))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return text_batches(rows).mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def hamming_limit(similarity: float, bits: int) -> int:
    """Most differing bits of two fingerprints whose shingle sets have at least this Jaccard similarity, as expected.

    Sets of like size and Jaccard similarity s have cosine 2s/(1+s), and bits differ with chance angle/pi.
    """
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


@dataclass
class Tree:
    """Nodes of a vantage-point tree; a child under 0 is leaf -child-1."""

    pivot: np.ndarray
    cut: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaves: int

    def home(self, f: np.ndarray) -> np.ndarray:
        at = np.zeros(len(f), np.int64) if len(self.pivot) else np.full(len(f), -1, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            close = np.bitwise_count(f[inner] ^ self.pivot[node]) <= self.cut[node]
            at[inner] = np.where(close, self.near[node], self.far[node])
        return -at - 1

    def visits(self, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row's ball may reach."""
        if not len(self.pivot):
            return np.arange(len(f)), np.zeros(len(f), np.int64)
        row, at, done = np.arange(len(f)), np.zeros(len(f), np.int64), []
        while row.size:
            d = np.bitwise_count(f[row] ^ self.pivot[at]).astype(np.int64)
            near, far = d - radius <= self.cut[at], d + radius > self.cut[at]
            row = np.concatenate([row[near], row[far]])
            at = np.concatenate([self.near[at[near]], self.far[at[far]]])
            leaf = at < 0
            done.append((row[leaf], -at[leaf] - 1))
            row, at = row[~leaf], at[~leaf]
        return np.concatenate([r for r, _ in done]), np.concatenate([x for _, x in done])


def best_cut(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int, float]:
    """Pivot and cut with the least expected work (queries times homes on both sides, of all), no side under a tenth."""
    best = (points[0], 0, 2.0)
    for pivot in points[rng.integers(0, len(points), tries)]:
        share = np.bincount(np.bitwise_count(points ^ pivot), minlength=65).cumsum() / len(points)
        cuts = np.flatnonzero((share >= 0.1) & (share <= 0.9))
        if not cuts.size:
            cuts = np.array([np.abs(share - 0.5).argmin()])
        reach = share[np.minimum(cuts + radius, 64)]
        beyond = 1 - np.where(cuts - radius >= 0, share[np.maximum(cuts - radius, 0)], 0.0)
        work = share[cuts] * reach + (1 - share[cuts]) * beyond + 0.05 * np.abs(share[cuts] - 0.5)
        if work.min() < best[2]:
            best = (pivot, int(cuts[work.argmin()]), float(work.min()))
    return best


def build_tree(points: np.ndarray, leaves: int, radius: int, seed: int = 42) -> Tree:
    """A tree of about `leaves` leaves whose cuts come from `points` (distinct fingerprints)."""
    rng = np.random.default_rng(seed)
    floor = max(2, len(points) // max(1, leaves))
    pivot, cut, near, far = [], [], [], []
    count = 0

    def grow(part: np.ndarray) -> int:
        nonlocal count
        if len(part) >= 2 * floor and count + 1 < leaves * 4:
            p, c, _ = best_cut(part, radius, rng)
            inside = np.bitwise_count(part ^ p) <= c
            if inside.any() and not inside.all():
                at = len(pivot)
                pivot.append(p), cut.append(c), near.append(0), far.append(0)
                near[at] = grow(part[inside])
                far[at] = grow(part[~inside])
                return at
        count += 1
        return -count

    grow(points)
    return Tree(np.array(pivot, np.uint64), np.array(cut, np.int64), np.array(near, np.int64), np.array(far, np.int64), count)


def forest_within(homes: np.ndarray, queries: np.ndarray, radius: int, limit: int) -> np.ndarray:
    """Labels over homes then queries: rows joined by a link between a query and a home.

    homes, queries: (n, words). Linked: first words within `radius` bits, all words within `limit`.
    """
    label = np.arange(len(homes) + len(queries))
    h0, q0 = homes[:, 0], queries[:, 0]
    rng = np.random.default_rng(7)

    def blocks(h: np.ndarray, q: np.ndarray) -> None:
        nonlocal label
        step = 1 << 14
        # Of pairs that pass the first word, all words are gathered: some 150 bytes a pair.
        pairs = 1 << (20 if homes.shape[1] == 1 else 17)
        for j in range(0, len(h), step):
            hj = h[j : j + step]
            hv = h0[hj]
            rows = max(1, pairs // len(hj))
            for i in range(0, len(q), rows):
                qi = q[i : i + rows]
                a, b = np.nonzero(np.bitwise_count(q0[qi][:, None] ^ hv[None, :]) <= radius)
                if not a.size:
                    continue
                a, b = qi[a], hj[b]
                open_ = label[len(homes) + a] != label[b]
                a, b = a[open_], b[open_]
                if homes.shape[1] > 1 and a.size:
                    full = np.bitwise_count(queries[a] ^ homes[b]).sum(1, dtype=np.int64) <= limit
                    a, b = a[full], b[full]
                if a.size:
                    label = merge_labels(label, len(homes) + a, b)

    stack = [(np.arange(len(homes)), np.arange(len(queries)))]
    while stack:
        h, q = stack.pop()
        if not h.size or not q.size:
            continue
        if h.size <= 256 or h.size * q.size <= 1 << 18:
            blocks(h, q)
            continue
        p, c, work = best_cut(h0[h[:: max(1, h.size // 1024)]], radius, rng)
        dh, dq = np.bitwise_count(h0[h] ^ p).astype(np.int64), np.bitwise_count(q0[q] ^ p).astype(np.int64)
        inside, reach, beyond = dh <= c, dq - radius <= c, dq + radius > c
        left = int(inside.sum()) * int(reach.sum()) + int((~inside).sum()) * int(beyond.sum())
        if left > 0.85 * h.size * q.size:
            blocks(h, q)
        else:
            stack += [(h[inside], q[reach]), (h[~inside], q[beyond])]
    return label


def links(classes: DataFrame, words: int, radius: int, limit: int, sample: int = 4096, tile: int = 1 << 18) -> DataFrame:
    """(a, b) of a spanning forest of the links between `classes` (cid, f0, ...), by step 2 and 3 above."""
    names = [f"f{w}" for w in range(words)]
    spark = classes.sparkSession
    total = classes.count()
    # Larger leaves as the classes grow: rows sent to many leaves and rows compared stay in balance.
    leaves = max(1, min(sample // 4, round(total / max(4096, 32 * math.sqrt(total)))))
    taken = classes.select("f0").distinct().orderBy(F.xxhash64("f0"), "f0").limit(sample).collect()
    points = np.array([r["f0"] for r in taken], np.int64).view(np.uint64)
    tree = build_tree(points, leaves, radius) if len(points) > 1 and leaves > 1 else Tree(*[np.zeros(0, np.int64)] * 4, 1)

    def route(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = batch["f0"].to_numpy(np.int64).view(np.uint64)
        home = tree.home(f)
        row, leaf = tree.visits(f, radius)
        later = leaf >= home[row]
        return home, row[later], leaf[later]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((tree.leaves, 2), np.int64)
        for batch in batches:
            home, _, leaf = route(batch)
            n[:, 0] += np.bincount(home, minlength=tree.leaves)
            n[:, 1] += np.bincount(leaf, minlength=tree.leaves)
        yield pd.DataFrame({"leaf": np.arange(tree.leaves), "h": n[:, 0], "q": n[:, 1]})

    load = classes.mapInPandas(counted, "leaf long, h long, q long").groupBy("leaf").agg(F.sum("h").alias("h"), F.sum("q").alias("q"))
    tiles = np.ones((tree.leaves, 2), np.int64)
    for r in load.collect():  # one row a leaf: at most `sample` of them
        tiles[r["leaf"]] = max(1, -(-r["h"] // tile)), max(1, -(-r["q"] // (4 * tile)))
    base = np.concatenate([[0], (tiles[:, 0] * tiles[:, 1]).cumsum()])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            home, row, leaf = route(batch)
            cid = batch["cid"].to_numpy(np.int64)
            values = batch[names].to_numpy(np.int64)
            mixed = _mixed(cid.view(np.uint64), 1)
            # A home is needed in all query blocks of its leaf, a query in all home blocks.
            copies = tiles[home, 1]
            at = np.repeat(np.arange(len(batch)), copies)
            block = np.arange(len(at)) - np.repeat(copies.cumsum() - copies, copies)
            hb = (mixed[at] % tiles[home[at], 0].astype(np.uint64)).astype(np.int64)
            t_home = base[home[at]] + hb * tiles[home[at], 1] + block
            copies = tiles[leaf, 0]
            to = np.repeat(np.arange(len(row)), copies)
            block = np.arange(len(to)) - np.repeat(copies.cumsum() - copies, copies)
            qb = (mixed[row[to]] % tiles[leaf[to], 1].astype(np.uint64)).astype(np.int64)
            t_query = base[leaf[to]] + block * tiles[leaf[to], 1] + qb
            rows = np.concatenate([at, row[to]])
            tile_no = np.concatenate([t_home, t_query])
            is_home = np.concatenate([np.ones(len(at), bool), np.zeros(len(to), bool)])
            for i in range(0, len(rows), 1 << 17):
                k = rows[i : i + (1 << 17)]
                yield pd.DataFrame(
                    {"tile": tile_no[i : i + (1 << 17)], "home": is_home[i : i + (1 << 17)], "cid": cid[k]}
                    | {n: values[k, w] for w, n in enumerate(names)}
                )

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        home = group["home"].to_numpy(bool)
        value = np.ascontiguousarray(group[names].to_numpy(np.int64)).view(np.uint64)
        label = forest_within(value[home], value[~home], radius, limit)
        cid = group["cid"].to_numpy(np.int64)
        cid = np.concatenate([cid[home], cid[~home]])
        joined = cid != cid[label]
        return pd.DataFrame({"a": cid[joined], "b": cid[label[joined]]})

    fields = ", ".join(f"{n} long" for n in names)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(base[-1]), 4096))
    return (
        classes.mapInPandas(dealt, f"tile long, home boolean, cid long, {fields}")
        .repartition(parts, "tile")
        .groupBy("tile")
        .applyInPandas(searched, "a long, b long")
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    words: int = 1,
    radius: int = 2,
    limit: int | None = None,
) -> DataFrame:
    """One row for each row of `df`: (id, f0, ..., component_id), component_id the smallest id reachable by links.

    Two fingerprints of `words` 64-bit words link if their first words differ in at most `radius` bits and
    all words in at most `limit` (default: `radius`). Equal texts share a component. Null ids are kept and
    never name a component that has another; a component of null ids only has a null component_id.
    Empty and null texts have fingerprint 0, linked like any other. An empty table gives no rows. Only the
    two named columns are read, whatever the other columns are called.
    """
    names = [f"f{w}" for w in range(words)]
    limit = radius if limit is None else limit
    rows = durable(fingerprints(df, id_col, text_col, width, words))
    classes = durable(rows.groupBy(*names).agg(F.min("id").alias("rep")).withColumn("cid", F.monotonically_increasing_id()))
    roots = connected_components(links(classes, words, radius, limit))
    rooted = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select(*names, "component_id")
    return rows.join(named, names)

"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once into flat blocks (`htmlblocks`). A tree keeps or drops each by its own words and link density, by those of
the blocks before and after it, and by what its containers say. It is grown here from the blocks of a small table of pages
labelled by hand (`labelled_pages`), whose features are measured as those of any page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmlblocks import Block, blocks_of
from .labelled_pages import PAGES
from .textkit import text_batches, texts_of, with_columns

FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "element", "named", "main", "page_has_main", "paragraph", "ended",
)
#: Signs that end a sentence, and those that may follow them. Fixed values.
END, CLOSING = ".!?\u2026\u3002\uff01\uff1f", "\"')]\u00bb\u201d\u2019"


def features(blocks: list[Block]) -> Iterator[tuple[float, ...]]:
    """The FEATURES of each block; beyond a page's ends there is a block of no words."""
    none = Block("")
    has_main = float(any(b.main for b in blocks))
    for before, b, after in zip([none, *blocks], blocks, [*blocks[1:], none], strict=False):
        ended = b.text.rstrip(CLOSING).endswith(tuple(END))
        yield (
            b.words, b.density, before.words, before.density, after.words, after.density,
            float(b.element), float(b.named), float(b.main), has_main, float(b.paragraph), float(ended),
        )


def labelled(page: str) -> tuple[str, list[bool]]:
    """A page of the table without its marks, and whether each of its blocks is main text."""
    lines = page.strip("\n").split("\n")
    return "\n".join(x[1:] for x in lines), [x[0] == "+" for x in lines if x[0] in "+-"]


def table(pages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of all blocks of labelled pages."""
    rows: list[tuple[float, ...]] = []
    labels: list[bool] = []
    for page in pages:
        text, own = labelled(page)
        found = list(features(blocks_of(text)))
        if len(found) != len(own):
            raise ValueError(f"{len(own)} labels for {len(found)} blocks: {text[:60]}")
        rows += found
        labels += own
    return np.array(rows, float), np.array(labels, int)


@dataclass
class Node:
    """A leaf (feature -1) says whether to keep; others send values up to the threshold left."""

    keep: bool
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def decide(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.left if row[node.feature] <= node.threshold else node.right
        return node.keep


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Node:
    """A tree by Gini impurity; ties take the first feature, then the lowest threshold, and keep in leaves."""
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= threshold
            if min(left.sum(), (~left).sum()) < least:
                continue
            score = sum(2 * y[s].mean() * (1 - y[s].mean()) * s.sum() for s in (left, ~left))
            if score < best[0] - 1e-9:
                best = (score, f, float(threshold))
    if best[1] < 0:
        return node
    _, node.feature, node.threshold = best
    left = x[:, node.feature] <= node.threshold
    node.left, node.right = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    if node.left.feature < 0 and node.right.feature < 0 and node.left.keep == node.right.keep:
        return Node(node.left.keep)
    return node


@cache
def trained(pages: tuple[str, ...] = PAGES) -> Node:
    return grow(*table(pages))


def main_text(page: str | None, tree: Node) -> str:
    """The kept blocks of a page in page order, joined by a line feed; empty if there are none."""
    blocks = blocks_of(page or "")
    return "\n".join([b.text for b, row in zip(blocks, features(blocks), strict=True) if tree.decide(row)])


def extract(df: DataFrame, html_col: str = "html", column: str = "text") -> DataFrame:
    """`df` with its HTML replaced by the column `column`, the main text.

    Null and empty pages, and pages without main text, give an empty text. Rows, repeats included, stay as they are;
    an empty table gives none. Other columns are passed on unread, except one that is called `column` (ValueError).
    """
    if column in df.columns and column != html_col:
        raise ValueError(f"column {column} is made here")
    names = [f"c{i}" for i in range(len(df.columns))]
    body = names[df.columns.index(html_col)]
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(page, tree) for page in texts_of(batch, body)], pa.string())
            yield with_columns(batch, {"made": made}, (body,))

    rows = text_batches(df).toDF(*names).withColumn(body, F.col(body).cast("string"))
    fields = [f"{n} {t}" for n, t in rows.dtypes if n != body]
    out = rows.mapInArrow(run, ", ".join([*fields, "made string"]))
    return out.toDF(*[c for n, c in zip(names, df.columns, strict=True) if n != body], column)

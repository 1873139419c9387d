"""Benchmark decontamination through suffix arrays of the training texts.

Each task fills shards with its rows' words, over as many Arrow batches as it takes, numbered by the benchmark's vocabulary: a
word that no test has ends a run, as nothing can match past it. A shard's suffixes are sorted in whole suffix order, and every
test suffix is binary-searched in it. The ranges of suffixes that begin with its window are its occurrences; the longest match of
each of these is with one of the two test suffixes beside it in the common order. Documents never move: there is no shuffle.

The benchmark is the stated query set. One of over `block_bytes` is taken in blocks, each by tasks of its own, so neither a
broadcast nor a task's memory outgrows one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .suffixes import Keys, SuffixArray, common_words, runs, suffix_order
from .textkit import lower_ascii, text_batches, texts_of, with_columns

#: Words: runs of digits, letters and anything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a window; an item of fewer is one window.
WINDOW = 8
#: Words of a shard, unless one text alone has more.
SHARD_WORDS = 1 << 20

Item = tuple[str | None, str | None]


@dataclass
class TestSet:
    """A block of benchmark items: their words as numbers from 1, a 0 behind each item, and the suffixes that begin with a window."""

    vocabulary: dict[bytes, int]
    keys: Keys
    items: list[str | None]  # ascending, null last
    start: np.ndarray  # of the suffixes, in suffix order
    item: np.ndarray  # index of each suffix's item
    at: np.ndarray  # its first word in the item, from 0
    common: np.ndarray  # words it shares with the suffix before it
    window: np.ndarray  # number of its window
    begin: np.ndarray  # for each window, its first suffix
    first: np.ndarray  # and where that stands
    length: np.ndarray  # words of each window
    owners: list[np.ndarray]  # items of each window, as indexes
    ids: np.ndarray  # index of each item's id: items that share an id are one


def compile_tests(items: list[Item]) -> TestSet:
    """Items without words are left out; items that share an id, or have none, count as one item."""
    vocabulary: dict[bytes, int] = {}
    told = sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1] or ""))
    words = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall(lower_ascii(text))] for _, text in told]
    kept = [k for k, w in enumerate(words) if w]
    begin = np.array([0, *np.cumsum([len(words[k]) + 1 for k in kept])], np.int64)
    flat = np.zeros(begin[-1], np.int64)
    for b, k in zip(begin.tolist(), kept, strict=False):
        flat[b : b + len(words[k])] = words[k]
    keys, run = Keys(flat, max(len(vocabulary), 1)), runs(flat)
    order = suffix_order(keys, run, np.flatnonzero(flat > 0))
    owner = np.searchsorted(begin, order, side="right") - 1
    at = order - begin[owner]
    least = np.minimum(WINDOW, np.diff(begin)[owner] - 1)
    fits = run[order] >= least
    order, owner, at, least = order[fits], owner[fits], at[fits], least[fits]
    common = np.append(0, common_words(keys, order[1:], keys, order[:-1])) if len(order) else np.zeros(0, np.int64)
    # Suffixes of one window are neighbours, but a short item's window may be the beginning of others: length comes first.
    new = np.ones(len(order), bool)
    by = np.lexsort([np.arange(len(order)), least])
    for n in np.unique(least).tolist():
        own = by[least[by] == n]
        low = np.minimum.reduceat(np.append(common, 0), np.stack([own[:-1] + 1, own[1:] + 1], 1).ravel())[::2] if len(own) > 1 else np.zeros(0, np.int64)
        new[own[1:]] = low < n
    window = np.zeros(len(order), np.int64)
    window[by] = new[by].cumsum() - 1
    begins = by[new[by]]
    first, length = order[begins], least[begins]
    names = [told[k][0] for k in kept]
    ids = np.array([0, *[a != b for a, b in zip(names, names[1:], strict=False)]], np.int64).cumsum() if names else np.zeros(0, np.int64)
    pairs = np.unique(window * (len(names) + 1) + ids[owner])
    owners = np.split(pairs % (len(names) + 1), np.flatnonzero(np.diff(pairs // (len(names) + 1))) + 1) if len(pairs) else []
    return TestSet(vocabulary, keys, list(dict.fromkeys(names)), order, owner, at, common, window, begins, first, length, owners, ids)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, position in it) for all positions of all ranges."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(size.cumsum() - size, size) + np.repeat(low, size)


class Shard:
    """Some rows' words in one array, a 0 behind each row, and their matches with a test set."""

    def __init__(self, rows: list[np.ndarray], tests: TestSet):
        self.tests = tests
        self.count = np.array([len(r) for r in rows], np.int64)
        self.begin = np.concatenate([[0], (self.count + 1).cumsum()[:-1]]).astype(np.int64)
        flat = np.zeros(int((self.count + 1).sum()), np.int64)
        for b, r in zip(self.begin.tolist(), rows, strict=True):
            flat[b : b + len(r)] = r
        self.array = SuffixArray(flat, int(tests.length.min()) if len(tests.length) else 1, max(len(tests.vocabulary), 1))
        self.low, self.high = self.array.ranges(tests.keys, tests.first, tests.length)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position in the shard) of every occurrence of a window, by position."""
        window, place = _expand(self.low, self.high)
        start = self.array.order[place]
        order = np.argsort(start, kind="stable")
        return window[order], start[order]

    def longest(self, window: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, words, a test suffix that matches so far) of the longest match at each position with an occurrence, ascending.

        A match must hold a window of its item: all of a short item, or WINDOW words.
        """
        tests, array = self.tests, self.array
        starts = np.unique(start)
        words, test = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        # Whole short items: the longest at a position comes last.
        short = np.flatnonzero(tests.length[window] < WINDOW)
        short = short[np.argsort(tests.length[window[short]], kind="stable")]
        at = np.searchsorted(starts, start[short])
        words[at], test[at] = tests.length[window[short]], tests.begin[window[short]]
        # Longer ones: beside the position's suffix in the common order stand the two tests that share most with it.
        live = np.flatnonzero(((self.low < self.high) & (tests.length == WINDOW))[tests.window])
        place = array.places(tests.keys, tests.start[live])
        rank = np.empty(len(array.keys.key), np.int64)
        rank[array.order] = np.arange(len(array.order))
        after = np.searchsorted(place, rank[starts], side="right")
        for side in (after - 1, after):
            inside = np.flatnonzero((side >= 0) & (side < len(live)))
            found = common_words(array.keys, starts[inside], tests.keys, tests.start[live[side[inside]]])
            better = (found >= WINDOW) & (found > words[inside])
            words[inside[better]], test[inside[better]] = found[better], live[side[inside[better]]]
        return starts, words, test

    def named(self, test: int, words: int) -> tuple[int, int]:
        """(item, its first word there) of all items whose match is as that of `test`: the first by item, then by place."""
        tests = self.tests
        if words < WINDOW:
            return int(tests.owners[tests.window[test]][0]), 0
        a, b = test, test + 1
        while a > 0 and tests.common[a] >= words:
            a -= 1
        while b < len(tests.common) and tests.common[b] >= words:
            b += 1
        return min(zip(tests.ids[tests.item[a:b]].tolist(), tests.at[a:b].tolist(), strict=True))


def numbered(text: str | None, tests: TestSet) -> np.ndarray:
    """A text's words as numbers, 0 for those that no test has."""
    found = WORD.findall(lower_ascii(text))
    known = tests.vocabulary
    return np.fromiter([known.get(w, 0) for w in found], np.int64, len(found))


def longest_matches(texts: list[str | None], tests: TestSet) -> pd.DataFrame:
    """(row, item, item_start, start, words): every longest match that can't be extended to the left, of a window at least.

    start counts the row's words from 0, item_start the item's. Of several items that match equally far the first counts.
    """
    shard = Shard([numbered(t, tests) for t in texts], tests)
    starts, words, test = shard.longest(*shard.occurrences())
    before = np.append(False, (np.diff(starts) == 1) & (words[:-1] == words[1:] + 1)) if len(starts) else np.zeros(0, bool)
    out = []
    for s, w, t in zip(starts[~before].tolist(), words[~before].tolist(), test[~before].tolist(), strict=True):
        row = int(np.searchsorted(shard.begin, s, side="right")) - 1
        item, at = shard.named(t, w)
        out.append((row, tests.items[item], at, s - int(shard.begin[row]), w))
    return pd.DataFrame(out, columns=["row", "item", "item_start", "start", "words"])


def _leaks(rows: list[np.ndarray], tests: TestSet) -> list[dict]:
    """The struct of `hits` for each row of one shard."""
    shard = Shard(rows, tests)
    window, start = shard.occurrences()
    row = np.searchsorted(shard.begin, start, side="right") - 1
    begin = start - shard.begin[row]
    cut = np.searchsorted(row, np.arange(len(rows) + 1))
    starts, words, test = shard.longest(window, start)
    own = np.searchsorted(starts, shard.begin).tolist() + [len(starts)]
    out: list[dict] = []
    for r, n in enumerate(shard.count.tolist()):
        a, b = cut[r], cut[r + 1]
        if a == b:
            out.append({"n_words": n, "spans": [], "items": [], "n_items": 0, "longest": 0, "longest_start": None, "longest_item": None, "longest_item_start": None})
            continue
        ends = np.maximum.accumulate(begin[a:b] + tests.length[window[a:b]])
        new = np.flatnonzero(np.append(True, begin[a + 1 : b] > ends[:-1]))
        spans = zip(begin[a:b][new].tolist(), ends[np.append(new[1:], b - a) - 1].tolist(), strict=True)
        items = np.unique(np.concatenate([tests.owners[w] for w in np.unique(window[a:b]).tolist()])).tolist()
        best = own[r] + int(words[own[r] : own[r + 1]].argmax())
        item, at = shard.named(int(test[best]), int(words[best]))
        out.append({
            "n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": [tests.items[i] for i in items if tests.items[i] is not None], "n_items": len(items),
            "longest": int(words[best]), "longest_start": int(starts[best] - shard.begin[r]), "longest_item": tests.items[item], "longest_item_start": at,
        })
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[Item]]:
    """The items in blocks of about `block_bytes`, ascending by id, items that share an id in one block; at least one block."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    block, size = [], 0
    for r in rows.where("t IS NOT NULL").orderBy(F.asc_nulls_last("i"), "t").toLocalIterator():
        if size >= block_bytes and block[-1][0] != r["i"]:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"].encode("utf-8", "surrogatepass"))
    yield block


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
LEAK = pa.struct([
    ("n_words", pa.int64()), ("spans", SPAN), ("items", pa.list_(pa.string())), ("n_items", pa.int64()),
    ("longest", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.string()), ("longest_item_start", pa.int64()),
])
KIND = (
    "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,n_items:long,"
    "longest:long,longest_start:long,longest_item:string,longest_item_start:long>"
)


def _search(rows: DataFrame, body: str, tests: TestSet, keep: list[str]) -> DataFrame:
    """`rows`, only the columns `keep` of them, with the column leak for one block of tests."""
    shared = rows.sparkSession.sparkContext.broadcast(tests)
    gone = tuple(c for c in rows.columns if c not in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        held: list[pa.RecordBatch] = []  # batches, the last one open
        done: list[dict] = []  # leaks of their rows so far
        words: list[np.ndarray] = []
        size = 0

        def ready() -> Iterator[pa.RecordBatch]:
            """The held batches whose rows all have their leak."""
            while held and len(done) >= held[0].num_rows:
                batch = held.pop(0)
                yield with_columns(batch, {"leak": pa.array(done[: batch.num_rows], LEAK)}, gone)
                del done[: batch.num_rows]

        for batch in batches:
            held.append(batch)
            for text in batch.column(batch.schema.get_field_index(body)):
                words.append(numbered(text.as_py(), tests))
                size += len(words[-1])
                if size >= SHARD_WORDS:
                    done += _leaks(words, tests)
                    words, size = [], 0
            yield from ready()
        if words:
            done += _leaks(words, tests)
        yield from ready()

    fields = [f"{n} {t}" for n, t in rows.dtypes if n in keep]
    return rows.mapInArrow(run, ", ".join([*fields, f"leak {KIND}"]))


def hits(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 8 << 20,
    keep_text: bool = True,
    column: str = "leak",
) -> DataFrame:
    """`df`, without its text unless `keep_text`, with one more column: struct(n_words, spans array<struct<start,end>>, items array<string>, n_items,
    longest, longest_start, longest_item, longest_item_start).

    spans are the word ranges (from 0, end exclusive, sorted, disjoint and not touching) inside any occurrence
    of a window of any item; items are the ids of those with one, sorted as strings, no id twice, and n_items counts them.
    longest is the length in words of the longest verbatim match that holds a window, longest_start the first place in the text that
    has one so long, longest_item and longest_item_start the first item and place there that it matches; 0 and nulls if there is none.
    Null and empty texts have no words; items without words match nothing; items that share an id are one, and so are all of null id,
    which n_items counts and items can't name. An empty benchmark gives no spans. Rows, repeats included, stay
    as they are, whatever the other columns are called, but for one that is called `column` (ValueError); an empty table gives none.
    """
    left = [c for c in df.columns if keep_text or c != text_col]
    if column.lower() in [c.lower() for c in left]:
        raise ValueError(f"column {column} is made here")
    # Plain names inside, whatever the columns are called.
    names = [f"c{i}" for i in range(len(df.columns))]
    body = names[df.columns.index(text_col)]
    keep = [n for n in names if keep_text or n != body]
    rows = text_batches(df).toDF(*names)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return _search(rows, body, compile_tests(block), keep).toDF(*left, column)
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = [_search(rows, body, compile_tests(block), ["row"])]
    while after is not None:
        parts.append(_search(rows, body, compile_tests(after), ["row"]))
        after = next(blocks, None)
    found = parts[0].withColumn("block", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        found = found.unionByName(part.where("leak.n_items > 0").withColumn("block", F.lit(k)))
    # Blocks ascend by id, so of equal matches the first block has the first item. At most one row a block meets here.
    best = F.max_by(F.col("leak"), F.struct("leak.longest", -F.coalesce(F.col("leak.longest_start"), F.lit(0)), -F.col("block")))
    merged = found.groupBy("row").agg(
        best.alias("b"), F.flatten(F.collect_list("leak.spans")).alias("s"), F.array_sort(F.flatten(F.collect_list("leak.items"))).alias("i"), F.sum("leak.n_items").alias("n")
    )
    span = "array<struct<start:long,end:long>>"
    joined = F.aggregate(
        F.array_sort("s"),
        F.array().cast(span),
        lambda out, s: F.when(
            (F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    fields = [F.col("b.n_words"), joined.alias("spans"), F.col("i").alias("items"), F.col("n").alias("n_items"), "b.longest", "b.longest_start", "b.longest_item", "b.longest_item_start"]
    leak = merged.select("row", F.struct(*fields).cast(KIND).alias("leak"))
    return rows.join(leak, "row").select(*keep, "leak").toDF(*left, column)


def decontaminate(df: DataFrame, benchmark: DataFrame, least_items: int = 2, **names: object) -> DataFrame:
    """The rows of `df` with windows of fewer than `least_items` items, whatever its columns are called; see `hits`."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text_col = f"c{df.columns.index(names.pop('text_col', 'text'))}"
    marked = hits(plain, benchmark, text_col=text_col, column="leak", **names)
    return marked.where(F.col("leak.n_items") < least_items).drop("leak").toDF(*df.columns)

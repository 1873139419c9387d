"""Chat conversations as training windows of a token budget.

Turns stream through a task in order, conversation by conversation: running sums of turn tokens choose
turn-aligned spans. Every window repeats the conversation's leading system turn and, up to a limit,
the turns before its span; what is repeated is outside the loss mask, so that each assistant text is
learned once. Memory holds one window's turns, however long a conversation is.

The template is  <|turn|>ROLE\\nTEXT<|end|>\\n  for each turn. In texts and roles, control strings get a
backslash behind their first character, and one more where backslashes are there already; taking one
away from each restores the text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import text_batches

#: What marks turns here or in other common templates. Fixed values.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL)
_ESCAPE, _UNESCAPE = re.compile(_FIRST), re.compile(rf"({_FIRST})\\")
TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens of a window, and of the earlier turns that a window repeats.
BUDGET, HISTORY = 1024, 256
SYSTEM, LEARNED = "system", "assistant"


def escaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def rendered(role: str, text: str) -> tuple[str, int]:
    """A turn as formatted, and where its text begins in that. Roles keep to one line."""
    one_line = role.replace("\\", "\\\\").replace("\n", "\\n")
    head = f"{TURN}{escaped(one_line)}\n"
    return head + escaped(text) + END, len(head)


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line))


class TokenCounter:
    """Counts tokens of texts by a public tiktoken rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


class Turn:
    __slots__ = ("role", "source", "text", "begin", "tokens")

    def __init__(self, role: str, source: str, count: Callable[[str], int]):
        self.role, self.source = role, source
        self.text, self.begin = rendered(role, source)
        self.tokens = count(self.text)


def windows(turns: Iterator[tuple[str, str]], count: Callable[[str], int], budget: int = BUDGET, history: int = HISTORY) -> Iterator[dict]:
    """The windows of one conversation's (role, text) turns, in order.

    Each is a dict: formatted, n_repeated (turns in front that are repeated or the retained system turn), n_new,
    n_tokens, and loss, the (start, end) code points of the new assistant texts. A new turn goes into the open window if the
    window stays within the budget; a window has one new turn at least, so a turn beyond the budget is alone and over it.
    """
    system: Turn | None = None
    past: list[Turn] = []  # the last turns, as many as history takes
    open_: list[Turn] = []
    used = 0

    front: list[Turn] = []

    def closed() -> dict:
        parts, loss, at = [], [], 0
        for i, t in enumerate([*front, *open_]):
            if i >= len(front) and t.role == LEARNED:
                loss.append((at + t.begin, at + len(t.text) - len(END)))
            parts.append(t.text)
            at += len(t.text)
        return {"formatted": "".join(parts), "n_repeated": len(front), "n_new": len(open_), "n_tokens": sum(t.tokens for t in [*front, *open_]), "loss": loss}

    first = True
    for role, text in turns:
        turn = Turn(role, text, count)
        if open_ and used + turn.tokens > budget:
            yield closed()
            past = [*past, *[t for t in open_ if t is not system]]
            sums = np.cumsum([t.tokens for t in reversed(past)])
            past = past[len(past) - int(np.searchsorted(sums, history, side="right")) :]
            kept = [system] if system else []
            room = budget - turn.tokens - sum(t.tokens for t in kept)
            sums = np.cumsum([t.tokens for t in reversed(past)])
            front = kept + past[len(past) - int(np.searchsorted(sums, room, side="right")) :]
            open_, used = [], sum(t.tokens for t in front)
        if first and role == SYSTEM:
            system = turn
        first = False
        open_.append(turn)
        used += turn.tokens
    if open_:
        yield closed()


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        out.append((role_of(role), unescaped(text)))
    return out


def _streamed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def format_windows(df: DataFrame, ranks_path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, n_new, n_tokens, loss) for `df` (conv_id, turn, role, text).

    Rows are ordered by turn, null turns first, equal turns by role, then text; repeated rows are turns of their own.
    Null roles and texts are empty; rows of null conv_id are one conversation. loss holds code points of `formatted`.
    Windows of a conversation stand in order in one partition. An empty table gives no rows; further columns are not read.

    Conversations are dealt by id and sorted on disk if need be; a task streams through its rows, so a huge
    conversation costs time in one task, but no memory.
    """
    with open(ranks_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast((file.read(), pattern))
    rows = text_batches(df).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(*shared.value)
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            conv, window, made = zip(*held, strict=True)
            field = lambda k, t: pa.array([m[k] for m in made], t)
            spans = pa.array([[{"start": a, "end": b} for a, b in m["loss"]] for m in made], loss)
            arrays = [pa.array(conv, pa.int64()), pa.array(window, pa.int64()), field("formatted", pa.string())]
            arrays += [field(k, pa.int64()) for k in ("n_repeated", "n_new", "n_tokens")]
            return pa.RecordBatch.from_arrays([*arrays, spans], ["conv_id", "window", "formatted", "n_repeated", "n_new", "n_tokens", "loss"])

        stream = _streamed(batches, ("conv_id", "role", "text"))
        row = next(stream, None)
        while row is not None:
            conv = row[0]

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[0] == conv:
                    yield row[1], row[2]
                    row = next(stream, None)

            for k, made in enumerate(windows(own(), count, budget, history)):
                held.append((conv, k, made))
                size += len(made["formatted"])
                if size > 8 << 20:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    schema = "conv_id long, window long, formatted string, n_repeated long, n_new long, n_tokens long, loss array<struct<start:long,end:long>>"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows), from the output of `format_windows` alone.

    It must get those rows as they come, without a shuffle between; digests grow as windows stream by.
    """
    import hashlib

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, state = None, None

        def finished() -> tuple:
            n, turns, chars, loss, total, k = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, k

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

        for own, text, n_repeated, spans in _streamed(batches, ("conv_id", "formatted", "n_repeated", "loss")):
            if state is None or own != conv:
                if state is not None:
                    done.append(finished())
                    if len(done) >= 10_000:
                        yield batch()
                        done = []
                conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in parsed(text)[n_repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for s in spans:
                said = unescaped(text[s["start"] : s["end"]])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
            state[5] += 1
        if state is not None:
            done.append(finished())
        if done:
            yield batch()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return formatted.select("conv_id", "formatted", "n_repeated", "loss").mapInArrow(run, schema)

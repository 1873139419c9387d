"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of the bytes before white space says so, so that passages shared
by documents give the same chunks wherever they stand. A chunk not met before is encoded once and kept, in a cache bounded in bytes
that lives as long as its task; the documents themselves never move.

Chunks encoded apart are exact only if no token reaches over their join. So every join is repaired: what stands beside it on both sides,
up to white space, is re-encoded together, and where that differs from the two parts, the chunks are put together and encoded as one,
and the join after them is judged in turn, until all that remain agree. An answer is kept for the very same two strings only.

The tokenizer's own definition may say that no token spans white space (`spans_no_space`). Then a chunk is the sum of its pieces, each of
them encoded once and kept, and a join before white space and behind none is one of pieces and needs no repair; else a chunk is encoded
whole. Pieces are given to the tokenizer many in one string, with an added token of its own between them, which ends all context.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import text_batches, texts_of, with_columns

#: White space as Unicode's property has it, which tokenizers' \\s is. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A piece: white space and what follows it, up to the next white space.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+\\Z")
SPACES = re.compile(f"[{SPACE}]")
LAST_PIECE = re.compile(f"[{SPACE}]*(?:[^{SPACE}]+|[{SPACE}]+)\\Z")
#: The rolling hash: bytes it looks at, its factor, and the bits that must be 0 at a cut (one white space in 64).
ROLL, FACTOR, MASK = 16, np.uint32(2654435761), np.uint32(63 << 20)
#: Bytes of the caches of chunks, pieces and joins in a task, about.
CHUNK_BYTES, PIECE_BYTES, JOIN_BYTES = 16 << 20, 64 << 20, 8 << 20
#: Characters of a chunk's end in which its last piece is looked for first.
TAIL = 48
#: Strings encoded at once; an encoding is much larger than its string. Strings put together into one.
AT_ONCE, JOINED = 2048, 128
#: Bytes of output that a task holds at once.
FLUSH = 8 << 20

#: Parts of tokenizers that act on each character, or on a base and its marks, and join no text to white space. Fixed values.
LOCAL_NORMALIZERS = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Nmt")
#: Split patterns none of whose matches has white space behind anything else. Fixed values.
LOCAL_SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)

Ids = bytes  # as little-endian int32


def _members(part: dict | None, key: str) -> list[dict]:
    if part is None:
        return []
    return [x for p in part[key] for x in _members(p, key)] if part["type"] == "Sequence" else [part]


def spans_no_space(spec: dict) -> bool:
    """Whether a tokenizer's definition says that no token holds white space behind anything else, so that a text's ids are those of its pieces.

    True needs: normalizers that act locally (a base and its marks; a run of white space), a pre-tokenizer whose pattern
    is known not to match across, no added token with white space in it or around it, and no template added to texts.
    Anything else is False, which costs time only.
    """
    for part in _members(spec.get("normalizer"), "normalizers"):
        runs = part["type"] == "Replace" and part["pattern"] == {"Regex": r"\s+"} and part["content"] == " "
        if part["type"] not in LOCAL_NORMALIZERS and not runs:
            return False
    parts = _members(spec.get("pre_tokenizer"), "pretokenizers")
    fine = False
    for part in parts:
        if part["type"] == "Split" and part["pattern"].get("Regex") in LOCAL_SPLITS and part["behavior"] == "Removed" and part["invert"]:
            fine = True
        elif part["type"] == "ByteLevel" and not part["add_prefix_space"]:
            fine |= part["use_regex"]
        else:
            return False
    for token in spec.get("added_tokens") or []:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or re.search(f"[{SPACE}]", token["content"]):
            return False
    return fine and spec["model"]["type"] == "BPE"


def _last_piece(chunk: str) -> str:
    found = LAST_PIECE.search(chunk[-TAIL:])
    # One that fills all of the end may begin before it.
    return found[0] if found.start() or len(chunk) <= TAIL else LAST_PIECE.search(chunk)[0]


class Recent(dict):
    """A cache of two generations: beyond half of `most` bytes the older one goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.old = most // 2, 0, {}

    def __missing__(self, key: object) -> object:
        value = self.old[key]  # KeyError: unknown
        self[key] = value
        self.size += sys.getsizeof(key) + sys.getsizeof(value) + 100
        return value

    def unknown(self, keys: set) -> set:
        return keys.difference(self, self.old)

    def keep(self, items: dict) -> None:
        self.update(items)
        self.size += sum(map(sys.getsizeof, items)) + sum(map(sys.getsizeof, items.values())) + 100 * len(items)

    def trim(self) -> None:
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0


def _packed(ids: list[int]) -> bytes:
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ChunkEncoder:
    """Encodes and decodes texts with one tokenizer; see the module."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.apart = spans_no_space(spec)
        marks = [(t["content"], t["id"]) for t in spec.get("added_tokens") or [] if not t["normalized"]]
        self.mark = marks[0] if self.apart and marks else None
        del spec
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Without a decoder, tokens are joined by a space; with one, only whole texts decode exactly.
        self.plain = self.tokenizer.decoder is None
        self.name: np.ndarray | None = None
        self.chunks, self.pieces, self.joins = Recent(CHUNK_BYTES), Recent(PIECE_BYTES), Recent(JOIN_BYTES)

    def _encode(self, texts: list[str]) -> Iterator[Ids]:
        for i in range(0, len(texts), AT_ONCE):
            some = texts[i : i + AT_ONCE]
            if self.mark:
                yield from self._joined([some[j : j + JOINED] for j in range(0, len(some), JOINED)])
            else:
                yield from self._each(some)

    def _each(self, texts: list[str]) -> Iterator[Ids]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield _packed(e.ids)

    def _joined(self, groups: list[list[str]]) -> Iterator[Ids]:
        """The ids of every text of the groups, each group encoded as one string with the mark between."""
        mark, number = self.mark
        whole = [mark.join(g) for g in groups]
        for group, text, e in zip(groups, whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<i4")
            ends = np.flatnonzero(ids == number)
            if not len(ends) == text.count(mark) == len(group) - 1:  # a text holds the mark, or makes another token with its beginning
                yield from self._each(group)
                continue
            packed = ids.tobytes()
            for a, b in zip([0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(packed)], strict=True):
                yield packed[a:b]

    def decode(self, ids: Ids) -> str:
        found = np.frombuffer(ids, "<i4")
        if not self.plain:
            return self.tokenizer.decode(found.tolist(), skip_special_tokens=False)
        if self.name is None:
            self.name = np.array([self.tokenizer.id_to_token(i) or "" for i in range(max(self.tokenizer.get_vocab().values()) + 1)], object)
        return " ".join(self.name[found].tolist())

    def _cut(self, text: str) -> list[str]:
        data = text.encode("utf-8", "surrogatepass")
        a = np.frombuffer(data, np.uint8)
        if len(a) <= 64:
            return [text] if text else []
        h, factor, span = a.astype(np.uint32), FACTOR, 1
        with np.errstate(over="ignore"):
            while span < ROLL:
                h[span:] += factor * h[:-span]
                factor, span = factor * factor, span * 2
        space = np.flatnonzero((a[1:] == 32) | ((a[1:] >= 9) & (a[1:] <= 13))) + 1
        cuts = space[(h[space - 1] & MASK == 0) & (a[space - 1] > 32)].tolist()
        ends = [*cuts, len(data)]
        return [data[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *cuts], ends, strict=True) if j > i]

    def _whole(self, texts: list[str]) -> dict[str, Ids]:
        return dict(zip(texts, self._encode(texts), strict=True))

    def _known(self, chunks: set[str]) -> None:
        """Encode those of the chunks that aren't kept."""
        new = self.chunks.unknown(chunks)
        if not self.apart:
            self.chunks.keep(self._whole(list(new)))
            return
        cut = {c: PIECE.findall(c) for c in new}
        self._pieces(set().union(*cut.values()))
        piece = self.pieces
        self.chunks.keep({c: b"".join(map(piece.__getitem__, ps)) for c, ps in cut.items()})

    def _pieces(self, wanted: set[str]) -> None:
        """Encode those of the pieces that aren't kept."""
        new = list(self.pieces.unknown(wanted))
        if new:
            self.pieces.keep(self._whole(new))

    def _repaired(self, cut: list[list[str]]) -> list[list[str]]:
        """The texts' chunks, those beside a join that doesn't agree put together."""

        def beside(a: str, b: str) -> tuple[str, str] | None:
            """What is re-encoded together; None where a piece ends anyway."""
            return None if self.apart and not SPACES.match(a[-1]) else (_last_piece(a), PIECE.match(b)[0])

        sides = [[beside(a, b) for a, b in zip(chunks, chunks[1:], strict=False)] for chunks in cut]
        new = list(self.joins.unknown({x for pairs in sides for x in pairs if x}))
        self._pieces({s for x in new for s in x})
        piece, both = self.pieces, self._encode([a + b for a, b in new])
        self.joins.keep({x: piece[x[0]] + piece[x[1]] == ids for x, ids in zip(new, both, strict=True)})
        agrees = self.joins
        out = []
        for chunks, pairs in zip(cut, sides, strict=True):
            made = chunks[:1]
            for chunk, pair in zip(chunks[1:], pairs, strict=True):
                if not pair or agrees[pair]:
                    made.append(chunk)
                else:
                    made[-1] += chunk
            out.append(made)
        return out

    def encode(self, texts: list[str]) -> list[Ids]:
        cut = self._repaired([self._cut(t) for t in texts])
        self._known(set().union(*cut))
        chunk = self.chunks
        out = [b"".join([chunk[c] for c in chunks]) for chunks in cut]
        for cache in (self.pieces, self.chunks, self.joins):
            cache.trim()
        return out


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker stays when its task is over."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep_text: bool = False, decode: bool = True) -> DataFrame:
    """`df` with n_tokens long, ids array<int> and, if `decode`, decoded string, without its text unless `keep_text`.

    ids are those of the tokenizer over the whole text without special tokens added; decoded is what it makes of
    them, special tokens kept. Null is as empty: no ids, an empty decoded text. Rows, repeats included, stay as
    they are; an empty table gives none. A column of `df` that is called as one made here, in whatever case, must be renamed first
    (ValueError). The tokenizer's file is read on the driver and broadcast.
    """
    added = ("n_tokens", "ids", "decoded") if decode else ("n_tokens", "ids")
    if clash := set(added) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    names = [f"c{i}" for i in range(len(df.columns))]
    body = names[df.columns.index(text_col)]
    gone = () if keep_text else (body,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ChunkEncoder | None = None

        def made(rows: pa.RecordBatch) -> pa.RecordBatch:
            parts = own.encode([t or "" for t in texts_of(rows, body)])
            counts = np.array([len(ids) // 4 for ids in parts], np.int64)
            offsets = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
            values = np.frombuffer(b"".join(parts), "<i4")
            columns = {"n_tokens": pa.array(counts), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}
            if decode:
                columns["decoded"] = pa.array(map(own.decode, parts), pa.string())
            return with_columns(rows, columns, gone)

        try:
            for batch in batches:
                own = own or ChunkEncoder(shared.value)
                first, size = 0, 0
                for i, text in enumerate(batch.column(batch.schema.get_field_index(body))):
                    size += 4 * (text.as_buffer().size if text.is_valid else 0)
                    if size >= FLUSH:
                        yield made(batch.slice(first, i + 1 - first))
                        first, size = i + 1, 0
                if first < batch.num_rows:
                    yield made(batch.slice(first))
        finally:
            own = None
            _give_back()

    fields = [f"{n} {t}" for n, (_, t) in zip(names, df.dtypes, strict=True) if n not in gone]
    schema = ", ".join([*fields, "n_tokens long", "ids array<int>", *["decoded string"] * decode])
    out = text_batches(df).toDF(*names).mapInArrow(run, schema)
    return out.toDF(*[c for n, c in zip(names, df.columns, strict=True) if n not in gone], *added)

"""Byte-level BPE: encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import count, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.llm import words as W
from vecclimb.llm.memo import Memo
from vecclimb.session import ship

#: Pieces of either part of the memo, and pairs of tokens that are kept.
MEMO, PAIRS = 130_000, 150_000
#: Bytes of texts that are encoded, or decoded, at once; a longer text is taken by itself.
SLICE_BYTES = 4 << 20
#: What no token holds: it parts the pieces of a pass of the automaton.
_GAP = "\u0100"
_LOADED: dict[tuple[str, str], "BytePairs"] = {}
_UNLIKE: dict[str, dict[str, list[tuple[int, int]]]] = {}


def classes_unlike(pattern: str) -> dict[str, list[tuple[int, int]]]:
    """The properties \\p{..} of pattern that tiktoken takes otherwise than the installed regex, each with the
    code points that only one of them has, as ranges; empty where both know the same Unicode.

    Both are asked about all code points, so the answer follows the installed versions.
    """
    if pattern not in _UNLIKE:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        found = {}
        for name in sorted(set(regex.findall(r"\\p\{\w+\}", pattern))):
            probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            codes = sorted(map(ord, set(bytes(probe.encode_ordinary(every)).decode()) ^ set(regex.findall(name, every))))
            runs = [list(run) for _, run in groupby(codes, lambda c, n=count(): c - next(n))]
            if runs:
                found[name] = [(r[0], r[-1]) for r in runs]
        _UNLIKE[pattern] = found
    return _UNLIKE[pattern]


class BytePairs:
    """A vocabulary of byte strings, whose ids are the ranks of their merges; single bytes come first."""

    def __init__(self, path: str, pattern: str, unlike: dict[str, list[tuple[int, int]]]):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        if [self.ranks[t] for t in self.tokens] != list(range(len(self.tokens))) or {len(t) for t in self.tokens[:256]} != {1}:
            raise ValueError("ranks must be gapless and begin with the 256 bytes")
        # \s of the rank files' pattern is the Unicode property, without the separators U+001C..U+001F
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(pattern)
        # texts with code points that the library takes otherwise are split by its classes; they are rare
        self.odd = np.zeros(0x110000, bool)
        for name, ranges in unlike.items():
            pattern = pattern.replace(name, f"[{name}~~[{''.join(rf'\U{a:08x}-\U{b:08x}' for a, b in ranges)}]]")
            for a, b in ranges:
                self.odd[a : b + 1] = True
        self.exact = regex.compile(pattern, regex.V1)
        self.sizes = [len(t) for t in self.tokens]
        self.fits: dict[int, bool] = {}
        self._split()
        # a token that merging never makes of its own bytes occurs as a whole piece only
        self.automaton = ahocorasick.Automaton()
        for token in (t for t in range(len(self.tokens)) if self.left[t] >= 0):
            self.automaton.add_word(self.tokens[token].decode("latin-1"), token)
        self.automaton.make_automaton()
        self._prefixes()
        self.sizes_of, self.spelled = np.array(self.sizes, np.int64), np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts_of = np.cumsum(self.sizes_of) - self.sizes_of
        self.memo = Memo(MEMO)

    @classmethod
    def load(cls, path: str, pattern: str, unlike: dict[str, list[tuple[int, int]]]) -> "BytePairs":
        """One per Python worker."""
        key = path, pattern
        if key not in _LOADED:
            _LOADED[key] = cls(path, pattern, unlike)
        return _LOADED[key]

    def _split(self) -> None:
        """left and right: the two tokens that each token's last merge joins; -1 if merging its bytes gives others.

        In the order of ranks: the two are tokens of lower rank that stay apart until all lower merges are done.
        """
        n = len(self.tokens)
        self.left, self.right = [-1] * n, [-1] * n
        self.joined: dict[int, int] = {}
        for token, data in enumerate(self.tokens):
            if len(data) == 1:
                self.left[token] = self.right[token] = token
                continue
            for i in range(1, len(data)):
                a, b = self.ranks.get(data[:i], n), self.ranks.get(data[i:], n)
                if a < token and b < token and self.left[a] >= 0 and self.left[b] >= 0 and self.compatible(a, b):
                    self.left[token], self.right[token] = a, b
                    self.joined[a << 32 | b] = token
                    break

    def _prefixes(self) -> None:
        """shorter: the longest token that is a proper prefix of each token; -1 if there is none."""
        self.shorter = [-1] * len(self.tokens)
        for token, data in enumerate(self.tokens):
            for n in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:n], -1)
                if rank >= 0 and self.left[rank] >= 0:
                    self.shorter[token] = rank
                    break

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, the leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) << 1), i) for i in range(len(parts) - 1))
            if parts[i] + parts[i + 1] not in self.ranks:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of the two tokens gives just these two.

        Merges are undone along the touching edge, the latest first, which is that of the higher rank, of equals
        the right one. Before each lies a pair of neighbours; if that pair joins at a lower rank than the merge
        undone (or at the same, further left), it would have been joined instead.
        """
        limit = len(self.tokens)
        left, right, joined = self.left, self.right, self.joined
        while True:
            if joined.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                if a < 256:
                    return True
                limit, a = a, right[a]
            else:
                if b < 256:
                    return True
                limit, b = b + 1, left[b]

    def _backtrack(self, text: str, longest: array, start: int, stop: int) -> list[int]:
        """Tokens from start to stop. A sequence is the merges' result if all neighbours are compatible.

        From the longest token at each place, go on; where no token fits, mark the place as dead and
        go back. Every place dies once at most, so the work is linear in the piece.
        """
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        out: list[int] = []
        dead: set[int] = set()
        at, before, token = start, -1, longest[start]
        while True:
            if token < 0:  # no token fits here
                dead.add(at)
                token = out.pop()
                before = out[-1] if out else -1
                at -= sizes[token]
                token = shorter[token]
                continue
            if before >= 0:
                good = fits.get(before << 32 | token)
                if good is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    good = fits[before << 32 | token] = self.compatible(before, token)
                if not good:
                    token = shorter[token]
                    continue
            end = at + sizes[token]
            if end in dead:
                token = shorter[token]
                continue
            out.append(token)
            if end == stop:
                return out
            at, before, token = end, token, longest[end]
            if token < 0:  # not a place of the pass
                token = longest[at] = next(self.automaton.iter_long(text[at:stop]))[1]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[array, list[int]]:
        """(tokens of all pieces, one after the other; how many each has).

        One pass of the automaton over all gives the longest token at each place that longest tokens from the
        left come to; other places ask it when backtracking comes to them.
        """
        sizes, ranks = self.sizes, self.ranks
        whole = list(map(ranks.get, pieces))
        text = _GAP.join([p.decode("latin-1") for p, token in zip(pieces, whole) if token is None])
        longest = array("i", [-1]) * len(text)
        for end, token in self.automaton.iter_long(text):
            longest[end + 1 - sizes[token]] = token
        tokens, counts = array("i"), []
        start = 0
        for piece, token in zip(pieces, whole):
            if token is not None:
                tokens.append(token)
                counts.append(1)
            else:
                found = self._backtrack(text, longest, start, start + len(piece)) if piece else []
                tokens.extend(found)
                counts.append(len(found))
                start += len(piece) + 1
        return tokens, counts

    def split(self, texts: list[str]) -> list[list[str]]:
        """The matches of the pattern in each text, as tiktoken finds them."""
        is_odd = lambda t: self.odd[np.frombuffer(t.encode("utf-32-le"), "<u4")].any()
        out = list(map(self.pieces.findall, texts))
        if is_odd("".join(texts)):
            out = [self.exact.findall(t) if is_odd(t) else found for t, found in zip(texts, out)]
        return out

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as little-endian 32-bit numbers."""
        pieces = self.split(parts)
        tokens, counts = self.encode_pieces([p.encode() for found in pieces for p in found])
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(counts, np.int64))])[np.cumsum([0, *map(len, pieces)])] * 4
        data, ends = tokens.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts that offsets bounds in data, one after the other; their places at the bounds).

        A piece never goes on past a blank between two words, nor does the pattern look further; so equal parts
        between such blanks have equal ids, and only different ones are looked at.
        """
        parts = W.parts(data, offsets, W.cuts_before_words)
        known = self.memo.values(parts.distinct, self._encoded)
        return parts.joined([known[p] for p in parts.distinct], "<i4")

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, one after the other; their places at the bounds of the ids)."""
        sizes = self.sizes_of[ids]
        places = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[bounds]
        return self.spelled[W.ranges(self.starts_of[ids], sizes)], places


def _binary(data: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(doc_id, keep..., ids array<int>) of every whole text: each match of pattern by itself, no special tokens.

    With decoded, the ids are decoded at once, as decode() does in a pass of its own: decoded binary.

    Null and empty texts have no ids. Rows stay as they are: repeated rows are encoded each, null
    ids are passed on, further columns are ignored unless kept, an empty table gives an empty result. A
    text of any length is one row; memory follows the longest text and a slice of texts.
    """
    ship(docs.sparkSession)
    extra = ["ids", "decoded"] if decoded else ["ids"]
    unlike = classes_unlike(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs.load(path, pattern, unlike)
        for batch in batches:
            data, offsets = W.buffers(batch.column(0))
            for low, high in W.slices(offsets, SLICE_BYTES):
                ids, bounds = coder.encode_texts(data, offsets[low : high + 1])
                out = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if decoded:
                    out.append(_binary(*coder.decode(ids, bounds)))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[1:], *out], names=[*batch.schema.names[1:], *extra])

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *keep)
    fields = StructType.fromDDL("ids array<int>, decoded binary").fields[: len(extra)]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *fields]))


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., ids, decoded binary) of the ids of every row; null ids decode to no bytes."""
    ship(encoded.sparkSession)
    unlike = classes_unlike(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs.load(path, pattern, unlike)
        for batch in batches:
            ids = batch.column("ids")
            offsets, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
            for low, high in W.slices(offsets, SLICE_BYTES >> 2):
                at = offsets[low : high + 1]
                out = _binary(*coder.decode(flat[at[0] : at[-1]], at - at[0]))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, out], names=[*batch.schema.names, "decoded"])

    rows = encoded.select("doc_id", *keep, F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("decoded binary").fields]))

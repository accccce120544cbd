"""Words and word hashes of whole texts, computed for many texts at once with numpy.

Texts come as Arrow string arrays. ASCII A-Z is lower-cased; a word is a maximal run of word bytes
inside one text. Work proceeds in slices of a few MB, so that memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]

#: Bytes that are not ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII digits, ASCII letters and every byte of a non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0..n-1 modulo 2 ** 64."""
    known = _POWERS.get(factor)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES)
        known = np.full(size, factor, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 8 * SLICE_BYTES:
            _POWERS[factor] = known
    return known[:n]


@dataclass
class Words:
    """The words of consecutive texts: text k has the words bounds[k]..bounds[k+1]."""

    data: np.ndarray  # bytes of the slice
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # past its last byte
    hashes: np.ndarray
    bounds: np.ndarray

    def word(self, i: int) -> bytes:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; a longer text is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """The words of the texts that offsets bounds in data."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * _powers(_FACTOR, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def each(texts: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) for slices of texts."""
    data, offsets = buffers(texts)
    for low, high in slices(offsets):
        yield low, split(data, offsets[low : high + 1], is_word)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the i-th begins at word i."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(out)]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def cuts_before_words(data: np.ndarray) -> np.ndarray:
    """Places of blanks between two characters that are surely no white space.

    Bytes that begin a character which may be Unicode white space count as if they did.
    """
    plain = (data > 32) & (data < 127) | (data >= 0xC3) & ~((data >= 0xE1) & (data <= 0xE3))
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before = np.where(data[at - 1] < 128, plain[at - 1], (data[at - 2] != 0xC2) & ((at < 3) | (data[at - 3] < 0xE1) | (data[at - 3] > 0xE3)))
    return at[before & plain[at + 1]]


@dataclass
class Parts:
    """Parts of consecutive texts: text k has the parts bounds[k]..bounds[k+1], by their numbers in distinct."""

    distinct: list[str]
    numbers: np.ndarray
    bounds: np.ndarray

    def joined(self, values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """(values of all parts, one after the other; their places at the bounds), for the value of each distinct part."""
        counts = np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize
        starts, counts = (np.cumsum(counts) - counts)[self.numbers], counts[self.numbers]
        flat = np.frombuffer(b"".join(values), kind)
        return flat[ranges(starts, counts)], np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])[self.bounds]


def parts(data: np.ndarray, offsets: np.ndarray, cuts) -> Parts:
    """The texts that offsets bounds in data, cut before the places that cuts(data) gives; equal parts have one number."""
    data = np.ascontiguousarray(data[offsets[0] : offsets[-1]])
    offsets = offsets - offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[cuts(data)] = True
    at = np.flatnonzero(edge)
    held = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
    return Parts(held.dictionary.to_pylist(), held.indices.to_numpy(), np.searchsorted(at, offsets))

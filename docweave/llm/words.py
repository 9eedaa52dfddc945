"""Words, lines and hashes of whole batches of texts, worked out on their UTF-8 bytes with numpy.

A word is a maximal run of characters other than the blank and tab to carriage return; as those are
ASCII, words of bytes are words of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text worked on at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) * np.uint64(0xD1B54A32D192ED03) + np.arange(1, n + 1, dtype=np.uint64) * _GOLD)


def _ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order``, and the numbers in it."""
    n = len(values)
    if n < 2:
        return np.zeros(n, np.int64), values
    signed, values = values.dtype, values.astype(np.uint64, copy=False)
    bits = np.uint64((n - 1).bit_length())
    fits = int(values.max()).bit_length() + int(bits) <= 64
    packed = (values if fits else values >> bits) << bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    packed >>= bits
    if fits:
        return at, packed.astype(signed, copy=False)
    found = values[at]
    same = packed[1:] == packed[:-1]  # numbers that may differ in their low bits
    if (same & (found[1:] != found[:-1])).any():
        run = np.zeros(n, bool)
        run[1:] |= same
        run[:-1] |= same
        tied = at[run]
        at[run] = tied[np.lexsort((tied, values[tied]))]
        found = values[at]
    return at, found.astype(signed, copy=False)


def order(values: np.ndarray) -> np.ndarray:
    """What a stable ``argsort`` of 64-bit numbers (none negative) gives, from a plain sort, which is far faster: of the
    numbers, or as many of their leading bits as there is room for, with the places in the low bits."""
    return _ordered(values)[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """``np.unique`` of numbers that hardly repeat: sorted, where numpy would hash them first."""
    out = np.sort(values)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` of 64-bit numbers (none negative) with the first place of each, and for each place its number."""
    at, found = _ordered(values)
    new = np.ones(len(at), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    of = np.empty(len(at), np.int64)
    of[at] = np.cumsum(new) - 1
    return found[new], at[new], of


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = stream(11, 256)
_BYTE_LOWER = _BYTE[LOWER]
_P = np.uint64(0x2545F4914F6CDD1D)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Texts:
    """A few texts as one run of bytes; ``offsets`` are where each begins, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self, blank: np.ndarray = BLANK) -> None:
        """``starts`` and ``ends`` of all words, and ``bounds``: each text's first word, and the end."""
        inside = ~blank[self.data]
        begin, end = inside.copy(), inside.copy()
        if len(inside):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cuts = self.offsets[:-1][np.diff(self.offsets) > 0]
            begin[cuts] = inside[cuts]
            end[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
        self.inside = inside
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def prefix(self, lower: bool) -> np.ndarray:
        """Running sums from which the hash of any slice is read."""
        up, _ = _power(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[: len(self.data)], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = _power(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)

    def text_of(self, counts: np.ndarray) -> np.ndarray:
        """Index of the text for each of ``counts`` items of every text."""
        return np.repeat(np.arange(self.n), counts)


def slices(column: pa.Array, limit: int = PIECE) -> Iterator[Texts]:
    """The texts of an Arrow column in runs of about ``limit`` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


_WEIGHTS = stream(17, 64) | np.uint64(1)


def windows(texts: Texts, size: int, lower: bool, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, text after text, and each text's first one (and the end).

    With ``whole_if_short`` a text of fewer words has one hash, of its whole sequence.
    """
    h = texts.hashes(texts.prefix(lower), texts.starts, texts.ends)
    counts = np.diff(texts.bounds)
    found = np.maximum(counts - size + 1, 0)
    at = np.repeat(texts.bounds[:-1], found) + _ranks(found)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out += h[at + k] * _WEIGHTS[k]
    out = mix(out)
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            value = counts[short].astype(np.uint64) * _GOLD
            for k in range(size - 1):
                there = np.minimum(texts.bounds[short] + k, len(h) - 1)
                value += np.where(counts[short] > k, h[there] * _WEIGHTS[k], np.uint64(0))
            place = np.concatenate([[0], np.cumsum(found)])[short]
            out = np.insert(out, place, mix(value))
            found[short] = 1
    return out, np.concatenate([[0], np.cumsum(found)])


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each of ``counts`` items of every text."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


ranks = _ranks


def same_within(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks values that occur twice or more in their text."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    keys = mix(values + owner * _GOLD)
    place = order(keys)
    ordered = keys[place]
    twice = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = ordered[1:] == ordered[:-1]
        twice[place[1:][equal]] = True
        twice[place[:-1][equal]] = True
    return twice

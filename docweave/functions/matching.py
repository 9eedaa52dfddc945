"""The given entity patterns on batches of texts, by Python's ``re`` itself.

The texts of a batch are joined by a sign that no given pattern takes in, so a match never reaches from one text
into the next and offsets of the joined text tell the text. What a match has to begin with is looked for first, in
the whole batch at once: runs of digits and what stands beside them, by array operations; words and signs, by plain
search. Only there the expression itself is tried, from left to right and never inside the match before, so
the matches are those of ``re.finditer``. Expressions of a caller's own have no such signs and are not for this module.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SEPARATOR = "\0"
SLICE = 1 << 20  # characters that are looked at together
DIGIT, WORD, SPACE, IN_PHONE = 1, 2, 4, 8  # bits of what a character is
_CLASSES = {DIGIT: r"\d", WORD: r"\w", SPACE: r"\s", IN_PHONE: r"[-+.()]"}
LOCAL = "[A-Za-z0-9._%+-]"  # what stands before the @ of an address


@cache
def _facts(ascii_only: bool) -> np.ndarray:
    """Bits of every character."""
    every = "".join(map(chr, range(128 if ascii_only else 0xD800)))
    if not ascii_only:  # surrogates are no characters
        every += "\0" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    out = np.zeros(len(every), np.uint8)
    for bit, kind in _CLASSES.items():
        for m in re.finditer(f"(?:{kind})+", every):
            out[m.start() : m.end()] |= bit
    return out


def _ends(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the runs of a mask that is false at both its ends."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edges[::2], edges[1::2]


class Batch:
    """Some texts as one, and what is found out about them when first asked for."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        self.text = SEPARATOR + SEPARATOR.join(texts) + SEPARATOR * 2
        self._runs = self._low = None

    def runs(self):
        """``(points, facts, begin, end, fresh)``: every run of digits, and whether no word goes on in it."""
        if self._runs is None:
            plain = self.text.isascii()
            points = np.frombuffer(self.text.encode("ascii" if plain else "utf-32-le"), np.uint8 if plain else np.uint32)
            facts = _facts(plain)[points]
            begin, end = _ends(facts & DIGIT != 0)
            self._runs = points, facts, begin, end, facts[begin - 1] & WORD == 0
        return self._runs

    def low(self) -> str:
        """In lower case, sign for sign, with the letters that equal an ASCII letter only when case is ignored."""
        if self._low is None:
            text = self.text
            if not text.isascii():
                for odd, letter in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
                    text = text.replace(odd, letter)
            self._low = text.lower()
        return self._low

    def places(self, word: str, text: str | None = None) -> list[int]:
        """Where a word stands."""
        text = self.text if text is None else text
        out, at = [], text.find(word)
        while at >= 0:
            out.append(at)
            at = text.find(word, at + 1)
        return out

    def words(self, *words: str) -> list[int]:
        """Where one of some lower-cased words stands, whatever its case."""
        out = [at for w in words for at in self.places(w, self.low())]
        return sorted(out) if len(words) > 1 else out


def _numbers(wanted: Callable[..., np.ndarray]) -> Callable[[Batch], list[int]]:
    """Runs of digits of a length that have the right sign behind them and no word before."""

    def run(batch: Batch) -> list[int]:
        points, _, begin, end, fresh = batch.runs()
        after = points[end]
        return begin[fresh & wanted(end - begin, lambda signs: np.isin(after, [ord(s) for s in signs]), batch)].tolist()

    return run


def _cards(size, followed, batch: Batch) -> np.ndarray:
    _, facts, _, end, _ = batch.runs()
    parted = followed("-") | (facts[end] & SPACE != 0)
    return (size == 16) | (np.isin(size, [4, 8, 12]) & parted)


def _percentages(batch: Batch) -> list[int]:
    points, _, begin, end, _ = batch.runs()
    if not len(begin):
        return []
    whole = points[end] == ord("%")
    parted = points[end] == ord(".")
    more = np.append((begin[1:] == end[:-1] + 1) & whole[1:], False)
    return begin[whole | (parted & (more | (points[end + 1] == ord("%"))))].tolist()


def _urls(batch: Batch) -> list[int]:
    return [at - back for at in batch.places("://") for back in (5, 4) if at > back]


Matches = Iterator[re.Match]


def _at(find: Callable[[Batch], list[int]]) -> Callable[[re.Pattern, Batch], Matches]:
    """Matches that begin at places known beforehand."""

    def run(pattern: re.Pattern, batch: Batch) -> Matches:
        last, text, match = 0, batch.text, pattern.match
        for at in find(batch):
            if at >= last:
                m = match(text, at)
                if m:
                    last = m.end()
                    yield m

    return run


def _phones(pattern: re.Pattern, batch: Batch) -> Matches:
    """A number lies in one run of the signs it may have; of digits it has ten."""
    _, facts, *_ = batch.runs()
    begin, end = _ends(facts & (DIGIT | SPACE | IN_PHONE) != 0)
    digits = np.cumsum(facts & DIGIT, dtype=np.int64)  # the digit's bit is 1; no run begins at 0
    enough = digits[end - 1] - digits[begin - 1] >= 10
    for a, b in zip(begin[enough].tolist(), end[enough].tolist()):
        yield from pattern.finditer(batch.text, a, b)


def _emails(pattern: re.Pattern, batch: Batch) -> Matches:
    """What is before the @ ends there, and what follows does not depend on where it begins: one trial for each @."""
    last, text = 0, batch.text
    back, first = _before_at(), _first_of_word()
    mirrored = None
    for at in batch.places("@"):
        if mirrored is None:
            mirrored = text[::-1]
        low = max(last, at - (back.match(mirrored, len(text) - at).end() - (len(text) - at)))
        begin = first.search(text, low, at)
        m = begin and pattern.match(text, begin.start())
        if m:
            last = m.end()
            yield m


@cache
def _before_at() -> re.Pattern:
    return re.compile(f"{LOCAL}*", re.IGNORECASE)


@cache
def _first_of_word() -> re.Pattern:
    return re.compile(rf"\b{LOCAL}", re.IGNORECASE)


def _signs(pattern: re.Pattern, batch: Batch) -> Matches:
    """The expression begins with a sign that ``re`` looks for by itself."""
    return pattern.finditer(batch.text)


FINDERS: dict[str, Callable[[re.Pattern, Batch], Matches]] = {
    "email": _emails,
    "phone": _phones,
    "ssn": _at(_numbers(lambda size, followed, _: (size == 3) & followed("-"))),
    "credit_card": _at(_numbers(_cards)),
    "date": _at(_numbers(lambda size, followed, _: np.isin(size, [1, 2, 4]) & followed("/-"))),
    "currency": _signs,
    "percentage": _at(_percentages),
    "zip_code": _at(_numbers(lambda size, *_: size == 5)),
    "url": _at(_urls),
    "ip_address": _at(_numbers(lambda size, followed, _: (size <= 3) & followed("."))),
    "invoice_number": _at(lambda b: b.words("inv")),
    "po_number": _at(lambda b: b.words("purchase order", "po")),
    "tax_id": _at(lambda b: b.words("tax id", "ein")),
    "account_number": _at(lambda b: b.words("account", "acct")),
    "routing_number": _at(lambda b: b.words("routing", "aba")),
    "total_amount": _at(lambda b: b.words("total", "amount due")),
    "subtotal": _at(lambda b: b.words("subtotal")),
    "tax_amount": _at(lambda b: b.words("tax", "vat")),
    "discount": _at(lambda b: b.words("discount")),
}


def _slices(column: pa.Array) -> Iterator[tuple[int, Batch]]:
    """Texts that are there, in slices of bounded size, each with the place of its first one; null texts are empty."""
    texts = [t or "" for t in column.to_pylist()]
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, Batch(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if size:
        yield first, Batch(texts[first:])


def _of(batch: Batch, places: list[int]) -> np.ndarray:
    return np.searchsorted(batch.starts, np.array(places, np.int64), "right") - 1


def entities(column: pa.Array, patterns: dict[str, re.Pattern], group: int | None, confidence: float, method: str) -> pa.Array:
    """For each text its matches, pattern by pattern: type, text, offsets, value, confidence, method."""
    kind, row, start, end, shown, value = [], [], [], [], [], []
    for first, batch in _slices(column):
        slices = []
        for number, (name, pattern) in enumerate(patterns.items()):
            found = list(FINDERS[name](pattern, batch))
            if found:
                slices.append((number, found))
        matches = [m for _, found in slices for m in found]
        begin = [m.start() for m in matches]
        at = _of(batch, begin)
        order = np.argsort(at, kind="stable")
        shift = batch.starts[at]
        kind.append(np.repeat([n for n, _ in slices], [len(f) for _, f in slices]).astype(np.int32)[order])
        row.append(at[order] + first)
        start.append((np.array(begin, np.int64) - shift)[order])
        end.append((np.array([m.end() for m in matches], np.int64) - shift)[order])
        shown.append(pa.array([m[0] for m in matches], pa.string()).take(pa.array(order)))
        if group:
            value.append(pa.array([m[group] for m in matches], pa.string()).take(pa.array(order)))
    n = sum(map(len, row))
    joined = lambda parts, type_: pa.array(np.concatenate(parts).astype(type_) if parts else np.zeros(0, type_))
    held = np.bincount(np.concatenate(row), minlength=len(column)) if n else np.zeros(len(column), np.int64)
    strings = lambda parts: pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    fields = {
        "entity_type": pa.array(list(patterns), pa.string()).take(joined(kind, np.int32)),
        "text": strings(shown),
        "start": joined(start, np.int32),
        "end": joined(end, np.int32),
        "value": strings(value) if group else pa.nulls(n, pa.string()),
        "confidence": pa.array(np.full(n, confidence)),
        "method": pa.array([method], pa.string()).take(pa.array(np.zeros(n, np.int32))),
    }
    offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def counts(column: pa.Array, patterns: dict[str, re.Pattern]) -> pa.Array:
    """For each text the number of matches of every pattern that has any."""
    total = np.zeros((len(column), len(patterns)), np.int64)
    for first, batch in _slices(column):
        for number, (name, pattern) in enumerate(patterns.items()):
            found = [m.start() for m in FINDERS[name](pattern, batch)]
            if found:
                np.add.at(total, (_of(batch, found) + first, number), 1)
    row, kind = np.nonzero(total)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]).astype(np.int32)
    names = pa.array(list(patterns), pa.string()).take(pa.array(kind))
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([names, pa.array(total[row, kind])], ["entity_type", "entities"])
    )

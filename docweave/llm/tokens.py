"""Whole texts to token ids with the tokenizers library, each distinct word being encoded once a worker.

A tokeniser's own normaliser and splitter decide what a word becomes; they never look beyond a word when
words are parted by single blanks and line ends, which is checked for every text. All other texts, and
tokenisers of other kinds, are encoded as a whole. The memory holds ``WORDS`` words and as many older ones, and
``PIECES`` pieces of them: most words are one piece, which would lie there twice.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

WORDS, PIECES = 500_000, 60_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = "\u024f"  # up to here a letter's lower case and composed form don't depend on its neighbours


_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]  # all that part words but the blank
_ASCII_BLANKS = [c for c in _BLANKS if c.isascii()]


def single_blanks(text: str) -> bool:
    """Whether words are parted by one blank each, and by nothing else; told without cutting the text."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any([c in text for c in (_ASCII_BLANKS if text.isascii() else _BLANKS)])


def _byte_signs() -> dict[int, int]:
    """The printable sign that byte-level tokenisers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_BYTES = _byte_signs()
#: Signs of the UTF-8 bytes of every character up to the lower case of ``_LATIN``'s.
_SIGNS = {c: chr(c).encode("utf-8").decode("latin-1").translate(_BYTES) for c in range(0x3000)}
_is_latin = re.compile(f"[\\0-{_LATIN}]*").fullmatch


def find(name: str) -> str:
    """Place of a public tokeniser's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory(dict):
    """Encodes what it doesn't hold yet. When full it starts anew, but takes over what is met again."""

    __slots__ = ("encode", "old", "size")

    def __init__(self, encode, size: int = WORDS):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self.encode(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """``encode`` gives a text's ids as bytes, four to an id, little-endian."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        splitter, normaliser, model = made.get("pre_tokenizer") or {}, made.get("normalizer"), made["model"]
        self.model = self.whole.model
        self.pieces = _Memory(self._piece(), PIECES)
        plain = model["type"] == "BPE" and not model.get("dropout")
        self.kind = "text"
        if plain and normaliser is None and splitter.get("type") == "ByteLevel" and not splitter["add_prefix_space"] and splitter["use_regex"]:
            self.kind = "bytes"
            self.first, self.next = _Memory(self._word("")), _Memory(self._word("Ġ"))
            self.line_end = self._parts("\n")
        elif plain and [x.get("type") for x in (normaliser or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            x.get("type") for x in splitter.get("pretokenizers", [])
        ] == ["Split", "ByteLevel"]:
            self.kind = "words"
            self.first = _Memory(self._word(""))

    def _piece(self):
        tokenize = self.model.tokenize
        return lambda piece: array("I", [x.id for x in tokenize(piece)]).tobytes()

    def _word(self, mark: str):
        """What encodes a word after ``mark``. Latin letters and a tail of ASCII marks are one piece each."""
        pieces, lower, parts = self.pieces, self.kind == "words", self._parts
        before = " " if mark else ""

        def encode(word: str) -> bytes:
            core = word.rstrip(_MARKS)
            if not core.isalpha():
                return parts(before + word)
            known = core.lower() if lower else core
            if not core.isascii():
                if not _is_latin(core):
                    return parts(before + word)
                known = known.translate(_SIGNS)
            out = pieces[mark + known]
            return out + pieces[word[len(core) :]] if len(core) < len(word) else out

        return encode

    def _parts(self, text: str) -> bytes:
        if self.kind == "words":
            text = self.whole.normalizer.normalize_str(text)
        return b"".join([self.pieces[p] for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind != "text":
            flat = text.replace("\n", " ")
            if single_blanks(flat):
                if self.kind == "words":
                    return b"".join(map(self.first.__getitem__, flat.split(" ")))
                lines = []
                for line in text.split("\n"):
                    head, _, rest = line.partition(" ")
                    lines.append(self.first[head] + b"".join(map(self.next.__getitem__, rest.split(" "))) if rest else self.first[head])
                return self.line_end.join(lines)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)

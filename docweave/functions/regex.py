"""Regular expressions with the matching rules of Python ``re`` on the JVM.

Patterns are written in Python syntax. ``jvm`` spells out the classes that the two engines read
differently, so that texts and offsets agree for any script, not just for ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace set, usable inside a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
# Letters that equal an ASCII letter only when case is ignored; lower-casing does not show it.
_FOLDING = "[\u0130\u0131\u017f\u212a]"

_NOT_BEFORE = f"(?<![{WORD}])"
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def jvm(pattern: str, dotall: bool = False, ignore_case: bool = True) -> str:
    """Translate a Python pattern; always Unicode, ``\\n`` the only line end."""
    source = pattern.replace("(?i)", "")
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(source):
        pair = source[i : i + 2]
        if pair == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif pair == r"\w":
            out.append(WORD if in_class else f"[{WORD}]")
        elif pair == r"\d":
            out.append(r"\p{Nd}")
        elif pair == r"\D":
            out.append(r"\P{Nd}")
        elif pair == r"\b":
            # Before a digit the look-behind alone decides, and it is tried at every position.
            digit_next = re.match(r"(\(\?:)?\\d", source[i + 2 :])
            out.append(_NOT_BEFORE if digit_next else _BOUNDARY)
        elif pair.startswith("\\"):
            out.append(pair)
        else:
            if source[i] == "[":
                in_class = True
            elif source[i] == "]":
                in_class = False
            out.append(source[i])
            i += 1
            continue
        i += 2
    # Folding case costs at every character; a pattern without letters does not need it.
    letters = re.search(r"[A-Za-z]", re.sub(r"\\p\{\w+\}|\\.", "", source))
    flags = ("iu" if ignore_case and letters else "") + "d" + ("s" if dotall else "")
    return f"(?{flags})" + "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    """The text in lower case, NULL where that may hide a letter from a pattern that ignores case."""
    return F.when(~text.rlike(_FOLDING), F.lower(text))


def may_hold(low: Column, words: list[str]) -> Column:
    """Whether a pattern that ignores case can find one of ``words`` in a ``lowered`` text: far cheaper than to try it."""
    found = low.contains(words[0])
    for w in words[1:]:
        found = found | low.contains(w)
    return F.coalesce(found, F.lit(True))


def strip(text: Column) -> Column:
    """``str.strip``: linear even on long runs of blanks."""
    head = F.regexp_replace(text, rf"\A[{SPACE}]++", "")
    return F.regexp_replace(head, rf"(?<![{SPACE}])[{SPACE}]++\z", "")


def first_group(text: Column, pattern: str, group: int = 1, dotall: bool = False) -> Column:
    """Group of the first match, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, jvm(pattern, dotall), group), F.lit(""))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches as an array of strings."""
    return F.regexp_extract_all(text, F.lit(jvm(pattern)), F.lit(group))


# Prefix sums work in blocks, so a text with a million matches does not cost a million squared.
_BLOCK = 128


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _running(values: Column) -> Column:
    """Exclusive prefix sums of a non-empty array of INT; ``values`` must be cheap to repeat."""
    n = F.size(values)

    def with_totals(totals: Column) -> Column:
        bases = F.transform(totals, lambda _, b: _sum(F.slice(totals, F.lit(1), b)))
        return let(
            bases,
            lambda base: F.transform(
                values,
                lambda _, i: base[(i / _BLOCK).cast("int")]
                + _sum(F.slice(values, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
            ),
        )

    blocks = F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: _sum(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(totals, with_totals)


# A noncharacter: no proper text holds it, and a text that does is matched twice instead.
_MARK = "\uffff"


def _plain(text: Column, start: Column, end: Column, value: Column) -> Column:
    return F.struct(text.alias("text"), start.alias("start"), end.alias("end"), value.alias("value"))


def find_spans(
    text: Column, pattern: str | Column, value_group: int | None = None, shape: Callable[..., Column] = _plain
) -> Column:
    """All matches with half-open code-point offsets.

    ``ARRAY<STRUCT<text,start,end,value>>``; ``value`` is NULL unless a group is asked for. ``shape`` makes
    other structs of these four; the array is then NULL where nothing matches. The engine has no offset function. So one replacement puts marks around every match, the marked text
    is cut at the marks, and the running length of the pieces gives every start. A column as pattern
    is taken as it is, in the engine's own syntax.
    """
    java = pattern if isinstance(pattern, Column) else F.lit(jvm(pattern))
    step = 3 if value_group else 2

    def place(pieces: Column) -> Column:
        """``pieces``: gap, match (, value), gap, match (, value), …, gap."""
        lengths = F.transform(
            pieces, lambda p, i: F.when(i % step == 2, 0).otherwise(F.length(p)) if value_group else F.length(p)
        )
        hits = F.sequence(F.lit(0), ((F.size(pieces) - 1) / step).cast("int") - 1)

        def spans(start: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
            def one(k: Column) -> Column:
                at = k * step + 1
                return shape(pieces[at], start(at), end(at), pieces[at + 1] if value_group else F.lit(None).cast("string"))

            return F.transform(hits, one)

        def few(sizes: Column) -> Column:
            upto = lambda at: _sum(F.slice(sizes, F.lit(1), at))
            return spans(upto, lambda at: upto(at + 1))

        def many(before: Column) -> Column:
            return spans(lambda at: before[at], lambda at: before[at] + F.length(pieces[at]))

        # Prefix sums cost more than they save where there are few matches.
        found = F.when(F.size(pieces) <= _BLOCK, let(lengths, few)).otherwise(let(let(lengths, _running), many))
        return F.when(F.size(pieces) > 1, found)

    marked = f"{_MARK}$0{_MARK}" + (f"${value_group}{_MARK}" if value_group else "")
    once = F.split(F.regexp_replace(text, java, F.lit(marked)), _MARK, -1)
    found = F.regexp_extract_all(text, java, F.lit(0))
    gaps = F.split(text, java, -1)
    if value_group:
        values = F.regexp_extract_all(text, java, F.lit(value_group))
        rows = F.zip_with(found, values, lambda m, v: F.array(m, v))
    else:
        rows = F.transform(found, lambda m: F.array(m))
    twice = let(
        F.struct(gaps.alias("g"), rows.alias("r")),
        lambda s: F.flatten(
            F.transform(s["g"], lambda g, i: F.concat(F.array(g), F.coalesce(F.get(s["r"], i), F.array().cast("array<string>"))))
        ),
    )
    pieces = F.when(text.contains(_MARK), twice).otherwise(once)
    spans = let(pieces, place)
    if shape is not _plain:
        return spans
    return F.coalesce(spans, F.array().cast("array<struct<text:string,start:int,end:int,value:string>>"))

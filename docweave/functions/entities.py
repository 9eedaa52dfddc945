"""Pattern entities with offsets: registries and the columns they turn into."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import matching
from docweave.functions.regex import find_spans, jvm, lowered, may_hold, strip

# The expressions that define each entity.
PATTERNS: dict[str, str] = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    "currency": r"\$[\d,]+\.?\d*",
    "percentage": r"\d+\.?\d*%",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
    "url": r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*))?)?",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "invoice_number": r"(?i)(?:invoice|inv)[#\s]*:?\s*([A-Z0-9-]+)",
    "po_number": r"(?i)(?:purchase order|po)[#\s]*:?\s*([A-Z0-9-]+)",
    "tax_id": r"(?i)(?:tax id|ein)[#\s]*:?\s*(\d{2}-\d{7})",
}
FINANCIAL: dict[str, str] = {
    "account_number": r"(?i)(?:account|acct)[#\s]*:?\s*([0-9-]+)",
    "routing_number": r"(?i)(?:routing|aba)[#\s]*:?\s*([0-9]{9})",
    "total_amount": r"(?i)(?:total|amount due)[:\s]*\$?([\d,]+\.?\d*)",
    "subtotal": r"(?i)subtotal[:\s]*\$?([\d,]+\.?\d*)",
    "tax_amount": r"(?i)(?:tax|vat)[:\s]*\$?([\d,]+\.?\d*)",
    "discount": r"(?i)discount[:\s]*\$?([\d,]+\.?\d*)",
}
ADDRESS = (
    r"\d+\s+[A-Za-z0-9\s,.-]+"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)"
    r"(?:\s+[A-Za-z0-9\s,.-]+)*(?:\s+\d{5}(?:-\d{4})?)?"
)
CONFIDENCE = {"patterns": 0.9, "financial": 0.85, "address": 0.8}

# A character no match can lack. Texts without it skip the regex altogether.
REQUIRED_CHAR = {
    "email": "@",
    "ssn": "-",
    "currency": "$",
    "percentage": "%",
    "url": "://",
    "ip_address": ".",
    "tax_id": "-",
}

# What a match begins with, of a phone its ten characters at least. Looked at first, it turns most positions away at once.
FIRST_CHAR = {
    "phone": r"[+(\d][-.()\d\s]{9}",
    "ssn": r"\d",
    "credit_card": r"\d",
    "date": r"\d",
    "percentage": r"\d",
    "zip_code": r"\d",
    "ip_address": r"\d",
}
# The same matches without backtracking: from the first digit of a run only, and giving nothing back
# where giving back cannot help. Long runs of digits or blanks would cost their square otherwise.
_RUN_OF_DIGITS = {"percentage": r"(?<!\d)\d++(?:\.\d*+)?%"}
_GIVES_NOTHING_BACK = {r"[#\s]*:?\s*": r"[#\s]*+:?\s*+", r"[:\s]*\$?": r"[:\s]*+\$?"}

# Words of which a match has at least one; looked for in the lower-cased text.
REQUIRED_WORDS = {
    "invoice_number": ["inv"],
    "po_number": ["po", "purchase order"],
    "tax_id": ["ein", "tax id"],
    "account_number": ["acct", "account"],
    "routing_number": ["aba", "routing"],
    "total_amount": ["total", "amount due"],
    "subtotal": ["subtotal"],
    "tax_amount": ["tax", "vat"],
    "discount": ["discount"],
}
# Of these a match has at least one digit, of any script.
REQUIRED_DIGIT = {"phone", "ssn", "credit_card", "date", "percentage", "zip_code", "ip_address", "tax_id"}

ENTITY = (
    "struct<entity_type:string,text:string,start:int,end:int,"
    "value:string,confidence:double,method:string>"
)


# An address lies in one run of letters, digits, blanks and ``,.-`` and ends at the last suffix of
# that run. Cutting such runs out first, from their first character, is linear; the address
# expression alone would try every digit of a run against the whole rest of it. Digits of other
# scripts may stand before a run but not in it, so texts with such digits take the direct way.
_RUN = (
    r"(?<![A-Za-z0-9\s,.-])(?=[A-Za-z0-9\s,.-]*[0-9]\s)" + ADDRESS.removeprefix(r"\d+\s+")
)
_OTHER_DIGIT = r"[\p{Nd}&&[^0-9]]"


def _address_spans(text: Column) -> Column:
    def stripped(s: Column, shift: Column) -> Column:
        return F.struct(
            strip(s["text"]).alias("text"),
            (shift + s["start"]).alias("start"),
            (shift + s["end"]).alias("end"),
            s["value"].alias("value"),
        )

    by_run = F.transform(
        find_spans(text, _RUN),
        lambda run: F.transform(
            find_spans(run["text"], ADDRESS), lambda s: stripped(s, run["start"])
        ),
    )
    direct = F.transform(find_spans(text, ADDRESS), lambda s: stripped(s, F.lit(0)))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(~ascii_only & text.rlike(_OTHER_DIGIT), direct).otherwise(F.flatten(by_run))


def _guarded(text: Column, name: str, pattern: str) -> tuple[Column, str]:
    """Whether the text can hold a match at all, and the pattern in the form that is tried."""
    # The checks belong to the given patterns; a caller's own one under the same name has none.
    given = pattern in (PATTERNS.get(name), FINANCIAL.get(name))
    present = text.isNotNull()
    if given and name in REQUIRED_CHAR:
        present = text.contains(REQUIRED_CHAR[name])
    if given and name in REQUIRED_WORDS:
        present = present & may_hold(lowered(text), REQUIRED_WORDS[name])
    if given and name in REQUIRED_DIGIT:
        present = present & text.rlike(r"\p{Nd}")
    if given:
        pattern = _RUN_OF_DIGITS.get(name, pattern)
        for slow, fast in _GIVES_NOTHING_BACK.items():
            pattern = pattern.replace(slow, fast)
    if given and name in FIRST_CHAR:
        pattern = f"(?={FIRST_CHAR[name]})(?:{pattern})"
    return present, pattern


def _spans(text: Column, name: str, pattern: str, confidence: float, method: str, group=None) -> Column:
    present, pattern = _guarded(text, name, pattern)

    def typed(found: Column, start: Column, end: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("entity_type"),
            found.alias("text"),
            start.alias("start"),
            end.alias("end"),
            value.alias("value"),
            F.lit(confidence).alias("confidence"),
            F.lit(method).alias("method"),
        )

    if name == "address":
        found = F.transform(_address_spans(text), lambda s: typed(s["text"], s["start"], s["end"], s["value"]))
    else:
        found = find_spans(text, pattern, group, typed)
    return F.coalesce(F.when(present, found), F.array().cast(f"array<{ENTITY}>"))


FEW = 3  # patterns that are tried as expressions over a row; more of the given ones are looked for in batches


def _many(names: Iterable[str], known: Mapping[str, str]) -> dict[str, re.Pattern] | None:
    """Given patterns ready for ``matching``; none where they are few or one is a caller's own."""
    wanted = {n: known[n] for n in names}
    if len(wanted) <= FEW or any(p not in (PATTERNS.get(n), FINANCIAL.get(n)) for n, p in wanted.items()):
        return None
    for name, pattern in wanted.items():
        pattern = _RUN_OF_DIGITS.get(name, pattern)
        for slow, fast in _GIVES_NOTHING_BACK.items():
            pattern = pattern.replace(slow, fast)
        wanted[name] = re.compile(pattern, re.IGNORECASE)
    return wanted


def _matched(text: Column, patterns: dict[str, re.Pattern], method: str, group: int | None = None) -> Column:
    confidence = CONFIDENCE[method]

    @F.arrow_udf(f"array<{ENTITY}>")
    def find(texts: pa.Array) -> pa.Array:
        return matching.entities(texts, patterns, group, confidence, method)

    return find(text)


def pattern_entities(
    text: Column, names: list[str] | None = None, registry: Mapping[str, str] | None = None
) -> Column:
    """Entities of the pattern registry; pass ``registry`` to add or replace patterns."""
    known = dict(PATTERNS if registry is None else registry)
    many = _many(names or known, known)
    if many:
        return _matched(text, many, "patterns")
    parts = [
        _spans(text, n, known[n], CONFIDENCE["patterns"], "patterns") for n in (names or known)
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pattern_counts(text: Column, names: list[str] | None = None) -> Column:
    """Number of entities of each pattern that the text holds: counted, without places or texts."""
    many = _many(names or PATTERNS, PATTERNS)
    if many:

        @F.arrow_udf("array<struct<entity_type:string,entities:bigint>>")
        def count(texts: pa.Array) -> pa.Array:
            return matching.counts(texts, many)

        return count(text)
    one = []
    for name in names or PATTERNS:
        present, pattern = _guarded(text, name, PATTERNS[name])
        n = F.when(present, F.regexp_count(text, F.lit(jvm(pattern)))).otherwise(0)
        one.append(F.struct(F.lit(name).alias("entity_type"), n.cast("bigint").alias("entities")))
    return F.filter(F.array(*one), lambda c: c["entities"] > 0)


def financial_entities(text: Column, names: list[str] | None = None) -> Column:
    """Financial entities; ``value`` holds the amount or number alone."""
    many = _many(names or FINANCIAL, FINANCIAL)
    if many:
        return _matched(text, many, "financial", 1)
    parts = [
        _spans(text, n, FINANCIAL[n], CONFIDENCE["financial"], "financial", 1)
        for n in (names or FINANCIAL)
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def address_entities(text: Column) -> Column:
    """Street addresses; the text is stripped, the offsets are those of the raw match."""
    return _spans(text, "address", ADDRESS, CONFIDENCE["address"], "address")

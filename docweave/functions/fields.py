"""Fields that only one document type carries: invoice, resume, contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.regex import find_all, first_group, let, lowered, may_hold, strip

# One expression per field; the first match counts.
INVOICE = {
    "number": r"(?i)invoice[#\s]*:?\s*([A-Z0-9-]+)",
    "date": r"(?i)(?:date|invoice date)[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
    "due_date": r"(?i)(?:due date|payment due)[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
    "total": r"(?i)(?:total|amount due|grand total)[:\s]*\$?([\d,]+\.?\d*)",
}
# Words of which a match has at least one.
INVOICE_WORDS = {
    "number": ["invoice"],
    "date": ["date"],
    "due_date": ["due date", "payment due"],
    "total": ["total", "amount due"],
}
EDUCATION = r"(?i)(education.*?)(?=experience|skills|$)"
DEGREE = r"(?i)(bachelor|master|phd|doctorate|associate|certificate).*?(?=\n|\d{4})"
EXPERIENCE = r"(?i)(experience.*?)(?=education|skills|$)"
JOB = (
    r"(?i)([a-zA-Z\s]+"
    r"(?:engineer|manager|analyst|developer|consultant|specialist|coordinator))"
)
# A title ends the last one of a run of words, so only the start of a run needs to be tried.
_JOB_RUN = r"(?<![a-zA-Z\s])" + JOB
PARTIES = [
    r"(?i)between\s+(.+?)\s+and\s+(.+?)(?:\s+hereby|\s+agree|\s+enter)",
    r"(?i)party\s+[\"']?([^\"']+)[\"']?\s+and\s+[\"']?([^\"']+)[\"']?",
]
EFFECTIVE = r"(?i)effective(?:\s+date)?[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{4})"
TERM = r"(?i)term.*?(\d+)\s*(year|month|day)"


def invoice_fields(text: Column) -> Column:
    """``STRUCT<number,date,due_date,total>``, each NULL where absent."""
    return let(
        lowered(text),
        lambda low: F.struct(*[F.when(may_hold(low, INVOICE_WORDS[name]), first_group(text, p)).alias(name) for name, p in INVOICE.items()]),
    )


def resume_fields(text: Column) -> Column:
    """``STRUCT<name,education,experience>``; the two lists hold keywords and job titles."""
    none = F.array().cast("array<string>")

    def listed(section_pattern: str, item: str) -> Column:
        section = first_group(text, section_pattern, dotall=True)
        return let(section, lambda s: F.coalesce(find_all(s, item, 1), none))

    name = strip(F.get(F.filter(F.split(text, "\n"), lambda line: strip(line) != ""), F.lit(0)))
    return F.struct(
        name.alias("name"),
        listed(EDUCATION, DEGREE).alias("education"),
        listed(EXPERIENCE, _JOB_RUN).alias("experience"),
    )


def contract_fields(text: Column) -> Column:
    """``STRUCT<party_a,party_b,effective_date,duration>``; the first form that fits names both."""

    def party(group: int) -> Column:
        return strip(F.coalesce(*[first_group(text, p, group) for p in PARTIES]))

    duration = F.concat_ws(" ", first_group(text, TERM, 1), first_group(text, TERM, 2))
    return F.struct(
        party(1).alias("party_a"),
        party(2).alias("party_b"),
        first_group(text, EFFECTIVE).alias("effective_date"),
        F.nullif(duration, F.lit("")).alias("duration"),
    )


def document_fields(document_type: Column, text: Column) -> Column:
    """Extractor chosen by type; other types get three NULL structs."""
    return F.struct(
        F.when(document_type == "invoice", invoice_fields(text)).alias("invoice"),
        F.when(document_type == "resume", resume_fields(text)).alias("resume"),
        F.when(document_type == "contract", contract_fields(text)).alias("contract"),
    )

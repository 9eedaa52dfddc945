"""Validators and normalisers for single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.regex import jvm

# Formats in the order they are tried.
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def valid_email(value: Column) -> Column:
    return F.coalesce(value.rlike(jvm(EMAIL, ignore_case=False)), F.lit(False))


def normalized_phone(value: Column) -> Column:
    """``(aaa) bbb-cccc`` for ten digits, ``1-(aaa) …`` for eleven from 1, else NULL."""
    digits = F.regexp_replace(value, r"\P{Nd}", "")

    def shape(d: Column, skip: int) -> Column:
        area, mid, last = F.substring(d, 1 + skip, 3), F.substring(d, 4 + skip, 3), F.substring(d, 7 + skip, 4)
        return F.concat(F.lit("("), area, F.lit(") "), mid, F.lit("-"), last)

    return F.when(F.length(digits) == 10, shape(digits, 0)).when(
        (F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("1-"), shape(digits, 1))
    )


def parsed_date(value: Column) -> Column:
    """First format that fits, month first; impossible days give NULL."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(fmt)) for fmt in DATE_FORMATS]).cast("date")


def clean_currency(value: Column) -> Column:
    """Amount as a number; anything unreadable is 0.0."""
    return F.coalesce(F.regexp_replace(value, r"[\$,]", "").try_cast("double"), F.lit(0.0))


def is_valid(entity_type: Column, value: Column) -> Column:
    """Only e-mails, phones and dates can be rejected; other types have no check (NULL)."""
    return (
        F.when(entity_type == "email", valid_email(value))
        .when(entity_type == "phone", normalized_phone(value).isNotNull())
        .when(entity_type == "date", parsed_date(value).isNotNull())
        .when(entity_type == "currency", F.lit(True))
    )


def normalized(entity_type: Column, value: Column) -> Column:
    """Normal form as text: phone layout, ISO date, plain amount."""
    return (
        F.when(entity_type == "phone", normalized_phone(value))
        .when(entity_type == "date", parsed_date(value).cast("string"))
        .when(entity_type == "currency", clean_currency(value).cast("string"))
        .when(entity_type == "email", value)
    )

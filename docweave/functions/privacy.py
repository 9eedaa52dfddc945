"""Column protection: encryption, keyed pseudonyms, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.entities import PATTERNS
from docweave.functions.regex import jvm


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM as base64 text; the key has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM")))


def decrypt(token: Column, key: Column) -> Column:
    """Clear text, '' where the token or the key is wrong."""
    return F.coalesce(
        F.try_aes_decrypt(F.try_to_binary(token, F.lit("base64")), key, F.lit("GCM")).cast("string"),
        F.lit(""),
    )


def pseudonym(value: Column, salt: Column) -> Column:
    """Salted SHA-256: equal inputs stay joinable, the input does not show."""
    return F.sha2(F.concat(salt, value), 256)


def matches_pseudonym(value: Column, salt: Column, digest: Column) -> Column:
    return F.coalesce(pseudonym(value, salt) == digest, F.lit(False))


def redact(text: Column, names: tuple[str, ...] = ("ssn", "credit_card", "email", "phone")) -> Column:
    """Replace each named pattern by ``[NAME]``, one after the other."""
    out = text
    for name in names:
        out = F.regexp_replace(out, jvm(PATTERNS[name]), f"[{name.upper()}]")
    return out

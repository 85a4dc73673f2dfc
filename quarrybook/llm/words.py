"""Column expressions for words, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two alphabets of ASCII case folding.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as in a character class of a Java or RE2 pattern.
BLANK = r"\x20\x09-\x0D"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; for texts without other characters ``lower`` is the same and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def alnum_words(text: Column) -> Column:
    """Runs of digits, lower-case ASCII letters and all non-ASCII characters, after ASCII case folding."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))

"""Text normal forms as column expressions. NULL is empty text unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents, and what they fold to.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def present(c: Column) -> Column:
    """Neither NULL nor empty."""
    return c.isNotNull() & (c != "")


def nonzero(c: Column) -> Column:
    """Neither NULL nor zero."""
    return c.isNotNull() & (c != 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use has it: else a rule that asks for a number ten times holds ten copies of its parsing."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)


def clean_text(c: Column) -> Column:
    """White space (no-break spaces too) collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "   ", "   "), r"\s+", " "))


def norm_text(c: Column, keep_punctuation: bool = False) -> Column:
    """Folded, punctuation to spaces, white space collapsed."""
    folded = fold(c) if keep_punctuation else F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def header_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]+", "")


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed lower-case parts, joined by bars."""
    texts = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 16)


def split_name(c: Column) -> tuple[Column, Column]:
    """First token, and the rest with its particles."""
    tokens = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
    return F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")), F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), " ")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods between two timestamps."""
    return F.timestamp_diff("DAY", start, end)


def half_even(c: Column, step: int) -> Column:
    """Rounded to a multiple of step, ties to even, as a long."""
    return F.bround(c / step).cast("long") * step

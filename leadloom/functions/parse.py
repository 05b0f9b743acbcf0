"""Numbers and booleans from text, by locale rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for yes and no.
TRUE_WORDS = ("1", "true", "yes", "sim", "y", "s", "particular", "owner")
FALSE_WORDS = ("0", "false", "no", "nao", "não", "n", "agencia", "agência")


def within(value: Column, low: float, high: float) -> Column:
    return F.when((value > low) & (value < high), value)


def listing_price(raw: Column, low: float = 5_000, high: float = 10_000_000) -> Column:
    """The first run of digits and separators; dots group thousands, a comma is the decimal sign."""
    run = F.regexp_extract(F.translate(raw, " ", " "), r"[\d\s.,]+", 0)
    plain = F.translate(F.regexp_replace(run, r"[\s.]", ""), ",", ".")
    single = F.when(F.length(plain) - F.length(F.replace(plain, F.lit("."), F.lit(""))) > 1, F.regexp_replace(plain, r"\.(?=.*\.)", "")).otherwise(plain)
    return within(single.try_cast("double"), low, high)


def listing_area(raw: Column) -> Column:
    """A number before m or m²."""
    return within(F.translate(F.regexp_extract(raw, r"(?i)(\d+[.,]?\d*)\s*m²?", 1), ",", ".").try_cast("double"), 5, 50_000)


def import_price(raw: Column) -> Column:
    """Of comma and dot the last is the decimal sign; a lone comma is; a lone dot isn't before three last digits."""
    s = F.regexp_replace(raw, r"[^\d,.]", "")
    comma, dot = s.contains(","), s.contains(".")
    no = lambda c, x: F.replace(c, F.lit(x), F.lit(""))
    point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    value = (
        F.when(comma & dot & comma_last, point(no(s, ".")))
        .when(comma & dot, no(s, ","))
        .when(comma, point(s))
        .when(dot & F.substring_index(s, ".", -1).rlike(r"^\d{3}$"), no(s, "."))
        .otherwise(s)
    )
    return value.try_cast("double")


def import_area(raw: Column) -> Column:
    return F.replace(F.regexp_replace(raw, r"[^\d.,]", ""), F.lit(","), F.lit(".")).try_cast("double")


def import_bool(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def price_per_area(price: Column, area: Column) -> Column:
    return F.when((price > 0) & (area > 0), F.round(price / area, 2))


def delta_pct(per_area: Column, benchmark: Column) -> Column:
    """Per cent below the benchmark."""
    return F.when((per_area != 0) & (benchmark != 0), F.round((benchmark - per_area) / benchmark * 100, 2))

"""Numeric expressions: ratios, directions, formats, numbers in text and their rounded forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
WORD_VALUES = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "half": 0.5, "halves": 0.5,
    "third": 1 / 3, "thirds": 1 / 3, "quarter": 0.25, "quarters": 0.25, "twice": 2, "thrice": 3, "double": 2, "doubled": 2, "triple": 3,
    "tripled": 3, "dozen": 12,
}
NUMBER = r"\d+(?:\.\d+)?"
WORD_NUMBER = r"(?i)\b(" + "|".join(sorted(WORD_VALUES, key=len, reverse=True)) + r")\b"


def log_ratio(treated: Column, control: Column) -> Column:
    """ln(treated / control), null unless both are positive."""
    return F.when((treated > 0) & (control > 0), F.log(treated / control))


def pct_change(ratio_log: Column) -> Column:
    return F.bround((F.exp(ratio_log) - 1) * 100, 1)


def confidence(r2: Column) -> Column:
    return F.when(r2 >= 0.10, "high").when(r2 >= 0, "medium").otherwise("low")


def effect_text(pct: Column, goal: Column, indicator: Column) -> Column:
    """A rounded size, half to even, the goal's word, and what it is in."""
    return F.concat(F.lit("~"), F.bround(F.abs(pct), 0).cast("bigint").cast("string"), F.lit("% "), goal, F.lit(" in "), indicator)


def signed_pct(value: Column) -> Column:
    """One decimal with a sign; zero has none."""
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_string("%.1f%%", value))


def tokens(text: Column) -> Column:
    """Numbers in a text as written, citation marks left out."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\[G?\d+\]", " "), F.lit(f"({NUMBER})"), 1)


def word_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_NUMBER), 1), F.lower)


def word_value(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in WORD_VALUES.items() for x in (k, float(v))]), word)


def safe_int(text: Column) -> Column:
    """The whole number a cell holds, cut towards zero, or null."""
    return text.try_cast("double").try_cast("bigint")


def safe_float(text: Column, places: int = 2) -> Column:
    """The number a cell holds, rounded half to even, or null."""
    return F.bround(text.try_cast("double"), places)


def year_of_parts(candidates: Column) -> Column:
    """The first year in an array of date-parts arrays, in order; empty and null parts are passed over."""
    return F.get(F.filter(F.transform(candidates, lambda c: F.get(F.get(c, F.lit(0)), F.lit(0))), lambda y: y.isNotNull()), F.lit(0)).cast("int")


def scaled(value: Column, nodata: Column, factor: float = 0.1) -> Column:
    """A stored value in its unit; the mark of no data and NaN become null."""
    return F.when(~value.eqNullSafe(nodata) & ~F.isnan(value.cast("double")), value * factor)


def multi_year_mean(values: Column) -> Column:
    """The mean over years; a negative value stands for no data and leaves no mean."""
    bad = F.exists(values, lambda v: v.isNull() | (v < 0))
    return F.when((F.size(values) > 0) & ~bad, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def variants(value: Column) -> Column:
    """A number and the rounded forms in which a text may state it."""
    return F.array_distinct(F.array(value, F.abs(value), F.bround(value, 0), F.bround(value, 1), F.bround(value, 2), F.bround(F.abs(value), 0)))


def all_variants(values: Column) -> Column:
    """The forms of every number in an array of strings."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: variants(v.cast("double")))))


def grounded(token: Column, allowed: Column) -> Column:
    """Whole numbers from 0 to 10 are free; others need a form in common with the allowed ones."""
    value = token.cast("double")
    small = (value == F.floor(value)) & value.between(0, 10)
    return small | F.arrays_overlap(variants(value), allowed)

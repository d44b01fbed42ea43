"""Scalar functions on texts: numbers, ranges, names, personal data, JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?[0-9]+(\.[0-9]+)?\s*$"
RANGE = r"([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{8,}[0-9]"


def parse_number(text: Column) -> Column:
    """The number a text is, comma or dot; null if it is anything else."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(NUMBER), F.trim(dotted).cast("double"))


def ranges(text: Column) -> Column:
    """All ``a-b`` with 0 <= a < b and b - a <= 1000, in order, as (low, high)."""
    lows, highs = F.regexp_extract_all(text, F.lit(RANGE), 1), F.regexp_extract_all(text, F.lit(RANGE), 2)
    both = F.zip_with(lows, highs, lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high")))
    return F.filter(both, lambda r: (r["low"] < r["high"]) & (r["high"] - r["low"] <= 1000))


def widest_range(text: Column) -> Column:
    return F.try_element_at(F.array_sort(F.transform(ranges(text), lambda r: F.struct((r["high"] - r["low"]).alias("span"), r["low"].alias("low"), r["high"].alias("high")))), F.lit(-1))


def normalize_name(text: Column) -> Column:
    """Lower case, ``&`` as and, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def personal_data(text: Column) -> Column:
    return F.struct(F.regexp_count(text, F.lit(EMAIL)).alias("emails"), F.regexp_count(text, F.lit(PHONE)).alias("phones"))


def feet_to_metres(feet: Column) -> Column:
    return (feet.cast("decimal(14,4)") * F.lit("0.3048").cast("decimal(5,4)")).cast("decimal(18,6)")


def metres_to_feet(metres: Column) -> Column:
    return (metres.cast("decimal(18,6)") / F.lit("0.3048").cast("decimal(5,4)")).cast("decimal(24,9)")


def json_number(text: Column, path: str) -> Column:
    """A number at a path of a JSON text; anything else there is null."""
    value = F.get_json_object(text, path)
    return F.when(value.rlike(NUMBER), value.cast("double"))

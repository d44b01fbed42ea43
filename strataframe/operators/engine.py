"""All ten constraints in one call, from a strict configuration, and any further ones a caller brings.

The engine reads long tables: ``intervals`` (doc, seq, top, bottom, thickness,
code), ``boreholes`` (doc, final_depth, water_depth), ``coordinates`` (doc,
field, value, raw), ``percentages`` (doc, field, value) and ``typed`` (doc,
kind: text or number, value, raw).  A table that isn't there has no cases.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators import constraints

Tables = Mapping[str, DataFrame]
#: The sections of a configuration, their keys beside enabled and severity, and the constraints' names.
VERSION = "v001"
SECTIONS = {
    "depth_validity": ("C1_depth_validity", ()), "thickness_consistency": ("C2_thickness_consistency", ("tolerance_m",)), "continuity": ("C3_interval_continuity", ("tolerance_m",)), "monotonicity": ("C4_depth_monotonicity", ("tolerance_m",)),
    "final_depth_consistency": ("C5_final_depth_consistency", ("tolerance_m",)), "groundwater_reasonableness": ("C6_groundwater_reasonableness", ()), "percentage_range": ("C7_percentage_range", ("fields", "minimum", "maximum")),
    "coordinate_format": ("C8_coordinate_format", ("minimum_digits", "maximum_digits", "confusables")), "stratum_code_sequence": ("C9_stratum_code_sequence", ()), "field_type_consistency": ("C10_field_type_consistency", ()),
}
CONFUSABLES = {"O/0": "Oo", "I/1": "I", "l/1": "l"}
#: A text that is only a number, and words that no depth holds.
ONLY_NUMBER, GEOLOGICAL = r"(?i)^\s*[-+]?[0-9]+(?:\.[0-9]+)?\s*(?:m|米)?\s*$", r"(?i)[\x{4e00}-\x{9fff}]|clay|sand|silt|rock|mudstone|sandstone|gravel|fill"


@dataclass(frozen=True)
class Constraint:
    """A constraint: ``count`` turns the tables into doc, evaluated, violations, a row for each document it looks at."""

    name: str
    severity: str
    count: Callable[[Tables], DataFrame | None]


def _sums(rows: DataFrame, evaluated: Column, violations: Column) -> DataFrame:
    return rows.groupBy("doc").agg(F.sum(F.coalesce(evaluated.cast("long"), F.lit(0))).alias("evaluated"), F.sum(F.coalesce(violations.cast("long"), F.lit(0))).alias("violations"))


def coordinate_faults(raw: Column, field: Column, least: int, most: int, letters: str) -> list[Column]:
    """Whether a coordinate's text holds letters that are read for digits, and whether it has a suspicious number of digits."""
    token = F.lit(False) if not letters else raw.rlike(rf"(?<![A-Za-z])[-+]?[0-9][0-9.,{letters}+-]*[{letters}][0-9.,{letters}+-]*(?![A-Za-z])")
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    floor = F.when(field == "collar_elevation_m", 1).otherwise(least)
    return [token, (digits > 0) & ((digits < floor) | (digits > most))]


def default_config(tolerance: str = "0.05") -> dict[str, Any]:
    out: dict[str, Any] = {"version": VERSION}
    for name, (_, keys) in SECTIONS.items():
        out[name] = {"enabled": True, "severity": "warning"} | ({"tolerance_m": tolerance} if "tolerance_m" in keys else {})
    return out


def engine(config: Mapping[str, Any]) -> list[Constraint]:
    """The enabled constraints of a complete configuration, in their order; anything unknown or missing is refused."""
    if config.get("version") != VERSION:
        raise ValueError(f"the configuration's version must be {VERSION}")
    if wrong := (set(config) - {"version"}) ^ set(SECTIONS):
        raise ValueError(f"unknown or missing sections: {sorted(wrong)}")
    out = []
    for section, (name, keys) in SECTIONS.items():
        c = config[section]
        if not isinstance(c, Mapping) or set(c) - {"enabled", "severity", *keys}:
            raise ValueError(f"section {section} isn't a mapping or has unknown keys")
        if not isinstance(c.get("enabled"), bool) or not isinstance(c.get("severity"), str) or not c["severity"].strip():
            raise ValueError(f"section {section} needs enabled and severity")
        if c["enabled"]:
            out.append(Constraint(name, c["severity"], _COUNTS[section](c)))
    return out


def _of_intervals(*checks: str) -> Callable[[Mapping[str, Any]], Callable[[Tables], DataFrame | None]]:
    def make(c: Mapping[str, Any]) -> Callable[[Tables], DataFrame | None]:
        tolerance = Decimal(str(c.get("tolerance_m", "0.05")))
        if tolerance < 0:
            raise ValueError("a tolerance must not be negative")
        return IntervalCount(checks, tolerance)

    return make


@dataclass(frozen=True)
class IntervalCount:
    """A constraint on neighbouring intervals: looked at where the first check is, violated where any is."""

    checks: tuple[str, ...]
    tolerance: Decimal

    def columns(self) -> tuple[Column, Column]:
        every = constraints.interval_checks(self.tolerance)
        looked, violated = F.coalesce(every[self.checks[0]][0], F.lit(False)), F.lit(False)
        for name in self.checks:
            violated = violated | F.coalesce(every[name][1], F.lit(False))
        return looked, looked & violated

    def __call__(self, tables: Tables) -> DataFrame | None:
        rows = _neighbours(tables)
        return None if rows is None else _sums(rows, *self.columns())


def _neighbours(tables: Tables) -> DataFrame | None:
    """The one window over (document, position) that all constraints on intervals read."""
    if "intervals" not in tables:
        return None
    rows = constraints.with_neighbours(tables["intervals"])
    finals = tables.get("boreholes")
    if finals is None:
        return rows.withColumn("final_depth", F.lit(None).cast("decimal(12,2)"))
    return rows.join(finals.select(F.col("doc").alias("f_doc"), "final_depth"), F.col("doc") == F.col("f_doc"), "left")


def _water(c: Mapping[str, Any]) -> Callable[[Tables], DataFrame | None]:
    return lambda t: constraints.water_checks(t["boreholes"]) if "boreholes" in t else None


def _percentages(c: Mapping[str, Any]) -> Callable[[Tables], DataFrame | None]:
    fields, low, high = list(c.get("fields", ("rqd_percent", "core_recovery_percent"))), float(c.get("minimum", 0)), float(c.get("maximum", 100))
    if low > high:
        raise ValueError("the minimum is over the maximum")
    value = F.col("value").cast("double")
    return lambda t: _sums(t["percentages"].where(F.col("field").isin(*fields)), value.isNotNull(), ~value.between(low, high)) if "percentages" in t else None


def _coordinates(c: Mapping[str, Any]) -> Callable[[Tables], DataFrame | None]:
    least, most, kinds = int(c.get("minimum_digits", 4)), int(c.get("maximum_digits", 12)), tuple(c.get("confusables", CONFUSABLES))
    if not 1 <= least <= most or set(kinds) - set(CONFUSABLES):
        raise ValueError("wrong bounds of digits, or letters that aren't known")
    letters = "".join(CONFUSABLES[k] for k in kinds)

    def count(t: Tables) -> DataFrame | None:
        if "coordinates" not in t:
            return None
        text = F.coalesce(F.nullif("raw", F.lit("")), F.col("value").cast("string"))
        known = text.isNotNull()
        faults = coordinate_faults(text, F.col("field"), least, most, letters)
        return _sums(t["coordinates"], known, sum((F.coalesce(f, F.lit(False)).cast("long") for f in faults), F.lit(0)))

    return count


def _codes(c: Mapping[str, Any]) -> Callable[[Tables], DataFrame | None]:
    def count(t: Tables) -> DataFrame | None:
        if "intervals" not in t or "code" not in t["intervals"].columns:
            return None
        return constraints.code_sequence(t["intervals"]).select("doc", "evaluated", (F.col("repeats") + F.col("jumps")).alias("violations"))

    return count


def _types(c: Mapping[str, Any]) -> Callable[[Tables], DataFrame | None]:
    value, raw, text = F.col("value").cast("string"), F.col("raw").cast("string"), F.col("kind") == "text"
    looked = F.when(text, value.isNotNull()).otherwise(F.coalesce(raw, value).isNotNull())
    wrong = F.when(text, value.rlike(ONLY_NUMBER)).otherwise(value.try_cast("decimal(38,12)").isNull() & F.coalesce(raw, value).rlike(GEOLOGICAL))
    return lambda t: _sums(t["typed"], looked, looked & wrong) if "typed" in t else None


_COUNTS: dict[str, Callable[[Mapping[str, Any]], Callable[[Tables], DataFrame | None]]] = {
    "depth_validity": _of_intervals("C1_depth_order"), "thickness_consistency": _of_intervals("C2_thickness"), "continuity": _of_intervals("C3_gap", "C3_overlap"), "monotonicity": _of_intervals("C4_monotone"),
    "final_depth_consistency": _of_intervals("C5_final_depth"), "groundwater_reasonableness": _water, "percentage_range": _percentages, "coordinate_format": _coordinates, "stratum_code_sequence": _codes, "field_type_consistency": _types,
}


def evaluate(tables: Tables, constraints_: list[Constraint] | None = None) -> DataFrame:
    """doc, constraint, severity, evaluated, violations, score, status over all constraints, their order in ``place``.

    Constraints on intervals are counted together, in one pass over one
    window.
    """
    asked = constraints_ or engine(default_config())
    out = None
    joint = [(place, c) for place, c in enumerate(asked) if isinstance(c.count, IntervalCount)]
    rows = _neighbours(tables) if joint else None
    if rows is not None:
        sums, told = [], []
        for place, c in joint:
            looked, violated = c.count.columns()
            sums += [F.sum(looked.cast("long")).alias(f"e{place}"), F.sum(violated.cast("long")).alias(f"v{place}")]
            told.append(F.struct(F.lit(place).alias("place"), F.lit(c.name).alias("constraint"), F.lit(c.severity).alias("severity"), F.col(f"e{place}").alias("evaluated"), F.col(f"v{place}").alias("violations")))
        out = rows.groupBy("doc").agg(*sums).select("doc", F.inline(F.array(*told)))
    for place, c in enumerate(asked):
        counted = None if isinstance(c.count, IntervalCount) else c.count(tables)
        if counted is not None:
            one = counted.select("doc", F.lit(place).alias("place"), F.lit(c.name).alias("constraint"), F.lit(c.severity).alias("severity"), F.col("evaluated").cast("long").alias("evaluated"), F.col("violations").cast("long").alias("violations"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no constraint has a table to look at")
    return out.withColumns({"score": constraints.score(F.col("evaluated"), F.col("violations")), "status": constraints.status(F.col("evaluated"), F.col("violations"))})


def load_config(text: str) -> list[Constraint]:
    """The constraints of a configuration told in JSON."""
    config = json.loads(text)
    if not isinstance(config, dict):
        raise ValueError("the configuration must be a mapping")
    return engine(config)

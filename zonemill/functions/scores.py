"""Score tables: lenient parsing, sentinel and suppression codes, classes and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonemill.functions.numbers import clamp, finite, finite_or_null
from zonemill.model import SCORE_SENTINEL

INSTITUTION = "institution-present-no-score"
INSUFFICIENT = "insufficient-data"


def source_value(text: Column) -> Column:
    """Number in a text cell; empty, non-numeric or infinite cells are null."""
    return finite_or_null(F.trim(text.cast("string")).try_cast("double"))


def official_number(text: Column) -> Column:
    """Published number; the suppression marks ``.`` and ``C`` and empty cells are null."""
    return F.when(~text.isin("", ".", "C"), source_value(text))


def score_status(value: Column) -> Column:
    return (F.when(value == SCORE_SENTINEL, INSTITUTION)
            .when(value.isNull(), INSUFFICIENT).otherwise("scored"))


def score_class(value: Column, status: Column) -> Column:
    """Render class: the nearest whole score, the institution mark, or ``no-data``."""
    nearest = F.concat(F.lit("score-"), F.floor(value + 0.5).cast("string"))
    return (F.when((value == SCORE_SENTINEL) | (status == INSTITUTION), INSTITUTION)
            .when((status != "scored") | ~finite(value.cast("double")), "no-data").otherwise(nearest))


def metric_value(metric: Column, final: Column, heat: Column, vulnerability: Column) -> Column:
    """Selected score; an unknown metric name means the final score."""
    return F.when(metric == "heat", heat).when(metric == "vulnerability", vulnerability).otherwise(final)


def metric_status(value: Column, record_status: Column) -> Column:
    inside = finite(value.cast("double")) & value.between(0, 10)
    return (F.when((value == SCORE_SENTINEL) | (record_status == INSTITUTION), INSTITUTION)
            .when(~inside, INSUFFICIENT).otherwise("scored"))


def interpretation(value: Column, status: Column) -> Column:
    return (F.when(status == INSTITUTION, "institution")
            .when((status != "scored") | ~finite(value.cast("double")), "insufficient")
            .when(value <= 2, "low").when(value <= 4, "rather-low").when(value <= 6, "medium")
            .when(value <= 8, "high").otherwise("very-high"))


def score_percentage(value: Column) -> Column:
    return F.when(finite(value.cast("double")), clamp(value.cast("double") * 10.0, 0.0, 100.0)).otherwise(0.0)


def asymmetry(value: Column) -> Column:
    return (F.when(~finite(value) | (F.abs(value) < 1), "balanced")
            .when(value > 0, "right").otherwise("left"))


def component_map(columns: dict[str, Column]) -> Column:
    """Map of component scores keyed by component name."""
    return F.create_map(*[item for key, value in columns.items() for item in (F.lit(key), value.cast("double"))])

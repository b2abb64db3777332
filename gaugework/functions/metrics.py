"""Coupling and risk metrics as column expressions. A zero denominator gives 0, never an error or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_INSTABILITY = LOW_ABSTRACTNESS = 0.2


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") * 100.0 / whole)


def instability(ca: Column, ce: Column) -> Column:
    return ratio(ce, ca + ce)


def abstractness(abstract: Column, concrete: Column) -> Column:
    return ratio(abstract, abstract + concrete)


def main_sequence_distance(a: Column, i: Column) -> Column:
    return F.abs(a + i - 1)


def stable_low_abstraction(ca: Column, i: Column, a: Column) -> Column:
    return (ca > 0) & (i <= LOW_INSTABILITY) & (a <= LOW_ABSTRACTNESS)


def crap_score(complexity: Column, coverage_percent: Column) -> Column:
    missed = F.lit(1.0) - coverage_percent / 100.0
    return complexity * complexity * missed * missed * missed + complexity


def passes(comparison: Column, actual: Column, limit: Column) -> Column:
    return F.when(comparison == "minimum", actual >= limit).when(comparison == "maximum", actual <= limit).otherwise(False)

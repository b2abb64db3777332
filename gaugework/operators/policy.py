"""Dependency policies over relationships, and path policies that give thresholds to metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.errors import ValidationError
from gaugework.functions.globs import glob_regex, selected
from gaugework.functions.metrics import passes
from gaugework.operators import rules as R
from gaugework.schemas import COMPARISONS, SEVERITIES

# Fixed value: the text of a finding.
PROHIBITED = 'Dependency rule "%s" prohibits this relationship: %s'



@dataclass(frozen=True)
class Selector:
    """All attributes must hold, any value of an attribute does; an empty list is every value."""

    ids: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    applications: tuple[str, ...] = ()

    def holds(self, c: dict[str, Column]) -> Column:
        tests = [c[k].isin(*v) for k, v in (("id", self.ids), ("role", self.roles), ("category", self.categories), ("application", self.applications)) if v]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class DependencyRule:
    id: str
    source: Selector = Selector()
    target: Selector = Selector()
    reason: str = ""
    same_application: bool = False

    def holds(self, s: dict[str, Column], t: dict[str, Column]) -> Column:
        out = self.source.holds(s) & self.target.holds(t)
        return out & (s["application"] != "") & (s["application"] == t["application"]) if self.same_application else out


@dataclass(frozen=True)
class DependencyPolicy:
    production_allowed: bool = True
    test_allowed: bool = True
    allow: tuple[DependencyRule, ...] = ()
    deny: tuple[DependencyRule, ...] = ()

    def __post_init__(self):
        ids = [r.id for r in (*self.allow, *self.deny)]
        if len(set(ids)) < len(ids) or not all(i and i == i.strip() for i in ids):
            raise ValidationError("dependency rules need distinct, non-empty ids")

    @property
    def noop(self) -> bool:
        return self.production_allowed and self.test_allowed and not self.allow and not self.deny

    def cache_key(self, base: str) -> str:
        """The key of results under this policy; a policy that changes nothing keeps the base key."""
        import hashlib

        return base if self.noop else hashlib.sha256(f"{base}\n{self!r}".encode()).hexdigest()


def stale_rules(components: DataFrame, policy: DependencyPolicy) -> DataFrame:
    """(rule, side) of each selector that matches no component."""
    columns = {c: F.col(c) for c in ("id", "role", "category", "application")}
    sides = [(r.id, side, getattr(r, side).holds(columns)) for r in (*policy.allow, *policy.deny) for side in ("source", "target")]
    if not sides:
        return components.sparkSession.createDataFrame([], "rule string, side string")
    counts = components.agg(*(F.count_if(test).alias(f"c{k}") for k, (_, _, test) in enumerate(sides)))
    rows = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(side).alias("side"), F.col(f"c{k}").alias("n")) for k, (rule, side, _) in enumerate(sides))))
    return counts.select(rows.alias("x")).select("x.*").filter("n = 0").select("rule", "side")


def configured_findings(rels: DataFrame, components: DataFrame, policy: DependencyPolicy) -> DataFrame:
    """Relationships, test-only ones too, that a rule denies or that neither a default nor a rule allows.

    Of the denying rules the first in order is named; a denial wins over any grant.
    """
    joined, s, t = R.with_ends(rels, components)
    denial = F.coalesce(*(F.when(r.holds(s, t), F.struct(F.lit(r.id).alias("id"), F.lit(r.reason).alias("reason"))) for r in policy.deny)) if policy.deny else F.lit(None).cast("struct<id:string,reason:string>")
    granted = reduce(lambda a, b: a | b, (r.holds(s, t) for r in policy.allow), F.lit(False))
    default = F.when(F.col("test_only"), F.lit(policy.test_allowed)).otherwise(F.lit(policy.production_allowed))
    rows = joined.withColumn("denial", denial).filter(F.col("denial").isNotNull() | ~(default | granted))
    message = F.when(F.col("denial").isNotNull(), F.format_string(PROHIBITED, F.col("denial.id"), F.col("denial.reason"))).otherwise("The configured dependency policy does not grant this relationship.")
    return R.finding(rows, R.CONFIGURED, "error", F.concat_ws(" -> ", "source", "target"), message, F.col("source"), F.col("target"))


@dataclass(frozen=True)
class Threshold:
    metric: str
    comparison: str
    value: float
    severity: str = "error"

    def __post_init__(self):
        if not self.metric or self.comparison not in COMPARISONS or self.severity not in SEVERITIES or not math.isfinite(self.value):
            raise ValidationError(f"threshold of {self.metric!r} isn't valid", threshold=self)


@dataclass(frozen=True)
class PathPolicy:
    id: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    thresholds: tuple[Threshold, ...] = field(default_factory=tuple)

    def __post_init__(self):
        metrics = [t.metric for t in self.thresholds]
        if not self.id or self.id != self.id.strip() or not self.thresholds or len(set(metrics)) < len(metrics):
            raise ValidationError(f"policy {self.id!r} needs an id and one threshold for each of its metrics", policy=self.id)
        for p in (*self.include, *self.exclude):
            glob_regex(p)


def validated(policies: list[PathPolicy]) -> list[PathPolicy]:
    ids = [p.id for p in policies]
    if len(set(ids)) < len(ids):
        raise ValidationError("policies need distinct ids")
    return policies


def resolve(metrics: DataFrame, policies: list[PathPolicy], path: Column | None = None) -> DataFrame:
    """Metric rows with ``candidates``, the thresholds of all policies that select their path and name their metric.

    Policies are configuration, so they become one expression per row: no join. ``threshold`` is the one candidate; a
    row with several is ambiguous, which ``ambiguous`` reports.
    """
    path = F.col("path") if path is None else path
    kind = "struct<policy:string,comparison:string,value:double,severity:string>"
    found = [
        F.when(selected(path, list(p.include), list(p.exclude)) & (F.col("name") == t.metric), F.struct(F.lit(p.id).alias("policy"), F.lit(t.comparison).alias("comparison"), F.lit(float(t.value)).alias("value"), F.lit(t.severity).alias("severity")))
        for p in validated(policies)
        for t in p.thresholds
    ]
    candidates = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{kind}>")
    return metrics.withColumn("candidates", candidates).withColumn("threshold", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))))


def ambiguous(resolved: DataFrame) -> DataFrame:
    """Metric rows that several policies select, with the sorted ids of these."""
    return resolved.filter(F.size("candidates") > 1).withColumn("policies", F.array_join(F.array_sort(F.col("candidates.policy")), ", ")).drop("candidates", "threshold")


def violations(resolved: DataFrame) -> DataFrame:
    """Metric rows whose value fails their threshold."""
    t = F.col("threshold")
    return resolved.filter(t.isNotNull() & ~passes(t["comparison"], F.col("value"), t["value"]))

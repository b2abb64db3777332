"""Architecture rules: predicates over cycles, diagnostics, components, and relationships joined with both their ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.checkpoint import cut
from gaugework.operators import closure as G
from gaugework.operators.components import ComponentGraph

FINDING = ("rule", "severity", "subject", "message", "source", "target", "components", "metrics")
#: Largest estimate of a table of components that is sent to every task.
BROADCAST_ROWS = 100_000

Theta = Callable[[dict[str, Column], dict[str, Column]], Column]

# Identifiers and messages of the rules over relationships.
EDGE_RULES: list[tuple[str, str, Theta]] = [
    ("stable-dependency-principle", "The source component imports a less stable target component.", lambda s, t: t["instability"] > s["instability"]),
    ("production-imports-development", "Production code imports development code.", lambda s, t: (s["role"] != "development") & (t["role"] == "development")),
    (
        "library-imports-feature",
        "A shared library imports application or module code.",
        lambda s, t: (s["role"] == "library") & t["role"].isin("application", "application-module", "shared-module"),
    ),
    (
        "shared-component-imports-application",
        "A shared component imports application-specific code.",
        lambda s, t: s["role"].isin("shared-module", "infrastructure") & t["role"].isin("application", "application-module"),
    ),
    (
        "cross-application-module-import",
        "An application module imports a module from another application.",
        lambda s, t: (s["role"] == "application-module") & (t["role"] == "application-module") & (s["application"] != t["application"]),
    ),
]
CYCLE, DIAGNOSTIC, LOW_ABSTRACTION = "dependency-cycle", "source-diagnostic", "stable-component-low-abstraction"
CONFIGURED = "configured-dependency"


def no_metrics() -> Column:
    return F.create_map().cast("map<string,double>")


def finding(df: DataFrame, rule: str | Column, severity: str, subject: Column, message: str | Column, source: Column | None = None, target: Column | None = None, components: Column | None = None, metrics: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (lit(rule), F.lit(severity), subject, lit(message), source if source is not None else F.lit(""), target if target is not None else F.lit(""),
              components if components is not None else F.array().cast("array<string>"), metrics if metrics is not None else no_metrics())
    return df.select(*(v.alias(n) for v, n in zip(values, FINDING, strict=True)))


def with_ends(rels: DataFrame, components: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Relationships joined with their source and target component; the number of components decides on sending them."""
    few = components.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = lambda p: (F.broadcast if few else lambda x: x)(components.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "role", "category", "application", "instability"))))
    joined = rels.join(side("s"), F.col("source") == F.col("s_id")).join(side("t"), F.col("target") == F.col("t_id"))
    columns = lambda p: {c: F.col(f"{p}_{c}") for c in ("id", "role", "category", "application", "instability")}
    return joined, columns("s"), columns("t")


def cycle_findings(cycle_members: DataFrame) -> DataFrame:
    c = G.cycles(cycle_members)
    return finding(c, CYCLE, "error", F.array_join("members", " -> "), "Production dependencies form a cycle.", components=F.col("members"), metrics=F.create_map(F.lit("componentCount"), F.col("size").cast("double")))


def diagnostic_findings(diagnostics: DataFrame) -> DataFrame:
    return finding(diagnostics, DIAGNOSTIC, "error", F.col("path"), F.col("message"))


def low_abstraction_findings(components: DataFrame) -> DataFrame:
    pairs = [("abstractness", "abstractness"), ("afferentCoupling", "afferent"), ("efferentCoupling", "efferent"), ("instability", "instability"), ("mainSequenceDistance", "distance")]
    values = F.create_map(*(x for name, c in pairs for x in (F.lit(name), F.col(c).cast("double"))))
    return finding(components.filter("stable_low_abstraction"), LOW_ABSTRACTION, "warning", F.col("id"), "One or more production components import this stable component, which has low abstraction.", metrics=values)


def edge_findings(rels: DataFrame, components: DataFrame, rules: list[tuple[str, str, Theta]] = EDGE_RULES) -> DataFrame:
    """One finding for each rule that a production relationship violates. The relationships are joined once for all rules."""
    joined, s, t = with_ends(rels.filter(~F.col("test_only")), components)
    violated = F.array_compact(F.array(*(F.when(theta(s, t), F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"))) for rule, message, theta in rules)))
    rows = joined.withColumn("v", F.explode(violated))
    values = F.when(F.col("v.rule") == EDGE_RULES[0][0], F.create_map(F.lit("sourceInstability"), s["instability"], F.lit("targetInstability"), t["instability"])).otherwise(no_metrics())
    return finding(rows, F.col("v.rule"), "warning", F.concat_ws(" -> ", "source", "target"), F.col("v.message"), F.col("source"), F.col("target"), metrics=values)


def evaluate(graph: ComponentGraph, diagnostics: DataFrame | None = None) -> DataFrame:
    """All findings of the default rules; in order when sorted by rule, subject, source, target, message."""
    out = cycle_findings(graph.cycle_members).unionByName(low_abstraction_findings(graph.components)).unionByName(edge_findings(graph.relationships, graph.components))
    return out if diagnostics is None else out.unionByName(diagnostic_findings(diagnostics))


def written_back(rels: DataFrame, findings: DataFrame) -> DataFrame:
    """Production relationships with the sorted names of the rules they violate; test-only ones have none."""
    per = findings.filter("source <> '' and target <> ''").groupBy(F.col("source").alias("fs"), F.col("target").alias("ft")).agg(F.sort_array(F.collect_set("rule")).alias("found"))
    out = rels.join(per, (F.col("source") == F.col("fs")) & (F.col("target") == F.col("ft")) & ~F.col("test_only"), "left").drop("fs", "ft")
    out = out.withColumn("rule_violations", F.coalesce("found", F.array().cast("array<string>"))).drop("found")
    return out.withColumn("violates_sdp", F.array_contains("rule_violations", EDGE_RULES[0][0]))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule", "subject", "source", "target", "message")


def cached(findings: DataFrame) -> DataFrame:
    return cut(findings)

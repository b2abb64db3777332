"""The query layer: filter, sort with a total order, count what matched, limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.errors import NotFoundError, ValidationError
from gaugework.schemas import GRAPH_SEVERITIES, ROLES, SOURCE_KINDS


@dataclass
class Selection:
    """``rows`` after the limit; ``matched`` is a row with the number before it."""

    rows: DataFrame
    matched: DataFrame

    def counts(self) -> DataFrame:
        return self.matched.crossJoin(self.rows.agg(F.count("*").alias("returned")))  # two rows of one row each


def limit_of(n: int) -> int:
    if n < 0:
        raise ValidationError(f"the limit {n} is negative")
    return n


def one_of(value: str, allowed, what: str) -> str:
    if value not in allowed:
        raise ValidationError(f"{what} {value!r} isn't one of {', '.join(allowed)}")
    return value


def select_rows(df: DataFrame, matches: Column | None, order: list[Column | str], limit: int = 0) -> Selection:
    """Limit 0 is no limit. ``order`` must end in a key, so that equal rows have one order."""
    found = df if matches is None else df.filter(matches)
    rows = found.orderBy(*order)
    return Selection(rows.limit(limit_of(limit)) if limit_of(limit) else rows, found.agg(F.count("*").alias("matched")))


COMPONENT_SORTS = {
    "identifier": None, "afferent": "afferent", "efferent": "efferent", "importers": "transitive_importers", "dependencies": "transitive_dependencies", "instability": "instability", "abstractness": "abstractness",
    "distance": "distance", "files": "source_files",
}
FUNCTION_SORTS = {
    "identifier": (), "incoming-call-sites": ("incoming_call_sites", "test_incoming_call_sites"), "outgoing-call-sites": ("outgoing_call_sites", "test_outgoing_call_sites"), "afferent": ("afferent", "test_afferent"),
    "efferent": ("efferent", "test_efferent"), "transitive-callers": ("transitive_callers",), "transitive-callees": ("transitive_callees",), "instability": ("instability",),
}
OVERVIEW = [
    "id", "name", "role", "category", "application", "source_files", "afferent", "efferent", "direct_importers", "transitive_importers", "using_application_count", "instability", "abstractness", "distance",
    "stable_low_abstraction", "in_cycle",
]


def components(df: DataFrame, role: str = "", category: str = "", sort: str = "afferent", limit: int = 20) -> Selection:
    if role:
        one_of(role, ROLES, "role")
    key = COMPONENT_SORTS[one_of(sort, COMPONENT_SORTS, "sort")]
    wanted = F.lit(True) if not role else F.col("role") == role
    wanted = wanted if not category else wanted & (F.col("category") == category)
    return select_rows(df.select(*OVERVIEW, "transitive_dependencies"), wanted, ([F.col(key).desc()] if key else []) + ["id"], limit)


def findings(df: DataFrame, severity: str = "all", rule: str = "", component: str = "", limit: int = 0) -> Selection:
    one_of(severity, ("all", *GRAPH_SEVERITIES), "severity")
    wanted = F.lit(True) if severity == "all" else F.col("severity") == severity
    if rule:
        wanted = wanted & (F.col("rule") == rule)
    if component:
        c = F.lit(component)
        wanted = wanted & ((F.col("subject") == c) | (F.col("source") == c) | (F.col("target") == c) | F.array_contains("components", component))
    return select_rows(df, wanted, ["rule", "subject", "source", "target", "message"], limit)


def functions(df: DataFrame, component: str = "", package: str = "", sort: str = "incoming-call-sites", include_tests: bool = False, limit: int = 20) -> Selection:
    keys = FUNCTION_SORTS[one_of(sort, FUNCTION_SORTS, "sort")]
    wanted = F.lit(True) if include_tests else ~F.col("test")
    wanted = wanted if not component else wanted & (F.col("component") == component)
    wanted = wanted if not package else wanted & (F.col("package") == package)
    key = sum((F.col(k) for k in (keys if include_tests else keys[:1])), F.lit(0)) if keys else None
    return select_rows(df, wanted, ([key.desc()] if key is not None else []) + ["id"], limit)


def calls(df: DataFrame, source_component: str = "", target_component: str = "", source: str = "", target: str = "", include_tests: bool = False, limit: int = 50) -> tuple[Selection, DataFrame]:
    """The calls, and the number of call sites of the calls that are returned."""
    wanted = F.lit(True) if include_tests else ~F.col("test")
    for c, v in (("source_component", source_component), ("target_component", target_component), ("source", source), ("target", target)):
        wanted = wanted & (F.col(c) == v) if v else wanted
    found = select_rows(df, wanted, ["source", "target", "test"], limit)
    return found, found.rows.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("call_sites"))


def existing(df: DataFrame, ident: str, what: str) -> DataFrame:
    found = df.filter(F.col("id") == ident)
    if found.isEmpty():
        raise NotFoundError(f"there is no {what} {ident!r}", id=ident)
    return found


def component_detail(graph, finds: DataFrame, functions_: DataFrame, calls_: DataFrame, ident: str) -> dict[str, DataFrame]:
    rels = graph.relationships
    return {
        "component": existing(graph.components, ident, "component"),
        "dependencies": rels.filter(F.col("source") == ident),
        "importers": rels.filter(F.col("target") == ident),
        "functions": functions_.filter(F.col("component") == ident),
        "calls": calls_.filter((F.col("source_component") == ident) | (F.col("target_component") == ident)),
        "findings": findings(finds, component=ident).rows,
    }


def function_detail(functions_: DataFrame, calls_: DataFrame, ident: str, include_tests: bool = False) -> dict[str, DataFrame]:
    visible = calls_ if include_tests else calls_.filter(~F.col("test"))
    return {"function": existing(functions_, ident, "function"), "incoming": visible.filter(F.col("target") == ident), "outgoing": visible.filter(F.col("source") == ident)}


def text_search(df: DataFrame, role: str = "", text: str = "") -> DataFrame:
    wanted = F.lit(True) if not role else F.col("role") == role
    return df.filter(wanted & F.contains(F.lower(F.concat_ws(" ", "id", "name", "category", "application")), F.lit(text.strip().lower())))


def source_kind(kind: str) -> Column:
    test, gen = F.col("test"), F.col("generated")
    return {"all": F.lit(True), "handwritten": ~test & ~gen, "test": test, "generated": gen}[one_of(kind, SOURCE_KINDS, "source kind")]

"""Evidence: long tables of metrics and findings, their validation, and the catalogue of evaluators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.errors import AlreadyExistsError, NotFoundError, PreconditionFailedError, ValidationError
from gaugework.functions.checkpoint import cut
from gaugework.schemas import SEVERITIES


@dataclass
class Report:
    """What an evaluator gives: (id, path, name, value, unit) and (id, rule, path, severity, message, actual, limit)."""

    name: str
    metrics: DataFrame
    findings: DataFrame


def metric(df: DataFrame, ident: Column, path: Column, name: Column | str, value: Column, unit: str = "") -> DataFrame:
    return df.select(ident.alias("id"), path.alias("path"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))


def finding(df: DataFrame, ident: Column, rule: Column | str, path: Column, severity: Column | str, message: Column, actual: Column | None = None, limit: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("double")
    return df.select(ident.alias("id"), lit(rule).alias("rule"), path.alias("path"), lit(severity).alias("severity"), message.alias("message"), (none if actual is None else actual.cast("double")).alias("actual"), (none if limit is None else limit.cast("double")).alias("limit"))


def problems(report: Report) -> DataFrame:
    """(table, id, problem) of every row that breaks the contract of evidence."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    m = report.metrics.select(F.lit("metrics").alias("table"), "id", F.when(F.coalesce("id", F.lit("")) == "", "empty id").when(F.coalesce("name", F.lit("")) == "", "empty name").when(F.col("value").isNull() | bad(F.col("value")), "value not finite").alias("problem"))
    f = report.findings.select(
        F.lit("findings").alias("table"), "id",
        F.when(F.coalesce("id", F.lit("")) == "", "empty id").when(F.coalesce("rule", F.lit("")) == "", "empty rule").when(F.coalesce("message", F.lit("")) == "", "empty message").when(~F.coalesce(F.col("severity"), F.lit("")).isin(*SEVERITIES), "unknown severity")
        .when(F.coalesce(bad(F.col("actual")), F.lit(False)) | F.coalesce(bad(F.col("limit")), F.lit(False)), "value not finite").alias("problem"),
    )
    twice = [d.groupBy("id").count().filter("count > 1").select(F.lit(t).alias("table"), "id", F.lit("repeated id").alias("problem")) for t, d in (("metrics", report.metrics), ("findings", report.findings))]
    return m.filter("problem is not null").unionByName(f.filter("problem is not null")).unionByName(twice[0]).unionByName(twice[1])


def validate(report: Report) -> Report:
    first = problems(report).agg(F.min(F.struct("table", "id", "problem")).alias("first")).first().first
    if first:
        raise ValidationError(f"{report.name} gives {first.table} {first.id!r} with {first.problem}", report=report.name)
    return report


def failing(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("failing"))


def check_summary(reports: list[Report]) -> DataFrame:
    """Counts of evaluators, metrics, findings and severities over all reports, as one row."""
    m = F.lit(len(reports)).cast("bigint")
    findings = reports[0].findings
    metrics = reports[0].metrics.select("id")
    for r in reports[1:]:
        findings, metrics = findings.unionByName(r.findings), metrics.unionByName(r.metrics.select("id"))
    f = findings.agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES))
    return metrics.agg(F.count("*").alias("metrics")).crossJoin(f).withColumn("plugins", m)  # two rows of one row each


def gate(findings: DataFrame, fail_on: str) -> None:
    """Raise if there is a finding of the given severity or a worse one; ``none`` never fails."""
    if fail_on not in ("none", "warning", "error"):
        raise ValidationError(f"unknown severity {fail_on!r}")
    levels = {"none": [], "warning": ["warning", "error"], "error": ["error"]}[fail_on]
    if levels and not findings.filter(F.col("severity").isin(*levels)).limit(1).isEmpty():
        raise PreconditionFailedError(f"there are findings of severity {' or '.join(levels)}")


def numbered(findings: DataFrame) -> DataFrame:
    """Architecture findings as evidence; a finding's id ends in its place in the order of rule, subject, source, target.

    Places are counted without moving all rows to one task: ranges of the order are sorted for themselves, and each gets
    the number of rows that lie before it.
    """
    order = ["rule", "subject", "source", "target", "message"]
    placed = place(findings, order)
    path = F.when(F.col("subject") == "", F.col("source")).otherwise(F.col("subject"))
    return finding(placed, F.concat(F.lit("architecture:"), F.col("rule"), F.lit(":"), F.col("place").cast("string")), F.col("rule"), path, F.col("severity"), F.col("message"))


def place(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0. Rows are ranged by the first keys, ranked within a range, and offset by what lies before."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select(F.col("__range").alias("__r"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__rank", inner).join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__range", "__r", "__rank", "__before")


Evaluator = Callable[[], Report]


@dataclass
class Catalog:
    """Evaluators by unique name; they run in the order of their names, and the first failure ends a run.

    A report is computed once, when it is validated; what counts or prints it reads the cut tables.
    """

    evaluators: dict[str, Evaluator] = field(default_factory=dict)

    def register(self, name: str, evaluator: Evaluator) -> None:
        if not name or name != name.strip():
            raise ValidationError(f"evaluator name {name!r} isn't valid")
        if name in self.evaluators:
            raise AlreadyExistsError(f"evaluator {name!r} is registered already")
        self.evaluators[name] = evaluator

    def names(self, wanted: list[str] | None = None) -> list[str]:
        for n in wanted or []:
            if n not in self.evaluators:
                raise NotFoundError(f"there is no evaluator {n!r}", evaluator=n)
        return sorted(set(wanted or self.evaluators))

    def run(self, wanted: list[str] | None = None) -> list[Report]:
        out = []
        for n in self.names(wanted):
            report = self.evaluators[n]()
            if report.name != n:
                raise ValidationError(f"evaluator {n!r} gave a report named {report.name!r}")
            out.append(validate(Report(n, cut(report.metrics), cut(report.findings))))
        return out

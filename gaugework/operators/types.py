"""Declared types: relations from other components, implementations of interfaces, diagram tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = (("implements", "implements"), ("embeds", "embeds"), ("references", "references"))


def relations(types: DataFrame) -> DataFrame:
    """(source, source_component, target, target_component, kind) of every reference of a type."""
    none = F.array().cast("array<struct<id:string,component:string>>")

    def tagged(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, none), lambda r: F.struct(r["id"].alias("target"), r["component"].alias("target_component"), F.lit(kind).alias("kind")))

    every = F.concat(*(tagged(column, kind) for column, kind in RELATIONS))
    return types.select(F.col("id").alias("source"), F.col("component").alias("source_component"), F.explode(every).alias("r")).select("source", "source_component", "r.*")


def incoming(types: DataFrame, component: str) -> DataFrame:
    """Relations that types of other components have with the types of one; in order by target, kind, source."""
    return relations(types).filter((F.col("target_component") == component) & (F.col("source_component") != component))


def incoming_counts(types: DataFrame) -> DataFrame:
    """Per type: the relations that come from outside of its component."""
    return relations(types).filter("source_component <> target_component").groupBy("target").agg(F.count("*").alias("incoming"))


def external_targets(types: DataFrame, component: str) -> DataFrame:
    """Distinct types of other components that the types of one refer to."""
    return relations(types).filter((F.col("source_component") == component) & (F.col("target_component") != component)).select(F.col("target").alias("id"), F.col("target_component").alias("component")).distinct()


def implementations(methods: DataFrame, interface_methods: DataFrame) -> DataFrame:
    """(type, interface) where the type has every method of the interface, by name and signature.

    Relational division: matched methods are counted against the interface's own number. Interfaces without methods are
    implemented by everything and left out. Generic interfaces come as facts of the tool chain.
    """
    wanted = interface_methods.distinct().toDF("interface", "i_method")
    sizes = wanted.groupBy("interface").agg(F.count("*").alias("n")).withColumnRenamed("interface", "i")
    matched = methods.distinct().join(wanted, F.col("method") == F.col("i_method")).filter("type <> interface").groupBy("type", "interface").agg(F.count("*").alias("matched"))
    return matched.join(sizes, (F.col("interface") == F.col("i")) & (F.col("matched") == F.col("n"))).select("type", "interface")


def without_embedded(types: DataFrame) -> DataFrame:
    """Types whose plain references don't repeat what they embed."""
    return types.withColumn("references", F.filter("references", lambda r: ~F.array_contains(F.col("embeds.id"), r["id"])))


def short_name(ident: Column) -> Column:
    return F.substring_index(ident, ".", -1)


def member_port(fields: Column, target: Column, embedded: Column) -> Column:
    """The first field, embedded or not as asked, whose type names the target as a word; null for none."""
    word = F.concat(F.lit(r"(^|\W)\Q"), short_name(target), F.lit(r"\E(\W|$)"))
    return F.get(F.filter(fields, lambda f: (f["embedded"] == embedded) & F.rlike(f["type"], word)), F.lit(0))["name"]


def member_rows(types: DataFrame) -> DataFrame:
    """Fields and methods as the rows of a class diagram: + for exported ones, - for others."""
    mark = lambda x: F.when(x["exported"], F.lit("+")).otherwise("-")
    fields = types.select("id", F.lit(0).alias("section"), F.posexplode("fields").alias("at", "m")).select("id", "section", "at", F.when(F.col("m.embedded"), F.concat(mark(F.col("m")), F.col("m.type"))).otherwise(F.concat(mark(F.col("m")), F.col("m.name"), F.lit(" "), F.col("m.type"))).alias("text"))
    methods = types.select("id", F.lit(1).alias("section"), F.posexplode("methods").alias("at", "m")).select("id", "section", "at", F.concat(mark(F.col("m")), F.col("m.name"), F.col("m.signature")).alias("text"))
    return fields.unionByName(methods)


def diagram_columns(sizes: DataFrame, most: int = 4) -> DataFrame:
    """Nodes (diagram, id, height) dealt in order of their id to the column that is least full, at most four.

    Each diagram is laid out for itself, one component's types at a time; placing one node needs all before it.
    """
    import pandas as pd

    from gaugework.functions.shipping import ship

    ship(sizes.sparkSession)

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        filled = [0.0] * min(most, max(1, len(pdf)))
        rows = []
        for r in pdf.sort_values("id").itertuples(index=False):
            k = filled.index(min(filled))
            rows.append((r.diagram, r.id, k, filled[k]))
            filled[k] += float(r.height)
        return pd.DataFrame(rows, columns=["diagram", "id", "column", "top"])

    return sizes.select("diagram", "id", F.col("height").cast("double")).groupBy("diagram").applyInPandas(lay, "diagram string, id string, column long, top double")

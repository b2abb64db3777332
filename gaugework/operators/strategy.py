"""The strategic view: groups of components, weighted edges between them, layers and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.checkpoint import cut
from gaugework.operators import closure as G


def group_of(ident: Column) -> Column:
    """The first two segments of a path."""
    return F.substring_index(ident, "/", 2)


def grouped(rels: DataFrame) -> DataFrame:
    """Production relationships between different groups, with the groups."""
    rows = rels.filter(~F.col("test_only")).select("source", "target", group_of(F.col("source")).alias("source_group"), group_of(F.col("target")).alias("target_group"))
    return rows.filter("source_group <> target_group")


def report(components: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (id, components, layer, in_cycle) and edges (source, target, weight, cyclic)."""
    edges = cut(grouped(rels).groupBy(F.col("source_group").alias("source"), F.col("target_group").alias("target")).agg(F.count("*").alias("weight")))
    plain = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    sizes = components.groupBy(group_of(F.col("id")).alias("id")).agg(F.count("*").alias("components"))
    placed = cut(G.layers(sizes.select(F.col("id").alias("node")).union(plain.select("src")).union(plain.select("dst")), plain))
    n = placed.groupBy("unit").agg(F.count("*").alias("n")).withColumnRenamed("unit", "u")
    unit = placed.join(n, F.col("unit") == F.col("u")).select("node", "unit", "layer", (F.col("n") > 1).alias("in_cycle"))
    groups = unit.join(sizes, F.col("node") == F.col("id"), "left").select(F.col("node").alias("id"), F.coalesce("components", F.lit(0)).alias("components"), "layer", "in_cycle")
    s, t = unit.select(F.col("node").alias("n1"), F.col("unit").alias("u1")), unit.select(F.col("node").alias("n2"), F.col("unit").alias("u2"))
    marked = edges.join(s, F.col("source") == F.col("n1")).join(t, F.col("target") == F.col("n2")).select("source", "target", "weight", (F.col("u1") == F.col("u2")).alias("cyclic"))
    return groups, marked


def thin(edges: DataFrame, most: int) -> DataFrame:
    """Edges of little weight that lie on no cycle: the easiest to remove, lightest first."""
    return edges.filter(~F.col("cyclic") & (F.col("weight") <= most))


def cyclic_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of groups of one cycle that an edge joins."""
    return edges.filter("cyclic").select(F.least("source", "target").alias("first"), F.greatest("source", "target").alias("second")).distinct()


def behind(rels: DataFrame, source_group: str, target_group: str = "") -> DataFrame:
    """Component edges behind an ordered pair of groups, or behind all edges of one."""
    rows = grouped(rels)
    if target_group:
        return rows.filter((F.col("source_group") == source_group) & (F.col("target_group") == target_group))
    return rows.filter((F.col("source_group") == source_group) | (F.col("target_group") == source_group))


def neighbours(rels: DataFrame, components: DataFrame, ident: str) -> DataFrame:
    """Importers and dependencies of a component with their names and roles; unknown ones go by their id."""
    c = components.select(F.col("id").alias("c_id"), F.col("name").alias("c_name"), F.col("role").alias("c_role"))
    both = rels.filter(F.col("target") == ident).select(F.lit("importer").alias("direction"), F.col("source").alias("id"), "test_only").unionByName(rels.filter(F.col("source") == ident).select(F.lit("dependency").alias("direction"), F.col("target").alias("id"), "test_only"))
    return both.join(c, F.col("id") == F.col("c_id"), "left").select("direction", "id", F.coalesce("c_name", "id").alias("name"), F.coalesce("c_role", F.lit("")).alias("role"), "test_only")


def matrix(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their intensity against the heaviest, in the order of the source's layer."""
    most = edges.agg(F.max("weight").alias("most"))
    g = groups.select(F.col("id").alias("g"), "layer")
    return edges.crossJoin(F.broadcast(most)).join(g, F.col("source") == F.col("g"), "left").select("source", "target", "weight", "cyclic", "layer", (F.col("weight") / F.col("most")).alias("intensity"))  # most is one row

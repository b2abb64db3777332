"""Readings of the coupling metrics: zones, labels, ranking, histogram, map layout, component tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Zones in the order of their presentation, limits, and the width of a histogram bar.
ZONES = ["pain", "useless", "drifting", "balanced", "free", "isolated"]
ZONE_LIMIT, BALANCED_DISTANCE, BAR = 0.2, 0.3, 0.1
RANKED = 15
LAYOUT_NODES = 18


def zone() -> Column:
    ca, ce, i, a = F.col("afferent"), F.col("efferent"), F.col("instability"), F.col("abstractness")
    return (
        F.when((ca == 0) & (ce == 0), "isolated").when(ca == 0, "free").when((i <= ZONE_LIMIT) & (a <= ZONE_LIMIT), "pain")
        .when((i >= 1 - ZONE_LIMIT) & (a >= 1 - ZONE_LIMIT), "useless").when(F.col("distance") <= BALANCED_DISTANCE, "balanced").otherwise("drifting")
    )


def _label(value: Column, names: tuple[str, str, str, str]) -> Column:
    return F.when(value <= ZONE_LIMIT, names[0]).when(value < 0.5, names[1]).when(value < 1 - ZONE_LIMIT, names[2]).otherwise(names[3])


def stability_label(value: Column) -> Column:
    return _label(value, ("Stable", "Mostly stable", "Mostly unstable", "Unstable"))


def abstraction_label(value: Column) -> Column:
    return _label(value, ("Concrete", "Mostly concrete", "Mostly abstract", "Abstract"))


def readings(components: DataFrame) -> DataFrame:
    return components.withColumn("zone", zone()).withColumn("stability", stability_label(F.col("instability"))).withColumn("abstraction", abstraction_label(F.col("abstractness")))


def zone_counts(components: DataFrame) -> DataFrame:
    """Every zone with its number of components, empty ones too, and its place."""
    names = components.sparkSession.createDataFrame(list(enumerate(ZONES)), "place long, z string")
    counts = components.withColumn("zone", zone()).groupBy("zone").agg(F.count("*").alias("n"))
    return names.join(counts, F.col("z") == F.col("zone"), "left").select("place", F.col("z").alias("zone"), F.coalesce("n", F.lit(0)).alias("components"))


def ranking(components: DataFrame, limit: int = RANKED) -> DataFrame:
    """The unbalanced components of the greatest risk: distance times dependents. Names that repeat give way to ids."""
    rows = readings(components).filter(F.col("zone").isin(*ZONES[:3])).withColumn("risk", F.col("distance") * F.col("afferent")).orderBy(F.col("risk").desc(), "id").limit(limit)
    same = F.count("*").over(Window.partitionBy("name"))
    return rows.withColumn("label", F.when(same > 1, F.col("id")).otherwise(F.col("name"))).select("id", "name", "label", "zone", "distance", "afferent", "risk")


def bars(spark: SparkSession) -> DataFrame:
    """Bounds of the bars in binary fractions, as multiples of the width: a distance at 0.6 lies in none of them."""
    n = round(1 / BAR)
    return spark.createDataFrame([(k, k * BAR, k * BAR + BAR, k == n - 1) for k in range(n)], "bar long, low double, high double, last boolean")


def histogram(components: DataFrame) -> DataFrame:
    measured = components.withColumn("zone", zone()).filter(F.col("zone").isin("balanced", "drifting", "pain", "useless")).groupBy("distance").agg(F.count("*").alias("n"))
    b = F.broadcast(bars(components.sparkSession))  # ten rows
    inside = (F.col("distance") >= F.col("low")) & F.when(F.col("last"), F.col("distance") <= F.col("high")).otherwise(F.col("distance") < F.col("high"))
    counts = measured.join(b, inside).groupBy("bar").agg(F.sum("n").alias("components")).withColumnRenamed("bar", "found")
    return bars(components.sparkSession).join(counts, F.col("bar") == F.col("found"), "left").select("bar", "low", "high", F.coalesce("components", F.lit(0)).alias("components"))


def layout(components: DataFrame, limit: int = LAYOUT_NODES) -> DataFrame:
    """The most coupled components on a circle, by coupling and then id; a top-k feature."""
    top = components.withColumn("coupling", F.col("afferent") + F.col("efferent")).orderBy(F.col("coupling").desc(), "id").limit(limit)
    whole = Window.partitionBy(F.lit(1))
    rows = top.withColumn("place", F.row_number().over(whole.orderBy(F.col("coupling").desc(), "id")) - 1).withColumn("n", F.count("*").over(whole))
    angle = F.col("place") * (2 * math.pi) / F.col("n") - math.pi / 2
    radius = F.when(F.col("n") < 8, 33.0).otherwise(39.0)
    return rows.select("id", "coupling", F.col("place").cast("bigint").alias("place"), (F.lit(50.0) + radius * F.cos(angle)).alias("x"), (F.lit(50.0) + radius * F.sin(angle)).alias("y"))


def layout_edges(rels: DataFrame, placed: DataFrame) -> DataFrame:
    """Relationships both of whose ends are on the map."""
    s, t = placed.select(F.col("id").alias("s_id"), F.col("x").alias("x1"), F.col("y").alias("y1")), placed.select(F.col("id").alias("t_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return rels.join(F.broadcast(s), F.col("source") == F.col("s_id")).join(F.broadcast(t), F.col("target") == F.col("t_id")).select("source", "target", "test_only", "x1", "y1", "x2", "y2")


TABLE_SORTS = ("name", "role", "afferent", "efferent", "instability", "distance")


def table_order(column: str, descending: bool) -> list:
    return [F.col(column).desc() if descending else F.col(column).asc(), "id"]


def tree(components: DataFrame) -> DataFrame:
    """(path, label, component_id, parent, n_children) of the component tree; folders with one child and no component join it.

    Every prefix of an id is a folder. A folder stays if it is a component, or has several children, or none; the label
    of what stays is its path from the nearest folder above that stays.
    """
    parts = F.split("id", "/")
    prefixes = components.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    folders = prefixes.select("path").distinct().withColumn("up", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    children = folders.filter("up is not null").groupBy("up").agg(F.count("*").alias("n")).withColumnRenamed("up", "of")
    own = components.select(F.col("id").alias("own")).distinct()
    kept = folders.join(children, F.col("path") == F.col("of"), "left").join(own, F.col("path") == F.col("own"), "left").filter("own is not null or n > 1").select("path", F.coalesce("own", F.lit("")).alias("component_id"))
    above = kept.select(F.col("path").alias("a"))
    up = kept.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("prefix"))
    parent = up.join(above, F.col("prefix") == F.col("a")).groupBy(F.col("path").alias("p")).agg(F.max_by("a", F.length("a")).alias("parent"))
    rows = kept.join(parent, F.col("path") == F.col("p"), "left").drop("p")
    n = rows.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "q")
    rows = rows.join(n, F.col("path") == F.col("q"), "left").drop("q")
    label = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.substring("path", F.length("parent") + 2, F.length("path")))
    return rows.select("path", label.alias("label"), "component_id", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def ancestors(rows: DataFrame, ident: str) -> DataFrame:
    """Folders of the tree above a component."""
    return rows.filter((F.col("path") != ident) & F.lit(ident).startswith(F.concat("path", F.lit("/")))).select("path")

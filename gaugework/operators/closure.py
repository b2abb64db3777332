"""Reachability, strongly connected components and layers of directed graphs, as fixpoints of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.checkpoint import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-loops or null ends."""
    return edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path from src to dst; a node never reaches itself, not even in a cycle.

    Semi-naive: a round joins only the pairs that the round before found, so every pair is extended once, and each round's
    new pairs are a table of their own, so every pair is written once. Edges are first joined with themselves, which
    halves the rounds.
    """
    step = cut(adjacency(edges))
    twice = step.join(step.toDF("mid", "far"), F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst"))
    step = cut(step.union(twice).filter("src <> dst").distinct())
    rounds, new = [step], step
    hop = step.toDF("mid", "far")
    while not new.isEmpty():
        found = new.join(hop, F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst")).filter("src <> dst").distinct()
        old = reduce(DataFrame.union, rounds).toDF("old_src", "old_dst")
        new = cut(found.join(old, (F.col("src") == F.col("old_src")) & (F.col("dst") == F.col("old_dst")), "left_anti"))
        rounds.append(new)
    return reduce(DataFrame.union, rounds)


def core(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: nodes without an incoming or without an outgoing edge are peeled off until none is left."""
    edges = cut(adjacency(edges))
    while True:
        n = edges.count()
        sources, targets = edges.select(F.col("src").alias("s")).distinct(), edges.select(F.col("dst").alias("t")).distinct()
        edges = cut(edges.join(targets, F.col("src") == F.col("t"), "left_semi").join(sources, F.col("dst") == F.col("s"), "left_semi"))
        if edges.count() == n:
            return edges


def components_of(reach: DataFrame) -> DataFrame:
    """(node, cycle_id) of the strongly connected components of more than one node; the id is the smallest member."""
    back = reach.select(F.col("dst").alias("b"), F.col("src").alias("a"))
    mutual = reach.join(back, (F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))).select("src", "dst")
    return mutual.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("cycle_id"))


def strongly_connected(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """As components_of; a closure that is at hand saves that of the core."""
    return components_of(reach if reach is not None else closure(core(edges)))


def cycles(members: DataFrame) -> DataFrame:
    """One row per component: cycle_id, sorted members, size."""
    return members.groupBy("cycle_id").agg(F.sort_array(F.collect_list("node")).alias("members")).withColumn("size", F.size("members").cast("bigint"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path down to a node without edges, over the condensation; a cycle shares a layer."""
    edges = adjacency(edges)
    scc = cut(strongly_connected(edges))
    unit = cut(nodes.select("node").distinct().join(scc.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("cycle_id", "node").alias("unit")))
    a, b = unit.toDF("n1", "u1"), unit.toDF("n2", "u2")
    between = cut(edges.join(a, F.col("src") == F.col("n1")).join(b, F.col("dst") == F.col("n2")).select(F.col("u1").alias("src"), F.col("u2").alias("dst")).filter("src <> dst").distinct())
    rank = cut(unit.select(F.col("unit").alias("u")).distinct().withColumn("layer", F.lit(0).cast("bigint")))
    while True:
        above = between.join(rank, F.col("dst") == F.col("u")).groupBy("src").agg((F.max("layer") + 1).alias("up"))
        new = cut(rank.join(above, F.col("u") == F.col("src"), "left").select("u", F.coalesce("up", F.lit(0)).cast("bigint").alias("new"), "layer"))
        moved = not new.filter("new <> layer").isEmpty()
        rank = new.select("u", F.col("new").alias("layer"))
        if not moved:
            return unit.join(rank, F.col("unit") == F.col("u")).select("node", "unit", "layer")

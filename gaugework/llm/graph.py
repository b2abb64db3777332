"""Connected components over links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import cut


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its smallest node.

    Large-star and small-star rounds: each joins links with the minimum of a node's neighbours, so a round shuffles as
    many rows as there are links, minima are combined before the shuffle, and the number of rounds grows with the
    logarithm of the longest path. Links with a null end are dropped. Each round is cut in the checkpoint folder. A graph
    that isn't done after ``most_rounds`` is an error, not a partial result.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m")).toDF("w", "m")
        pairs = large.join(lower, F.col("a") == F.col("w"))
        small = pairs.select(F.col("a"), F.col("m").alias("b")).union(pairs.filter("b <> m").select(F.col("b"), F.col("m"))).toDF("a", "b").filter("a <> b").distinct()
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't final after {most_rounds} rounds")
    found = links.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(found, F.col("node") == F.col("a"), "left").select("node", F.coalesce("component", "node").alias("component"))

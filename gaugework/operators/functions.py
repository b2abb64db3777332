"""The function graph: declarations, call edges, coupling, reachability, and what it adds to components and relationships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.functions import metrics as M
from gaugework.functions.checkpoint import cut
from gaugework.operators import closure as G


def merged(declarations: DataFrame) -> DataFrame:
    """One declaration per id: in scope first, then the smallest place; an empty path comes last."""
    order = Window.partitionBy("id").orderBy(F.col("in_scope").desc(), (F.col("path") == "").asc(), "path", "line")
    return declarations.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def known_references(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """References both of whose ends are declared, with the components of the ends."""
    ends = declarations.select("id", "component")
    s, t = ends.toDF("sid", "source_component"), ends.toDF("tid", "target_component")
    return references.join(s, F.col("source") == F.col("sid")).join(t, F.col("target") == F.col("tid")).drop("sid", "tid")


def call_sites(known: DataFrame) -> DataFrame:
    """The distinct call sites of each call edge, as rows."""
    return known.select("source", "target", "test", "source_component", "target_component", "path", "line", "column").distinct()


def call_edges(known: DataFrame) -> DataFrame:
    """Per (source, target, test): the number of distinct call sites."""
    out = call_sites(known).groupBy("source", "target", "test", "source_component", "target_component").agg(F.count("*").alias("calls"))
    return out.withColumn("cross_component", F.col("source_component") != F.col("target_component"))


def call_site_totals(known: DataFrame) -> DataFrame:
    """Per function: raw references in and out, by kind; calls of itself count."""
    side = lambda c, inc: known.select(F.col(c).alias("id"), F.lit(inc).alias("incoming"), "test")
    both = side("target", True).union(side("source", False))
    n = lambda inc, test: F.count_if((F.col("incoming") == inc) & (F.col("test") == test))
    return both.groupBy("id").agg(n(True, False).alias("incoming_call_sites"), n(False, False).alias("outgoing_call_sites"), n(True, True).alias("test_incoming_call_sites"), n(False, True).alias("test_outgoing_call_sites"))


def coupling(known: DataFrame) -> DataFrame:
    """Per function: distinct callers and callees, by kind and across components; a function isn't its own caller."""
    pairs = known.filter("source <> target").select("source", "target", "test", (F.col("source_component") != F.col("target_component")).alias("cross")).distinct()
    ends = pairs.select(F.col("target").alias("id"), F.lit(True).alias("incoming"), "test", "cross").union(pairs.select("source", F.lit(False), "test", "cross"))
    n = lambda inc, test: F.count_if((F.col("incoming") == inc) & (F.col("test") == test))
    cross = lambda inc: F.count_if((F.col("incoming") == inc) & ~F.col("test") & F.col("cross"))
    return ends.groupBy("id").agg(
        n(True, False).alias("afferent"), n(False, False).alias("efferent"), n(True, True).alias("test_afferent"), n(False, True).alias("test_efferent"),
        cross(True).alias("cross_component_callers"), cross(False).alias("cross_component_callees"),
    )


def production_edges(known: DataFrame) -> DataFrame:
    return known.filter(~F.col("test")).select(F.col("source").alias("src"), F.col("target").alias("dst"))


@dataclass
class FunctionGraph:
    functions: DataFrame
    calls: DataFrame
    known: DataFrame
    reach: DataFrame
    cycle_members: DataFrame


def build(declarations: DataFrame, references: DataFrame, descriptors: DataFrame) -> FunctionGraph:
    one = cut(merged(declarations))
    known = cut(known_references(references, one))
    reach = G.closure(production_edges(known))
    members = cut(G.components_of(reach))
    callees = reach.groupBy("src").agg(F.count("*").alias("transitive_callees"))
    callers = reach.groupBy("dst").agg(F.count("*").alias("transitive_callers"))
    owner = one.select(F.col("id").alias("fid"), "component").join(descriptors.filter("application <> ''").select(F.col("id").alias("cid"), "application"), F.col("component") == F.col("cid")).select("fid", "application")
    users = reach.select(F.col("dst").alias("used"), F.col("src").alias("user")).union(one.select("id", "id"))
    apps = users.join(owner, F.col("user") == F.col("fid")).groupBy("used").agg(F.sort_array(F.collect_set("application")).alias("using_applications"))
    named = lambda df, key: df.withColumnRenamed(key, f"k_{key}")
    rows = one
    for df, key in ((call_site_totals(known), "id"), (coupling(known), "id")):
        other = df.withColumnRenamed(key, "__k")
        rows = rows.join(other, F.col("id") == F.col("__k"), "left").drop("__k")
    rows = rows.join(named(callees, "src"), F.col("id") == F.col("k_src"), "left").join(named(callers, "dst"), F.col("id") == F.col("k_dst"), "left").drop("k_src", "k_dst")
    rows = rows.join(apps, F.col("id") == F.col("used"), "left").drop("used").join(members.withColumnRenamed("node", "member"), F.col("id") == F.col("member"), "left")
    counts = [
        "incoming_call_sites", "outgoing_call_sites", "test_incoming_call_sites", "test_outgoing_call_sites", "afferent", "efferent", "test_afferent", "test_efferent", "cross_component_callers",
        "cross_component_callees", "transitive_callees", "transitive_callers",
    ]
    rows = rows.na.fill(0, counts).withColumn("in_cycle", F.col("member").isNotNull()).drop("member", "cycle_id")
    rows = rows.withColumn("using_applications", F.coalesce("using_applications", F.array().cast("array<string>"))).withColumn("using_application_count", F.size("using_applications").cast("bigint"))
    rows = rows.withColumn("instability", M.instability(F.col("afferent"), F.col("efferent")))
    return FunctionGraph(cut(rows), cut(call_edges(known)), known, reach, members)


def with_calls(rels: DataFrame, calls: DataFrame) -> DataFrame:
    """Relationships with the call sites between their components; calls without an import between them are dropped."""
    per = calls.filter("cross_component").groupBy("source_component", "target_component").agg(
        F.coalesce(F.sum(F.when(~F.col("test"), F.col("calls"))), F.lit(0)).alias("production_call_sites"), F.coalesce(F.sum(F.when(F.col("test"), F.col("calls"))), F.lit(0)).alias("test_call_sites"),
        F.countDistinct("source").alias("caller_functions"), F.countDistinct("target").alias("callee_functions"),
    )
    out = rels.join(per, (F.col("source") == F.col("source_component")) & (F.col("target") == F.col("target_component")), "left").drop("source_component", "target_component")
    return out.na.fill(0, ["production_call_sites", "test_call_sites", "caller_functions", "callee_functions"])


def component_calls(calls: DataFrame) -> DataFrame:
    """Per component: call sites in and out, by kind."""
    ends = calls.select(F.col("target_component").alias("component"), F.lit(True).alias("incoming"), "test", "calls").union(calls.select("source_component", F.lit(False), "test", "calls"))
    n = lambda inc, test: F.coalesce(F.sum(F.when((F.col("incoming") == inc) & (F.col("test") == test), F.col("calls"))), F.lit(0))
    return ends.groupBy("component").agg(n(True, False).alias("production_incoming"), n(False, False).alias("production_outgoing"), n(True, True).alias("test_incoming"), n(False, True).alias("test_outgoing"))


def component_functions(functions: DataFrame) -> DataFrame:
    """Per component: functions in scope, by kind."""
    return functions.filter("in_scope").groupBy("component").agg(F.count_if(~F.col("test")).alias("production_functions"), F.count_if("test").alias("test_functions"))

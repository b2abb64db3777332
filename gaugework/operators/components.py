"""The component graph: relationships, coupling, reachability and the components with their metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import metrics as M
from gaugework.functions.checkpoint import cut
from gaugework.operators import closure as G


def file_totals(files: DataFrame) -> DataFrame:
    """Per component: packages, files by kind, and types over production files alone."""
    return files.groupBy("component").agg(
        F.countDistinct("package").alias("packages"),
        F.countDistinct("path").alias("source_files"),
        F.countDistinct(F.when(~F.col("test"), F.col("path"))).alias("production_files"),
        F.countDistinct(F.when(F.col("test"), F.col("path"))).alias("test_files"),
        F.coalesce(F.sum(F.when(~F.col("test"), F.col("abstract_types"))), F.lit(0)).alias("abstract_types"),
        F.coalesce(F.sum(F.when(~F.col("test"), F.col("concrete_types"))), F.lit(0)).alias("concrete_types"),
    )


def relationships(imports: DataFrame) -> DataFrame:
    """Per (source, target): referencing files by kind and packages; imports within a component are none.

    A relationship is test-only if no production file has it. Files are counted once before relationships are, so no row
    is copied for a distinct count; the sets hold packages, not import sites, which stay rows (import_sites).
    """
    per_file = imports.filter("source <> target").groupBy("source", "target", "path").agg(
        F.bool_or(~F.col("test")).alias("production"), F.bool_or("test").alias("tested"), F.collect_set("source_package").alias("sp"), F.collect_set("target_package").alias("tp"), F.count("*").alias("n")
    )
    merged = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    return (
        per_file.groupBy("source", "target").agg(
            F.count_if("production").alias("production_files"), F.count_if("tested").alias("test_files"), merged("sp").alias("source_packages"), merged("tp").alias("target_packages"), F.sum("n").alias("sites"),
        ).withColumn("test_only", F.col("production_files") == 0)
    )


def import_sites(imports: DataFrame) -> DataFrame:
    """The import sites of relationships as rows; in order when sorted by all columns."""
    return imports.filter("source <> target").select("source", "target", "path", "line", "target_package", "alias", "source_package", "test")


def production_edges(rels: DataFrame) -> DataFrame:
    return rels.filter(~F.col("test_only")).select(F.col("source").alias("src"), F.col("target").alias("dst"))


def identifiers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Components that own a file or stand at either end of an import."""
    return files.select(F.col("component").alias("id")).union(imports.select("source")).union(imports.select("target")).distinct()


def coupling(ids: DataFrame, rels: DataFrame, imports: DataFrame) -> DataFrame:
    """Per component: dependencies and importers by kind, importer packages by kind."""
    outgoing = rels.groupBy("source").agg(
        F.count("*").alias("direct_dependencies"), F.count_if(~F.col("test_only")).alias("efferent"), F.count_if("test_only").alias("test_only_dependencies")
    )
    incoming = rels.groupBy("target").agg(F.count("*").alias("direct_importers"), F.count_if(~F.col("test_only")).alias("afferent"), F.count_if("test_only").alias("test_only_importers"))
    packages = imports.filter("source <> target").groupBy(F.col("target").alias("user"), "source_package").agg(F.bool_or(~F.col("test")).alias("production"), F.bool_or("test").alias("tested"))
    packages = packages.groupBy("user").agg(F.count("*").alias("importer_packages"), F.count_if("production").alias("production_importer_packages"), F.count_if("tested").alias("test_importer_packages"))
    joined = ids.join(outgoing, F.col("id") == F.col("source"), "left").join(incoming, F.col("id") == F.col("target"), "left").join(packages, F.col("id") == F.col("user"), "left")
    return joined.drop("source", "target", "user").na.fill(0)


def reach_counts(reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitive dependencies per source, transitive importers per target."""
    return (
        reach.groupBy("src").agg(F.count("*").alias("transitive_dependencies")),
        reach.groupBy("dst").agg(F.count("*").alias("transitive_importers")),
    )


def using_applications(ids: DataFrame, reach: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Applications of a component's transitive importers and its own; components of no application give none."""
    users = reach.select(F.col("dst").alias("used"), F.col("src").alias("user")).union(ids.select("id", "id"))
    apps = descriptors.filter("application <> ''").select(F.col("id").alias("owner"), "application")
    return users.join(apps, F.col("user") == F.col("owner")).groupBy("used").agg(F.sort_array(F.collect_set("application")).alias("using_applications"))


@dataclass
class ComponentGraph:
    components: DataFrame
    relationships: DataFrame
    reach: DataFrame
    cycle_members: DataFrame

    @property
    def cycles(self) -> DataFrame:
        return G.cycles(self.cycle_members)


def build(files: DataFrame, imports: DataFrame, descriptors: DataFrame) -> ComponentGraph:
    """All tables of the component graph, cut in the checkpoint folder once."""
    rels = cut(relationships(imports))
    ids = cut(identifiers(files, imports))
    reach = G.closure(production_edges(rels))
    members = cut(G.components_of(reach))
    forward, backward = reach_counts(reach)
    apps = using_applications(ids, reach, descriptors)
    d = descriptors.toDF(*(f"d_{c}" for c in descriptors.columns))
    t = file_totals(files)
    rows = (
        coupling(ids, rels, imports)
        .join(d, F.col("id") == F.col("d_id"), "left").join(t, F.col("id") == F.col("component"), "left").drop("component")
        .join(forward, F.col("id") == F.col("src"), "left").drop("src").join(backward, F.col("id") == F.col("dst"), "left").drop("dst")
        .join(apps, F.col("id") == F.col("used"), "left").drop("used")
        .join(members.withColumnRenamed("node", "member"), F.col("id") == F.col("member"), "left")
    )
    counts = ["packages", "source_files", "production_files", "test_files", "abstract_types", "concrete_types", "transitive_dependencies", "transitive_importers"]
    rows = rows.na.fill(0, counts)
    role = F.coalesce("d_role", F.lit(""))
    rows = rows.select(
        "id", F.coalesce("d_name", "id").alias("name"), role.alias("role"), F.when(F.coalesce("d_category", F.lit("")) == "", role).otherwise(F.col("d_category")).alias("category"),
        F.coalesce("d_application", F.lit("")).alias("application"), "packages", "source_files", "production_files", "test_files", "direct_dependencies", F.col("efferent"), "test_only_dependencies", "direct_importers",
        F.col("afferent"), "test_only_importers", "importer_packages", "production_importer_packages", "test_importer_packages", "transitive_dependencies", "transitive_importers",
        F.coalesce("using_applications", F.array().cast("array<string>")).alias("using_applications"), "abstract_types", "concrete_types", F.col("member").isNotNull().alias("in_cycle"),
    )
    rows = rows.withColumn("using_application_count", F.size("using_applications").cast("bigint")).withColumn("instability", M.instability(F.col("afferent"), F.col("efferent")))
    rows = rows.withColumn("abstractness", M.abstractness(F.col("abstract_types"), F.col("concrete_types"))).withColumn("distance", M.main_sequence_distance(F.col("abstractness"), F.col("instability")))
    rows = rows.withColumn("stable_low_abstraction", M.stable_low_abstraction(F.col("afferent"), F.col("instability"), F.col("abstractness")))
    return ComponentGraph(cut(rows), rels, reach, members)


def summary(components: DataFrame, rels: DataFrame, n_cycles: int, findings: DataFrame, functions: DataFrame | None = None, calls: DataFrame | None = None, n_function_cycles: int = 0) -> DataFrame:
    """The graph's counters as one row."""
    role = lambda r: F.count_if(F.col("role") == r)
    c = components.agg(
        F.count("*").alias("components"), role("application").alias("applications"), role("application-module").alias("application_modules"), role("shared-module").alias("shared_modules"),
        role("library").alias("libraries"), role("infrastructure").alias("infrastructure"), role("development").alias("development_tools"), F.count_if("stable_low_abstraction").alias("stable_low_abstraction_components"),
    )
    r = rels.agg(F.count("*").alias("relationships"), F.count_if(~F.col("test_only")).alias("production_relationships"), F.count_if("test_only").alias("test_only_relationships"))
    f = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = c.crossJoin(r).crossJoin(f).withColumn("cycles", F.lit(n_cycles).cast("bigint"))  # three rows of one row each
    if functions is not None and calls is not None:
        fn = functions.agg(F.count("*").alias("functions"), F.count_if(~F.col("test")).alias("production_functions"), F.count_if("test").alias("test_functions"))
        cl = calls.agg(F.count("*").alias("function_calls"), F.coalesce(F.sum("calls"), F.lit(0)).alias("function_call_sites"), F.coalesce(F.sum(F.when(F.col("cross_component"), F.col("calls"))), F.lit(0)).alias("cross_component_call_sites"))
        out = out.crossJoin(fn).crossJoin(cl).withColumn("function_cycles", F.lit(n_function_cycles).cast("bigint"))
    return out


def categories(components: DataFrame) -> DataFrame:
    return components.groupBy("category").agg(F.count("*").alias("components"))

"""Queries over the component and function graphs, rules, policies and the views of the console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import metrics as M
from gaugework.operators import balance as B
from gaugework.operators import closure as G
from gaugework.operators import components as C
from gaugework.operators import evidence as E
from gaugework.operators import functions as Fn
from gaugework.operators import policy as P
from gaugework.operators import query as Q
from gaugework.operators import rules as R
from gaugework.operators import strategy as S
from gaugework.operators import types as T
from gaugework.plans.registry import VIEWS, Context, query


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


VIEWS |= {
    "o_rel": """SELECT source, target, count(DISTINCT CASE WHEN NOT test THEN path END) AS production_files, count(DISTINCT CASE WHEN test THEN path END) AS test_files, count(*) AS sites,
        count(DISTINCT CASE WHEN NOT test THEN path END) = 0 AS test_only FROM {source_imports} WHERE source <> target GROUP BY source, target""",
    "o_edge": "SELECT source AS src, target AS dst FROM {o_rel} WHERE NOT test_only",
    "o_walk": "SELECT src, dst FROM {o_edge} UNION SELECT o_walk.src, o_edge.dst FROM o_walk JOIN o_edge ON o_walk.dst = o_edge.src",
    "o_reach": "SELECT src, dst FROM {o_walk} WHERE src <> dst",
    "o_scc": "SELECT a.src AS node, least(a.src, min(a.dst)) AS cycle_id FROM {o_reach} a JOIN {o_reach} b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
    "o_ids": "SELECT component AS id FROM {source_files} UNION SELECT source FROM {source_imports} UNION SELECT target FROM {source_imports}",
    "o_files": """SELECT component, count(DISTINCT package) AS packages, count(DISTINCT path) AS source_files, count(DISTINCT CASE WHEN NOT test THEN path END) AS production_files, count(DISTINCT CASE WHEN test THEN path END) AS test_files,
        coalesce(sum(CASE WHEN NOT test THEN abstract_types END), 0)::BIGINT AS abstract_types, coalesce(sum(CASE WHEN NOT test THEN concrete_types END), 0)::BIGINT AS concrete_types FROM {source_files} GROUP BY component""",
    "o_apps": """SELECT used, string_agg(DISTINCT application, ',' ORDER BY application) AS apps, count(DISTINCT application) AS n
        FROM (SELECT dst AS used, src AS who FROM {o_reach} UNION ALL SELECT id, id FROM {o_ids}) u JOIN {descriptors} d ON d.id = who WHERE application <> '' GROUP BY used""",
    "o_base": """SELECT i.id, coalesce(d.name, i.id) AS name, coalesce(d.role, '') AS role, CASE WHEN coalesce(d.category, '') = '' THEN coalesce(d.role, '') ELSE d.category END AS category, coalesce(d.application, '') AS application,
        coalesce(packages, 0) AS packages, coalesce(source_files, 0) AS source_files, coalesce(production_files, 0) AS production_files, coalesce(test_files, 0) AS test_files, coalesce(abstract_types, 0) AS abstract_types, coalesce(concrete_types, 0) AS concrete_types,
        (SELECT count(*) FROM {o_rel} WHERE source = i.id) AS direct_dependencies, (SELECT count(*) FROM {o_rel} WHERE source = i.id AND NOT test_only) AS efferent, (SELECT count(*) FROM {o_rel} WHERE source = i.id AND test_only) AS test_only_dependencies,
        (SELECT count(*) FROM {o_rel} WHERE target = i.id) AS direct_importers, (SELECT count(*) FROM {o_rel} WHERE target = i.id AND NOT test_only) AS afferent, (SELECT count(*) FROM {o_rel} WHERE target = i.id AND test_only) AS test_only_importers,
        (SELECT count(DISTINCT source_package) FROM {source_imports} s WHERE target = i.id AND source <> target) AS importer_packages,
        (SELECT count(DISTINCT source_package) FROM {source_imports} s WHERE target = i.id AND source <> target AND NOT test) AS production_importer_packages,
        (SELECT count(DISTINCT source_package) FROM {source_imports} s WHERE target = i.id AND source <> target AND test) AS test_importer_packages,
        (SELECT count(*) FROM {o_reach} WHERE src = i.id) AS transitive_dependencies, (SELECT count(*) FROM {o_reach} WHERE dst = i.id) AS transitive_importers,
        coalesce(apps, '') AS using_applications, coalesce(n, 0) AS using_application_count, i.id IN (SELECT node FROM {o_scc}) AS in_cycle
        FROM {o_ids} i LEFT JOIN {descriptors} d ON d.id = i.id LEFT JOIN {o_files} f ON f.component = i.id LEFT JOIN {o_apps} a ON a.used = i.id""",
    "o_rates": """SELECT *, CASE WHEN afferent + efferent = 0 THEN 0.0 ELSE efferent / (afferent + efferent)::DOUBLE END AS instability, CASE WHEN abstract_types + concrete_types = 0 THEN 0.0 ELSE abstract_types / (abstract_types + concrete_types)::DOUBLE END AS abstractness FROM {o_base}""",
    "o_comp": "SELECT *, abs(abstractness + instability - 1) AS distance, afferent > 0 AND instability <= 0.2 AND abstractness <= 0.2 AS stable_low_abstraction FROM {o_rates}",
    "o_cycles": "SELECT cycle_id, string_agg(node, ',' ORDER BY node) AS members, string_agg(node, ' -> ' ORDER BY node) AS subject, count(*) AS size FROM {o_scc} GROUP BY cycle_id",
    "o_ends": """SELECT r.source, r.target, r.test_only, s.role AS s_role, t.role AS t_role, s.application AS s_app, t.application AS t_app, s.instability AS s_i, t.instability AS t_i, s.category AS s_category, t.category AS t_category
        FROM {o_rel} r JOIN {o_comp} s ON s.id = r.source JOIN {o_comp} t ON t.id = r.target""",
    "o_edge_findings": """SELECT 'stable-dependency-principle' AS rule, 'The source component imports a less stable target component.' AS message, source, target FROM {o_ends} WHERE NOT test_only AND t_i > s_i
        UNION ALL SELECT 'production-imports-development', 'Production code imports development code.', source, target FROM {o_ends} WHERE NOT test_only AND s_role <> 'development' AND t_role = 'development'
        UNION ALL SELECT 'library-imports-feature', 'A shared library imports application or module code.', source, target FROM {o_ends} WHERE NOT test_only AND s_role = 'library' AND t_role IN ('application', 'application-module', 'shared-module')
        UNION ALL SELECT 'shared-component-imports-application', 'A shared component imports application-specific code.', source, target FROM {o_ends} WHERE NOT test_only AND s_role IN ('shared-module', 'infrastructure') AND t_role IN ('application', 'application-module')
        UNION ALL SELECT 'cross-application-module-import', 'An application module imports a module from another application.', source, target FROM {o_ends} WHERE NOT test_only AND s_role = 'application-module' AND t_role = 'application-module' AND s_app <> t_app""",
    "o_findings": """SELECT rule, 'warning' AS severity, source || ' -> ' || target AS subject, message, source, target, '' AS components FROM {o_edge_findings}
        UNION ALL SELECT 'dependency-cycle', 'error', subject, 'Production dependencies form a cycle.', '', '', members FROM {o_cycles}
        UNION ALL SELECT 'source-diagnostic', 'error', path, message, '', '', '' FROM {diagnostics}
        UNION ALL SELECT 'stable-component-low-abstraction', 'warning', id, 'One or more production components import this stable component, which has low abstraction.', '', '', '' FROM {o_comp} WHERE stable_low_abstraction""",
    "o_zone": """SELECT *, CASE WHEN afferent = 0 AND efferent = 0 THEN 'isolated' WHEN afferent = 0 THEN 'free' WHEN instability <= 0.2 AND abstractness <= 0.2 THEN 'pain' WHEN instability >= 0.8 AND abstractness >= 0.8 THEN 'useless'
        WHEN distance <= 0.3 THEN 'balanced' ELSE 'drifting' END AS zone FROM {o_comp}""",
    "o_decl": "SELECT * FROM {function_declarations} QUALIFY row_number() OVER (PARTITION BY id ORDER BY in_scope DESC, path = '', path, line) = 1",
    "o_known": "SELECT r.*, s.component AS source_component, t.component AS target_component FROM {function_references} r JOIN {o_decl} s ON s.id = r.source JOIN {o_decl} t ON t.id = r.target",
    "o_calls": """SELECT source, target, test, source_component, target_component, count(DISTINCT path || ':' || line || ':' || "column") AS calls, source_component <> target_component AS cross_component FROM {o_known} GROUP BY source, target, test, source_component, target_component""",
    "o_fedge": "SELECT DISTINCT source AS src, target AS dst FROM {o_known} WHERE NOT test AND source <> target",
    "o_fwalk": "SELECT src, dst FROM {o_fedge} UNION SELECT o_fwalk.src, o_fedge.dst FROM o_fwalk JOIN o_fedge ON o_fwalk.dst = o_fedge.src",
    "o_freach": "SELECT src, dst FROM {o_fwalk} WHERE src <> dst",
    "o_fscc": "SELECT a.src AS node, least(a.src, min(a.dst)) AS cycle_id FROM {o_freach} a JOIN {o_freach} b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
    "o_fapps": """SELECT used, string_agg(DISTINCT application, ',' ORDER BY application) AS apps, count(DISTINCT application) AS n
        FROM (SELECT dst AS used, src AS who FROM {o_freach} UNION ALL SELECT id, id FROM {o_decl}) u JOIN {o_decl} f ON f.id = who JOIN {descriptors} d ON d.id = f.component WHERE application <> '' GROUP BY used""",
    "o_fn": """SELECT f.*, (SELECT count(*) FROM {o_known} k WHERE k.target = f.id AND NOT k.test) AS incoming_call_sites, (SELECT count(*) FROM {o_known} k WHERE k.source = f.id AND NOT k.test) AS outgoing_call_sites,
        (SELECT count(*) FROM {o_known} k WHERE k.target = f.id AND k.test) AS test_incoming_call_sites, (SELECT count(*) FROM {o_known} k WHERE k.source = f.id AND k.test) AS test_outgoing_call_sites,
        (SELECT count(DISTINCT source) FROM {o_known} k WHERE k.target = f.id AND NOT k.test AND source <> target) AS afferent, (SELECT count(DISTINCT target) FROM {o_known} k WHERE k.source = f.id AND NOT k.test AND source <> target) AS efferent,
        (SELECT count(DISTINCT source) FROM {o_known} k WHERE k.target = f.id AND k.test AND source <> target) AS test_afferent, (SELECT count(DISTINCT target) FROM {o_known} k WHERE k.source = f.id AND k.test AND source <> target) AS test_efferent,
        (SELECT count(DISTINCT source) FROM {o_known} k WHERE k.target = f.id AND NOT k.test AND source_component <> target_component) AS cross_component_callers,
        (SELECT count(DISTINCT target) FROM {o_known} k WHERE k.source = f.id AND NOT k.test AND source_component <> target_component) AS cross_component_callees,
        (SELECT count(*) FROM {o_freach} WHERE src = f.id) AS transitive_callees, (SELECT count(*) FROM {o_freach} WHERE dst = f.id) AS transitive_callers, coalesce(a.apps, '') AS using_applications, coalesce(a.n, 0) AS using_application_count,
        f.id IN (SELECT node FROM {o_fscc}) AS in_cycle FROM {o_decl} f LEFT JOIN {o_fapps} a ON a.used = f.id""",
    "o_func": "SELECT *, CASE WHEN afferent + efferent = 0 THEN 0.0 ELSE efferent / (afferent + efferent)::DOUBLE END AS instability FROM {o_fn}",
    "o_groups": """SELECT s.id AS source, t.id AS target, regexp_replace(s.id, '^([^/]*/[^/]*)/.*$', '\\1') AS sg, regexp_replace(t.id, '^([^/]*/[^/]*)/.*$', '\\1') AS tg, test_only FROM {o_rel} r JOIN {strategy_components} s ON s.nation = r.source JOIN {strategy_components} t ON t.nation = r.target""",
    "o_gedge": "SELECT sg AS src, tg AS dst, count(*) AS weight FROM {o_groups} WHERE NOT test_only AND sg <> tg GROUP BY sg, tg",
    "o_gwalk": "SELECT src, dst FROM {o_gedge} UNION SELECT o_gwalk.src, o_gedge.dst FROM o_gwalk JOIN o_gedge ON o_gwalk.dst = o_gedge.src",
    "o_gscc": "SELECT a.src AS node, least(a.src, min(a.dst)) AS unit, count(DISTINCT a.dst) AS others FROM {o_gwalk} a JOIN {o_gwalk} b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src",
    "o_gnodes": "SELECT DISTINCT regexp_replace(id, '^([^/]*/[^/]*)/.*$', '\\1') AS id, count(*) AS components FROM {strategy_components} GROUP BY 1",
    "o_gunits": "SELECT g.id, g.components, coalesce(s.unit, g.id) AS unit, s.unit IS NOT NULL AS in_cycle FROM {o_gnodes} g LEFT JOIN {o_gscc} s ON s.node = g.id",
    "o_uedge": "SELECT DISTINCT a.unit AS src, b.unit AS dst FROM {o_gedge} e JOIN {o_gunits} a ON a.id = e.src JOIN {o_gunits} b ON b.id = e.dst WHERE a.unit <> b.unit",
    "o_upath": "SELECT DISTINCT unit AS node, 0 AS depth FROM {o_gunits} UNION SELECT e.src, o_upath.depth + 1 FROM o_upath JOIN {o_uedge} e ON e.dst = o_upath.node",
    "o_layers": "SELECT u.id, u.components, max(p.depth)::BIGINT AS layer, u.in_cycle FROM {o_gunits} u JOIN {o_upath} p ON p.node = u.unit GROUP BY u.id, u.components, u.in_cycle",
}

# ---- component graph ------------------------------------------------------------------------------------------------

query("agg_01", "SELECT * FROM {o_files}")(lambda c: C.file_totals(c.fact("source_files")))


@query("agg_02", "SELECT source, target, production_files, test_files, string_agg(DISTINCT source_package, ',' ORDER BY source_package) AS source_packages, string_agg(DISTINCT target_package, ',' ORDER BY target_package) AS target_packages, sites FROM {o_rel} JOIN {source_imports} USING (source, target) GROUP BY source, target, production_files, test_files, sites")
def agg_02(c: Context) -> DataFrame:
    return c.graph.relationships.select("source", "target", "production_files", "test_files", joined("source_packages").alias("source_packages"), joined("target_packages").alias("target_packages"), "sites")


query("agg_03", "SELECT source, target, test_only FROM {o_rel}")(lambda c: c.graph.relationships.select("source", "target", "test_only"))
COUPLING = ["id", "direct_dependencies", "efferent", "test_only_dependencies", "direct_importers", "afferent", "test_only_importers", "importer_packages", "production_importer_packages", "test_importer_packages"]
query("agg_04", f"SELECT {', '.join(COUPLING)} FROM {{o_comp}}")(lambda c: C.coupling(C.identifiers(c.fact("source_files"), c.fact("source_imports")), C.relationships(c.fact("source_imports")), c.fact("source_imports")).select(*COUPLING))
query("agg_05", "SELECT id, round(instability, 6) AS instability FROM {o_comp}")(lambda c: c.graph.components.select("id", r6(M.instability(F.col("afferent"), F.col("efferent"))).alias("instability")))
query("agg_06", "SELECT id, round(abstractness, 6) AS abstractness FROM {o_comp}")(lambda c: c.graph.components.select("id", r6(M.abstractness(F.col("abstract_types"), F.col("concrete_types"))).alias("abstractness")))
query("agg_07", "SELECT id, round(distance, 6) AS distance FROM {o_comp}")(lambda c: c.graph.components.select("id", r6(M.main_sequence_distance(F.col("abstractness"), F.col("instability"))).alias("distance")))
query("agg_08", "SELECT id, stable_low_abstraction FROM {o_comp}")(lambda c: c.graph.components.select("id", M.stable_low_abstraction(F.col("afferent"), F.col("instability"), F.col("abstractness")).alias("stable_low_abstraction")))

COMPONENT = [
    "id", "name", "role", "category", "application", "packages", "source_files", "production_files", "test_files", "direct_dependencies", "efferent", "test_only_dependencies", "direct_importers", "afferent", "test_only_importers",
    "importer_packages", "production_importer_packages", "test_importer_packages", "transitive_dependencies", "transitive_importers", "using_application_count", "abstract_types", "concrete_types", "in_cycle", "stable_low_abstraction",
]
COMPONENT_SQL = f"SELECT {', '.join(COMPONENT)}, using_applications, round(instability, 6) AS instability, round(abstractness, 6) AS abstractness, round(distance, 6) AS distance FROM {{o_comp}}"


def component_rows(df: DataFrame) -> DataFrame:
    return df.select(*COMPONENT, joined("using_applications").alias("using_applications"), r6("instability").alias("instability"), r6("abstractness").alias("abstractness"), r6("distance").alias("distance"))


query("g_06", COMPONENT_SQL)(lambda c: component_rows(c.graph.components))
query("g_01", "SELECT src, dst, 'out' AS direction FROM {o_edge} UNION ALL SELECT dst, src, 'in' FROM {o_edge}")(lambda c: G.adjacency(C.production_edges(c.graph.relationships)).withColumn("direction", F.lit("out")).union(G.reverse(G.adjacency(C.production_edges(c.graph.relationships))).withColumn("direction", F.lit("in"))))
query("g_02", "SELECT src, dst FROM {o_reach}")(lambda c: c.graph.reach)
query("g_03", "SELECT id, transitive_dependencies, transitive_importers FROM {o_comp}")(lambda c: c.graph.components.select("id", "transitive_dependencies", "transitive_importers"))
query("g_04", "SELECT cycle_id, members, size FROM {o_cycles}")(lambda c: c.graph.cycles.select("cycle_id", joined("members").alias("members"), "size"))
query("g_04_core", "SELECT node, cycle_id FROM {o_fscc}")(lambda c: G.strongly_connected(Fn.production_edges(c.functions.known)))
query("g_05", "SELECT id, in_cycle FROM {o_comp}")(lambda c: c.graph.components.select("id", "in_cycle"))
query("j_19", "SELECT used, apps AS using_applications FROM {o_apps}")(lambda c: C.using_applications(c.graph.components.select("id"), c.graph.reach, c.fact("descriptors")).select("used", joined("using_applications").alias("using_applications")))
query("set_01", "SELECT target AS component, string_agg(DISTINCT source, ',' ORDER BY source) AS importers FROM {o_rel} GROUP BY target")(lambda c: c.graph.relationships.groupBy(F.col("target").alias("component")).agg(joined(F.sort_array(F.collect_set("source"))).alias("importers")))

SUMMARY_SQL = """SELECT count(*) AS components, count(*) FILTER (role = 'application') AS applications, count(*) FILTER (role = 'application-module') AS application_modules, count(*) FILTER (role = 'shared-module') AS shared_modules,
    count(*) FILTER (role = 'library') AS libraries, count(*) FILTER (role = 'infrastructure') AS infrastructure, count(*) FILTER (role = 'development') AS development_tools, count(*) FILTER (stable_low_abstraction) AS stable_low_abstraction_components,
    (SELECT count(*) FROM {o_rel}) AS relationships, (SELECT count(*) FROM {o_rel} WHERE NOT test_only) AS production_relationships, (SELECT count(*) FROM {o_rel} WHERE test_only) AS test_only_relationships,
    (SELECT count(*) FROM {o_findings}) AS findings, (SELECT count(*) FROM {o_findings} WHERE severity = 'error') AS errors, (SELECT count(*) FROM {o_findings} WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM {o_cycles}) AS cycles,
    (SELECT count(*) FROM {o_func}) AS functions, (SELECT count(*) FROM {o_func} WHERE NOT test) AS production_functions, (SELECT count(*) FROM {o_func} WHERE test) AS test_functions, (SELECT count(*) FROM {o_calls}) AS function_calls,
    (SELECT coalesce(sum(calls), 0)::BIGINT FROM {o_calls}) AS function_call_sites, (SELECT coalesce(sum(calls), 0)::BIGINT FROM {o_calls} WHERE cross_component) AS cross_component_call_sites,
    (SELECT count(DISTINCT cycle_id) FROM {o_fscc}) AS function_cycles FROM {o_comp}"""


def summary(c: Context) -> DataFrame:
    g, f = c.graph, c.functions
    return C.summary(g.components, g.relationships, g.cycles.count(), c.findings, f.functions, f.calls, G.cycles(f.cycle_members).count())


query("agg_13", SUMMARY_SQL)(summary)
query("agg_13_categories", "SELECT category, count(*) AS components FROM {o_comp} GROUP BY category")(lambda c: C.categories(c.graph.components))
query("f_10", SUMMARY_SQL)(lambda c: summary(c).select("*"))
query("cmd_02", SUMMARY_SQL)(summary)

# ---- rules ----------------------------------------------------------------------------------------------------------

FINDING_SQL = "SELECT rule, severity, subject, message, source, target, components FROM {o_findings}"


def finding_rows(df: DataFrame) -> DataFrame:
    return df.select("rule", "severity", "subject", "message", "source", "target", joined("components").alias("components"))


query("r_01", FINDING_SQL + " WHERE rule = 'dependency-cycle'")(lambda c: finding_rows(R.cycle_findings(c.graph.cycle_members)))
query("r_02", FINDING_SQL + " WHERE rule = 'source-diagnostic'")(lambda c: finding_rows(R.diagnostic_findings(c.fact("diagnostics"))))
query("r_03", "SELECT id AS subject, round(abstractness, 6) AS abstractness, afferent::DOUBLE AS afferent, efferent::DOUBLE AS efferent, round(instability, 6) AS instability, round(distance, 6) AS distance FROM {o_comp} WHERE stable_low_abstraction")(
    lambda c: R.low_abstraction_findings(c.graph.components).select("subject", *(r6(F.col("metrics")[k]).alias(n) for k, n in (("abstractness", "abstractness"), ("afferentCoupling", "afferent"), ("efferentCoupling", "efferent"), ("instability", "instability"), ("mainSequenceDistance", "distance"))))
)
for _k, (_rule, _, _) in enumerate(R.EDGE_RULES):
    query(f"r_{4 + _k:02d}", FINDING_SQL + f" WHERE rule = '{_rule}'")(lambda c, k=_k: finding_rows(R.edge_findings(c.graph.relationships, c.graph.components, [R.EDGE_RULES[k]])))
query("r_09", "SELECT count(*) AS findings FROM {o_edge_findings} e JOIN {o_rel} r USING (source, target) WHERE r.test_only")(
    lambda c: R.edge_findings(c.graph.relationships, c.graph.components).join(c.graph.relationships.filter("test_only").select(F.col("source").alias("s"), F.col("target").alias("t")), (F.col("source") == F.col("s")) & (F.col("target") == F.col("t"))).agg(F.count("*").alias("findings"))
)
query("r_10", FINDING_SQL)(lambda c: R.ordered(finding_rows(R.evaluate(c.graph, c.fact("diagnostics")))))
WRITTEN_SQL = """SELECT r.source, r.target, coalesce(string_agg(DISTINCT e.rule, ',' ORDER BY e.rule), '') AS rule_violations, coalesce(bool_or(e.rule = 'stable-dependency-principle'), false) AS violates_sdp
    FROM {o_rel} r LEFT JOIN {o_edge_findings} e ON e.source = r.source AND e.target = r.target AND NOT r.test_only GROUP BY r.source, r.target"""
query("r_11", WRITTEN_SQL)(lambda c: R.written_back(c.graph.relationships, c.findings).select("source", "target", joined("rule_violations").alias("rule_violations"), "violates_sdp"))
query("r_13", FINDING_SQL + " WHERE source = (SELECT min(source) FROM {o_rel} WHERE NOT test_only) AND source <> ''")(
    lambda c: finding_rows(R.edge_findings(c.graph.relationships.filter(F.col("source") == c.graph.relationships.filter(~F.col("test_only")).agg(F.min("source")).first()[0]), c.graph.components))
)
query("j_01", "SELECT source, target, s_role, t_role, s_app AS s_application, t_app AS t_application FROM {o_ends}")(lambda c: R.with_ends(c.graph.relationships, c.graph.components)[0].select("source", "target", "s_role", "t_role", "s_application", "t_application"))
query("set_02", "SELECT rule, count(*) AS n FROM {o_findings} GROUP BY rule")(lambda c: c.findings.groupBy("rule").agg(F.count("*").alias("n")))
query("u_03", "SELECT rule, count(*) AS n FROM {o_edge_findings} WHERE rule LIKE '%imports%' GROUP BY rule")(lambda c: R.edge_findings(c.graph.relationships, c.graph.components, [x for x in R.EDGE_RULES if "imports" in x[0]]).groupBy("rule").agg(F.count("*").alias("n")))

POLICY = P.DependencyPolicy(
    production_allowed=False, test_allowed=True,
    allow=(P.DependencyRule("grant-lower", P.Selector(roles=("application", "application-module", "shared-module")), P.Selector(roles=("library", "infrastructure"))), P.DependencyRule("same-app", same_application=True)),
    deny=(P.DependencyRule("no-asia", P.Selector(), P.Selector(categories=("ASIA",)), "ASIA is closed"), P.DependencyRule("no-development", P.Selector(roles=("library",)), P.Selector(roles=("development",)), "libraries are for all")),
)
CONFIGURED_SQL = """SELECT source, target, CASE WHEN deny IS NOT NULL THEN 'Dependency rule "' || deny || '" prohibits this relationship: ' || CASE deny WHEN 'no-asia' THEN 'ASIA is closed' ELSE 'libraries are for all' END
      ELSE 'The configured dependency policy does not grant this relationship.' END AS message FROM (SELECT *, CASE WHEN t_category = 'ASIA' THEN 'no-asia' WHEN s_role = 'library' AND t_role = 'development' THEN 'no-development' END AS deny,
      test_only OR (s_role IN ('application', 'application-module', 'shared-module') AND t_role IN ('library', 'infrastructure')) OR (s_app <> '' AND s_app = t_app) AS granted FROM {o_ends}) x WHERE deny IS NOT NULL OR NOT granted"""
for _n in ("j_14", "r_12"):
    query(_n, CONFIGURED_SQL)(lambda c: P.configured_findings(c.graph.relationships, c.graph.components, POLICY).select("source", "target", "message"))
query("j_15", "SELECT id FROM {o_comp} WHERE role IN ('library', 'development') AND category IN ('ASIA', 'EUROPE', 'library')")(
    lambda c: c.graph.components.filter(P.Selector(roles=("library", "development"), categories=("ASIA", "EUROPE", "library")).holds({k: F.col(k) for k in ("id", "role", "category", "application")})).select("id")
)
STALE = P.DependencyPolicy(False, True, allow=(P.DependencyRule("a", P.Selector(ids=("NOWHERE",)), P.Selector(roles=("library",))), P.DependencyRule("b", P.Selector(ids=("NATION_4", "NOWHERE")))))
query("j_16", "SELECT 'a' AS rule, 'source' AS side WHERE NOT EXISTS (SELECT 1 FROM {o_comp} WHERE id = 'NOWHERE') UNION ALL SELECT 'b', 'source' WHERE NOT EXISTS (SELECT 1 FROM {o_comp} WHERE id IN ('NATION_4', 'NOWHERE'))")(lambda c: P.stale_rules(c.graph.components, STALE))

# ---- function graph -------------------------------------------------------------------------------------------------

query("agg_12", "SELECT id, component, path, line, in_scope FROM {o_decl}")(lambda c: Fn.merged(c.fact("function_declarations")).select("id", "component", "path", "line", "in_scope"))
query("j_02", "SELECT source, target, test, count(*) AS n FROM {o_known} GROUP BY source, target, test")(lambda c: Fn.known_references(c.fact("function_references"), Fn.merged(c.fact("function_declarations"))).groupBy("source", "target", "test").agg(F.count("*").alias("n")))
query("agg_09", "SELECT id, afferent, efferent, test_afferent, test_efferent, cross_component_callers, cross_component_callees FROM {o_func}")(lambda c: c.functions.functions.select("id", "afferent", "efferent", "test_afferent", "test_efferent", "cross_component_callers", "cross_component_callees"))
query("agg_10", "SELECT id, incoming_call_sites, outgoing_call_sites, test_incoming_call_sites, test_outgoing_call_sites FROM {o_func}")(lambda c: c.functions.functions.select("id", "incoming_call_sites", "outgoing_call_sites", "test_incoming_call_sites", "test_outgoing_call_sites"))
query("agg_11", "SELECT * FROM {o_calls}")(lambda c: c.functions.calls)
query("g_07", "SELECT id, name, package, component, path, line, receiver, method, exported, test, synthetic, in_scope, afferent, efferent, transitive_callees, transitive_callers, using_applications, in_cycle, round(instability, 6) AS instability FROM {o_func}")(
    lambda c: c.functions.functions.select("id", "name", "package", "component", "path", "line", "receiver", "method", "exported", "test", "synthetic", "in_scope", "afferent", "efferent", "transitive_callees", "transitive_callers", joined("using_applications").alias("using_applications"), "in_cycle", r6("instability").alias("instability"))
)
query("j_20", "SELECT id, using_applications, using_application_count FROM {o_func}")(lambda c: c.functions.functions.select("id", joined("using_applications").alias("using_applications"), "using_application_count"))
query("j_03", """SELECT r.source, r.target, coalesce(sum(calls) FILTER (NOT c.test), 0)::BIGINT AS production_call_sites, coalesce(sum(calls) FILTER (c.test), 0)::BIGINT AS test_call_sites, count(DISTINCT c.source) AS caller_functions, count(DISTINCT c.target) AS callee_functions
    FROM {o_rel} r LEFT JOIN {o_calls} c ON c.source_component = r.source AND c.target_component = r.target GROUP BY r.source, r.target""")(
    lambda c: Fn.with_calls(c.graph.relationships.select("source", "target"), c.functions.calls.withColumnRenamed("source", "caller").withColumnRenamed("target", "callee").withColumnRenamed("caller", "source").withColumnRenamed("callee", "target"))
)
query("j_04", """SELECT component, coalesce(sum(calls) FILTER (inc AND NOT test), 0)::BIGINT AS production_incoming, coalesce(sum(calls) FILTER (NOT inc AND NOT test), 0)::BIGINT AS production_outgoing, coalesce(sum(calls) FILTER (inc AND test), 0)::BIGINT AS test_incoming,
    coalesce(sum(calls) FILTER (NOT inc AND test), 0)::BIGINT AS test_outgoing FROM (SELECT target_component AS component, true AS inc, test, calls FROM {o_calls} UNION ALL SELECT source_component, false, test, calls FROM {o_calls}) x GROUP BY component""")(
    lambda c: Fn.component_calls(c.functions.calls)
)
query("j_05", "SELECT component, count(*) FILTER (NOT test) AS production_functions, count(*) FILTER (test) AS test_functions FROM {o_func} WHERE in_scope GROUP BY component")(lambda c: Fn.component_functions(c.functions.functions))
query("w_05", "SELECT id, path, line FROM {o_decl}")(lambda c: Fn.merged(c.fact("function_declarations")).select("id", "path", "line"))
query("sc_11", "SELECT id, list_contains(string_split(using_applications, ','), 'app1') AS used, using_application_count AS n FROM {o_comp}")(
    lambda c: c.graph.components.select("id", F.array_contains("using_applications", "app1").alias("used"), F.size(F.array_distinct(F.sort_array("using_applications"))).cast("bigint").alias("n"))
)
query("o_09", "SELECT source, target, path, line, target_package, alias, source_package, test FROM {source_imports} WHERE source <> target")(
    lambda c: C.import_sites(c.fact("source_imports")).orderBy("source", "target", "path", "line", "target_package", "alias", "source_package", "test")
)

# ---- query layer ----------------------------------------------------------------------------------------------------

OVERVIEW = ["id", "name", "role", "category", "application", "source_files", "afferent", "efferent", "direct_importers", "transitive_importers", "using_application_count", "stable_low_abstraction", "in_cycle"]
OVERVIEW_SQL = f"SELECT {', '.join(OVERVIEW)}, round(instability, 6) AS instability, round(abstractness, 6) AS abstractness, round(distance, 6) AS distance FROM {{o_comp}}"


def overview(df: DataFrame) -> DataFrame:
    return df.select(*OVERVIEW, r6("instability").alias("instability"), r6("abstractness").alias("abstractness"), r6("distance").alias("distance"))


query("f_01", "SELECT (SELECT count(*) FROM {o_comp} WHERE role = 'library') AS matched, (SELECT count(*) FROM (SELECT id FROM {o_comp} WHERE role = 'library' LIMIT 2) x) AS returned")(lambda c: Q.select_rows(c.graph.components, F.col("role") == "library", [F.col("afferent").desc(), "id"], 2).counts())
query("f_03", FINDING_SQL + " WHERE severity <> 'notice' AND (subject = 'NATION_4' OR source = 'NATION_4' OR target = 'NATION_4' OR list_contains(string_split(components, ','), 'NATION_4'))")(lambda c: finding_rows(Q.findings(c.findings, component="NATION_4").rows))
query("f_04", OVERVIEW_SQL + " WHERE role = 'library' ORDER BY afferent DESC, id")(lambda c: overview(Q.components(c.graph.components, role="library", limit=0).rows))
query("f_05", "SELECT id, component, package, incoming_call_sites FROM {o_func} WHERE NOT test AND package = 'pkg3'")(lambda c: Q.functions(c.functions.functions, package="pkg3", limit=0).rows.select("id", "component", "package", "incoming_call_sites"))
query("f_06", "SELECT coalesce(sum(calls), 0)::BIGINT AS call_sites FROM (SELECT calls FROM {o_calls} WHERE NOT test ORDER BY source, target, test LIMIT 50) x")(lambda c: Q.calls(c.functions.calls)[1])
query("f_07", """SELECT 'dependencies' AS part, count(*) AS n FROM {o_rel} WHERE source = 'NATION_3' UNION ALL SELECT 'importers', count(*) FROM {o_rel} WHERE target = 'NATION_3' UNION ALL SELECT 'functions', count(*) FROM {o_func} WHERE component = 'NATION_3'
    UNION ALL SELECT 'calls', count(*) FROM {o_calls} WHERE source_component = 'NATION_3' OR target_component = 'NATION_3' UNION ALL SELECT 'component', count(*) FROM {o_comp} WHERE id = 'NATION_3'
    UNION ALL SELECT 'findings', count(*) FROM {o_findings} WHERE subject = 'NATION_3' OR source = 'NATION_3' OR target = 'NATION_3' OR list_contains(string_split(components, ','), 'NATION_3')""")(lambda c: detail_counts(c, "NATION_3"))


def detail_counts(c: Context, ident: str) -> DataFrame:
    parts = Q.component_detail(c.graph, c.findings, c.functions.functions, c.functions.calls, ident)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("f_08", "SELECT CASE WHEN target = 'pkg5.Fn5' THEN 'incoming' ELSE 'outgoing' END AS direction, source, target, test, calls FROM {o_calls} WHERE NOT test AND target = 'pkg5.Fn5' UNION ALL SELECT 'outgoing', source, target, test, calls FROM {o_calls} WHERE NOT test AND source = 'pkg5.Fn5'")
def f_08(c: Context) -> DataFrame:
    d = Q.function_detail(c.functions.functions, c.functions.calls, "pkg5.Fn5")
    pick = lambda k: d[k].select(F.lit(k).alias("direction"), "source", "target", "test", "calls")
    return pick("incoming").unionByName(pick("outgoing"))


query("f_11", OVERVIEW_SQL)(lambda c: overview(c.graph.components))
query("f_26", "SELECT id FROM {o_comp} WHERE contains(lower(id || ' ' || name || ' ' || category || ' ' || application), 'n_1')")(lambda c: Q.text_search(c.graph.components, text=" N_1 ").select("id"))
query("f_27", FINDING_SQL + " WHERE severity = 'warning'")(lambda c: finding_rows(Q.findings(c.findings, "warning").rows))
SORT_SQL = {"identifier": "id", "afferent": "afferent DESC, id", "efferent": "efferent DESC, id", "importers": "transitive_importers DESC, id", "dependencies": "transitive_dependencies DESC, id", "instability": "instability DESC, id", "abstractness": "abstractness DESC, id", "distance": "distance DESC, id", "files": "source_files DESC, id"}
for _sort, _sql in SORT_SQL.items():
    query("o_01" if _sort == "afferent" else f"o_01_{_sort}", OVERVIEW_SQL + f" ORDER BY {_sql} LIMIT 10")(lambda c, s=_sort: overview(Q.components(c.graph.components, sort=s, limit=10).rows))
FSORT_SQL = {
    "identifier": "id", "incoming-call-sites": "incoming_call_sites + test_incoming_call_sites DESC, id", "outgoing-call-sites": "outgoing_call_sites + test_outgoing_call_sites DESC, id", "afferent": "afferent + test_afferent DESC, id",
    "efferent": "efferent + test_efferent DESC, id", "transitive-callers": "transitive_callers DESC, id", "transitive-callees": "transitive_callees DESC, id", "instability": "instability DESC, id",
}
for _sort, _sql in FSORT_SQL.items():
    query("o_02" if _sort == "incoming-call-sites" else "o_02_" + _sort.replace("-", "_"), f"SELECT id, component, test FROM {{o_func}} ORDER BY {_sql} LIMIT 20")(lambda c, s=_sort: Q.functions(c.functions.functions, sort=s, include_tests=True).rows.select("id", "component", "test"))
query("o_11", "SELECT id, role FROM {o_comp} ORDER BY role DESC, id")(lambda c: c.graph.components.select("id", "role").orderBy(*B.table_order("role", True)))
query("o_12", "SELECT id, afferent FROM {o_comp} ORDER BY afferent DESC, id LIMIT 3")(lambda c: Q.select_rows(c.graph.components.select("id", "afferent"), None, [F.col("afferent").desc(), "id"], 3).rows)
query("cmd_03", FINDING_SQL + " WHERE rule = 'stable-dependency-principle'")(lambda c: finding_rows(Q.findings(c.findings, rule="stable-dependency-principle").rows))
query("cmd_04", OVERVIEW_SQL + " ORDER BY afferent DESC, id LIMIT 20")(lambda c: overview(Q.components(c.graph.components).rows))
query("cmd_05", COMPONENT_SQL + " WHERE id = 'NATION_3'")(lambda c: component_rows(Q.component_detail(c.graph, c.findings, c.functions.functions, c.functions.calls, "NATION_3")["component"]))
query("cmd_06", "SELECT id, component, incoming_call_sites FROM {o_func} WHERE NOT test ORDER BY incoming_call_sites DESC, id LIMIT 20")(lambda c: Q.functions(c.functions.functions).rows.select("id", "component", "incoming_call_sites"))
query("cmd_07", "SELECT id, component, afferent, efferent FROM {o_func} WHERE id = 'pkg5.Fn5'")(lambda c: Q.function_detail(c.functions.functions, c.functions.calls, "pkg5.Fn5", True)["function"].select("id", "component", "afferent", "efferent"))
query("cmd_08", "SELECT source, target, test, calls FROM {o_calls} WHERE NOT test AND source_component = 'NATION_3' ORDER BY source, target, test LIMIT 50")(lambda c: Q.calls(c.functions.calls, source_component="NATION_3")[0].rows.select("source", "target", "test", "calls"))
query("cmd_01", "SELECT source, target, production_files, test_files, test_only FROM {o_rel}")(lambda c: c.graph.relationships.select("source", "target", "production_files", "test_files", "test_only"))
query("f_30", """SELECT 'importer' AS direction, r.source AS id, c.name, c.role, test_only FROM {o_rel} r JOIN {o_comp} c ON c.id = r.source WHERE target = 'NATION_3' UNION ALL
    SELECT 'dependency', r.target, c.name, c.role, test_only FROM {o_rel} r JOIN {o_comp} c ON c.id = r.target WHERE source = 'NATION_3'""")(lambda c: S.neighbours(c.graph.relationships, c.graph.components, "NATION_3"))

# ---- balance and strategy -------------------------------------------------------------------------------------------

query("agg_27", "SELECT place::BIGINT AS place, z AS zone, (SELECT count(*) FROM {o_zone} WHERE zone = z) AS components FROM (VALUES (0, 'pain'), (1, 'useless'), (2, 'drifting'), (3, 'balanced'), (4, 'free'), (5, 'isolated')) v(place, z)")(lambda c: B.zone_counts(c.graph.components))
_BARS = ", ".join(f"({k}, {k * 0.1!r}::DOUBLE, {k * 0.1 + 0.1!r}::DOUBLE)" for k in range(10))
query("agg_28", f"""SELECT bar::BIGINT AS bar, (SELECT count(*) FROM {{o_zone}} WHERE zone IN ('balanced', 'drifting', 'pain', 'useless') AND distance >= low AND (distance < high OR bar = 9 AND distance <= high)) AS components FROM (VALUES {_BARS}) v(bar, low, high)""")(lambda c: B.histogram(c.graph.components).select("bar", "components"))
_LABEL = "CASE WHEN {c} <= 0.2 THEN '{0}' WHEN {c} < 0.5 THEN '{1}' WHEN {c} < 0.8 THEN '{2}' ELSE '{3}' END"
query("agg_29", "SELECT id, " + _LABEL.format("Stable", "Mostly stable", "Mostly unstable", "Unstable", c="instability") + " AS stability, " + _LABEL.format("Concrete", "Mostly concrete", "Mostly abstract", "Abstract", c="abstractness") + " AS abstraction FROM {o_comp}")(
    lambda c: B.readings(c.graph.components).select("id", "stability", "abstraction")
)
query("agg_31", "SELECT DISTINCT role FROM {o_comp}")(lambda c: c.graph.components.select("role").distinct().orderBy("role"))
RANKING_SQL = "SELECT id, name, zone, round(distance, 6) AS distance, afferent FROM {o_zone} WHERE zone IN ('pain', 'useless', 'drifting') ORDER BY distance * afferent DESC, id LIMIT 15"
query("o_10", RANKING_SQL)(lambda c: B.ranking(c.graph.components).select("id", "name", "zone", r6("distance").alias("distance"), "afferent"))
query("w_06", f"SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN id ELSE name END AS label FROM ({RANKING_SQL}) x")(lambda c: B.ranking(c.graph.components).select("id", "label"))
LAYOUT_SQL = """SELECT id, coupling, place, round(50.0 + CASE WHEN n < 8 THEN 33.0 ELSE 39.0 END * cos(place * 2 * pi() / n - pi() / 2), 4) AS x, round(50.0 + CASE WHEN n < 8 THEN 33.0 ELSE 39.0 END * sin(place * 2 * pi() / n - pi() / 2), 4) AS y
    FROM (SELECT id, coupling, row_number() OVER (ORDER BY coupling DESC, id) - 1 AS place, count(*) OVER () AS n FROM (SELECT id, afferent + efferent AS coupling FROM {o_comp} ORDER BY 2 DESC, 1 LIMIT 18) t) p"""
query("g_13", LAYOUT_SQL)(lambda c: B.layout(c.graph.components).select("id", "coupling", "place", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y")))
query("j_22", "SELECT source, target, test_only FROM {o_rel} WHERE source IN (SELECT id FROM (SELECT id, afferent + efferent AS k FROM {o_comp} ORDER BY k DESC, id LIMIT 18) a) AND target IN (SELECT id FROM (SELECT id, afferent + efferent AS k FROM {o_comp} ORDER BY k DESC, id LIMIT 18) b)")(
    lambda c: B.layout_edges(c.graph.relationships, B.layout(c.graph.components)).select("source", "target", "test_only")
)


def strategy_input(c: Context) -> tuple[DataFrame, DataFrame]:
    s = c.fact("strategy_components")
    a, b = s.toDF("id1", "n1"), s.toDF("id2", "n2")
    rels = c.graph.relationships.select("source", "target", "test_only").join(a, F.col("source") == F.col("n1")).join(b, F.col("target") == F.col("n2")).select(F.col("id1").alias("source"), F.col("id2").alias("target"), "test_only")
    return s.select("id"), rels


def strategy(c: Context) -> tuple[DataFrame, DataFrame]:
    return S.report(*strategy_input(c))


query("g_09", "SELECT id, regexp_replace(id, '^([^/]*/[^/]*)/.*$', '\\1') AS grp FROM {strategy_components}")(lambda c: c.fact("strategy_components").select("id", S.group_of(F.col("id")).alias("grp")))
query("g_10", "SELECT src AS source, dst AS target, weight FROM {o_gedge}")(lambda c: strategy(c)[1].select("source", "target", "weight"))
query("g_11", "SELECT id, components, layer, in_cycle FROM {o_layers}")(lambda c: strategy(c)[0])
CYCLIC_SQL = "SELECT e.src AS source, e.dst AS target, e.weight, a.unit = b.unit AS cyclic FROM {o_gedge} e JOIN {o_gunits} a ON a.id = e.src JOIN {o_gunits} b ON b.id = e.dst"
query("g_12", CYCLIC_SQL)(lambda c: strategy(c)[1])
query("f_28", f"SELECT source, target, weight FROM ({CYCLIC_SQL}) x WHERE NOT cyclic AND weight <= 2 UNION ALL SELECT DISTINCT least(source, target), greatest(source, target), -1 FROM ({CYCLIC_SQL}) y WHERE cyclic")(
    lambda c: (lambda e: S.thin(e, 2).select("source", "target", "weight").union(S.cyclic_pairs(e).select("first", "second", F.lit(-1).cast("bigint"))))(strategy(c)[1])
)
query("f_29", "SELECT source, target FROM {o_groups} WHERE NOT test_only AND sg <> tg AND (sg = 'ASIA/g0' OR tg = 'ASIA/g0')")(lambda c: S.behind(strategy_input(c)[1], "ASIA/g0").select("source", "target"))
query("o_13", f"SELECT source, target, weight, layer, round(weight / (SELECT max(weight) FROM {{o_gedge}})::DOUBLE, 6) AS intensity FROM ({CYCLIC_SQL}) x JOIN {{o_layers}} l ON l.id = source")(
    lambda c: S.matrix(*strategy(c)).select("source", "target", "weight", "layer", r6("intensity").alias("intensity")).orderBy(F.col("layer").desc(), "source", "target")
)
TREE_VIEWS = {
    "o_tfolder": "SELECT DISTINCT list_aggregate(list_slice(string_split(id, '/'), 1, k), 'string_agg', '/') AS path FROM (SELECT id, unnest(range(1, len(string_split(id, '/')) + 1)) AS k FROM {tree_paths}) x",
    "o_tkept": "SELECT path FROM {o_tfolder} f WHERE path IN (SELECT id FROM {tree_paths}) OR (SELECT count(*) FROM o_tfolder g WHERE g.path LIKE f.path || '/%' AND length(g.path) - length(replace(g.path, '/', '')) = length(f.path) - length(replace(f.path, '/', '')) + 1) > 1",
    "o_tparent": "SELECT k.path, coalesce((SELECT arg_max(p.path, length(p.path)) FROM {o_tkept} p WHERE k.path LIKE p.path || '/%'), '') AS parent FROM {o_tkept} k",
}
VIEWS |= TREE_VIEWS
query("g_08", "SELECT path, CASE WHEN parent = '' THEN path ELSE substr(path, length(parent) + 2) END AS label, CASE WHEN path IN (SELECT id FROM {tree_paths}) THEN path ELSE '' END AS component_id, parent, (SELECT count(*) FROM {o_tparent} c WHERE c.parent = t.path) AS n_children FROM {o_tparent} t")(
    lambda c: B.tree(c.fact("tree_paths"))
)
query("g_08_ancestors", "SELECT path FROM {o_tkept} WHERE (SELECT max(id) FROM {tree_paths}) LIKE path || '/%'")(lambda c: B.ancestors(B.tree(c.fact("tree_paths")), c.fact("tree_paths").agg(F.max("id")).first()[0]))

# ---- types ----------------------------------------------------------------------------------------------------------


def type_rows(c: Context) -> DataFrame:
    """Types whose three reference arrays come from the relations."""
    ref = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("target").alias("id"), F.col("target_component").alias("component")))))
    return c.fact("type_relations").groupBy(F.col("source").alias("id"), F.col("source_component").alias("component")).agg(ref("implements").alias("implements"), ref("embeds").alias("embeds"), ref("references").alias("references"))


TYPE_COLUMNS = ["source", "source_component", "target", "target_component", "kind"]
INCOMING_SQL = "SELECT source, source_component, target, target_component, kind FROM {type_relations} WHERE target_component = 'Brand#11' AND source_component <> 'Brand#11'"
for _n in ("j_06", "f_09"):
    query(_n, INCOMING_SQL)(lambda c: T.incoming(type_rows(c), "Brand#11").select(*TYPE_COLUMNS).orderBy("target", "kind", "source"))
query("g_15", "SELECT DISTINCT target AS id, target_component AS component FROM {type_relations} WHERE source_component = 'Brand#11' AND target_component <> 'Brand#11'")(lambda c: T.external_targets(type_rows(c), "Brand#11"))
query("agg_30", "SELECT target, count(*) AS incoming FROM {type_relations} WHERE source_component <> target_component GROUP BY target")(lambda c: T.incoming_counts(type_rows(c)))
query("j_17", "SELECT m.type, i.interface FROM {type_methods} m JOIN {interface_methods} i ON i.method = m.method GROUP BY m.type, i.interface HAVING count(DISTINCT m.method) = (SELECT count(DISTINCT method) FROM {interface_methods} x WHERE x.interface = i.interface)")(
    lambda c: T.implementations(c.fact("type_methods"), c.fact("interface_methods"))
)
DISTINCT_SQL = """SELECT source AS id, target FROM {type_relations} r WHERE kind = 'references' AND NOT EXISTS (SELECT 1 FROM {type_relations} e WHERE e.kind = 'embeds' AND e.source = r.source AND e.target = r.target)"""
for _n in ("j_18", "set_05"):
    query(_n, DISTINCT_SQL)(lambda c: T.without_embedded(type_rows(c)).select("id", F.explode("references.id").alias("target")))
query("sc_03", "SELECT type, string_split(type, '.')[-1] AS short FROM {type_methods}")(lambda c: c.fact("type_methods").select("type", T.short_name(F.col("type")).alias("short")))


def fields(c: Context) -> DataFrame:
    p = c.fact("part")
    field = lambda name, kind, embedded: F.struct(name.alias("name"), kind.alias("type"), F.lit(embedded).alias("embedded"), (F.col("p_size") % 2 == 0).alias("exported"))
    return p.select(F.col("p_partkey").alias("id"), "p_size", F.array(field(F.lit("a"), F.concat(F.lit("[]T"), (F.col("p_size") % 4).cast("string")), False), field(F.lit("b"), F.concat(F.lit("*x.T"), (F.col("p_size") % 3).cast("string")), False), field(F.lit(""), F.lit("T1"), True)).alias("fields"),
                    F.array(F.struct(F.lit("Do").alias("name"), F.lit("()").alias("signature"), F.lit(True).alias("exported"), F.lit(False).alias("pointer_receiver"))).alias("methods"))


query("j_23", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN 'a' WHEN p_size % 3 = 1 THEN 'b' END AS port FROM {part}")(lambda c: fields(c).select("id", T.member_port(F.col("fields"), F.lit("pkg.T1"), F.lit(False)).alias("port")))
query("sc_06", """SELECT p_partkey AS id, 0 AS section, 0 AS at, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || 'a []T' || (p_size % 4) AS text FROM {part} UNION ALL SELECT p_partkey, 0, 1, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || 'b *x.T' || (p_size % 3) FROM {part}
    UNION ALL SELECT p_partkey, 0, 2, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || 'T1' FROM {part} UNION ALL SELECT p_partkey, 1, 0, '+Do()' FROM {part}""")(lambda c: T.member_rows(fields(c)))
query("g_14")(lambda c: T.diagram_columns(c.fact("part").select(F.col("p_brand").alias("diagram"), F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("height"))))

# ---- architecture evidence ------------------------------------------------------------------------------------------

ARCH_SQL = "SELECT 'architecture:' || rule || ':' || place AS id, rule, path, severity, message FROM (SELECT *, row_number() OVER (ORDER BY rule, subject, source, target, message) - 1 AS place, CASE WHEN subject = '' THEN source ELSE subject END AS path FROM {o_findings}) x"
for _n in ("r_20", "w_01"):
    query(_n, ARCH_SQL)(lambda c: E.numbered(c.findings).select("id", "rule", "path", "severity", "message"))

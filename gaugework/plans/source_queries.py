"""Queries over source trees, profiles, stored results, streams and scalar functions.

Source trees come from the generic tables too: a path per document or order, and Go text made from their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import errors, schemas
from gaugework.functions import checkpoint
from gaugework.functions import metrics as M
from gaugework.functions.classify import Classifier, generated
from gaugework.operators import components as C
from gaugework.operators import evidence as E
from gaugework.operators import query as Q
from gaugework.plans.registry import VIEWS, Context, query
from gaugework.sources import coverage as Profile
from gaugework.sources import files as Fi
from gaugework.sources import gosyntax as Go
from gaugework.sources import store as St
from gaugework.streaming import refresh as Re

VIEWS |= {
    "o_tree": """SELECT CASE o_orderkey % 9 WHEN 0 THEN 'cmd/app' || (o_custkey % 3) || '/main' WHEN 1 THEN 'internal/module/orders' WHEN 2 THEN 'internal/library/clock/deep' WHEN 3 THEN 'vendor/x' WHEN 4 THEN '.hidden/y' WHEN 5 THEN 'internal/module/billing/testdata'
        WHEN 6 THEN 'pkg/tool' WHEN 7 THEN '.git/z' ELSE 'other' END || '/f' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '_test.go' WHEN o_orderkey % 5 = 1 THEN '.txt' ELSE '.go' END AS path FROM {orders}""",
    "o_go": "SELECT path FROM {o_tree} WHERE path LIKE '%.go'",
}


def tree(c: Context) -> DataFrame:
    k = F.col("o_orderkey")
    folders = ["internal/module/orders", "internal/library/clock/deep", "vendor/x", ".hidden/y", "internal/module/billing/testdata", "pkg/tool", ".git/z", "other"]
    folder = F.when(k % 9 == 0, F.concat(F.lit("cmd/app"), (F.col("o_custkey") % 3).cast("string"), F.lit("/main")))
    for i, f in enumerate(folders, 1):
        folder = folder.when(k % 9 == i, f)
    ending = F.when(k % 4 == 0, "_test.go").when(k % 5 == 1, ".txt").otherwise(".go")
    return c.fact("orders").select(F.concat(folder, F.lit("/f"), k.cast("string"), ending).alias("path"))


query("src_01", "SELECT path FROM {o_go} WHERE (path LIKE 'cmd/%' OR path LIKE 'internal/%' OR path LIKE 'pkg/%') AND NOT (path LIKE '%/testdata/%')")(lambda c: Fi.architecture_files(tree(c), ["cmd", "internal", "pkg"], ["testdata"]))
query("src_02", "SELECT path FROM {o_go} WHERE path NOT LIKE '%!_test.go' ESCAPE '!' AND path NOT LIKE '.%' AND path NOT LIKE 'vendor/%' AND path NOT LIKE '%/testdata/%'")(lambda c: Fi.production_files(tree(c)))
query("src_03", "SELECT path FROM {o_go} WHERE path NOT LIKE '.%' AND path NOT LIKE 'vendor/%' AND path NOT LIKE '%/testdata/%' AND (path LIKE 'internal/%' OR path LIKE 'cmd/%')")(lambda c: Fi.all_files(tree(c), ["internal", "cmd/"]))
query("src_04", "SELECT unnest(['cmd', 'internal/module']) AS scope")(lambda c: c.spark.createDataFrame([(s,) for s in Fi.existing(tree(c), Fi.scopes(["internal/./module", "cmd/", "cmd"]))], "scope string"))
query("src_05", "SELECT path FROM {o_go} WHERE path NOT LIKE '.git/%' AND path NOT LIKE 'vendor/%'")(lambda c: Fi.similarity_files(tree(c)))
query("src_06", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 <> 2 THEN 'example.com/' || lower(n_name) END AS module FROM {nation}")(
    lambda c: c.fact("nation").select(F.col("n_nationkey").alias("id"), Fi.module_path(F.concat(F.lit("// head\n"), F.when(F.col("n_nationkey") % 3 == 0, "module ").when(F.col("n_nationkey") % 3 == 1, 'module "').otherwise("// module "), F.lit("example.com/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 1, '"').otherwise(""), F.lit("\n\ngo 1.24\n"))).alias("module"))
)
MODULES = [(".", "example.com/root"), ("internal", "example.com/in"), ("internal/module/billing", "example.com/billing")]
query("src_07", """SELECT path, CASE WHEN path LIKE 'internal/module/billing/%' THEN 'internal/module/billing' WHEN path LIKE 'internal/%' THEN 'internal' ELSE '.' END AS module_dir FROM {o_tree}""")(
    lambda c: Fi.located(tree(c), c.spark.createDataFrame(MODULES, "module_dir string, module_path string")).select("path", "module_dir")
)
VIEWS["o_profile"] = """SELECT CASE WHEN l_partkey % 6 = 0 THEN 'mode: atomic' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'other.com/x/' ELSE 'example.com/m/' END || CASE WHEN l_partkey % 7 = 0 THEN '../' ELSE '' END || 'p/f' || l_orderkey || '.go:' || l_linenumber || '.2,' || (l_linenumber + 3) || '.4 ' || (l_partkey % 9) || ' ' || (l_suppkey % 2) END AS value,
    l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}"""


def profile(c: Context) -> DataFrame:
    p, s = F.col("l_partkey"), lambda x: x.cast("string")
    line = F.col("l_linenumber")
    entry = F.concat(F.when(p % 5 == 0, "other.com/x/").otherwise("example.com/m/"), F.when(p % 7 == 0, "../").otherwise(""), F.lit("p/f"), s(F.col("l_orderkey")), F.lit(".go:"), s(line), F.lit(".2,"), s(line + 3), F.lit(".4 "), s(p % 9), F.lit(" "), s(F.col("l_suppkey") % 2))
    return c.fact("lineitem").select(F.when(p % 6 == 0, "mode: atomic").otherwise(entry).alias("value"))


PROFILE_SQL = "SELECT 'p/f' || l_orderkey || '.go' AS file, l_linenumber::BIGINT AS start_line, l_linenumber + 3::BIGINT AS end_line, l_partkey % 9 AS num_stmt, l_suppkey % 2 AS count FROM {o_profile} WHERE l_partkey % 6 <> 0 AND l_partkey % 5 <> 0 AND l_partkey % 7 <> 0"
for _n in ("src_08", "src_09"):
    query(_n, PROFILE_SQL)(lambda c: Profile.blocks(profile(c), "example.com/m"))
query("src_14", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, min(path) AS path FROM {o_go} GROUP BY 1")(lambda c: Fi.package_queries(tree(c).filter(F.col("path").endswith(".go"))))
query("f_31", "SELECT unnest(['./cmd', './internal/...']) AS pattern")(lambda c: c.spark.createDataFrame([(p,) for p in Fi.package_patterns(["internal", "cmd/x.go", "internal/"])], "pattern string"))

# ---- Go text: a file for each nation, whose declarations follow its key ---------------------------------------------


def go_files(c: Context) -> DataFrame:
    """Go text with n % 4 functions of n % 3 branches, n % 5 comment lines, one interface and n % 2 structs."""
    n = F.col("n_nationkey")
    rep = lambda text, times: F.repeat(F.lit(text), times.cast("int"))
    body = lambda i: F.concat(F.lit(f"\nfunc F{i}(x int) bool {{\n"), rep("\tif x > 0 && x != 1 {\n\t\treturn true\n\t}\n", n % 3), F.lit("\treturn x+1 == 0\n}\n"))
    parts = [F.when(n % 6 == 0, "// Code generated by tool. DO NOT EDIT.\n\n").otherwise(""), F.lit('package x\n\nimport (\n\t"fmt"\n\ta "example.com/m/lib"\n\tb "example.com/m/lib"\n)\n\n'), rep("// remark\n", n % 5), F.lit("type I interface{ M() }\n"), rep("type S struct {\n\ta int\n}\n", n % 2)]
    parts += [F.when(n % 4 > i, body(i)).otherwise("") for i in range(3)]
    return c.fact("nation").select(F.concat(F.lit("x/f"), n.cast("string"), F.lit(".go")).alias("path"), F.concat(*parts).alias("content"))


GO = "'x/f' || n_nationkey || '.go'"
query("src_10", f"SELECT {GO} AS path, 'lib' AS target_package, CASE WHEN n_nationkey % 6 = 0 THEN 8 ELSE 6 END::BIGINT AS line, 'b' AS alias FROM {{nation}}")(lambda c: Go.module_imports(Go.extract(go_files(c), "imports"), "example.com/m").select("path", "target_package", "line", "alias"))
query("src_11", f"SELECT {GO} AS path, n_nationkey % 4 > 0 AS has_functions FROM {{nation}}")(lambda c: Go.extract(go_files(c), "files").select("path", "has_functions"))
query("src_12", f"SELECT {GO} AS path, 1::BIGINT AS abstract_types, (n_nationkey % 2)::BIGINT AS concrete_types FROM {{nation}}")(lambda c: Go.extract(go_files(c), "files").select("path", "abstract_types", "concrete_types"))
query("src_20", f"SELECT {GO} AS path, n_nationkey % 6 = 0 AS generated_marker, ((n_nationkey % 6 = 0)::INT * 2 + 8 + n_nationkey % 5 + 1 + 3 * (n_nationkey % 2) + (n_nationkey % 4) * (4 + 3 * (n_nationkey % 3)))::BIGINT AS total FROM {{nation}}")(
    lambda c: Go.extract(go_files(c), "files").select("path", "generated_marker", "total")
)
for _n in ("src_21", "agg_20"):
    query(_n, f"SELECT {GO} AS path, 'F' || k AS name, (1 + 2 * (n_nationkey % 3))::BIGINT AS complexity FROM {{nation}} JOIN (SELECT unnest([0, 1, 2]) AS k) ks ON k < n_nationkey % 4")(lambda c: Go.extract(go_files(c), "functions").select("path", "name", "complexity"))
query("f_21", f"SELECT {GO} AS path, ((n_nationkey % 6 = 0)::INT + n_nationkey % 5)::BIGINT AS comment FROM {{nation}}")(lambda c: Go.extract(go_files(c), "lines").groupBy("path").agg(F.count_if(F.col("class") == "comment").alias("comment")))
# Functions of one file differ in their names alone, and those of two files in how often one branch repeats.
query("sc_14", """SELECT a.n AS "left", b.n AS "right", a.n % 3 = b.n % 3 AS same, a.n % 3 > 0 AND b.n % 3 > 0 AS alike FROM (SELECT n_nationkey AS n FROM {nation} WHERE n_nationkey % 4 > 0) a JOIN (SELECT n_nationkey AS n FROM {nation} WHERE n_nationkey % 4 > 0) b ON a.n < b.n""")(
    lambda c: shape_pairs(Go.extract(go_files(c), "shapes"))
)


def shape_pairs(shapes: DataFrame) -> DataFrame:
    """Of each two files of the few in the table: whether all shapes of their functions are equal, and whether a branch's shape is in both."""
    n = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    per = shapes.groupBy(n.alias("n")).agg(F.collect_set(F.struct("nodes", F.array_sort(F.array_distinct("fingerprints")).alias("prints"))).alias("shapes"))
    per = per.withColumn("prints", F.array_distinct(F.flatten("shapes.prints")))
    plain = per.filter("n % 3 = 0").agg(F.array_distinct(F.flatten(F.collect_list("prints"))).alias("plain"))
    per = per.crossJoin(plain).withColumn("branch", F.array_except("prints", "plain"))  # one row
    a, b = per.select("n", "shapes", "branch").toDF("left", "ls", "lb"), per.select("n", "shapes", "branch").toDF("right", "rs", "rb")
    return a.join(b, F.col("left") < F.col("right")).select("left", "right", (F.col("ls") == F.col("rs")).alias("same"), F.arrays_overlap("lb", "rb").alias("alike"))


query("sc_08", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE '?' END || '.M' AS name FROM {nation}")(
    lambda c: (lambda rows: Go.extract(rows, "functions").select(F.regexp_extract("path", r"(\d+)", 1).cast("int").alias("id"), "name"))(
        c.fact("nation").select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.lit("package x\n\nfunc ("), F.element_at(F.array(*map(F.lit, ("a *A", "a A[T]", "b *p.B", ""))), (F.col("n_nationkey") % 4 + 1).cast("int")), F.lit(") M() {}\n")).alias("content"))
    )
)
query("f_20", "SELECT id, CASE WHEN path LIKE 'src1/%' THEN false WHEN path LIKE '%/de/%' THEN true ELSE doc % 11 = 0 OR doc % 4 = 0 END AS generated FROM (SELECT id, path, replace(id, 'm:', '')::BIGINT AS doc FROM {path_metrics}) x")(
    lambda c: (lambda d: d.select("id", generated(F.col("path"), F.when(F.col("doc") % 4 == 0, "x\n// machine made").otherwise("x"), F.col("doc") % 11 == 0, force_handwritten=["src1/**"], force_generated=["**/de/*"], markers=["^// machine"]).alias("generated")))(
        c.fact("path_metrics").withColumn("doc", F.replace("id", F.lit("m:"), F.lit("")).cast("bigint"))
    )
)
CLASSIFIER = Classifier.of(taxonomy=[("kernel", "library", ["pkg/{component}"])], application_module=["cmd/{application}/internal/{component}"], shared_module=["internal/module/{component}"], library=["internal/library/{component}"], development=["tools"], application=["cmd/{application}"])
query("f_19", """SELECT path, CASE WHEN path LIKE 'pkg/%' THEN 'pkg/tool' WHEN path LIKE 'internal/module/%' OR path LIKE 'internal/library/%' THEN regexp_extract(path, '^([^/]+/[^/]+/[^/]+)', 1) WHEN path LIKE 'cmd/%' THEN regexp_extract(path, '^([^/]+/[^/]+)', 1) END AS component_id,
    CASE WHEN path LIKE 'pkg/%' THEN 'library' WHEN path LIKE 'internal/module/%' THEN 'shared-module' WHEN path LIKE 'internal/library/%' THEN 'library' WHEN path LIKE 'cmd/%' THEN 'application' END AS component_role,
    CASE WHEN path LIKE 'pkg/%' THEN 'kernel' WHEN path LIKE 'internal/module/%' THEN 'shared-module' WHEN path LIKE 'internal/library/%' THEN 'library' WHEN path LIKE 'cmd/%' THEN 'application' END AS component_category FROM {o_go}""")(
    lambda c: CLASSIFIER.classify(tree(c).filter(F.col("path").endswith(".go"))).select("path", "component_id", "component_role", "component_category")
)

# ---- facts that the tool chain gives --------------------------------------------------------------------------------

query("src_13", "SELECT DISTINCT package FROM {function_declarations}")(lambda c: c.fact("function_declarations").select("package").distinct().orderBy("package"))
query("src_15", "SELECT synthetic, test, count(*) AS n FROM {function_declarations} GROUP BY synthetic, test")(lambda c: c.fact("function_declarations").groupBy("synthetic", "test").agg(F.count("*").alias("n")))
query("src_16", "SELECT source, count(*) AS unresolved FROM {function_references} WHERE target NOT IN (SELECT id FROM {function_declarations}) GROUP BY source")(
    lambda c: (lambda r, d: r.join(d, F.col("target") == F.col("known"), "left_anti").groupBy("source").agg(F.count("*").alias("unresolved")))(c.fact("function_references"), c.fact("function_declarations").select(F.col("id").alias("known")))
)


def identity(package: Column, receiver: Column, name: Column, path: Column, line: Column) -> Column:
    """package.[Receiver.]Name; initialisers also carry their place, for a package may have several."""
    base = F.concat_ws(".", package, F.when(receiver != "", receiver), name)
    return F.when(name == "init", F.concat(base, F.lit("@"), path, F.lit(":"), line.cast("string"))).otherwise(base)


query("src_17", "SELECT id, line, package || CASE WHEN receiver <> '' THEN '.' || receiver ELSE '' END || CASE WHEN synthetic THEN '.init@' || path || ':' || line ELSE '.' || name END AS identity FROM {function_declarations}")(
    lambda c: c.fact("function_declarations").select("id", "line", identity(F.col("package"), F.col("receiver"), F.when(F.col("synthetic"), "init").otherwise(F.col("name")), F.col("path"), F.col("line")).alias("identity"))
)
query("src_18", "SELECT kind, count(*) AS n FROM {type_relations} GROUP BY kind")(lambda c: c.fact("type_relations").groupBy("kind").agg(F.count("*").alias("n")))
query("src_19", "SELECT DISTINCT source, target FROM {type_relations}")(lambda c: c.fact("type_relations").select("source", "target").distinct())

# ---- stores, sinks, configuration -----------------------------------------------------------------------------------


def stored(c: Context) -> DataFrame:
    import uuid

    folder = f"{checkpoint.ensure_checkpoint_dir(c.spark)}/store-{uuid.uuid4().hex}"
    key = St.cache_key({"folder": c.sf_dir})
    made = lambda: {"components": c.graph.components.select("id", "role", "afferent")}
    store = St.Store(folder)
    store.get(c.spark, key, ["components"], made)
    return store.get(c.spark, key, ["components"], made, "require")["components"]


query("src_23", "SELECT id, role, afferent FROM {o_comp}")(stored)
query("src_24", "SELECT count(*) AS blocks FROM {o_profile} WHERE l_partkey % 6 <> 0 AND l_partkey % 5 <> 0 AND l_partkey % 7 <> 0")(lambda c: Profile.blocks(profile(c), "example.com/m").agg(F.count("*").alias("blocks")))
query("src_25", "SELECT 5::BIGINT AS most, 'afferent' AS sort")(lambda c: (lambda s: c.spark.createDataFrame([(s.limit, s.sort)], "most long, sort string"))(config_of(c)))


def config_of(c: Context):  # noqa: ANN201
    from gaugework.config import Settings

    return Settings.load('{"limit": 50}').override(limit=5)


JSON_SQL = """SELECT '{"id":"' || id || '","role":"' || role || '","afferent":' || afferent || '}' AS document FROM {o_comp}"""
query("snk_01", JSON_SQL)(lambda c: St.as_json(c.graph.components.select("id", "role", "afferent")))
query("snk_02", """SELECT '{"source":"' || source || '","target":"' || target || '","test_only":' || test_only || '}' AS document FROM {o_rel}""")(lambda c: St.as_json(c.graph.relationships.select("source", "target", "test_only")))
query("snk_03", """SELECT '{"rule":"' || rule || '","n":' || count(*) || '}' AS document FROM {o_findings} GROUP BY rule""")(lambda c: St.as_json(c.findings.groupBy("rule").agg(F.count("*").alias("n"))))
query("snk_04", JSON_SQL)(lambda c: json_roundtrip(c))


def json_roundtrip(c: Context) -> DataFrame:
    """Compressed JSON written and read again, as text."""
    import uuid

    path = f"{checkpoint.ensure_checkpoint_dir(c.spark)}/json-{uuid.uuid4().hex}"
    c.graph.components.select("id", "role", "afferent").write.option("compression", "gzip").json(path)
    return c.spark.read.text(path).withColumnRenamed("value", "document")


query("snk_05", "SELECT 'components' AS part, count(*) AS n FROM {o_comp} UNION ALL SELECT 'relationships', count(*) FROM {o_rel} UNION ALL SELECT 'findings', count(*) FROM {o_findings}")(
    lambda c: c.graph.components.agg(F.count("*").alias("n")).select(F.lit("components").alias("part"), "n").unionByName(c.graph.relationships.agg(F.count("*").alias("n")).select(F.lit("relationships").alias("part"), "n")).unionByName(c.findings.agg(F.count("*").alias("n")).select(F.lit("findings").alias("part"), "n"))
)
query("snk_06", "SELECT o_orderkey AS id, greatest(0, least(o_orderkey * 100000 - 5000000, 4294967295)) AS wire FROM {orders}")(lambda c: c.fact("orders").select(F.col("o_orderkey").alias("id"), St.wire_count(F.col("o_orderkey") * 100000 - 5000000).alias("wire")))


def guarded(c: Context, names: list[str]) -> DataFrame:
    """Which of these arguments are refused, and as what."""
    from gaugework.operators import policy as P

    tries = {"limit": lambda: Q.limit_of(-1), "no limit": lambda: Q.limit_of(0), "sort": lambda: Q.one_of("size", Q.COMPONENT_SORTS, "sort"), "role": lambda: Q.one_of("boss", schemas.ROLES, "role"), "kind": lambda: Q.source_kind("old"), "threshold": lambda: P.Threshold("m", "about", 1.0), "policy": lambda: P.PathPolicy("p"), "glob": lambda: P.PathPolicy("p", include=("[a",), thresholds=(P.Threshold("m", "minimum", 1.0),))}
    rows = []
    for name in names:
        try:
            tries[name]()
            rows.append((name, "accepted"))
        except errors.AnalysisError as e:
            rows.append((name, e.category))
    return c.spark.createDataFrame(rows, "argument string, category string")


for _n, _names in (("f_02", ["limit"]), ("f_12", ["sort", "role", "kind"]), ("r_22", ["threshold", "policy", "glob"])):
    _sql = " UNION ALL ".join(f"SELECT '{x}' AS argument, 'validation' AS category" for x in _names) + (" UNION ALL SELECT 'no limit', 'accepted'" if _n == "f_02" else "")
    query(_n, _sql)(lambda c, names=[*_names, *(["no limit"] if _n == "f_02" else [])]: guarded(c, names))
query("f_25", "SELECT id, role IN ('application', 'application-module', 'shared-module', 'library', 'infrastructure', 'development') AS valid FROM {descriptors}")(lambda c: c.fact("descriptors").select("id", F.col("role").isin(*schemas.ROLES).alias("valid")))
query("u_04", "SELECT unnest(['a', 'b']) AS name")(lambda c: (lambda k: (k.register("b", None), k.register("a", None), c.spark.createDataFrame([(n,) for n in k.names()], "name string"))[2])(E.Catalog()))
query("u_05", "SELECT component, packages FROM (SELECT component, count(DISTINCT package) AS packages FROM {source_files} GROUP BY component) x")(lambda c: C.file_totals(c.fact("source_files")).select("component", "packages"))
query("u_07", "SELECT 15::BIGINT AS categories, 15::BIGINT AS codes")(lambda c: c.spark.createDataFrame([(len(errors.CATEGORIES), len(errors.RPC_CODES))], "categories long, codes long"))

# ---- streams --------------------------------------------------------------------------------------------------------


def feed(c: Context, changed: bool) -> DataFrame:
    """Runs the feed over the files of one table until nothing is new, and once more with or without a change."""
    import uuid

    folder = f"{checkpoint.ensure_checkpoint_dir(c.spark)}/feed-{uuid.uuid4().hex}"
    source = c.fact("nation")
    state = {"tables": {"nation": source}}
    f = Re.Feed(lambda: state["tables"], f"{folder}/events")
    source.write.parquet(f"{folder}/in")
    f.start(c.spark, source.schema, f"{folder}/in", f"{folder}/state", once=True).awaitTermination()
    if changed:
        state["tables"] = {"nation": source.filter("n_nationkey > 0")}
    source.write.mode("append").parquet(f"{folder}/in")
    f.start(c.spark, source.schema, f"{folder}/in", f"{folder}/state", once=True).awaitTermination()
    return c.spark.read.parquet(f"{folder}/events").select("kind")


query("s_01", "SELECT count(DISTINCT x) = 1 AS same FROM (SELECT 1 AS x) y")(
    lambda c: (lambda a, b: c.spark.createDataFrame([(a == b,)], "same boolean"))(Re.revision({"n": c.fact("nation")}).first()[0], Re.revision({"n": c.fact("nation").orderBy(F.col("n_name").desc())}).first()[0])
)
query("s_02", "SELECT 750::BIGINT AS interval_ms, 100::BIGINT AS least_ms")(lambda c: c.spark.createDataFrame([(Re.INTERVAL, Re.LEAST_INTERVAL)], "interval_ms long, least_ms long"))
query("s_03", "SELECT 'ready' AS kind")(lambda c: feed(c, False))
query("s_04", "SELECT unnest(['ready', 'changed']) AS kind")(lambda c: feed(c, True))
query("s_05", "SELECT unnest(['ready', 'changed']) AS kind")(lambda c: feed(c, True).distinct())
query("s_06", "SELECT 'ready' AS kind")(lambda c: feed(c, False).distinct())
query("s_07", "SELECT 2::BIGINT AS published")(lambda c: feed(c, True).agg(F.count("*").alias("published")))

# ---- scalar functions -----------------------------------------------------------------------------------------------

query("sc_01", "SELECT path, replace(path, '/', '.') AS dotted, path LIKE 'cmd/%' AS is_command, regexp_replace(path, '^internal/', '') AS trimmed FROM {o_tree}")(
    lambda c: tree(c).select("path", F.replace("path", F.lit("/"), F.lit(".")).alias("dotted"), F.col("path").startswith("cmd/").alias("is_command"), F.regexp_replace("path", "^internal/", "").alias("trimmed"))
)
query("sc_02", "SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS base FROM {o_tree}")(lambda c: tree(c).select("path", Fi.folder(F.col("path")).alias("folder"), F.substring_index("path", "/", -1).alias("base")))
query("sc_05", "SELECT p_partkey AS id, printf('%.2f of %.3f \"%s\"', p_retailprice, p_size / 8.0, p_brand) AS text FROM {part}")(lambda c: c.fact("part").select(F.col("p_partkey").alias("id"), F.format_string('%.2f of %.3f "%s"', "p_retailprice", F.col("p_size") / F.lit(8.0), "p_brand").alias("text")))
query("sc_09", "SELECT p_partkey AS id, round(CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_partkey / (p_size % 5)::DOUBLE END, 6) AS ratio, ceil(p_retailprice)::BIGINT AS up, abs(p_size - 25) AS off FROM {part}")(
    lambda c: c.fact("part").select(F.col("p_partkey").alias("id"), F.round(M.ratio(F.col("p_partkey"), F.col("p_size") % 5), 6).alias("ratio"), F.ceil("p_retailprice").alias("up"), F.abs(F.col("p_size") - 25).alias("off"))
)
query("sc_10", "SELECT p_partkey AS id, sha256(p_name || '|' || p_brand) AS digest FROM {part}")(lambda c: c.fact("part").select(F.col("p_partkey").alias("id"), F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("digest")))
query("sc_12", "SELECT source, target, round(s_i, 6) AS source_instability, round(t_i, 6) AS target_instability FROM {o_ends} WHERE NOT test_only AND t_i > s_i")(
    lambda c: c.findings.filter("rule = 'stable-dependency-principle'").select("source", "target", F.round(F.col("metrics")["sourceInstability"], 6).alias("source_instability"), F.round(F.col("metrics")["targetInstability"], 6).alias("target_instability"))
)
query("sc_13", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM {events}")(lambda c: c.fact("events").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
query("sc_15", "SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h' ELSE s // 86400 || ' d' END AS ago FROM (SELECT event_id, (epoch(TIMESTAMP '2024-03-01') - epoch(date_trunc('second', ts)))::BIGINT AS s FROM {events}) x")(
    lambda c: (lambda s: c.fact("events").select("event_id", F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d"))).alias("ago")))(F.unix_seconds(F.lit("2024-03-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))
)
query("set_03", "SELECT DISTINCT module_path FROM {loc_files} UNION SELECT package_dir FROM {loc_files}")(lambda c: c.fact("loc_files").select("module_path").union(c.fact("loc_files").select("package_dir")).distinct().orderBy("module_path"))
query("cmd_16", "SELECT unnest(['ready', 'changed']) AS kind")(lambda c: feed(c, True))

"""Queries over lines of code, coverage, change risk, mutation, similarity and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import globs
from gaugework.functions import metrics as M
from gaugework.functions.checkpoint import cut
from gaugework.operators import coverage as Cov
from gaugework.operators import evidence as E
from gaugework.operators import loc as L
from gaugework.operators import mutation as Mu
from gaugework.operators import policy as P
from gaugework.operators import query as Q
from gaugework.operators import similarity as Si
from gaugework.plans.registry import VIEWS, Context, query


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


COUNTER_SQL = """count(*) AS files_total, count(*) FILTER (test) AS files_test, count(*) FILTER (generated) AS files_generated, sum(total)::BIGINT AS lines_total, sum(code)::BIGINT AS lines_code, sum(comment)::BIGINT AS lines_comment, sum(blank)::BIGINT AS lines_blank,
    coalesce(sum(total) FILTER (test), 0)::BIGINT AS lines_test, coalesce(sum(total) FILTER (generated), 0)::BIGINT AS lines_generated, coalesce(sum(nf), 0)::BIGINT AS functions_total, coalesce(sum(nf) FILTER (test), 0)::BIGINT AS functions_test, coalesce(sum(nf) FILTER (generated), 0)::BIGINT AS functions_generated,
    CASE WHEN sum(total) = 0 THEN 0.0 ELSE coalesce(sum(total) FILTER (generated), 0) * 100.0 / sum(total) END AS lines_generated_percent,
    count(*) FILTER (NOT test AND NOT generated) AS files_handwritten, coalesce(sum(total) FILTER (NOT test AND NOT generated), 0)::BIGINT AS lines_handwritten, coalesce(sum(nf) FILTER (NOT test AND NOT generated), 0)::BIGINT AS functions_handwritten"""
STAT_SQL = "avg(code) AS a, quantile_disc(code, 0.95) AS p, max(code) AS m"
COUNTERS = [L.column(k) for k in L.COUNTERS]
VIEWS |= {
    "o_lf": "SELECT f.*, coalesce(n, 0) AS nf FROM {loc_files} f LEFT JOIN (SELECT path, count(*) AS n FROM {loc_functions} GROUP BY path) g ON g.path = f.path",
    "o_lfun": "SELECT u.*, f.package_dir, f.module_dir, f.module_path, f.test, f.generated FROM {loc_functions} u JOIN {loc_files} f ON f.path = u.path",
    "o_total": f"""SELECT scope, identity, path, {', '.join(COUNTERS)}, coalesce(a, 0.0) AS function_lines_average, coalesce(p, 0) AS function_lines_p95, coalesce(m, 0) AS function_lines_maximum FROM (
        SELECT 'repository' AS scope, 'repository' AS identity, '' AS path, '' AS k, {COUNTER_SQL} FROM {{o_lf}} UNION ALL SELECT 'module', module_dir || '@' || module_path, module_dir || '/go.mod', module_dir, {COUNTER_SQL} FROM {{o_lf}} GROUP BY module_dir, module_path
        UNION ALL SELECT 'package', package_dir, package_dir, package_dir, {COUNTER_SQL} FROM {{o_lf}} GROUP BY package_dir UNION ALL SELECT 'file', path, path, path, {COUNTER_SQL} FROM {{o_lf}} GROUP BY path) t
        LEFT JOIN (SELECT 'repository' AS s, '' AS sk, {STAT_SQL} FROM {{o_lfun}} UNION ALL SELECT 'module', module_dir, {STAT_SQL} FROM {{o_lfun}} GROUP BY module_dir UNION ALL SELECT 'package', package_dir, {STAT_SQL} FROM {{o_lfun}} GROUP BY package_dir
          UNION ALL SELECT 'file', path, {STAT_SQL} FROM {{o_lfun}} GROUP BY path) u ON s = scope AND sk = k""",
    "o_cov": "SELECT file, sum(num_stmt)::BIGINT AS statements, coalesce(sum(num_stmt) FILTER (count > 0), 0)::BIGINT AS covered, CASE WHEN sum(num_stmt) = 0 THEN 0.0 ELSE coalesce(sum(num_stmt) FILTER (count > 0), 0) * 100.0 / sum(num_stmt) END AS percent FROM {coverage_blocks} GROUP BY file",
    "o_fcov": """SELECT f.file, f.name, f.package, f.start_line, f.end_line, f.complexity, coalesce(sum(num_stmt), 0)::BIGINT AS statements, coalesce(sum(num_stmt) FILTER (count > 0), 0)::BIGINT AS covered,
        f.file IN (SELECT file FROM {coverage_blocks}) AS measured FROM {function_complexity} f LEFT JOIN {coverage_blocks} b ON b.file = f.file AND b.end_line >= f.start_line AND b.start_line <= f.end_line
        GROUP BY f.file, f.name, f.package, f.start_line, f.end_line, f.complexity""",
    "o_risk": """SELECT *, CASE WHEN measured THEN CASE WHEN statements = 0 THEN 0.0 ELSE covered * 100.0 / statements END END AS percent, row_number() OVER (ORDER BY file, name, start_line, end_line, complexity, package) - 1 AS place FROM {o_fcov}""",
    "o_crap": "SELECT *, complexity * complexity * (1 - percent / 100.0) ** 3 + complexity AS score, file || ':' || name || ':' || place AS identity FROM {o_risk}",
    "o_mutant": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in Mu.MUTANTS) + ") v(o, mutant, category)",
    "o_site": 'SELECT file, line, "column", original, mutant, category, row_number() OVER (PARTITION BY file ORDER BY line, "column") - 1 AS index FROM {mutation_tokens} JOIN {o_mutant} ON o = original',
    "o_placed": """SELECT s.*, coalesce((SELECT arg_min(f.name, f.start_line) FROM {function_complexity} f WHERE f.file = s.file AND s.line BETWEEN f.start_line AND f.end_line), '') AS function,
        EXISTS (SELECT 1 FROM {coverage_blocks} b WHERE b.file = s.file AND b.count > 0 AND s.line BETWEEN b.start_line AND b.end_line) AS ran FROM {o_site} s""",
    "o_mut": "SELECT *, function = '' OR ran AS covered, (line + \"column\") % 3 <> 0 AS killed FROM {o_placed}",
    "o_mutfile": "SELECT file, count(*) AS total, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS uncovered, count(*) FILTER (covered AND killed) AS killed, count(*) FILTER (covered AND NOT killed) AS survived FROM {o_mut} GROUP BY file",
    "o_print": "SELECT DISTINCT ord, fingerprint FROM {fingerprints}",
    "o_size": "SELECT ord, count(*) AS n FROM {o_print} GROUP BY ord",
    "o_pair": """SELECT a.ord AS "left", b.ord AS "right", count(*) AS shared, count(*) / (min(x.n) + min(y.n) - count(*))::DOUBLE AS score FROM {o_print} a JOIN {o_print} b ON a.fingerprint = b.fingerprint AND a.ord < b.ord JOIN {o_size} x ON x.ord = a.ord JOIN {o_size} y ON y.ord = b.ord
        GROUP BY a.ord, b.ord HAVING count(*) / (min(x.n) + min(y.n) - count(*))::DOUBLE >= 0.85""",
    "o_dup": """SELECT p.*, l.file AS left_file, l.start_line AS left_start_line, l.end_line AS left_end_line, r.file AS right_file, r.start_line AS right_start_line, r.end_line AS right_end_line FROM {o_pair} p JOIN {shapes} l ON l.ord = p."left" JOIN {shapes} r ON r.ord = p."right" """,
    "o_rank": "SELECT *, row_number() OVER (ORDER BY score DESC, left_file, left_start_line, right_file, right_start_line) AS rank, count(*) OVER () AS n FROM {o_dup}",
}


def files(c: Context) -> DataFrame:
    return c.fact("loc_files")


def functions(c: Context) -> DataFrame:
    return c.fact("loc_functions")


# ---- lines of code --------------------------------------------------------------------------------------------------

STATS = ["function_lines_p95", "function_lines_maximum"]
PLAIN = [k for k in COUNTERS if k != "lines_generated_percent"]
TOTAL_SQL = f"SELECT scope, identity, path, {', '.join(PLAIN)}, {', '.join(STATS)}, round(lines_generated_percent, 6) AS lines_generated_percent, round(function_lines_average, 6) AS function_lines_average FROM {{o_total}}"
query("agg_18", TOTAL_SQL)(lambda c: L.aggregates(files(c), functions(c)).select("scope", "identity", "path", *PLAIN, *STATS, r6("lines_generated_percent").alias("lines_generated_percent"), r6("function_lines_average").alias("function_lines_average")))
query("agg_19", "SELECT package_dir, round(avg(code), 6) AS average, quantile_disc(code, 0.95) AS p95, max(code) AS maximum FROM {o_lfun} GROUP BY package_dir")(
    lambda c: L.aggregates(files(c), functions(c)).filter("scope = 'package' and functions_total > 0").select(F.col("identity").alias("package_dir"), r6("function_lines_average").alias("average"), F.col("function_lines_p95").alias("p95"), F.col("function_lines_maximum").alias("maximum"))
)
_LONG = " UNION ALL ".join(f"SELECT 'loc:' || scope || ':' || identity || ':{k}' AS id, path, 'loc.' || scope || '.{n}' AS name, round({L.column(k)}, 6)::DOUBLE AS value, '{u}' AS unit FROM {{o_total}}" + (" WHERE scope <> 'file'" if k in L.STATISTICS else "") for k, (n, u) in {**L.COUNTERS, **L.STATISTICS}.items())
query("agg_18_long", _LONG)(lambda c: L.metric_rows(L.aggregates(files(c), functions(c))).withColumn("value", r6("value")))
_FN = " UNION ALL ".join(f"SELECT 'loc:function:' || path || ':' || start_line || ':' || name || ':{k}' AS id, path, 'loc.function.{n}' AS name, {col}::DOUBLE AS value, '{u}' AS unit FROM {{loc_functions}}" for k, n, col, u in (("lines:total", "lines.total", "total", "lines"), ("lines:code", "lines.code", "code", "lines"), ("lines:comment", "lines.comment", "comment", "lines"), ("lines:blank", "lines.blank", "blank", "lines"), ("start-line", "start-line", "start_line", "count"), ("end-line", "end-line", "end_line", "count")))
query("agg_22", _FN)(lambda c: L.function_metric_rows(functions(c)))
HAND = ["files_handwritten", "lines_handwritten", "functions_handwritten"]
HAND_SQL = f"SELECT package_dir, {', '.join(PLAIN + HAND)}, round(lines_handwritten * 100.0 / lines_total, 6) AS lines_handwritten_percent FROM (SELECT package_dir, {COUNTER_SQL} FROM {{o_lf}} GROUP BY package_dir) x"
hand = lambda df: df.select("package_dir", *PLAIN, *HAND, r6("lines_handwritten_percent").alias("lines_handwritten_percent"))
query("agg_23", HAND_SQL)(lambda c: hand(L.overview(files(c), functions(c), ["package_dir"])))
PIVOT = ["loc.file.lines.total", "loc.file.lines.code"]
pivot_sql = "SELECT path, max(lines_total)::DOUBLE AS lines_total, max(lines_code)::DOUBLE AS lines_code FROM {o_total} WHERE scope = 'file' GROUP BY path"
for _n in ("j_21", "agg_24"):
    query(_n, pivot_sql)(lambda c: L.pivoted(L.metric_rows(L.aggregates(files(c), functions(c))), PIVOT).select("path", F.col(f"`{PIVOT[0]}`").alias("lines_total"), F.col(f"`{PIVOT[1]}`").alias("lines_code")))
for _kind, _sql in (("handwritten", "NOT test AND NOT generated"), ("test", "test"), ("generated", "generated")):
    query("f_13" if _kind == "handwritten" else f"f_13_{_kind}", f"SELECT path FROM {{loc_files}} WHERE {_sql}")(lambda c, k=_kind: files(c).filter(Q.source_kind(k)).select("path"))
FILE_SQL = "SELECT path, total, code, comment, blank, nf AS n_functions FROM {o_lf}"
file_rows = lambda df: df.select("path", "total", "code", "comment", "blank", "n_functions")
query("f_14", FILE_SQL + " WHERE package_dir = 'src1/en' AND NOT test AND NOT generated")(lambda c: file_rows(L.file_list(files(c), functions(c), "src1/en", "handwritten").rows))
FUN_SQL = "SELECT path, name, start_line, total, code, comment, blank FROM {o_lfun}"
fun_rows = lambda df: df.select("path", "name", "start_line", "total", "code", "comment", "blank")
query("f_15", FUN_SQL + " WHERE package_dir = 'src1/en' AND test")(lambda c: fun_rows(L.function_list(files(c), functions(c), "src1/en", kind="test").rows))
for _sort, _col in L.AGGREGATE_SORTS.items():
    _order = f"{_col} DESC, package_dir" if _col else "package_dir"
    query("o_03" if _sort == "lines" else "o_03_" + _sort.replace("-", "_"), f"SELECT package_dir, files_total, lines_total FROM (SELECT package_dir, {COUNTER_SQL} FROM {{o_lf}} GROUP BY package_dir) x ORDER BY {_order} LIMIT 7")(lambda c, s=_sort: L.packages(files(c), functions(c), s, 7).rows.select("package_dir", "files_total", "lines_total"))
for _sort, _col in L.FILE_SORTS.items():
    _order = f"{_col} DESC, path" if _col else "path"
    query("o_04" if _sort == "lines" else f"o_04_{_sort}", f"SELECT * FROM ({FILE_SQL}) x ORDER BY {_order} LIMIT 9")(lambda c, s=_sort: file_rows(L.file_list(files(c), functions(c), sort=s, limit=9).rows))
for _sort, _col in L.FUNCTION_SORTS.items():
    _order = f"{_col} DESC, path, start_line, name" if _col else "path, start_line, name"
    query("o_05" if _sort == "code" else f"o_05_{_sort}", FUN_SQL + f" ORDER BY {_order} LIMIT 9")(lambda c, s=_sort: fun_rows(L.function_list(files(c), functions(c), sort=s, limit=9).rows))
query("o_06", HAND_SQL)(lambda c: hand(L.packages(files(c), functions(c), "path").rows))
query("cmd_11", f"SELECT {', '.join(PLAIN + HAND)} FROM (SELECT {COUNTER_SQL} FROM {{o_lf}}) x")(lambda c: L.overview(files(c), functions(c), []).select(*PLAIN, *HAND))
VIEWS["o_lines"] = "SELECT doc_id, i AS line, CASE WHEN length(l) = 0 THEN 'blank' WHEN length(l) < 80 THEN 'comment' ELSE 'code' END AS class FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {documents}) x"


def line_classes(c: Context) -> DataFrame:
    rows = c.fact("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return rows.select("path", (F.col("i") + 1).cast("bigint").alias("line"), F.when(F.length("l") == 0, "blank").when(F.length("l") < 80, "comment").otherwise("code").alias("class"))


query("agg_21", """SELECT 'd' || d.doc_id AS path, 'all' AS name, 1::BIGINT AS start_line, 3 + doc_id % 5 AS end_line, count(line) AS total, count(*) FILTER (class = 'code') AS code, count(*) FILTER (class = 'comment') AS comment, count(*) FILTER (class = 'blank') AS blank
    FROM {documents} d LEFT JOIN (SELECT doc_id AS id, line, class FROM {o_lines}) l ON l.id = d.doc_id AND line BETWEEN 1 AND 3 + doc_id % 5 GROUP BY d.doc_id""")(
    lambda c: L.range_lines(c.fact("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("all").alias("name"), F.lit(1).cast("bigint").alias("start_line"), (3 + F.col("doc_id") % 5).alias("end_line")), line_classes(c))
)

# ---- coverage and change risk ---------------------------------------------------------------------------------------

blocks = lambda c: c.fact("coverage_blocks")
POLICIES = [
    P.PathPolicy("low", include=("f1*",), exclude=("f19*",), thresholds=(P.Threshold("coverage.percent", "minimum", 40.0), P.Threshold("crap.score", "maximum", 90.0, "warning"))),
    P.PathPolicy("rest", include=("f2*", "f3*"), thresholds=(P.Threshold("coverage.percent", "minimum", 25.0, "warning"),)),
]
query("agg_16", "SELECT file, statements, covered, round(percent, 6) AS percent FROM {o_cov} UNION ALL SELECT 'overall', sum(statements)::BIGINT, sum(covered)::BIGINT, round(sum(covered) * 100.0 / sum(statements), 6) FROM {o_cov}")(
    lambda c: (lambda f: f.unionByName(Cov.overall(f).select(F.lit("overall").alias("file"), "statements", "covered", "percent")).withColumn("percent", r6("percent")))(Cov.per_file(blocks(c)))
)
query("agg_32", "SELECT DISTINCT file FROM {coverage_blocks}")(lambda c: Cov.measured_files(blocks(c)))
query("j_07", "SELECT file, name, start_line, statements, covered, measured FROM {o_fcov}")(lambda c: Cov.function_coverage(c.fact("function_complexity"), blocks(c)).select("file", "name", "start_line", "statements", "covered", "measured"))
query("j_08", "SELECT DISTINCT file, line FROM {mutation_tokens} t WHERE EXISTS (SELECT 1 FROM {coverage_blocks} b WHERE b.file = t.file AND b.count > 0 AND t.line BETWEEN b.start_line AND b.end_line)")(lambda c: Cov.covered_lines(c.fact("mutation_tokens").select("file", "line").distinct(), blocks(c)))
query("agg_17", "SELECT file, name, start_line, round(score, 4) AS score FROM {o_crap}")(lambda c: Cov.risk(c.fact("function_complexity"), blocks(c)).select("file", "name", "start_line", F.round("score", 4).alias("score")))
query("w_02", "SELECT identity, file, name, start_line FROM {o_crap}")(lambda c: Cov.risk(c.fact("function_complexity"), blocks(c)).select("identity", "file", "name", "start_line"))
RISK_SQL = """SELECT 'crap:unmeasured:' || identity AS id, 'indeterminate-crap-score' AS rule, 'warning' AS severity, NULL::DOUBLE AS actual, NULL::DOUBLE AS "limit" FROM {o_crap} WHERE NOT measured
    UNION ALL SELECT 'crap:low:' || identity, 'maximum-crap-score', 'warning', round(score, 4), 90.0::DOUBLE FROM {o_crap} WHERE measured AND file LIKE 'f1%' AND file NOT LIKE 'f19%' AND score > 90
    UNION ALL SELECT 'crap:default:' || identity, 'maximum-crap-score', 'error', round(score, 4), 8.0::DOUBLE FROM {o_crap} WHERE measured AND NOT (file LIKE 'f1%' AND file NOT LIKE 'f19%') AND score > 8"""
risk_findings = lambda c: Cov.risk_findings(Cov.risk(c.fact("function_complexity"), blocks(c)), POLICIES).select("id", "rule", "severity", F.round("actual", 4).alias("actual"), "limit")
query("r_16", RISK_SQL)(risk_findings)
query("cmd_13", RISK_SQL)(risk_findings)
COV_SQL = """SELECT 'coverage:low:' || file AS id, file AS path, 'error' AS severity, round(percent, 6) AS actual, 40.0::DOUBLE AS "limit" FROM {o_cov} WHERE file LIKE 'f1%' AND file NOT LIKE 'f19%' AND percent < 40
    UNION ALL SELECT 'coverage:rest:' || file, file, 'warning', round(percent, 6), 25.0::DOUBLE FROM {o_cov} WHERE (file LIKE 'f2%' OR file LIKE 'f3%') AND percent < 25 UNION ALL SELECT 'coverage:go-test-run', '', 'error', NULL, NULL"""
cov_findings = lambda c: Cov.coverage_findings(Cov.per_file(blocks(c)), POLICIES, True).select("id", "path", "severity", r6("actual").alias("actual"), "limit")
query("r_15", COV_SQL)(cov_findings)
query("cmd_12", COV_SQL)(cov_findings)

VIEWS["o_pm"] = "SELECT *, path LIKE 'src1/%' OR path LIKE 'src%/en/%' OR path LIKE 'src2/de/%' AS a, path LIKE '%/de/%' AND path NOT LIKE '%d1__.x' AS b FROM {path_metrics}"
PATHS = [
    P.PathPolicy("a", include=("src1/**", "src*/en/**", "src2/de/*"), thresholds=(P.Threshold("loc.file.lines.total", "maximum", 2000.0),)),
    P.PathPolicy("b", include=("**/de/**",), exclude=("**/*d1??.x",), thresholds=(P.Threshold("loc.file.lines.total", "minimum", 500.0, "warning"), P.Threshold("loc.file.lines.code", "maximum", 900.0))),
]
query("j_13", "SELECT id, CASE WHEN a AND b THEN 'a, b' END AS policies FROM {o_pm} WHERE name = 'loc.file.lines.total' AND a AND b")(lambda c: P.ambiguous(P.resolve(c.fact("path_metrics"), PATHS)).select("id", "policies"))
LOCTHR_SQL = """SELECT id, 'a' AS policy, value, 2000.0::DOUBLE AS "limit" FROM {o_pm} WHERE name = 'loc.file.lines.total' AND a AND NOT b AND value > 2000 UNION ALL SELECT id, 'b', value, 500.0::DOUBLE FROM {o_pm} WHERE name = 'loc.file.lines.total' AND b AND NOT a AND value < 500
    UNION ALL SELECT id, 'b', value, 900.0::DOUBLE FROM {o_pm} WHERE name = 'loc.file.lines.code' AND b AND value > 900"""
for _n in ("r_14", "r_19"):
    query(_n, LOCTHR_SQL)(lambda c: P.violations(P.resolve(c.fact("path_metrics"), PATHS)).select("id", F.col("threshold.policy").alias("policy"), "value", F.col("threshold.value").alias("limit")))
query("f_16", "SELECT id FROM {path_metrics} WHERE (path LIKE 'src1/%' OR path LIKE 'src3/%') AND NOT path LIKE '%/fr/%'")(lambda c: c.fact("path_metrics").filter(globs.selected(F.col("path"), ["src1/**", "src3/**"], ["**/fr/**"])).select("id"))
query("f_17", "SELECT id FROM {path_metrics} WHERE regexp_matches(path, '^src[1-3]/[^/]*/d[0-9][0-9]\\.x$')")(lambda c: c.fact("path_metrics").filter(globs.matches_any(F.col("path"), ["src[1-3]/*/d[0-9][0-9].x"])).select("id"))
query("f_18", "SELECT id FROM {path_metrics} WHERE NOT (path LIKE '%/de/%' OR path LIKE 'src4/en/%')")(lambda c: c.fact("path_metrics").filter(~globs.ignored(F.col("path"), ["de", "src4/en"])).select("id"))
query("sc_04", "SELECT doc_id FROM {documents} WHERE regexp_matches(text, '[0-9]{4}')")(lambda c: c.fact("documents").filter(F.col("text").rlike("[0-9]{4}")).select("doc_id"))

# ---- mutation -------------------------------------------------------------------------------------------------------


def mutation_sites(c: Context) -> DataFrame:
    return Mu.sites(c.fact("mutation_tokens"))


def tested(c: Context) -> DataFrame:
    placed = Mu.with_coverage(Mu.with_function(mutation_sites(c), c.fact("function_complexity")), blocks(c))
    return placed.withColumn("killed", (F.col("line") + F.col("column")) % 3 != 0)


SITE_SQL = 'SELECT file, line, "column", original, mutant, category, index FROM {o_site}'
for _n in ("j_09", "w_03", "src_22", "f_22"):
    query(_n, SITE_SQL)(lambda c: mutation_sites(c).select("file", "line", "column", "original", "mutant", "category", "index"))
query("j_10", 'SELECT file, index, function FROM {o_placed}')(lambda c: Mu.with_function(mutation_sites(c), c.fact("function_complexity")).select("file", "index", "function"))
query("f_23", "SELECT file, index, covered FROM {o_mut}")(lambda c: tested(c).select("file", "index", "covered"))
MUT_SQL = "SELECT *, CASE WHEN killed + survived > 0 THEN round(killed * 100.0 / (killed + survived), 6) END AS killed_percent FROM {o_mutfile}"
for _n in ("agg_25", "cmd_15"):
    query(_n, MUT_SQL)(lambda c: Mu.totals(tested(c), True).withColumn("killed_percent", r6("killed_percent")))
query("r_18", """SELECT 'mutation:survivor:' || file || ':' || line || ':' || index AS id, 'surviving-mutation' AS rule, 'notice' AS severity, function || ' line ' || line || ' changes ' || original || ' -> ' || mutant || ' and the tests still pass' AS message FROM {o_mut} WHERE covered AND NOT killed
    UNION ALL SELECT 'mutation:uncovered:' || file, 'maximum-uncovered-mutations', 'error', uncovered || ' mutation sites are uncovered; the configured limit is 2' FROM {o_mutfile} WHERE uncovered > 2
    UNION ALL SELECT 'mutation:survived:' || file, 'maximum-surviving-mutations', 'error', survived || ' mutations survived; the configured limit is 1' FROM {o_mutfile} WHERE survived > 1""")(
    lambda c: (lambda t: Mu.survivor_findings(t).unionByName(Mu.threshold_findings(Mu.totals(t, True), 2, 1)).select("id", "rule", "severity", "message"))(tested(c))
)
query("sc_07", "SELECT file, index, original || ' -> ' || mutant AS description, '[' || mutant || ']' AS text FROM {o_site}")(
    lambda c: Mu.described(mutation_sites(c)).select("file", "index", "description", Mu.applied(F.concat(F.lit("["), "original", F.lit("]")), F.lit(1), F.col("original"), F.col("mutant")).alias("text"))
)

# ---- similarity -----------------------------------------------------------------------------------------------------

PAIR_SQL = 'SELECT "left", "right", shared, round(score, 6) AS score FROM {o_pair}'
similar = lambda c: Si.pairs(c.fact("fingerprints"), 0.85)
for _n in ("j_11", "j_12", "set_04"):
    query(_n, PAIR_SQL)(lambda c: similar(c).select("left", "right", "shared", r6("score").alias("score")))
DUP_SQL = "SELECT left_file, left_start_line, right_file, right_start_line, round(score, 6) AS score FROM {o_rank}"
dup = lambda df: df.select("left_file", "left_start_line", "right_file", "right_start_line", r6("score").alias("score"))
query("o_07", DUP_SQL)(lambda c: dup(Si.located(similar(c), c.fact("shapes")).orderBy(*Si.order())))
query("w_04", "SELECT left_file, right_file, rank FROM {o_rank} WHERE rank <= n - 5")(lambda c: Si.over_budget(Si.located(similar(c), c.fact("shapes")), 5).select("left_file", "right_file", "rank"))
DUPF_SQL = "SELECT 'duplication:' || left_file || ':' || left_start_line || ':' || right_file || ':' || right_start_line AS id, round(score, 6) AS actual, 0.85::DOUBLE AS \"limit\" FROM {o_rank} WHERE rank <= n - 5"
for _n in ("r_17", "cmd_14"):
    query(_n, DUPF_SQL)(lambda c: Si.duplication_findings(Si.located(similar(c), c.fact("shapes")), 5, 0.85).select("id", r6("actual").alias("actual"), "limit"))
query("f_24", "SELECT ord FROM {shapes} WHERE has_body AND end_line - start_line + 1 >= 5 AND nodes >= 20")(lambda c: Si.admitted(c.fact("shapes"), 5, 20).select("ord"))
query("agg_26", "SELECT ord, count(DISTINCT fingerprint) AS n FROM {fingerprints} GROUP BY ord")(lambda c: c.fact("fingerprints").groupBy("ord").agg(F.size(F.collect_set("fingerprint")).cast("bigint").alias("n")))

# ---- evidence -------------------------------------------------------------------------------------------------------


def reports(c: Context) -> E.Catalog:
    catalog = E.Catalog()
    catalog.register("coverage", lambda: (lambda f: E.Report("coverage", Cov.coverage_metrics(f), Cov.coverage_findings(f, POLICIES)))(cut(Cov.per_file(blocks(c)))))
    catalog.register("crap", lambda: (lambda r: E.Report("crap", Cov.risk_metrics(r), Cov.risk_findings(r, POLICIES)))(cut(Cov.risk(c.fact("function_complexity"), blocks(c)))))
    catalog.register("duplication", lambda: (lambda d: E.Report("duplication", Si.duplication_metrics(d), Si.duplication_findings(d, 5, 0.85)))(cut(Si.located(similar(c), c.fact("shapes")))))
    return catalog


# An evaluator as a table function: its name in, its rows out, validated.
query("u_01", f"""SELECT 'metric' AS kind, 'coverage:' || file AS id, file AS path, round(percent, 6) AS value FROM {{o_cov}} UNION ALL SELECT 'metric', 'coverage:overall', '', round(sum(covered) * 100.0 / sum(statements), 6) FROM {{o_cov}}
    UNION ALL SELECT 'finding', id, path, actual FROM ({COV_SQL}) x WHERE id <> 'coverage:go-test-run'""")(
    lambda c: (lambda r: r.metrics.select(F.lit("metric").alias("kind"), "id", "path", r6("value").alias("value")).unionByName(r.findings.select(F.lit("finding").alias("kind"), "id", "path", r6("actual").alias("value"))))(reports(c).run(["coverage"])[0])
)


VIEWS["o_check"] = f"""SELECT severity FROM ({RISK_SQL}) a UNION ALL SELECT severity FROM ({COV_SQL}) b WHERE id <> 'coverage:go-test-run' UNION ALL SELECT 'error' FROM ({DUPF_SQL}) d"""
CHECK_SQL = """SELECT 3::BIGINT AS plugins, (SELECT count(*) FROM {o_cov}) + 1 + (SELECT count(*) + 2 * count(*) FILTER (measured) FROM {o_crap}) + (SELECT count(*) + 1 FROM {o_pair}) AS metrics, count(*) AS findings,
    count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices FROM {o_check}"""
for _n in ("agg_14", "u_02", "cmd_09"):
    query(_n, CHECK_SQL)(lambda c: E.check_summary(reports(c).run()).select("plugins", "metrics", "findings", "errors", "warnings", "notices"))
query("agg_15", "SELECT count(*) FILTER (severity = 'error') AS failing FROM {o_findings}")(lambda c: E.failing(c.findings))
query("cmd_10", "SELECT unnest(['coverage', 'crap', 'duplication']) AS name")(lambda c: c.spark.createDataFrame([(n,) for n in reports(c).names()], "name string"))
query("o_14", "SELECT unnest(['coverage', 'duplication']) AS name")(lambda c: c.spark.createDataFrame([(n,) for n in reports(c).names(["duplication", "coverage", "duplication"])], "name string"))
query("o_08", "SELECT id, path, name, round(value, 6) AS value FROM (SELECT 'coverage:' || file AS id, file AS path, 'coverage.percent' AS name, percent AS value FROM {o_cov}) x ORDER BY path, name, id")(
    lambda c: Cov.coverage_metrics(Cov.per_file(blocks(c))).filter("path <> ''").select("id", "path", "name", r6("value").alias("value")).orderBy("path", "name", "id")
)
BROKEN_SQL = """SELECT 'metrics' AS "table", id, 'value not finite' AS problem FROM {path_metrics} WHERE value > 15000 UNION ALL SELECT 'findings', 'x', 'repeated id' WHERE (SELECT count(*) FROM {path_metrics} WHERE value > 10000) > 1"""


def broken(c: Context) -> DataFrame:
    rows = c.fact("path_metrics")
    m = rows.select("id", "path", "name", F.when(F.col("value") > 15000, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), "unit")
    f = E.finding(rows.filter("value > 10000"), F.lit("x"), "rule", F.col("path"), "error", F.lit("message"))
    return E.problems(E.Report("broken", m, f)).select("table", "id", "problem")


query("r_21", BROKEN_SQL)(broken)
query("snk_07", "SELECT count(*) > 0 AS failed FROM {o_findings} WHERE severity = 'error'")(lambda c: gate(c))


def gate(c: Context) -> DataFrame:
    from gaugework.errors import PreconditionFailedError

    try:
        E.gate(c.findings, "error")
        failed = False
    except PreconditionFailedError:
        failed = True
    return c.spark.createDataFrame([(failed,)], "failed boolean")


query("u_06", "SELECT file, round(complexity * complexity * 0.125::DOUBLE + complexity, 6) AS score, complexity >= 8 AS over FROM {function_complexity}")(
    lambda c: c.fact("function_complexity").select("file", r6(M.crap_score(F.col("complexity"), F.lit(50.0))).alias("score"), M.passes(F.lit("minimum"), F.col("complexity"), F.lit(8)).alias("over"))
)

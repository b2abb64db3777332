"""Fact tables over the driver's tables, in SQL that both Spark and other engines read.

Each fact is a projection of the generic tables onto the engine's domain. A name in braces is a table or another fact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

FACTS: dict[str, str] = {
    "descriptors": """
        SELECT n_name AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'shared' ELSE lower(n_name) END AS name,
          CASE n_nationkey % 6 WHEN 0 THEN 'application' WHEN 1 THEN 'application-module' WHEN 2 THEN 'shared-module' WHEN 3 THEN 'library' WHEN 4 THEN 'infrastructure' ELSE 'development' END AS role,
          CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE r_name END AS category,
          CASE WHEN n_nationkey % 6 < 2 THEN 'app' || CAST(n_regionkey AS STRING) ELSE '' END AS application
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "source_files": """
        SELECT 'f' || CAST(o_orderkey AS STRING) AS path, 'p' || CAST(c_custkey % 50 AS STRING) AS package, n_name AS component, o_orderkey % 5 = 0 AS test,
          CAST(CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS abstract_types, CAST(CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 3 <> 0 THEN 0 ELSE 1 END AS BIGINT) AS concrete_types
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey <> 24""",  # a gap that is wanted: one component owns no file, as one that is only imported does
    "source_imports": """
        SELECT 'f' || CAST(l_orderkey AS STRING) AS path, 'p' || CAST(c_custkey % 50 AS STRING) AS source_package, 'q' || CAST(l_suppkey AS STRING) AS target_package, CASE WHEN c_nationkey = 3 THEN sn.n_name ELSE cn.n_name END AS source, sn.n_name AS target,
          CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_tax > 0.05 THEN 'alias' ELSE '' END AS alias, (c_nationkey + s_nationkey) % 5 = 0 OR l_returnflag = 'R' AS test
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
          JOIN {nation} cn ON cn.n_nationkey = c_nationkey JOIN {nation} sn ON sn.n_nationkey = s_nationkey
        WHERE (c_nationkey * 7 + s_nationkey * 3) % 11 = 0 OR c_nationkey = s_nationkey""",
    "diagnostics": """
        SELECT 'f' || CAST(o_orderkey AS STRING) AS path, 'priority ' || o_orderpriority AS message FROM {orders} WHERE o_orderkey % 1000 = 7""",
    "function_declarations": """
        SELECT 'pkg' || CAST(u % 10 AS STRING) || '.Fn' || CAST(u AS STRING) AS id, 'Fn' || CAST(u AS STRING) AS name, 'pkg' || CAST(u % 10 AS STRING) AS package, n_name AS component,
          CASE WHEN v = 0 THEN 'src' || CAST(u AS STRING) || '.x' ELSE '' END AS path, CAST(u % 40 + v AS BIGINT) AS line, CASE WHEN u % 3 = 0 THEN 'T' ELSE '' END AS receiver, u % 3 = 0 AS method, u % 2 = 0 AS exported,
          u % 9 = 0 AS test, u % 50 = 0 AS synthetic, u % 17 <> 0 AND v = 0 AS in_scope
        FROM (SELECT DISTINCT user_id % 200 AS u FROM {events}) users JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v) variants ON v = 0 OR u % 4 = 0 JOIN {nation} ON n_nationkey = u % 25""",
    "function_references": """
        SELECT 'pkg' || CAST(u % 10 AS STRING) || '.Fn' || CAST(u AS STRING) AS source, CASE WHEN e % 97 = 0 THEN 'ext.Unknown' ELSE 'pkg' || CAST(t % 10 AS STRING) || '.Fn' || CAST(t AS STRING) END AS target, test,
          'src' || CAST(u AS STRING) || '.x' AS path, CAST(e % 50 AS BIGINT) AS line, CAST(e % 7 AS BIGINT) AS column
        FROM (SELECT u, e, test, CASE WHEN e % 11 = 0 AND u < 100 THEN u + 100 WHEN (u - u % 20) % 40 = 0 THEN u - u % 20 + (u % 20 + e % 4) % 20 WHEN u % 20 + e % 4 > 19 THEN u - u % 20 + 19 ELSE u + e % 4 END AS t
          FROM (SELECT user_id % 200 AS u, event_id AS e, event_type = 'signup' AS test FROM {events}) refs) places""",
    "loc_files": """
        SELECT source || '/' || lang || '/d' || CAST(doc_id AS STRING) || '.x' AS path, source || '/' || lang AS package_dir, source AS module_dir, 'example.com/' || source AS module_path, doc_id % 7 = 0 AS test, doc_id % 11 = 0 AS generated,
          CAST(n + 3 AS BIGINT) AS total, CAST(n + 3 - (n + 3) % 3 - (n + 3) % 2 AS BIGINT) AS code, CAST((n + 3) % 3 AS BIGINT) AS comment, CAST((n + 3) % 2 AS BIGINT) AS blank
        FROM (SELECT doc_id, source, lang, length(text) - length(replace(text, chr(10), '')) AS n FROM {documents}) lines""",
    "loc_functions": """
        SELECT source || '/' || lang || '/d' || CAST(doc_id AS STRING) || '.x' AS path, 'F' || CAST(k AS STRING) AS name, CAST(k * 10 AS BIGINT) AS start_line, CAST(k * 10 + n_chars % 9 AS BIGINT) AS end_line, k <> 3 AS has_body,
          CAST(n_chars % 9 + 1 AS BIGINT) AS total, CAST((n_chars + k * 7) % 40 AS BIGINT) AS code, CAST(n_chars % 5 AS BIGINT) AS comment, CAST(n_chars % 3 AS BIGINT) AS blank
        FROM {documents} JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) ks ON k <= doc_id % 4""",
    "coverage_blocks": """
        SELECT 'f' || CAST(l_orderkey AS STRING) AS file, CAST(l_linenumber * 3 AS BIGINT) AS start_line, CAST(l_linenumber * 3 + l_partkey % 4 AS BIGINT) AS end_line, CAST(l_quantity AS BIGINT) - CAST(l_quantity AS BIGINT) % 5 AS num_stmt,
          CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS BIGINT) AS count
        FROM {lineitem} WHERE l_orderkey % 3 <> 0""",  # a gap that is wanted: a profile leaves files out, and these are unmeasured
    "function_complexity": """
        SELECT 'f' || CAST(l_orderkey AS STRING) AS file, 'F' || CAST(l_linenumber AS STRING) AS name, 'p' || CAST(l_suppkey AS STRING) AS package, CAST(l_linenumber * 3 - 1 AS BIGINT) AS start_line,
          CAST(l_linenumber * 3 + l_suppkey % 5 AS BIGINT) AS end_line, CAST(1 + l_partkey % 15 AS BIGINT) AS complexity
        FROM {lineitem}""",
    "mutation_tokens": """
        SELECT 'f' || CAST(l_orderkey AS STRING) AS file, CAST(l_linenumber * 3 AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS column,
          CASE l_partkey % 17 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '*' WHEN 3 THEN '>' WHEN 4 THEN '>=' WHEN 5 THEN '<' WHEN 6 THEN '<=' WHEN 7 THEN '==' WHEN 8 THEN '!=' WHEN 9 THEN '&&' WHEN 10 THEN '||' WHEN 11 THEN '0'
            WHEN 12 THEN '1' WHEN 13 THEN 'true' WHEN 14 THEN 'false' WHEN 15 THEN '%' ELSE '2' END AS original
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) picked""",
    "shapes": """
        SELECT CAST(p_partkey AS BIGINT) AS ord, 'part' || CAST(p_partkey AS STRING) || '.x' AS file, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + p_partkey % 30 AS BIGINT) AS end_line, CAST(p_partkey % 60 AS BIGINT) AS nodes,
          p_partkey % 13 <> 0 AS has_body
        FROM {part}""",
    "fingerprints": """
        SELECT CAST(p_partkey AS BIGINT) AS ord, 'p' || CAST((p_partkey - p_partkey % 4) / 4 * 10 + i AS STRING) AS fingerprint
        FROM {part} JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i UNION ALL SELECT 2 AS i UNION ALL SELECT 3 AS i UNION ALL SELECT 4 AS i UNION ALL SELECT 5 AS i UNION ALL SELECT 6 AS i UNION ALL SELECT 7 AS i) ks ON i < 8 - p_partkey % 3
        UNION ALL SELECT CAST(p_partkey AS BIGINT) AS ord, 'common' || CAST(p_size AS STRING) AS fingerprint FROM {part}""",
    "type_methods": """
        SELECT 'pkg.' || replace(p_name, ' ', '') || CAST(p_partkey AS STRING) AS type, 'M' || CAST(i AS STRING) || '()' AS method
        FROM {part} JOIN (SELECT 1 AS i UNION ALL SELECT 2 AS i UNION ALL SELECT 3 AS i UNION ALL SELECT 4 AS i) ks ON (p_size + i * p_partkey) % (i + 1) = 0""",
    "interface_methods": """
        SELECT 'pkg.I' || CAST(n_nationkey AS STRING) AS interface, 'M' || CAST(i AS STRING) || '()' AS method
        FROM {nation} JOIN (SELECT 1 AS i UNION ALL SELECT 2 AS i UNION ALL SELECT 3 AS i UNION ALL SELECT 4 AS i) ks ON (n_nationkey + i) % 3 <> 0 AND i <= 1 + n_nationkey % 4""",
    "type_relations": """
        SELECT 'pkg.T' || CAST(p_partkey AS STRING) AS source, p_brand AS source_component, 'pkg.T' || CAST((p_partkey * 7) % 100 AS STRING) AS target, 'Brand#' || CAST(1 + (p_partkey * 7) % 5 AS STRING) || CAST(1 + p_size % 5 AS STRING) AS target_component,
          CASE p_partkey % 3 WHEN 0 THEN 'implements' WHEN 1 THEN 'embeds' ELSE 'references' END AS kind
        FROM {part}""",
    "path_metrics": """
        SELECT 'm:' || CAST(doc_id AS STRING) AS id, source || '/' || lang || '/d' || CAST(doc_id AS STRING) || '.x' AS path, CASE WHEN doc_id % 2 = 0 THEN 'loc.file.lines.total' ELSE 'loc.file.lines.code' END AS name,
          CAST(n_chars AS DOUBLE) AS value, 'lines' AS unit
        FROM {documents}""",
    "tree_paths": """
        SELECT DISTINCT source || '/' || lang || CASE WHEN doc_id % 3 = 0 THEN '/deep/only/d' || CAST(doc_id % 10 AS STRING) ELSE '' END AS id FROM {documents}""",
    "strategy_components": """
        SELECT r_name || '/g' || CAST(n_nationkey % 3 AS STRING) || '/' || n_name AS id, n_name AS nation FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact as a DataFrame; nothing is computed yet."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = FACTS[name]
    return spark.sql(sql, **{n: fact(spark, sf_dir, n) for n in names_in(sql)})


def oracle(body: str, views: dict[str, str] | None = None) -> str:
    """A whole statement: ``body`` with all facts and views that it names, directly or not, as common tables."""
    known = FACTS | (views or {})
    ordered: dict[str, str] = {}

    def need(sql: str) -> None:
        for n in names_in(sql):
            if n not in TABLES and n not in ordered:
                need(known[n])
                ordered[n] = known[n]

    need(body)
    plain = lambda sql: re.sub(r"\{([a-z]\w*)\}", r"\1", sql).strip()
    head = ",\n".join(f"{n} AS ({plain(sql)})" for n, sql in ordered.items())
    return (f"WITH RECURSIVE {head}\n" if head else "") + plain(body)

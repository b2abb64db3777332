"""Schemas of the fact tables that the engine consumes and of the evidence that it gives. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

GRAPH_VERSION = 9
EVIDENCE_VERSION = 1

_DDL = {
    "source_files": "path string, package string, component string, test boolean, abstract_types long, concrete_types long",
    "source_imports": "path string, source_package string, target_package string, source string, target string, line long, alias string, test boolean",
    "descriptors": "id string, name string, role string, category string, application string",
    "diagnostics": "path string, message string",
    "function_declarations": "id string, name string, package string, component string, path string, line long, receiver string, method boolean, exported boolean, test boolean, synthetic boolean, in_scope boolean",
    "function_references": "source string, target string, test boolean, path string, line long, column long",
    "types": "id string, name string, package string, component string, path string, line long, kind string, exported boolean, test boolean, underlying string, "
    "fields array<struct<name:string,type:string,embedded:boolean,exported:boolean>>, methods array<struct<name:string,signature:string,exported:boolean,pointer_receiver:boolean>>, "
    "embeds array<struct<id:string,component:string>>, implements array<struct<id:string,component:string>>, references array<struct<id:string,component:string>>",
    "coverage_blocks": "file string, start_line long, end_line long, num_stmt long, count long",
    "function_complexity": "file string, name string, package string, start_line long, end_line long, complexity long",
    "loc_files": "path string, package_dir string, module_dir string, module_path string, test boolean, generated boolean, total long, code long, comment long, blank long",
    "loc_functions": "path string, name string, start_line long, end_line long, has_body boolean, total long, code long, comment long, blank long",
    "mutation_sites": "file string, index long, line long, column long, original string, mutant string, category string, function string",
    "fingerprints": "file string, start_line long, end_line long, nodes long, ord long, fingerprint string",
    "path_policies": "id string, include array<string>, exclude array<string>, thresholds array<struct<metric:string,comparison:string,value:double,severity:string>>",
    "metrics": "id string, path string, name string, value double, unit string",
    "findings": "id string, rule string, path string, severity string, message string, actual double, limit double",
}
TABLES = tuple(_DDL)


def schema(name: str) -> StructType:
    """The schema of a table; Spark must be running, for it reads the declarations."""
    return StructType.fromDDL(_DDL[name])



ROLES = ("application", "application-module", "shared-module", "library", "infrastructure", "development")
TYPE_KINDS = ("struct", "interface", "alias", "basic")
GRAPH_SEVERITIES = ("error", "warning")
SEVERITIES = ("error", "warning", "notice")
COMPARISONS = ("minimum", "maximum")
SOURCE_KINDS = ("all", "handwritten", "test", "generated")

"""Small fixtures with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from gaugework import errors
from gaugework.functions import globs
from gaugework.functions import metrics as M
from gaugework.functions.classify import Classifier, Template
from gaugework.operators import balance as B
from gaugework.operators import closure as G
from gaugework.operators import components as C
from gaugework.operators import coverage as Cov
from gaugework.operators import evidence as E
from gaugework.operators import functions as Fn
from gaugework.operators import loc as L
from gaugework.operators import policy as P
from gaugework.operators import query as Q
from gaugework.operators import rules as R
from gaugework.operators import similarity as Si
from gaugework.operators import strategy as S
from gaugework.sources import files as Fi
from gaugework.sources import gosyntax as Go


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_metrics(spark):
    one = spark.range(1)
    got = one.select(
        M.instability(F.lit(2), F.lit(1)), M.abstractness(F.lit(1), F.lit(3)), M.main_sequence_distance(F.lit(0.25), F.lit(1 / 3)), M.instability(F.lit(0), F.lit(0)), M.abstractness(F.lit(0), F.lit(0)),
        *(M.crap_score(F.lit(4), F.lit(float(p))) for p in (100, 75, 50, 25, 0)),
    ).first()
    assert got[0] == pytest.approx(1 / 3) and got[1] == 0.25 and got[2] == pytest.approx(5 / 12) and got[3] == got[4] == 0
    assert list(got[5:]) == [4, 4.25, 6, 10.75, 20]


def test_cycles_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "e"), (None, "a")], "src string, dst string")
    assert rows(G.cycles(G.strongly_connected(edges)), "members") == [(["a", "b"],), (["c", "d"],)]
    assert rows(G.closure(edges)) == [("a", "b"), ("b", "a"), ("c", "d"), ("c", "e"), ("d", "c"), ("d", "e")]
    assert rows(G.closure(edges.limit(0))) == []
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "src string, dst string")
    assert G.closure(chain).count() == 78


def test_function_graph(spark):
    d = lambda n, app: (f"p.{n}", n, "p", app, f"{n}.x", 1, "", False, True, False, False, True)
    decl = spark.createDataFrame([d("Start", "cmd"), d("Read", "lib"), d("Write", "lib")], "id string, name string, package string, component string, path string, line long, receiver string, method boolean, exported boolean, test boolean, synthetic boolean, in_scope boolean")
    refs = spark.createDataFrame([("p.Start", "p.Read", False, "s", 1, 1), ("p.Read", "p.Write", False, "r", 1, 1), ("p.Write", "p.Read", False, "w", 1, 1), ("p.Read", "p.Read", False, "r", 2, 1), ("p.Read", "p.Read", False, "r", 2, 1), ("p.X", "p.Read", False, "r", 2, 1)], "source string, target string, test boolean, path string, line long, column long")
    apps = spark.createDataFrame([("cmd", "control"), ("lib", "")], "id string, application string")
    g = Fn.build(decl, refs, apps)
    assert rows(G.cycles(g.cycle_members), "members") == [(["p.Read", "p.Write"],)]
    read = g.functions.filter("id = 'p.Read'").first()
    assert read.using_applications == ["control"] and read.afferent == 2 and read.incoming_call_sites == 4 and read.in_cycle
    assert g.calls.filter("source = 'p.Read' and target = 'p.Read'").first().calls == 1  # an edge counts distinct sites


def test_component_graph(spark):
    files = spark.createDataFrame([("a/1", "a", "a", False, 0, 1), ("a/1_t", "a", "a", True, 5, 5), ("b/1", "b", "b", False, 1, 0)], "path string, package string, component string, test boolean, abstract_types long, concrete_types long")
    site = lambda path, s, t, test: (path, s, t, s, t, 1, "", test)
    imports = spark.createDataFrame([site("a/1", "a", "b", False), site("a/1_t", "a", "c", True), site("a/1", "a", "a", False), site("b/1", "b", "c", False)], "path string, source_package string, target_package string, source string, target string, line long, alias string, test boolean")
    roles = spark.createDataFrame([("a", "a", "library", "", ""), ("b", "b", "development", "tools", ""), ("c", "c", "shared-module", "", "")], "id string, name string, role string, category string, application string")
    g = C.build(files, imports, roles)
    a, b, c = (g.components.filter(F.col("id") == i).first() for i in "abc")
    assert (a.efferent, a.test_only_dependencies, a.abstract_types, a.concrete_types, a.category) == (1, 1, 0, 1, "library")
    assert (b.afferent, b.abstractness, b.category) == (1, 1.0, "tools")
    assert (c.source_files, c.afferent, c.transitive_importers, c.importer_packages) == (0, 1, 2, 2)
    assert rows(R.evaluate(g), "rule", "subject") == [("library-imports-feature", "a -> c")] * 0 + [("production-imports-development", "a -> b"), ("stable-component-low-abstraction", "c")]
    back = R.written_back(g.relationships, R.evaluate(g))
    assert back.filter("source = 'a' and target = 'b'").first().rule_violations == ["production-imports-development"]


def test_rules_are_strict_about_instability(spark):
    comps = spark.createDataFrame([("a", "library", "", "", 0.5), ("b", "library", "", "", 0.5), ("c", "library", "", "", 0.6)], "id string, role string, category string, application string, instability double")
    rels = spark.createDataFrame([("a", "b", False), ("a", "c", False), ("b", "c", True)], "source string, target string, test_only boolean")
    assert rows(R.edge_findings(rels, comps), "rule", "subject") == [("stable-dependency-principle", "a -> c")]


def test_dependency_policy(spark):
    comps = spark.createDataFrame([("a", "library", "", "x", 0.5), ("b", "library", "", "x", 0.5), ("c", "development", "", "", 0.6)], "id string, role string, category string, application string, instability double")
    rels = spark.createDataFrame([("a", "b", False), ("a", "c", False), ("b", "c", True)], "source string, target string, test_only boolean")
    assert P.configured_findings(rels, comps, P.DependencyPolicy()).count() == 0
    grant = P.DependencyRule("g", same_application=True)
    deny = P.DependencyRule("d", P.Selector(roles=("library",)), P.Selector(roles=("development",)), "no")
    assert rows(P.configured_findings(rels, comps, P.DependencyPolicy(False, True, (grant,))), "subject") == [("a -> c",)]
    assert rows(P.configured_findings(rels, comps, P.DependencyPolicy(True, True, (grant,), (deny,))), "subject") == [("a -> c",), ("b -> c",)]
    assert P.DependencyPolicy().cache_key("k") == "k" and P.DependencyPolicy(False).cache_key("k") != "k"
    with pytest.raises(errors.ValidationError):
        P.DependencyPolicy(allow=(grant, grant))


def test_globs(spark):
    def match(pattern, path):
        return spark.createDataFrame([(path,)], "p string").select(globs.matches_any(F.col("p"), [pattern])).first()[0]

    for pattern, path, want in [
        ("internal/**", "internal", True), ("internal/**", "internal/a/b", True), ("**/*.go", "main.go", True), ("**/testdata/**", "internal/order/testdata/input.go", True), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/b/c", False),
        ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("f?[a-c].x", "f1b.x", True), ("f?[^a-c].x", "f1b.x", False), ("**", "a/b", True), ("a.b", "axb", False), ("a/**/b/**", "a/b", True),
    ]:
        assert match(pattern, path) is want, (pattern, path)
    df = spark.createDataFrame([("internal/order/service.go",), ("internal/order/testdata/input.go",), ("internal/generated/x.go",)], "path string")
    assert rows(df.filter(globs.selected(F.col("path"), ["internal/**", "pkg/**"], ["**/testdata/**", "internal/generated/**"]))) == [("internal/order/service.go",)]
    assert rows(df.filter(globs.ignored(F.col("path"), ["testdata", "internal/gen*"]))) == [("internal/generated/x.go",), ("internal/order/testdata/input.go",)]
    with pytest.raises(errors.ValidationError):
        globs.glob_regex("[a")


def test_classifier(spark):
    k = Classifier.of(application_module=["cmd/{application}/internal/{component}"], shared_module=["internal/module/{component}"], library=["pkg"], application=["cmd/{application}"])
    paths = ["cmd/x/main.go", "cmd/x/internal/orders/a.go", "internal/module/audit/deep/x.go", "internal/module", "pkg/x.go", "pkg/deep/x.go", "x.go"]
    got = dict(rows(k.classify(spark.createDataFrame([(p,) for p in paths], "path string")), "path", "component_id"))
    assert got == {"cmd/x/main.go": "cmd/x", "cmd/x/internal/orders/a.go": "cmd/x/internal/orders", "internal/module/audit/deep/x.go": "internal/module/audit", "internal/module": None, "pkg/x.go": "pkg", "pkg/deep/x.go": None, "x.go": None}
    with pytest.raises(errors.ValidationError):
        Template("cmd/{thing}", "application", "application")


def test_coverage(spark):
    blocks = spark.createDataFrame([("order.go", 10, 14, 3, 2), ("order.go", 16, 18, 2, 0), ("empty.go", 5, 5, 0, 0)], "file string, start_line long, end_line long, num_stmt long, count long")
    f = spark.createDataFrame([("order.go", "a", 10, 14), ("order.go", "b", 16, 18), ("order.go", "c", 1, 100), ("order.go", "d", 200, 210), ("none.go", "e", 1, 2)], "file string, name string, start_line long, end_line long")
    assert rows(Cov.function_coverage(f, blocks), "name", "measured", "percent") == [("a", True, 100.0), ("b", True, 0.0), ("c", True, 60.0), ("d", True, 0.0), ("e", False, None)]
    two = spark.createDataFrame([("a", 1, 1, 1, 1), ("b", 1, 1, 9, 0)], "file string, start_line long, end_line long, num_stmt long, count long")
    assert Cov.overall(Cov.per_file(two)).first().percent == 10.0


def test_lines_of_code(spark):
    files = spark.createDataFrame([("p/a", "p", "m", "mod", False, False, 10, 6, 2, 2), ("p/b", "p", "m", "mod", True, True, 5, 5, 0, 0)], "path string, package_dir string, module_dir string, module_path string, test boolean, generated boolean, total long, code long, comment long, blank long")
    fns = spark.createDataFrame([("p/a", "f", 1, 2, True, 1, c, 0, 0) for c in (1, 3, 2)], "path string, name string, start_line long, end_line long, has_body boolean, total long, code long, comment long, blank long")
    t = L.aggregates(files, fns)
    repo = t.filter("scope = 'repository'").first()
    assert (repo.lines_total, repo.lines_test, repo.function_lines_average, repo.function_lines_p95, repo.function_lines_maximum) == (15, 5, 2.0, 3, 3)
    empty = t.filter("scope = 'file' and path = 'p/b'").first()
    assert (empty.functions_total, empty.function_lines_average, empty.function_lines_p95) == (0, 0.0, 0)
    o = L.overview(files, fns, ["package_dir"]).first()
    assert (o.files_handwritten, o.lines_handwritten, o.lines_handwritten_percent) == (1, 10, pytest.approx(200 / 3))
    assert L.aggregates(files.limit(0), fns.limit(0)).filter("scope = 'repository'").first().lines_generated_percent == 0


@pytest.mark.parametrize("n", [1, 7, 19, 20, 21, 40, 59, 60, 61, 100])
def test_nearest_rank(spark, n):
    files = spark.createDataFrame([("p/a", "p", "m", "mod", False, False, 1, 1, 0, 0)], "path string, package_dir string, module_dir string, module_path string, test boolean, generated boolean, total long, code long, comment long, blank long")
    fns = spark.range(1, n + 1).selectExpr("'p/a' path", "'f' name", "id start_line", "id end_line", "true has_body", "id total", "id code", "0L comment", "0L blank")
    assert L.aggregates(files, fns).filter("scope = 'repository'").first().function_lines_p95 == math.ceil(0.95 * n)


def test_similarity(spark):
    sets = [(1, x) for x in range(10)] + [(2, x) for x in range(10)] + [(3, x) for x in range(2, 13)] + [(4, 99)]
    df = spark.createDataFrame(sets, "ord long, fingerprint long")
    assert rows(Si.pairs(df, 8 / 13), "left", "right", "shared") == [(1, 2, 10), (1, 3, 8), (2, 3, 8)]
    assert rows(Si.pairs(df, 0.62), "left", "right") == [(1, 2)]
    with pytest.raises(errors.ValidationError):
        Si.pairs(df, 0)
    places = spark.createDataFrame([(i, f"f{i}", 1, 9) for i in range(1, 5)], "ord long, file string, start_line long, end_line long")
    found = Si.located(Si.pairs(df, 0.6), places)
    assert rows(Si.over_budget(found, 2), "left_file", "right_file", "rank") == [("f1", "f2", 1)]


def test_similarity_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = {i: {rng.randrange(30) for _ in range(rng.randrange(1, 14))} for i in range(80)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "ord long, fingerprint long")
    for t in (0.3, 0.5, 0.75, 1.0):
        want = sorted((i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t)
        assert rows(Si.pairs(df, t), "left", "right") == want


def test_zones(spark):
    c = spark.createDataFrame([("p", "p", 17, 0, 0.0, 0.0, 1.0), ("b", "b", 1, 1, 0.5, 0.5, 0.0), ("f", "f", 0, 2, 1.0, 0.0, 0.0), ("i", "i", 0, 0, 0.0, 0.0, 1.0), ("x", "x", 1, 1, 0.5, 0.2, 0.3)], "id string, name string, afferent long, efferent long, instability double, abstractness double, distance double")
    assert [r[1:] for r in rows(B.zone_counts(c))] == [("pain", 1), ("useless", 0), ("drifting", 0), ("balanced", 2), ("free", 1), ("isolated", 1)]
    bars = dict(rows(B.histogram(c), "bar", "components"))
    assert bars[2] == 1 and bars[3] == 0 and bars[9] == 1 and sum(bars.values()) == 3
    gap = c.limit(1).withColumn("distance", F.lit(0.6))
    assert sum(n for _, n in rows(B.histogram(gap), "bar", "components")) == 0


def test_strategy(spark):
    ids = ["cmd/control", "internal/module/orders", "internal/module/billing", "internal/library/telemetry", "internal/library/clock"]
    comps = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = [(ids[0], ids[1]), (ids[0], ids[2]), (ids[1], ids[3]), (ids[1], ids[4]), (ids[1], ids[2]), (ids[3], ids[4])]
    make = lambda e: spark.createDataFrame([(*x, False) for x in e], "source string, target string, test_only boolean")
    groups, between = S.report(comps, make(edges))
    assert dict(rows(groups, "id", "layer")) == {"internal/library": 0, "internal/module": 1, "cmd/control": 2}
    assert ("internal/module", "internal/library", 2) in rows(between, "source", "target", "weight")
    groups, between = S.report(comps, make([*edges, (ids[4], ids[1])]))
    assert dict(rows(groups, "id", "layer"))["internal/library"] == dict(rows(groups, "id", "layer"))["internal/module"]
    assert rows(between.filter("cyclic"), "source") == [("internal/library",), ("internal/module",)]


def test_tree(spark):
    t = B.tree(spark.createDataFrame([("internal/module/a",), ("internal/module/b",), ("cmd/x",)], "id string"))
    assert rows(t, "path", "label", "parent") == [("cmd/x", "cmd/x", ""), ("internal/module", "internal/module", ""), ("internal/module/a", "a", "internal/module"), ("internal/module/b", "b", "internal/module")]


def test_select(spark):
    s = Q.select_rows(spark.createDataFrame([(4,), (1,), (3,), (2,)], "v long"), F.col("v") % 2 == 0, [F.col("v").desc()], 1)
    assert s.counts().first().asDict() == {"matched": 2, "returned": 1} and rows(s.rows) == [(4,)]
    with pytest.raises(errors.ValidationError):
        Q.limit_of(-1)


def test_evidence(spark):
    m = spark.createDataFrame([("a", "p", "n", 1.0, ""), ("a", "p", "n", float("inf"), "")], "id string, path string, name string, value double, unit string")
    f = spark.createDataFrame([("x", "r", "p", "fatal", "m", None, None)], "id string, rule string, path string, severity string, message string, actual double, limit double")
    assert rows(E.problems(E.Report("r", m, f)), "id", "problem") == [("a", "repeated id"), ("a", "value not finite"), ("x", "unknown severity")]
    catalog = E.Catalog()
    catalog.register("b", lambda: E.Report("b", m.limit(1), f.limit(0)))
    with pytest.raises(errors.AlreadyExistsError):
        catalog.register("b", lambda: None)
    with pytest.raises(errors.NotFoundError):
        catalog.names(["c"])
    assert len(catalog.run()) == 1
    placed = E.place(spark.range(100).withColumn("k", F.col("id") % 7), ["k", "id"])
    want = {v: i for i, v in enumerate(sorted(range(100), key=lambda x: (x % 7, x)))}
    assert dict(rows(placed, "id", "place")) == want


def test_policies_reject_what_is_ambiguous(spark):
    m = spark.createDataFrame([("src/a", "x", 1.0), ("lib/a", "x", 3.0)], "path string, name string, value double")
    ps = [P.PathPolicy("p", ("src/**",), (), (P.Threshold("x", "minimum", 2.0),)), P.PathPolicy("q", (), ("lib/**",), (P.Threshold("x", "maximum", 2.0),))]
    assert rows(P.ambiguous(P.resolve(m, ps)), "path", "policies") == [("src/a", "p, q")]
    with pytest.raises(errors.ValidationError):
        P.Threshold("x", "minimum", float("nan"))


GO = """// Code generated by x. DO NOT EDIT.

package main

import (
	"fmt"
	al "example.com/m/a"
)

type Reader interface { Read() }
type (
	A struct {
		x int
	}
	B = A
)

/* multi
line */
func (r *A[T]) Do(x int) (int, error) {
	if x > 0 && x != 1 { // c
		return x - 1, nil
	}
	for i := range 3 {
		s := `raw

string`
		_ = s
	}
	return -x, nil
}

func plain()
"""


def test_go_source(spark):
    assert [(f.name, f.start_line, f.end_line, f.has_body, f.complexity) for f in Go.functions(GO)] == [("A.Do", 20, 31, True, 4), ("plain", 33, 33, False, 1)]
    assert Go.imports(GO) == [("fmt", "", 6), ("example.com/m/a", "al", 7)] and Go.named_types(GO) == (1, 2)
    lines = Go.line_classes(GO)
    assert lines[25] == "code" and lines.count("comment") == 3 and len(lines) == 33  # a blank line in a raw string is code
    assert [t.text for t in Go.mutable_tokens(GO)] == [">", "0", "&&", "!=", "1", "-", "1"]
    same, other = (Go.shape(Go.functions(f"package p\nfunc F({a} int) int {{\n\treturn {a} {op} 2\n}}\n")[0].body)[1] for a, op in (("x", "+"), ("y", "+")))
    assert same == other and same != Go.shape(Go.functions("package p\nfunc F(x int) int {\n\treturn x - 2\n}\n")[0].body)[1]
    files = spark.createDataFrame([("a.go", GO), ("b.go", None)], "path string, content string")
    assert rows(Go.extract(files, "files"), "path", "generated_marker", "total") == [("a.go", True, 33), ("b.go", False, 0)]
    assert rows(Go.module_imports(Go.extract(files, "imports"), "example.com/m")) == [("a.go", "a", 7, "al")]


def test_scopes():
    assert Fi.scopes(["b/./c", "a/", "a"]) == ["a", "b/c"] and Fi.scopes([]) == ["."]
    for bad in ("/a", "..", "a/../..", "", " a"):
        with pytest.raises(errors.ValidationError):
            Fi.scopes([bad])


def test_errors():
    assert len(errors.CATEGORIES) == 15 and set(errors.RPC_CODES) == set(errors.CATEGORIES)
    assert errors.NotFoundError("x", id=1).entity == {"id": 1}

from cairngraph.operators import lookup
from cairngraph.plans import graph_queries, report_queries
from tests.helpers import edge, edges, graph, node, nodes, rows


def names(spark, *given):
    return spark.createDataFrame([(x,) for x in given], "name string")


def test_names(spark, work):
    many = [node(f"m{i}.same") for i in range(12)]
    g = graph(spark, work, [node("app.a.f"), node("b.f"), node("dom.s.pay"), node("top.mod"), *many], [])
    roots = lookup.path_roots("/w/owner/app", ["src"])
    assert "owner.app" in roots and "app.src" in roots and "w.owner.app" in roots
    got = {r["name"]: r for r in lookup.resolve_names(g, names(spark, "b.f", " a.f ", "f", "app.dom.s.pay", "owner.app.top.mod", "nope.s.pay", "same", "", None, "x_f", "app"), roots).collect()}
    of = lambda n: (got[n]["resolved"], got[n]["via_suffix"], len(got[n]["candidates"]), got[n]["truncated"])
    assert of("b.f") == ("b.f", False, 0, False) and of("a.f") == ("app.a.f", True, 0, False)
    assert of("f") == (None, False, 2, False) and got["f"]["candidates"] == ["app.a.f", "b.f"]
    assert of("app.dom.s.pay") == ("dom.s.pay", True, 0, False) and of("owner.app.top.mod") == ("top.mod", True, 0, False)
    assert of("nope.s.pay") == (None, False, 0, False) and of("same") == (None, False, 10, True)
    assert of("") == (None, False, 0, False) and of("x_f")[0] is None and of("app")[0] is None


def test_prefixes_and_filters(spark, work):
    g = graph(spark, work, [node("dom.s.pay"), node("app.x", namespace="EXTERNAL", file_path="EXTERNAL"), node("proj.proj.y"), node("t.tests.z"), node("t.testservice.z"), node("pkg.m", "FILE")], [])
    roots = ["app", "src", "src.app", "proj"]
    got = dict(rows(lookup.effective_prefixes(g, spark.createDataFrame([("app.dom",), ("src.app.dom.s",), ("proj.proj",), ("app.none",), (" dom ",), (" ",)], "prefix string"), roots)))
    assert got == {"app.dom": "dom", "src.app.dom.s": "dom.s", "proj.proj": "proj.proj", "app.none": "app.none", "dom": "dom"}
    assert lookup.covers_internal(g, "dom").first()[0] and not lookup.covers_internal(g, "app").first()[0] and not lookup.covers_internal(g, "do").first()[0]
    assert lookup.terms(" a ") == ["a"] and lookup.terms(None) == [] and lookup.terms(["a", " ", "b ", "a"]) == ["a", "b"]
    assert rows(g.nodes.where(lookup.without_segments("id", "tests")).where("id like 't.%'").select("id")) == [("t.testservice.z",)]
    assert rows(g.nodes.where(lookup.in_scope("id", ["dom", "t.tests"])).select("id")) == [("dom.s.pay",), ("t.tests.z",)]
    assert g.nodes.where(lookup.in_scope("id", None)).count() == 6
    assert lookup.is_package(g, "pkg") and not lookup.is_package(g, "pkg.m")
    assert rows(lookup.fetch_nodes(g, spark.createDataFrame([("dom.s.pay",), ("dom.s.pay",), ("no",)], "id string")).select("id")) == [("dom.s.pay",)]


def test_contexts_lookups_and_reports(spark, work):
    n = [node("p.C", "CLASS"), node("p.C.a", "METHOD", metadata='{"self_attrs": []}'), node("p.C.b", "METHOD", metadata='{"self_attrs": []}'), node("p.g"), node("p.tests.t", test=True), node("q.h")]
    e = [edge("1", "p.C", "p.C.a", "DECLARES"), edge("2", "p.C", "p.C.b", "DECLARES"), edge("3", "p.g", "p.C.a"), edge("4", "p.tests.t", "p.C.a"), edge("5", "q.h", "p.g"), edge("6", "q.h", "raw_call:x")]
    g = graph(spark, work, n, e)
    owner, members = lookup.class_context(g, "p.C.a")
    assert rows(owner.select("id")) == [("p.C",)] and rows(members.select("id")) == [("p.C.b",)]
    assert lookup.class_context(g, "p.g")[0].count() == 0
    got = lookup.answer_lookups(g, ["C.a", "none", "q.h"])
    assert rows(got.select("name", "resolved", "caller", "depth")) == sorted([("C.a", "p.C.a", "p.g", 1), ("C.a", "p.C.a", "q.h", 2), ("none", None, None, None), ("q.h", "q.h", None, None)], key=str)
    report = {(r["section"], r["nth"]): (r["id"], r["first"], r["second"]) for r in lookup.architecture_report(g, ["tests"], ["p"]).collect()}
    assert report["bottlenecks", 1] == ("p.C.a", 2.0, 0.0) and report["god_classes", 1] == ("p.C", 2.0, None)
    assert report["cohesion", 1] == ("p.C", 2.0, 2.0) and report["resolution", 1] == (None, 0.0, 3.0) and report["critical", 1][0] == "p.C.a"
    top = {(r["kind"], r["nth"]): (r["prefix"], r["symbols"]) for r in lookup.overview_packages(g, limit=1).collect()}
    assert top == {("production", 1): ("p", 2), ("test", 1): ("p.tests", 1)}


def test_base_classes_as_in_sql(spark, work, tmp_path):
    from compare import plain, tables

    n = [node("A", "CLASS", at=1), node("B", "CLASS", at=1), node("B", "CLASS", at=2, name="B2"), node("C", "CLASS", at=1), node("C", "CLASS", at=2, gone=3), node("D", "CLASS", at=1, gone=2), node("D", "CLASS", at=3), node("E", "CLASS")]
    e = [edge("1", "E", " A ", "extends"), edge("2", "E", "B", "EXTENDS"), edge("3", "D", "B", "EXTENDS"), edge("4", "E", "C", "EXTENDS"), edge("5", "E", "D", "EXTENDS"), edge("6", "D", "E"), edge("7", "D", "none", "EXTENDS")]
    nodes(spark, n).write.parquet(f"{tmp_path}/nodes.parquet")
    edges(spark, e).write.parquet(f"{tmp_path}/edges.parquet")
    want = tables(str(tmp_path)).execute(graph_queries.ORACLE["node_lookup"])
    got = report_queries.node_lookup(graph(spark, work, n, e))
    assert got.columns == [c[0] for c in want.description] and dict(got.dtypes)["deleted_at"] == "timestamp"
    assert rows(got) == sorted(map(plain, want.fetchall()), key=str)
    assert rows(got.select("id", "name", "deleted_at")) == [("A", "A", None), ("B", "B2", None), ("D", "D", None)]

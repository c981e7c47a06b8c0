from cairngraph.operators import linking
from tests.helpers import edge, edges, node, nodes, rows


def test_rules_in_their_order(spark, work):
    n = [node("m.f", file_path="m.py"), node("m.g", file_path="m.py"), node("k.g", file_path="k.py"), node("k.only", file_path="k.py"), node("k.Base", "CLASS", file_path="k.py"), node("k.Base.run", "METHOD", file_path="k.py"), node("m.Sub", "CLASS", file_path="m.py"), node("m.Sub.go", "METHOD", file_path="m.py"), node("di.db", "VARIABLE", file_path="di.py"), node("x.db", "VARIABLE", file_path="x.py"), node("m.db", "VARIABLE", file_path="m.py"), node("crud.make", file_path="crud.py"), node("crud.drop", file_path="crud.py"), node("clash", file_path="z.py"), node("other.clash", file_path="w.py")]
    targets = {
        "imported": ("m.f", "raw_call:kk.g"), "local": ("m.f", "raw_call:g"), "global": ("m.f", "raw_call:only"), "none": ("m.f", "raw_call:nothing.at"), "clash": ("m.f", "raw_call:clash"),
        "self": ("m.Sub.go", "self.go"), "base": ("m.Sub.go", "self.run"), "lost": ("m.Sub.go", "self.missing"), "prefix": ("m.f", "raw_call:mk"), "final": ("m.f", "app.crud.drop"), "out": ("m.f", "raw_call:np.sum"), "std": ("m.f", "raw_call:json.dumps"),
    }
    e = [edge(k, s, t, file_path="m.py") for k, (s, t) in targets.items()]
    e += [edge("ext", "m.Sub", "raw_class:Base", "EXTENDS", file_path="m.py"), edge("known", "m.Sub", "k.Base", "EXTENDS"), edge("ext2", "m.Sub", "raw_class:odd.Base", "EXTENDS", file_path="m.py"), edge("dep", "m.f", "raw_dep:db", "DEPENDS_ON", file_path="m.py"), edge("dep2", "k.g", "raw_dep:db", "DEPENDS_ON", file_path="k.py"), edge("dep3", "m.f", "raw_dep:Base2", "DEPENDS_ON", file_path="m.py"), edge("dep4", "m.f", "raw_dep:make2", "DEPENDS_ON", file_path="m.py"), edge("imp", "m.f", "raw_import:k", "IMPORTS", file_path="m.py"), edge("imp2", "m.f", "raw_import:k.only", "IMPORTS", file_path="m.py")]
    imports = spark.createDataFrame([("m.py", "kk", "k"), ("m.py", "mk", "app.crud.make"), ("q.py", "d", "app.crud.drop"), ("m.py", "np", "numpy"), ("m.py", "Base2", "k.Base"), ("m.py", "make2", "app.crud.make"), ("m.py", "json", "json")], "file_path string, name string, full string")
    got = {r["id"]: (r["target"], r["confidence"], r["type"]) for r in linking.link(nodes(spark, n), edges(spark, e), imports, work).collect()}
    call = lambda t, c=1.0: (t, c, "CALLS")
    assert {k: got[k] for k in targets} == {"imported": call("k.g"), "local": call("m.g"), "global": call("k.only"), "none": call("nothing.at", 0.8), "clash": call("raw_call:clash", 0.8), "self": call("m.Sub.go"), "base": call("k.Base.run"), "lost": call("missing", 0.8), "prefix": call("crud.make"), "final": call("crud.drop"), "out": call("np.sum", 0.8), "std": call("json.dumps", 0.8)}
    assert got["ext"] == ("k.Base", 1.0, "EXTENDS") and got["ext2"] == ("odd.Base", 0.5, "EXTENDS")
    assert got["dep"] == ("m.db", 1.0, "DEPENDS_ON") and got["dep3"] == ("k.Base", 1.0, "REFERENCES")
    assert not {"dep2", "dep4", "imp"} & set(got) and got["imp2"][0] == "k.only"


def test_outside_nodes(spark, work):
    n = [node("a.f"), node("b.g")]
    df = nodes(spark, n).selectExpr("*", "id as x").drop("x")
    ts = df.where("id = 'b.g'").drop("language").selectExpr("*", "'typescript' as language").select(df.columns)
    df = df.where("id = 'a.f'").unionByName(ts)
    e = edges(spark, [edge("1", "a.f", "json.dumps"), edge("2", "b.g", "json.dumps"), edge("3", "b.g", "os.path"), edge("4", "a.f", "numpy.sum"), edge("5", "a.f", "a.gone", confidence=1.0), edge("6", "a.f", "b.g"), edge("7", "gone.h", "raw_call:clash")])
    made = linking.outside_nodes(df, e, spark.createDataFrame([("numpy",)], "root string"))
    assert rows(made.select("id", "name", "language", "namespace")) == [("a.gone", "gone", "python", "UNKNOWN"), ("json.dumps", "dumps", "python", "STDLIB"), ("numpy.sum", "sum", "python", "EXTERNAL"), ("os.path", "path", "typescript", "UNKNOWN"), ("raw_call:clash", "clash", "", "UNKNOWN")]
    assert dict(rows(linking.agreed(e, made).select("id", "confidence")))["5"] == 0.8


def test_re_exports_and_tails(spark, work):
    index = linking.build_index(nodes(spark, [node("src.p.core.Cmd", "CLASS"), node("a.x"), node("b.x")]), spark.createDataFrame([], "file_path string, name string, full string"), work)
    asked = spark.createDataFrame([("p.core.Cmd",), ("p.Cmd",), ("x",), ("src.p.core.Cmd",), (None,)], "name string")
    forward = spark.createDataFrame([("p.Cmd", "p.core.Cmd")], "symbol string, final string")
    assert rows(linking.place(asked, index, forward)) == [("p.Cmd", "src.p.core.Cmd"), ("p.core.Cmd", "src.p.core.Cmd"), ("src.p.core.Cmd", "src.p.core.Cmd")]

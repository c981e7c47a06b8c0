from cairngraph.operators import motifs
from tests.helpers import edge, graph, node


def test_rungs_from_symbols_to_the_root(spark, work):
    n, e = [], []
    for k, path in enumerate(["a/x/m0.py", "a/y/m1.py", "b/m2.py"]):
        n += [node(f"m{k}", "FILE", file_path=path), node(f"m{k}.C", "CLASS", file_path=path), node(f"m{k}.C.f", "METHOD", file_path=path), node(f"m{k}.C.g", "METHOD", file_path=path)]
        e += [(f"m{k}", f"m{k}.C", "CONTAINS"), (f"m{k}.C", f"m{k}.C.f", "DECLARES"), (f"m{k}.C", f"m{k}.C.g", "DECLARES")]
    e += [("m0.C.f", "m1.C.f", "CALLS"), ("m0.C.g", "m2.C.g", "CALLS"), ("m0", "m1", "IMPORTS"), ("m1", "m2", "IMPORTS"), ("alone", "alone2", "CONTAINS")]
    g = graph(spark, work, n, [edge(f"e{k}", *x) for k, x in enumerate(e)])
    got = {(r["layer"], r["name"]): (r["n_groups"], r["n_triads"]) for r in motifs.structural_ladder(g).collect()}
    # No triad among symbols, one of classes; modules, directories and imports at T0 to T3 repeat what was before them.
    assert got == {("CALLS", "T0_symbol"): (12, 0), ("CALLS", "T1_class"): (6, 1), ("CALLS", "T4_up2"): (2, 0), ("IMPORTS", "T0_symbol"): (12, 1), ("IMPORTS", "T4_up2"): (2, 0)}


def test_fit_needs_three_live_rungs(spark):
    rows = [("CALLS", 0, 64, 50, 1.0), ("CALLS", 1, 16, 40, 1.5), ("CALLS", 2, 4, 30, 2.0), ("CALLS", 3, 1, 90, 9.0), ("IMPORTS", 0, 64, 50, 1.0), ("IMPORTS", 1, 16, 40, 2.0), ("IMPORTS", 2, 4, 9, 3.0)]
    ladder = spark.createDataFrame(rows, "layer string, rung int, n_groups long, n_triads long, entropy double")
    got = {r["layer"]: r for r in motifs.ladder_fit(ladder).collect()}
    assert (round(got["CALLS"]["slope"], 9), got["CALLS"]["points"], got["CALLS"]["verdict"]) == (0.25, 3, "hierarchical") and got["CALLS"]["std_error"] < 1e-6
    assert (got["IMPORTS"]["slope"], got["IMPORTS"]["points"], got["IMPORTS"]["verdict"]) == (None, 2, "no_signal")

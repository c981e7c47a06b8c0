from cairngraph.operators import evaluation as ev
from tests.helpers import day, rows


def test_matching_against_truth(spark):
    f = spark.createDataFrame([("r", 1, "a", 5, 0.9, 0), ("r", 2, "a", 6, 0.8, 1), ("r", 3, "b", 1, 0.7, 2), ("r", 4, "a", None, 0.95, 3), ("r", 5, "c", 9, 0.1, 4), ("q", 1, "z", 1, 0.5, 0)], "review string, finding int, file string, line int, confidence double, nth int")
    t = spark.createDataFrame([("r", "t1", "a", 4, 6, 0), ("r", "t2", "a", None, None, 1), ("r", "t3", "c", 1, 2, 2)], "review string, truth string, file string, first int, last int, nth int")
    a = spark.createDataFrame([("r", "b")], "review string, file string")
    got = ev.match_findings(f, t, a)
    assert rows(got) == sorted([("r", 4, "t2", "matched"), ("r", 1, "t1", "matched"), ("r", 2, None, "noise"), ("r", 3, None, "ambiguous"), ("r", 5, None, "noise"), ("r", None, "t3", "missed"), ("q", 1, None, "noise")], key=str)
    s = {r["review"]: r for r in ev.review_scores(got).collect()}
    assert s["r"]["recall"] == 2 / 3 and s["r"]["precision"] == 2 / 5 and (s["q"]["recall"], s["q"]["precision"]) == (1.0, 0.0)
    assert ev.match_findings(f.where("false"), t.where("false")).count() == 0


def test_findings_are_listed_once(spark):
    f = spark.createDataFrame([("a", 1, "x", 0.5, "p"), ("a", 1, "x", 0.9, "q"), ("a", None, "x", 0.1, "r"), ("a", None, "x", 0.1, "b"), ("a", 1, "y", 0.2, "s")], "file string, line int, category string, confidence double, text string")
    assert rows(ev.dedup_findings(f)) == sorted([("a", 1, "x", 0.9, "q"), ("a", None, "x", 0.1, "b"), ("a", 1, "y", 0.2, "s")], key=str)
    d = spark.createDataFrame([(9, True), (7, True), (1, False), (2, None), (None, True)], "s int, real boolean")
    assert ev.score_separation(d, "s", "real").first()[0] == 6.5 and ev.score_separation(d.where("real"), "s", "real").first()[0] is None


def test_union_of_runs(spark):
    pair = lambda run, url, g, c, hit, ng, nc: (run, url, g, c, hit, ng, nc)
    data = [pair("1", "u", 0, 0, 1, 2, 1), pair("1", "u", 1, 0, 0, 2, 1), pair("2", "u", 0, 0, 0, 2, 2), pair("2", "u", 1, 0, 1, 2, 2), pair("2", "u", 0, 1, 1, 2, 2), pair("1", "v", None, None, None, 1, 0), pair("2", "v", 0, 0, 0, 1, 1), pair("1", "only", 0, 0, 1, 1, 1)]
    df = spark.createDataFrame(data, "run string, url string, golden int, candidate int, hit int, n_goldens int, n_candidates int")
    got, effect = ev.union_of_runs(df)
    assert rows(got) == [("u", 2, 3, 2, 1, 0, 0.5), ("v", 1, 1, 0, 1, 1, 0.0)]
    e = effect.first()
    assert (e["n"], e["mean"], e["passes"]) == (2, 0.25, False) and e["f_beta"] > 0


def test_chunks(spark, work):
    files = spark.createDataFrame([(f,) for f in ("src/p/core.py", "src/p/score.py", "tests/u/test_core.py", "a.py", "b.py", "tests/test_b.py", "lib/b.py", "z.py", None)], "file string")
    links = spark.createDataFrame([("a.py", "z.py"), ("a.py", "unchanged.py"), ("unchanged.py", "b.py")], "source_file string, target_file string")
    assert rows(ev.change_chunks(files, links, work)) == [("a.py", "a.py"), ("a.py", "z.py"), ("b.py", "b.py"), ("lib/b.py", "lib/b.py"), ("src/p/core.py", "src/p/core.py"), ("src/p/core.py", "tests/u/test_core.py"), ("src/p/score.py", "src/p/score.py"), ("tests/test_b.py", "tests/test_b.py")]


def test_answers(spark):
    gold = spark.createDataFrame([("t", "symbol", "1", "cli.structure", True), ("t", "symbol", "2", "Raft.setState", True), ("t", "file", "f", "src/p/a.py", True), ("t", "file", "g", "src/p/ok.py", False), ("e", "file", "x", "only.py", True)], "task string, kind string, id string, spelling string, required boolean")
    answers = spark.createDataFrame([("t", "symbol", "`src/pkg/cli.py::structure()`"), ("t", "symbol", "func (r *Raft) setState"), ("t", "symbol", "cli.structure_x"), ("t", "file", "./p/a.py:12"), ("t", "file", "src/p/ok.py"), ("t", "file", "a.py")], "task string, kind string, said string")
    got = {r["task"]: r for r in ev.answer_scores(gold, answers).collect()}
    assert (got["t"]["n_gold"], got["t"]["n_found"], got["t"]["n_said"], got["t"]["n_unexpected"]) == (3, 3, 6, 2)
    assert (got["e"]["recall"], got["e"]["precision"]) == (0.0, 0.0)


def test_review_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    one = spark.createDataFrame([(1, day(1), "m", 3, 2.5, None)], ev.REVIEW)
    ev.record_review(one, folder)
    ev.record_review(one, folder)
    (tmp_path / "log" / "x.json").write_text("no json\n")
    assert ev.load_reviews(spark, folder).count() == 2


def test_ranks_of_ties(spark, work):
    d = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "v double")
    assert rows(ev.tied_ranks(d, "v", "r", work)) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]

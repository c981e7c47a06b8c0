import json

import pytest

from cairngraph.__main__ import COMMANDS, main, parser
from tests.helpers import edge, edges, node, nodes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    n = [node(f"p.{x}", "FILE", file_path=f"p/{x}.py") for x in "abc"] + [node("p.a.f", file_path="p/a.py", lines=(1, 5)), node("p.b.g", file_path="p/b.py", lines=(1, 5)), node("p.c.K", "CLASS", file_path="p/c.py", lines=(1, 5))]
    e = [edge("1", "p.a", "p.b", "IMPORTS"), edge("2", "p.b.g", "p.a.f", line=2), edge("3", "p.a", "p.a.f", "CONTAINS"), edge("4", "p.b.g", "raw_call:x")]
    nodes(spark, n).write.parquet(f"{at}/nodes.parquet")
    edges(spark, e).write.parquet(f"{at}/edges.parquet")
    return at


def said(spark, capsys, *argv):
    main(list(argv), spark)
    return [json.loads(x) if x.startswith("{") else x for x in capsys.readouterr().out.splitlines()]


def test_answers(spark, capsys, folder, tmp_path):
    assert said(spark, capsys, "resolve", folder, "b.g") == ["p.b.g"]
    assert {"id": "p.b.g", "depth": 1} in said(spark, capsys, "impact", folder, "a.f")
    assert {"id": "p.a.f", "depth": 1} in said(spark, capsys, "trace", folder, "p.b.g")
    assert [x["id"] for x in said(spark, capsys, "structure", folder, "p")] == ["p.a", "p.b", "p.c"]
    assert {"id": "p.c.K"} in said(spark, capsys, "orphans", folder)
    assert {"source": "p.a", "target": "p.b", "kind": "imports"} in said(spark, capsys, "module-graph", folder, "p")
    (tmp_path / "d.diff").write_text("--- a/p/a.py\n+++ b/p/a.py\n@@ -1 +1 @@\n-x\n+y\n")
    assert said(spark, capsys, "diff-check", folder, str(tmp_path / "d.diff"))[0]["site"] == "p.b.g"
    main(["export", folder, str(tmp_path / "out")], spark)
    assert "fan_in" in spark.read.json(str(tmp_path / "out" / "nodes")).columns


def test_exits(spark, folder):
    with pytest.raises(SystemExit):
        main(["resolve", folder, "nothing"], spark)
    with pytest.raises(SystemExit):
        main(["validate", folder, "--threshold", "0.01"], spark)
    assert set(COMMANDS) <= set(parser()._subparsers._group_actions[0].choices)

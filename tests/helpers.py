from datetime import datetime, timedelta, timezone

START = datetime(2025, 1, 1, tzinfo=timezone.utc)
EDGES = "id string, source string, target string, type string, weight double, confidence double, context string, file_path string, line_number int, type_only boolean, ingested_at timestamp"
NODES = "id string, type string, name string, file_path string, start_line int, end_line int, language string, ontology_class string, domains array<string>, confidence_score double, metadata string, namespace string, is_test boolean, is_generated boolean, ingested_at timestamp, deleted_at timestamp"


def day(n):
    return None if n is None else START + timedelta(days=n)


def edge(i, source, target, type="CALLS", weight=1.0, at=0, file_path=None, line=None, type_only=False, confidence=1.0):
    return (i, source, target, type, weight, confidence, None, file_path, line, type_only, day(at))


def node(i, type="FUNCTION", at=0, gone=None, file_path="a.py", namespace="INTERNAL", name=None, test=False, metadata="{}", domains=None, generated=False, lines=(1, 9)):
    return (i, type, name or i.rsplit(".", 1)[-1], file_path, lines[0], lines[1], "python", None, domains, 1.0, metadata, namespace, test, generated, day(at), day(gone))


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODES)


def graph(spark, work, node_rows, edge_rows):
    from cairngraph.graph import Graph

    return Graph.of(nodes(spark, node_rows), edges(spark, edge_rows), work)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)

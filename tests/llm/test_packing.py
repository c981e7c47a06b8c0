import random

from cairngraph.llm import packing
from cairngraph.llm.packing import best_fit, crossover, evolve, pack_documents, pack_texts, packing_summary
from cairngraph.llm.tokens import count_tokens


def check(packed, sizes, capacity, name):
    rows = [r for r in packed.collect() if r["container"] == name]
    bins, parts = {}, {}
    for r in rows:
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"], r["piece"]))
    assert all(b <= capacity for b in bins.values())
    assert set(parts) == {d for d, n in sizes if n}
    for d, n in sizes:
        if n:
            at = 0
            for k, (start, length, piece) in enumerate(sorted(parts[d])):
                assert (start, piece) == (at, k)
                at += length
            assert at == n and len(parts[d]) == -(-n // capacity)
    return len(bins)


def test_every_document_once_and_little_room_left(spark, work, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 60)
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, 1, 100, 250, rng.randint(1, 1300)])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    capacities = {"small": 256, "large": 1000, "none": 0, None: 5}
    packed = pack_documents(df, capacities, work)
    for name in ("small", "large"):
        n = check(packed, sizes, capacities[name], name)
        c = capacities[name]
        rest = sorted((s % c for _, s in sizes if s % c), reverse=True)
        assert n <= sum(s // c for _, s in sizes) + len(best_fit(rest, list(range(len(rest))), c)) + 1
    assert {r["container"] for r in packing_summary(packed, {"small": 256, "large": 1000}).collect()} == {"small", "large"}


def test_nothing_and_no_container(spark, work):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack_documents(none, {"a": 5}, work).count() == 0
    assert pack_documents(none, {}, work).count() == 0


def test_genetic_steps_keep_the_items():
    rng = random.Random(9)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    order = list(range(80))
    a, b = best_fit(sizes, order, 100), best_fit(sizes, order[::-1], 100)
    child = crossover(sizes, a, b, 100, rng)
    for solution in (child, evolve(sizes, 100, [], None, 1)[0], evolve(sizes, 100, [a], b, 2)[0]):
        assert sorted(i for x in solution for i in x) == order
        assert all(sum(sizes[i] for i in x) <= 100 for x in solution)
    assert len(evolve(sizes, 100, [], None, 1)[0]) <= len(a)


def test_texts(spark, work):
    text = "word " * 900
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x")], "doc_id long, text string").withColumnRenamed("x", "y")
    boxes = spark.createDataFrame([("s", 512)], "name string, capacity_tokens int")
    check(pack_texts(docs, boxes, work), [(1, count_tokens([text])[0]), (3, 0), (4, 1)], 512, "s")

import random

import numpy as np
import pytest

from cairngraph.llm.mixing import FEATURES, features, fit, held_out, labelled, memberships, mix, settle, train

DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def texts(kind, rng):
    words = {"note": "graph node edge", "code": "def return import", "talk": "hello thanks please"}[kind].split()
    return " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))


@pytest.fixture(scope="module")
def documents(spark):
    rng, spell = random.Random(10), {"note": ["note", "NOTE", " Note"], "code": ["code"], "talk": ["talk", "Talk "]}
    rows = [(i, texts(k, rng), rng.choice(spell[k])) for i, k in enumerate(rng.choices(["note", "code", "talk"], [70, 25, 5], k=600))]
    rows += [(1000 + i, texts("code", rng), None) for i in range(20)] + [(2000, None, "note"), (2001, "", "code"), (None, "x", "note")]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark, work, documents):
    targets = spark.createDataFrame([("note", 0.5, 1), ("code", 0.3, 2), ("talk", 0.2, 3), ("gone", 0.0, 1)], TARGETS)
    used, shares = mix(documents, targets, work)
    got = {r["source"]: r for r in shares.collect()}
    for name, share in (("note", 0.5), ("code", 0.3), ("talk", 0.2)):
        assert abs(got[name]["reached_share"] - share) < 0.01
    rows = used.collect()
    cap = {"note": 1, "code": 2, "talk": 3}
    assert rows and all(0 < r["repeats"] <= cap[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows) and 2000 not in {r["doc_id"] for r in rows}
    assert all(r["source"] == "code" for r in rows if r["predicted"])
    assert abs(sum(r["n_tokens"] * r["repeats"] for r in rows) - sum(r["n_tokens"] for r in got.values())) < 1


def test_a_total_beyond_the_caps_is_reported_as_it_is(spark, work, documents):
    used, shares = mix(documents, spark.createDataFrame([("note", 0.5, 1), ("talk", 0.5, 1)], TARGETS), work, total_tokens=10**9)
    assert all(r["repeats"] == 1 for r in used.collect())
    assert {r["source"]: r["reached_share"] for r in shares.collect()}["note"] > 0.8


def test_empty(spark, work, documents):
    targets = spark.createDataFrame([("note", 1.0, 1)], TARGETS)
    used, shares = mix(documents.where("false"), targets, work)
    assert used.count() == 0 and [tuple(r)[:3] for r in shares.collect()] == [("note", 1.0, 0.0)]
    used, shares = mix(documents, spark.createDataFrame([], TARGETS), work)
    assert used.count() == 0 and shares.count() == 0


def test_the_classifier_tells_held_out_texts():
    rng = random.Random(11)
    kinds = ["note", "code", "talk"]
    data = [(k, features(texts(kinds[k], rng))) for k in rng.choices(range(3), k=300)]
    x, y = np.stack([v for _, v in data]), np.array([k for k, _ in data])
    model = fit(x[:200], y[:200], tuple(kinds), np.ones(3) / 3)
    assert model.weights.shape == (FEATURES, 3)
    z = x[200:] @ model.weights + model.shift
    assert (z.argmax(axis=1) == y[200:]).mean() > 0.9


def test_posteriors_of_texts_alone_reach_the_shares_where_texts_tell_sources(spark, work, documents):
    targets = spark.createDataFrame([("note", 0.5, 1), ("code", 0.3, 2), ("talk", 0.2, 3)], TARGETS)
    assert all(r["n_told"] >= 0.9 * r["n_held_out"] for r in held_out(documents, targets, work).collect())
    _, shares = mix(documents, targets, work, trust=None)
    for r in shares.collect():
        assert abs(r["expected_share"] - r["target_share"]) < 0.02 and abs(r["reached_share"] - r["target_share"]) < 0.02


def test_every_document_is_a_soft_member(spark, documents):
    names = ["note", "code", "talk"]
    docs = labelled(documents, names)
    p = [r["p"] for r in memberships(docs, train(docs.where("label is not null"), names)).collect()]
    assert len(p) == 621 and all(abs(sum(x) - 1) < 1e-6 and min(x) > 0 for x in p)


def test_a_name_its_text_denies_is_doubted():
    x = np.zeros((4, FEATURES), np.float32)
    x[[0, 1], 0] = x[[2, 3], 1] = 1
    model = fit(x, np.array([0, 0, 1, 1]), ("a", "b"), np.array([0.5, 0.5]))
    sure = np.array([[1e-6, 1 - 1e-6]])
    object.__setattr__(model, "posteriors", lambda texts: sure)
    assert model.memberships(["x"], np.array([0]), 0.99)[0, 1] > 0.9 and model.memberships(["x"], np.array([1]), 0.99)[0, 1] > 0.99
    assert (model.memberships(["x"], np.array([0]), None) == sure).all()


def test_what_is_owed_is_settled_from_the_pool():
    pool = [(1, 0, 100, 0, 1), (2, 0, 40, 1, 1), (3, 0, 7, 0, 3), (4, 1, 5, 2, 2)]
    assert settle(np.array([62.0, -4.0]), pool) == {1: 1, 2: -1, 4: -1}
    assert settle(np.array([1000.0, 0.0]), pool) == {1: 1, 3: 3}
    assert settle(np.array([3.0, 0.0]), []) == {}

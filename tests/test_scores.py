"""BLEU, ROUGE-L, answer scoring, retrieval."""

import math
import random

import numpy as np
import pytest

from velobus.evaluation import retrieval
from velobus.evaluation.scores import bleu, lcs_length, record_answers, rouge_l, score_answers
from velobus.schemas import ANSWERS_TABLE
from pyspark.sql import functions as F

CASES = [
    ("the cat sat on the mat today", "the cat sat on the mat", math.exp(1 - 7 / 6)),
    ("the cat sat on the mat", "The cat sat on the mat", 1.0),
    ("a b c d e", "v w x y z", 0.0),
    ("a b", "a b", 0.0),
    ("", "a b c d", 0.0),
    ("a b c d", " ", 0.0),
    ("a b c d e f", "a b c d x a b c d e", None),
]


def brute_bleu(reference, hypothesis):
    r, h = reference.lower().split(), hypothesis.lower().split()
    if not r or not h:
        return 0.0
    logs = []
    for n in range(1, 5):
        grams = [tuple(h[i:i + n]) for i in range(len(h) - n + 1)]
        have = [tuple(r[i:i + n]) for i in range(len(r) - n + 1)]
        hits = sum(min(grams.count(g), have.count(g)) for g in set(grams))
        if not hits:
            return 0.0
        logs.append(math.log(hits / len(grams)))
    return math.exp(sum(logs) / 4) * min(1.0, math.exp(1 - len(r) / len(h)))


def test_bleu(spark):
    rows = [(i, r, h) for i, (r, h, _) in enumerate(CASES)]
    found = bleu(spark.createDataFrame(rows, "id INT, r STRING, h STRING"), "id", "r", "h")
    found = {x["id"]: x["bleu"] for x in found.collect()}
    assert len(found) == len(CASES)
    for i, (r, h, expected) in enumerate(CASES):
        assert found[i] == pytest.approx(brute_bleu(r, h))
        if expected is not None:
            assert found[i] == pytest.approx(expected)


def test_bleu_shuffles_texts_not_grams(spark):
    frame = spark.createDataFrame([(1, "a b c d", "a b c d")], "id INT, r STRING, h STRING")
    plan = bleu(frame, "id", "r", "h")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = (
                table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            )
    return table[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert lcs_length(a, b) == brute_lcs(a, b)


def test_rouge(spark):
    rows = [(1, "a b c d e", "a x c e"), (2, "same words", "same words"), (3, "a", "")]
    found = rouge_l(spark.createDataFrame(rows, "id INT, r STRING, h STRING"), "id", "r", "h")
    found = {x["id"]: x["rouge_l"] for x in found.collect()}
    assert found[1] == pytest.approx(2 / 3, abs=1e-4)
    assert (found[2], found[3]) == (1.0, 0.0)


def test_only_pending_answers_are_scored(spark):
    rows = [
        (1, "a b c d", "a b c d", False, None, None),
        (2, "a b c d", "a b c d", True, None, None),
        (3, "a b c d", "x", False, 0.5, 0.5),
        (4, "a b c d", " \n ", False, None, None),
        (5, None, "x", False, None, None),
        (6, "a b c d", "a b c d", False, 0.7, None),
    ]
    schema = (
        "answer_id INT, ground_truth STRING, llm_response STRING, llm_error BOOLEAN, "
        "bleu_score DOUBLE, rouge_score DOUBLE"
    )
    scored = score_answers(spark.createDataFrame(rows, schema))
    found = {r["answer_id"]: (r["bleu_score"], r["rouge_score"]) for r in scored.collect()}
    assert found == {
        1: (1.0, 1.0), 2: (None, None), 3: (0.5, 0.5), 4: (None, None), 5: (None, None), 6: (1.0, 1.0),
    }


def test_answers_are_recorded(spark):
    asked = spark.createDataFrame(
        [("q1", "a", "?", "truth"), ("q3", None, "?", "mean")],
        "question_key STRING, value STRING, question_text STRING, ground_truth STRING",
    )
    given = spark.createDataFrame(
        [("q1", "a", "yes", 5.0, False, None), ("q3", None, None, 1.0, True, "down")],
        "question_key STRING, value STRING, llm_response STRING, response_time_ms DOUBLE, "
        "llm_error BOOLEAN, llm_error_message STRING",
    )
    records = record_answers(asked, given, F.lit("2024-01-01").cast("timestamp"))
    assert records.schema.simpleString() == spark.createDataFrame([], ANSWERS_TABLE).schema.simpleString()
    found = {r["question_key"]: (r["ground_truth"], r["llm_response"], r["llm_error"]) for r in records.collect()}
    assert found == {"q1": ("truth", "yes", False), "q3": ("mean", "", True)}


def test_top_k_in_blocks(spark, monkeypatch):
    """Every split of both sides gives the brute-force answer, ties by id included."""
    rng = np.random.default_rng(2)
    docs = rng.normal(size=(200, 8)).astype("float32")
    docs[150:160] = docs[3]  # equal vectors in different slices
    wanted = np.concatenate([rng.normal(size=(7, 8)), docs[3:4].astype("float64"), np.zeros((1, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(docs)] + [(900, [0.0] * 8), (901, None)]
    frame = spark.createDataFrame(rows, "id BIGINT, v ARRAY<FLOAT>").repartition(5)
    queries = spark.createDataFrame(
        [(f"q{i}", v.tolist()) for i, v in enumerate(wanted)] + [("none", None)],
        "query STRING, vector ARRAY<DOUBLE>",
    )
    d = np.concatenate([docs.astype("float64"), np.zeros((1, 8))])
    names = [*range(200), 900]
    expected = {}
    for i, w in enumerate(wanted):
        sims = (retrieval.unit(w[None]) * retrieval.unit(d)).sum(axis=1)
        for p, j in enumerate(sorted(range(201), key=lambda j: (-sims[j], names[j]))[:4]):
            expected[f"q{i}", p + 1] = names[j]
    for size, block in ((20_000, 2_000), (30, 3)):
        monkeypatch.setattr(retrieval, "SLICE", size)
        monkeypatch.setattr(retrieval, "BLOCK", block)
        found = retrieval.top_k(frame, "id", "v", queries, 4).collect()
        assert {(r["query"], r["place"]): r["doc"] for r in found} == expected
    assert retrieval.top_k(frame.limit(0), "id", "v", queries, 4).count() == 0
    assert retrieval.top_k(frame, "id", "v", queries.limit(0), 4).count() == 0


def test_no_vector_passes_the_driver(spark):
    frame = spark.createDataFrame([(1, [1.0])], "id BIGINT, v ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(1, [1.0])], "query BIGINT, vector ARRAY<DOUBLE>")
    plan = retrieval.top_k(frame, "id", "v", asked, 1)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan


def test_index_finds_most_and_holds_all(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = docs.where("vec_id % 20 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    for size in (20_000, 500):  # a sample that is all rows, then one in four
        monkeypatch.setattr(retrieval, "SAMPLE", size)
        index = retrieval.CoarseIndex(docs, "vec_id", "embedding")
        assert index.documents.count() == docs.count()
        exact = retrieval.top_k(docs, "vec_id", "embedding", asked, 5)
        row = retrieval.recall(index.top_k(asked, 5), exact).agg(F.sum("hits"), F.sum("wanted")).first()
        assert row[1] == 5 * asked.count() and row[0] >= 0.9 * row[1]
    every = index.top_k(asked, 5, probes=64).select("query", "doc", "place")
    assert sorted(every.collect()) == sorted(exact.select("query", "doc", "place").collect())


def test_queries_take_turns_within_a_block(monkeypatch):
    """What a group holds at a time is bounded, also where most documents are equally near."""
    import numpy as np
    import pandas as pd

    from velobus.evaluation import retrieval

    rng = np.random.default_rng(5)
    docs = [rng.normal(size=4) if i % 3 == 0 else np.ones(4) for i in range(300)]
    documents = pd.DataFrame({"doc": range(300), "vector": docs})
    queries = pd.DataFrame({"query": range(50), "vector": docs[:50]})
    whole = retrieval.nearest_of(queries, documents, 4).reset_index(drop=True)
    held, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *b, **c: held.append(a.size) or partition(a, *b, **c))
    monkeypatch.setattr(retrieval, "PRODUCTS", 1_000)
    parts = retrieval.nearest_of(queries, documents, 4).reset_index(drop=True)
    assert parts.equals(whole) and len(whole) == 200 and max(held) <= 1_000


def test_an_index_places_few_rows_at_a_time(spark, monkeypatch):
    import numpy as np

    from velobus.evaluation import retrieval

    index = object.__new__(retrieval.CoarseIndex)
    index.centres = retrieval.unit(np.random.default_rng(1).normal(size=(8, 3)))
    frame = spark.range(60).coalesce(1).selectExpr("id AS query", "array(id - 20.0D, 1.0D, id % 7 - 3.0D) AS vector")
    whole = sorted(map(tuple, index._cells(frame, "query", 5).select("cell", "query").collect()))
    monkeypatch.setattr(retrieval, "PLACED", 20)
    parts = index._cells(frame, "query", 5)
    assert sorted(map(tuple, parts.select("cell", "query").collect())) == whole and len(whole) == 300

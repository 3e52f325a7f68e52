"""Texts longer than the piece that tasks work on at a time, and strings under a very frequent anchor."""

import random

import pytest

from velobus.llm import arrays, oneperm, suffixes, superminhash, templates, toxicity

SMALL = 300


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    base = " ".join(rng.choices(words, k=400))
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 30, 300])))) for i in range(30)]
    rows += [(100, base), (101, base), (102, base + " end"), (103, rows[2][1] + " " + base[:500]), (104, None), (105, ""), (106, "é" * 900)]
    rows += [(200 + i, "x " * 400 + words[i]) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", ["dedup", "fingerprints", "passages", "toxicity", "decontamination"])
def test_small_pieces_change_nothing(spark, docs, monkeypatch, name):
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int")
    items = docs.where("doc_id in (1, 2, 4)").selectExpr("doc_id AS item_id", "text")
    run = {
        "dedup": lambda: superminhash.near_duplicates(docs),
        "fingerprints": lambda: oneperm.fingerprinted(docs),
        "passages": lambda: suffixes.without_repeats(docs),
        "toxicity": lambda: toxicity.toxicity(docs, marks),
        "decontamination": lambda: templates.contaminated(docs, items),
    }[name]
    whole = rows_of(run())
    assert whole
    for module in (arrays, oneperm, suffixes, templates):
        monkeypatch.setattr(module, "PIECE", SMALL)
    real = arrays.shingle_sets
    for module in (superminhash,):
        monkeypatch.setattr(module, "shingle_sets", lambda column, size=5, limit=4 * SMALL: real(column, size, limit))
    assert rows_of(run()) == whole


def test_a_frequent_anchor_changes_nothing(docs):
    """More stretches under one anchor than a task compares itself."""

    def covered(**limit):
        spans, _ = suffixes.repeated_spans(docs, **limit)
        return {(r.doc_id, place) for r in spans.collect() for place in range(r.begin, r.end)}

    whole = covered()
    assert whole
    for limit in (2, 5):
        assert covered(limit=limit) == whole


def test_stretches_are_taken_apart_a_few_at_a_time(monkeypatch):
    """However many rows a batch has, no more than ``limit`` and one portion are held."""
    import numpy as np
    import pyarrow as pa

    from velobus.llm import suffixes

    rng = np.random.default_rng(3)
    lead = np.sort(rng.integers(0, 60, 900))
    body = [bytes(rng.integers(97, 99, 12).tolist()) for _ in lead]
    columns = [pa.array(lead), pa.array(np.arange(900)), pa.array(np.zeros(900, np.int64)), pa.array(body, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["lead", "doc_id", "begin", "body"])
    held, strings = [], suffixes._strings
    monkeypatch.setattr(suffixes, "_strings", lambda table, span: held.append(table.num_rows) or strings(table, span))

    def found(rows: int, limit: int) -> list[tuple]:
        held.clear()
        monkeypatch.setattr(suffixes, "ROWS", rows)
        return sorted((tuple(r.values()) for b in suffixes._matched(8, limit)([batch]) for r in b.to_pylist()), key=str)

    whole = found(1_000, 1_000)
    assert max(held) > 500
    assert found(7, 1_000) == whole and max(held) <= 60
    assert found(7, 5) and max(held) <= 5 + 7

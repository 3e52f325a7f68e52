"""Periodic runs, token ids and clusters against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from velobus.llm import arrays, bindings, hadamard, periodic, treebpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def brute_runs(words, shortest=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng, n, letters):
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 14:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            for i in range(a, min(n, a + p * rng.randrange(1, 5) + rng.randrange(p + 1))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("shortest", [2, 3, 12])
def test_runs_of_random_words(shortest):
    rng = random.Random(shortest)
    texts = [planted(rng, rng.randrange(rng.choice([15, 40, 150])), rng.choice([1, 2, 3, 5, 60])) for _ in range(300)]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    word = np.unique(np.array([w for t in texts for w in t]), return_inverse=True)[1]
    found = periodic.runs_of_words(word, owner, len(texts), shortest)
    assert found == [brute_runs(t, shortest) for t in texts]


def test_long_segments():
    """No word is rare here, so nothing is split off: the scan alone has to cope."""
    few = np.random.default_rng(0).integers(0, 400, 100_000)
    few[50_000:60_000] = np.tile(few[50_000:52_000], 5)
    for word, want in (
        (np.zeros(100_000, np.int64), [(0, 100_000, 1)]),
        (np.arange(100_000) % 33_333, [(0, 100_000, 33_333)]),
        (few, [(50_000, 10_000, 2_000)]),
    ):
        assert periodic.runs_of_words(word, np.zeros(len(word), np.int64), 1)[0] == want


def test_periods_of_texts(spark, monkeypatch):
    rng = random.Random(7)
    texts = {k: " ".join(planted(rng, rng.randrange(200), 9)) for k in range(60)}
    texts |= {
        60: None, 61: "", 62: " \t\n\v\f\r ", 63: "a " * 11, 64: "a " * 12, 65: "A a " * 6, 66: "ü x " * 12,
        67: " ".join(planted(rng, 20_000, 5)) + " end", 68: "x " * 30 + "é", 69: "é" + " x" * 30,
    }
    rows = [(k, t, [1], "c") for k, t in texts.items()] + [(64, texts[64], [2], "c"), (None, "b " * 13, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, collapsed string").repartition(3)
    got = periodic.without_periods(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", (texts[r.doc_id] if r.doc_id is not None else "b " * 13) or "")
        runs = brute_runs(words) if r.doc_id != 67 else [tuple(x) for x in r.runs]
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        assert r.collapsed == brute_collapsed(words, runs)
    assert periodic.without_periods(frame.limit(0)).count() == 0
    # Pieces far smaller than the texts change nothing.
    monkeypatch.setattr(periodic, "PIECE", 100)
    again = periodic.without_periods(frame).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_number_of_words_is_exact():
    run, starts = arrays.text_run(__import__("pyarrow").array(["a b", "b  a", None, "", "ab"]))
    begin, end = periodic._spans_by_text(run, starts)
    assert periodic.numbered(run, begin, end).tolist() == [0, 1, 1, 0, 2]


@pytest.fixture(scope="module")
def vocabulary():
    return treebpe.read_vocabulary(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORD_BPE)


def by_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def random_text(rng, size):
    letters = rng.choice(["ab", "aab", "abcdefghij", "thenationing", "éèêabc", "0123abc'", "'st re", "漢字かな", "ΑΣς İß", "áë "])
    return "".join(rng.choice(letters) for _ in range(size))


@pytest.mark.parametrize(("leaf", "window"), [(2, 1), (3, 1), (32, 4)])
def test_joined_halves_are_exact(vocabulary, library, leaf, window):
    """Tiny leaves and windows put a join almost everywhere."""
    tokenizer = treebpe.Tokenizer(vocabulary, leaf=leaf, window=window)
    rng = random.Random(leaf)
    texts = [random_text(rng, rng.choice([1, 5, 30, 300])) for _ in range(300)]
    texts += ["a" * n for n in (1, 2, 31, 32, 33, 64, 100, 1000)] + ["b" + "a" * 1001 + "c" + "a" * 77]
    for text, ids in zip(texts, tokenizer.ids(texts), strict=True):
        assert (ids, tokenizer.text(ids)) == by_library(library, text)


def test_every_letter(vocabulary, library):
    """All code points that Python's tables know, alone and between letters."""
    import unicodedata

    tokenizer = treebpe.Tokenizer(vocabulary)
    known = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(f"a{c}b {c}" for c in known[i : i + 500]) for i in range(0, len(known), 500)]
    for text, ids in zip(texts, tokenizer.ids(texts), strict=True):
        assert ids == by_library(library, text)[0]


def test_long_unsplit_text(vocabulary, library):
    rng = random.Random(1)
    tokenizer = treebpe.Tokenizer(vocabulary)
    for text in ("".join(rng.choice("etaoinshr") for _ in range(100_000)), "a" * 100_001, "ab" * 50_000 + "c" + "ab" * 50_000):
        assert tokenizer.ids([text])[0] == by_library(library, text)[0]


def test_codes_of_texts(spark, library, monkeypatch):
    rng = random.Random(4)
    texts = {k: random_text(rng, rng.randrange(400)) for k in range(40)}
    texts |= {
        40: None, 41: "", 42: " \n\t ", 43: "<|endoftext|>", 44: "x<|startoftext|><|endoftext|>y<|END", 45: "It's WE'RE 'tis 2024!!",
        46: "long " * 3_000 + "x" * 5_000, 47: "é<|endoftext|>́", 48: "a\0b", 49: "é ́e",
    }
    rows = [(k, t, 1, "d") for k, t in texts.items()] + [(45, texts[45], 1, "d"), (None, "null id", 1, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    for piece in (None, 200):
        if piece:
            monkeypatch.setattr(treebpe, "PIECE", piece)
        got = treebpe.encoded(frame, WORD_BPE).collect()
        assert len(got) == len(rows)
        for r in got:
            ids, text = by_library(library, (texts[r.doc_id] if r.doc_id is not None else "null id") or "")
            assert (np.array(r.ids, "<u4").tobytes(), r.decoded) == (ids, text)
    packed = {r.doc_id: bytes(r.ids) for r in treebpe.encoded(frame, WORD_BPE, packed=True).collect()}
    assert packed[45] == by_library(library, texts[45])[0] and packed[40] == b""
    assert treebpe.encoded(frame.limit(0), WORD_BPE).count() == 0


def test_codes_of_given_documents(spark, folder, library):
    rows = bindings.QUERIES["op12_tree_bpe"](spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = by_library(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def brute_clusters(kept, k, rounds, size, seed):
    """By plain squared distances of Python numbers."""
    names = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))
    centres = [v for _, v in names[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if step == rounds:
            return near, centres
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            centres[j] = [sum(x) // len(own) for x in zip(*own)] if own else centres[j]


def test_transform_is_exact():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 64):
        rows = rng.integers(-1000, 1000, (7, n))
        out = hadamard.transform(rows)
        assert ((out**2).sum(1) == n * (rows**2).sum(1)).all()
        signs = hadamard.transform(np.eye(n, dtype=np.int64)).T
        assert [(np.diff(s) != 0).sum() for s in signs] == list(range(n))


@pytest.mark.parametrize("spread", [3, 1000])
def test_nearest_with_ties(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread, (40, 64))
    centres[7] = centres[3]
    rows = np.concatenate([rng.integers(-spread, spread, (500, 64)), centres])
    far = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    cluster, distance = hadamard.nearest(hadamard.transform(rows), hadamard.transform(centres))
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


@pytest.mark.parametrize(("size", "k", "large"), [(4, 5, False), (8, 3, True), (2, 40, False)])
def test_clusters(spark, size, k, large):
    rng = random.Random(size)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 2.0]) + rng.random() for _ in range(size)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (3, rows[4][1]), (None, rows[5][1])]  # ties, a repeated id, a null id
    rows += [(200, None), (201, []), (202, [1.0] * (size + 1)), (203, [None] + [1.0] * (size - 1)), (204, [float("nan")] * size), (205, [float("inf")] * size)]
    if large:
        rows += [(300 + i, [s * 4e6 + i] * size) for i, s in enumerate((1, -1, 1, -1))]
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    frame = spark.createDataFrame([(i, v, 9, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    got = hadamard.clustered(frame, k=k, rounds=3, size=size).collect()
    near, centres = brute_clusters(kept, k, 3, size, 2)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = {j: sum(d for d, c in near if c == j) for j in range(len(centres))}
    want = [(i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, near)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert hadamard.clustered(frame).count() == 0
    assert hadamard.clustered(frame.where(F.lit(False))).columns[0] == "vec_id"


def test_planted_periods(spark):
    """The query's own edit: every tenth id by checksum repeats a stretch to its end."""
    import zlib

    texts = {i: " ".join(f"w{j}" for j in range(i % 90)) for i in range(300)} | {1000: None, 1001: "  "}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bindings.with_planted_periods(frame).collect():
        words, h = (texts[r.doc_id] or "").split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (r.text or "").split() == words

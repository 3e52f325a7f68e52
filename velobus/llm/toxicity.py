"""Toxicity by non-negative positive-unlabelled learning."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velobus.llm.arrays import PIECE, slices, text_run, words
from velobus.llm.shared import checkpointed, only, text_or_empty

# Words here are runs of letters: every ASCII byte but a-z and A-Z separates.
NO_LETTER = np.arange(256) < 128
NO_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False


@dataclass
class Model:
    """Sorted word hashes, their weights, and the bias (None: no example was confirmed)."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float | None


def present(column: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last text, then text and vocabulary number of each word present."""
    run, starts = text_run(column)
    for first, last in slices(starts, 4 * PIECE):
        own = starts[first : last + 1] - starts[first]
        hashes, owner, _ = words(run[starts[first] : starts[last]], own, NO_LETTER)
        if not len(vocabulary) or not len(hashes):
            yield first, last, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[at] == hashes
        pairs = np.unique(owner[known] * len(vocabulary) + at[known])
        yield first, last, pairs // len(vocabulary), pairs % len(vocabulary)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of texts: in how many confirmed and unlabelled texts a word is."""
    for batch in batches:
        confirmed = np.array(batch.column("confirmed").to_pylist(), bool)
        run, starts = text_run(batch.column("text"))
        for first, last in slices(starts, 4 * PIECE):
            own = starts[first : last + 1] - starts[first]
            hashes, owner, _ = words(run[starts[first] : starts[last]], own, NO_LETTER)
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            word, of = np.unique(hashes[new], return_inverse=True)
            positive = np.bincount(of, weights=confirmed[first + owner[new]], minlength=len(word)).astype(np.int64)
            all_ = np.bincount(of, minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(positive), pa.array(all_ - positive)], names=["word", "p", "u"])


def _rows_of_words(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, owner, word in present(batch.column("text"), vocabulary):
                bounds = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("confirmed").slice(first, last - first), lists], names=["confirmed", "words"])

    return run


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, steps: int = 600, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk estimator.

    With logistic loss l, the risk is prior * P[l(f)] + max(0, U[l(-f)] - prior * P[l(-f)]): the
    second part is the risk on negatives, estimated without any. Where it turns negative the model
    has begun to fit single unlabelled texts, and the step goes back up that part instead.
    """
    rows = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    weights, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    is_p = np.arange(len(rows)) < n_p
    for step in range(1, steps + 1):
        score = bias + np.bincount(owner, weights=weights[word], minlength=len(rows))
        up, down = 1 / (1 + np.exp(-score)), 1 / (1 + np.exp(score))  # slopes of l(-f) and -l(f)
        negative = np.logaddexp(0, score)
        rest = negative[~is_p].mean() - prior * negative[is_p].mean()
        slope = np.where(is_p, -prior * up / n_p, up / n_u)
        slope = slope - np.where(is_p, prior * down / n_p, 0) if rest >= 0 else -slope
        gradient = np.append(np.bincount(word, weights=slope[owner], minlength=width) + ridge * weights, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, vocabulary: int = 1_024, least_z: float = 4.0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on at most ``bound`` confirmed and ``bound`` unlabelled texts (the first in the order
    of a hash of their ids).

    ``labels`` says which documents are confirmed toxic (1); its zeros only enter the class prior,
    the share of ones among labelled rows. An id labelled several times counts with its largest
    label. The vocabulary is the words whose document frequencies differ most between the two
    groups. Null ids and labels are left out; without a confirmed or an unlabelled text the model
    is empty.
    """
    docs = only(docs, doc_id=doc_id, text=text).where("doc_id is not null")
    marks = only(labels, doc_id=doc_id, toxic=label).where("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marks.agg(F.avg("toxic").alias("prior")).first().prior
    if not prior or prior >= 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), None)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Both samples are bounded by a parameter, so they may be sent to all tasks.
    confirmed = marks.where("toxic = 1").select("doc_id").orderBy(*order).limit(bound).withColumn("confirmed", F.lit(True))
    others = docs.select("doc_id").distinct().orderBy(*order).limit(bound).withColumn("confirmed", F.lit(False))
    chosen = docs.join(F.broadcast(checkpointed(confirmed.union(others))), "doc_id").select("confirmed", text_or_empty().alias("text"))
    chosen = checkpointed(chosen)
    size = {r.confirmed: r["count"] for r in chosen.groupBy("confirmed").count().collect()}
    if len(size) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), None)
    n_p, n_u = size[True], size[False]
    counts = chosen.mapInArrow(_word_counts, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    best = counts.where("p + u >= 5").withColumn("z", F.abs(z)).where(F.col("z") >= least_z)
    found = best.orderBy(F.desc("z"), "word").limit(vocabulary).select("word").collect()
    known = np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))
    rows: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in chosen.mapInArrow(_rows_of_words(known), "confirmed boolean, words array<int>").toLocalIterator():
        rows[r.confirmed].append(np.array(r.words, np.int64))
    weights, bias = nnpu(rows[True], rows[False], len(known), float(prior))
    return Model(known, weights, bias)


def score(model: Model, text: str = "text") -> Column:
    """The model's estimate that a text is toxic, between 0 and 1.

    Null and blank texts get the score of a text without known words; an empty model gives 0.
    """

    def run(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        if model.bias is not None:
            for first, last, owner, word in present(column, model.vocabulary):
                total = model.bias + np.bincount(owner, weights=model.weights[word], minlength=last - first)
                out[first:last] = 1 / (1 + np.exp(-total))
        return pa.array(out)

    return F.arrow_udf(run, T.DoubleType())(F.col(f"`{text}`"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows whose labels no model sees: crc32 of the id's text leaves 1 when divided by 3."""
    rest = F.crc32(F.encode(F.col(f"`{doc_id}`").cast("string"), "UTF-8")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows that are not held out."""
    return fit(docs.where(~held_out()), labels.where(~held_out()))


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; predicted is 1 from ``limit`` on.

    An empty table gives an empty result. A null doc_id is not held out. Repeated rows get equal
    scores; other columns are ignored.
    """
    scored = docs.select("doc_id", held_out().alias("held_out"), score(train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The documents whose score stays below ``limit``, with all their columns."""
    return docs.where(score(train(docs, labels)) < limit)

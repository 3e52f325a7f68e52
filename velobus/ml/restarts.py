"""K-means from many starts and for many k at once: one pass over the vectors per round for all runs.

The vectors lie in blocks (numpy matrices) of a kept RDD. A pass hands on one sum and one count per
centre of every run, added up within each task; the driver holds centres and sums, no vectors.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

ROUNDS = 300
TOLERANCE = 1e-4  # a run ends when none of its centres moves farther
CHUNK = 4_096  # rows compared with all centres at a time


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            data = batch.column(0).flatten().to_numpy(zero_copy_only=False).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([batch.num_rows])], names=["data", "n"])


def matrices(vectors: DataFrame) -> RDD:
    """The ``features`` of a frame as an RDD of matrices, one per Arrow batch."""
    rows = vectors.select(vector_to_array("features").alias("v")).mapInArrow(_blocks, "data binary, n long")
    return rows.rdd.map(lambda r: np.frombuffer(r["data"]).reshape(r["n"], -1))


def _chunks(blocks: Iterable[np.ndarray], origin: np.ndarray) -> Iterator[np.ndarray]:
    for block in blocks:
        for first in range(0, len(block), CHUNK):
            yield block[first : first + CHUNK] - origin


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centre, row): squared distances less the squared length of the row."""
    gaps = (-2 * centres) @ rows.T
    gaps += (centres**2).sum(axis=1)[:, None]
    return gaps


def _add(left: tuple, right: tuple) -> tuple:
    return tuple(a + b for a, b in zip(left, right, strict=True))


def _middle(data: RDD) -> np.ndarray:
    """The mean of all rows: distances are taken from there, where they lose the fewest digits."""

    def total(blocks):
        sums = [(block.sum(axis=0), len(block)) for block in blocks]
        if sums:
            yield sum(s for s, _ in sums), sum(n for _, n in sums)

    found = data.mapPartitions(total).collect()
    if not found:
        raise ValueError("no vectors to cluster")
    return sum(s for s, _ in found) / sum(n for _, n in found)


def _starts(data: RDD, origin: np.ndarray, k: int, seeds: list[int]) -> list[np.ndarray]:
    """Per seed a k-means++ start; its first j centres are the start for j. With fewer distinct rows
    than k there are as many centres.

    Each further centre is a row drawn with a chance in proportion to its squared distance from the
    nearest one: the row with the smallest of exponential times, each divided by that weight.
    """
    chosen = [np.zeros((0, len(origin))) for _ in seeds]
    for step in range(k):

        def draw(number: int, blocks, step=step, chosen=tuple(chosen)):
            least, row = np.full(len(seeds), np.inf), np.zeros((len(seeds), len(origin)))
            clocks = [np.random.default_rng([seed, step, number]) for seed in seeds]
            for rows in _chunks(blocks, origin):
                square = (rows**2).sum(axis=1)
                for i, clock in enumerate(clocks):
                    weight = np.ones(len(rows))
                    if step:
                        weight = np.maximum(_gaps(rows, chosen[i]).min(axis=0) + square, 0)
                        weight[weight <= 1e-12 * square] = 0  # the centre itself, but for rounding
                    with np.errstate(divide="ignore"):
                        times = clock.standard_exponential(len(rows)) / weight
                    at = int(times.argmin())
                    if times[at] < least[i]:
                        least[i], row[i] = times[at], rows[at]
            yield least, row

        drawn = data.mapPartitionsWithIndex(draw).collect()
        first = np.argmin([least for least, _ in drawn], axis=0)
        for i, p in enumerate(first):
            if np.isfinite(drawn[p][0][i]):
                chosen[i] = np.concatenate([chosen[i], drawn[p][1][i][None]])
    return chosen


def _assign(data: RDD, origin: np.ndarray, runs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per run the sums and the counts of the rows nearest to each of its centres."""
    centres = np.concatenate(runs)
    ends = np.cumsum([len(run) for run in runs])
    spans = list(zip(ends - [len(run) for run in runs], ends))

    def gather(blocks):
        sums, counts = np.zeros(centres.shape), np.zeros(len(centres))
        for rows in _chunks(blocks, origin):
            gaps = _gaps(rows, centres)
            mine = np.zeros(gaps.shape)
            each = np.arange(len(rows))
            for low, high in spans:
                mine[low + gaps[low:high].argmin(axis=0), each] = 1
            sums += mine @ rows
            counts += mine.sum(axis=1)
        yield sums, counts

    sums, counts = data.mapPartitions(gather).reduce(_add)
    return [sums[low:high] for low, high in spans], [counts[low:high] for low, high in spans]


def fit_all(vectors: DataFrame, ks: list[int], restarts: int, seed: int) -> dict[int, np.ndarray]:
    """The centres per k, those of the restart with the lowest inertia; the first of equals.

    A round moves every centre to the mean of its rows (one without rows stays); a run ends after
    ``ROUNDS`` or when its centres stand still, and the passes go on for the others.
    """
    data = matrices(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        origin = _middle(data)
        starts = _starts(data, origin, max(ks), [seed + i for i in range(restarts)])
        runs = {(k, i): starts[i][:k] for k in ks for i in range(restarts)}
        saved = {}  # how much less than about the mean the squared distances of a run are
        moving = list(runs)
        for _ in range(ROUNDS):
            if not moving:
                break
            found = zip(moving, *_assign(data, origin, [runs[run] for run in moving]))
            still = []
            for run, sums, counts in found:
                held = counts[:, None] > 0
                moved = np.where(held, sums / np.maximum(counts, 1)[:, None], runs[run])
                saved[run] = float((sums**2 / np.maximum(counts, 1)[:, None]).sum())
                if ((moved - runs[run]) ** 2).sum(axis=1).max() > TOLERANCE**2:
                    still.append(run)
                runs[run] = moved
            moving = still
    finally:
        data.unpersist()
    best = {k: max(range(restarts), key=lambda i: (saved[k, i], -i)) for k in ks}
    return {k: runs[k, i] + origin for k, i in best.items()}

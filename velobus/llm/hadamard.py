"""Centroid clustering of integer vectors by progressive search over Walsh-Hadamard coefficients."""

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.llm.shared import only, stored

SCALE = 256
# Below this size of a component all sums of 64 squared coefficient differences fit 64 bits.
SMALL = 1 << 21
BLOCK = 2_048  # vectors searched at a time


def transform(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in whole numbers, coefficients by sequency.

    Rows have a power of two of components. Coefficient k changes sign k times, so the first ones
    hold the coarse shape. Squared lengths grow by exactly the number of components.
    """
    out, n = vectors, vectors.shape[1]
    half = 1
    while half < n:
        pairs = out.reshape(len(out), n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        half *= 2
    # Natural place of the coefficient with k sign changes: the bits of k's Gray code, reversed.
    width = n.bit_length() - 1
    places = [int(format(k ^ (k >> 1), f"0{width}b")[::-1], 2) if width else 0 for k in range(n)]
    return out[:, places]


def nearest(coefficients: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each transformed row the nearest transformed centroid (the first of equals) and its squared
    distance before the transform.

    Squared differences are summed coarse to fine, a few more coefficients at a time. After each
    step the centroid that leads is summed to its end, and whatever is already strictly further
    than that goes; so what stays at the end is summed over all coefficients and nothing that
    could win or tie was left out.
    """
    rows, n = coefficients.shape
    so_far = np.zeros((rows, len(centroids)), coefficients.dtype)
    alive = np.ones(so_far.shape, bool)
    best = None
    begin, end = 0, min(4, n)
    while True:
        row, centroid = np.nonzero(alive)
        step = coefficients[row, begin:end] - centroids[centroid, begin:end]
        so_far[row, centroid] += (step * step).sum(axis=1)
        if end == n:
            break
        leader = np.where(alive, so_far, so_far.max(axis=1, keepdims=True) + 1).argmin(axis=1)
        rest = coefficients[:, end:] - centroids[leader, end:]
        whole = so_far[np.arange(rows), leader] + (rest * rest).sum(axis=1)
        best = whole if best is None else np.minimum(best, whole)
        alive &= so_far <= best[:, None]
        begin, end = end, min(2 * end, n)
    final = np.where(alive, so_far, so_far.max(axis=1, keepdims=True) + 1)
    chosen = final.argmin(axis=1)
    return chosen, final[np.arange(rows), chosen] // n


def _wide(array: np.ndarray) -> np.ndarray:
    """Whole numbers in a type in which the search can't overflow."""
    return array.astype(object) if len(array) and np.abs(array).max() >= SMALL else array.astype(np.int64)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), size)


def _search(packed: list[pa.Array], size: int, centroids: list[list[int]]):
    """Vectors of a batch, their clusters and distances."""
    vectors = _rows(packed, size)
    middle, own = _wide(np.array(centroids, object)), _wide(vectors)
    if object in (middle.dtype, own.dtype):
        middle, own = middle.astype(object), own.astype(object)
    middle = transform(middle)
    found = [nearest(transform(own[i : i + BLOCK]), middle) for i in range(0, len(own), BLOCK)]
    cluster, distance = (np.concatenate([f[part] for f in found]) for part in (0, 1))
    return vectors, cluster, distance


def whole_vectors(frame: DataFrame, size: int) -> DataFrame:
    """(vec_id, packed): the vectors with exactly ``size`` finite components, each component x as
    floor(256 * x), in 64-bit little-endian numbers; other rows are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            fits = np.array(lists.value_lengths().fill_null(0)) == size
            flat = lists.filter(pa.array(fits)).flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # null is nan here
            good = np.isfinite(values).all(axis=1)
            whole = np.floor(values[good] * SCALE)
            if np.abs(whole).max(initial=0) >= 2.0**62:
                raise ValueError("a component is too large for whole numbers of 64 bits")
            ids = batch.column("vec_id").filter(pa.array(fits)).filter(pa.array(good))
            packed = [row.tobytes() for row in whole.astype("<i8")]
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], ["vec_id", "packed"])

    return frame.mapInArrow(pack, "vec_id long, packed binary")


def _first(vectors: DataFrame, k: int, size: int, seed: int) -> list[list[int]]:
    """The k starting centroids: a bounded number of vectors."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "packed").limit(k)
    return [np.frombuffer(r.packed, "<i8").tolist() for r in chosen.select("packed").collect()]


def _moved(vectors: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The centroids after one round. Every task sums its vectors by cluster; one row per cluster,
    component and task is shuffled, and one per cluster and component reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 1), object)  # the last component counts
        for batch in batches:
            if not batch.num_rows:
                continue
            own, cluster, _ = _search(batch.column("packed"), size, centroids)
            for c in np.unique(cluster):
                members = own[cluster == c]
                bounded = np.abs(members).max() < 2**62 // len(members)
                total[c, :size] += (members if bounded else members.astype(object)).sum(axis=0)
                total[c, size] += len(members)
        cluster, component = np.nonzero(total)
        columns = [pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array([Decimal(int(x)) for x in total[cluster, component]], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "total"])

    parts = vectors.mapInArrow(sums, "cluster int, component int, total decimal(38,0)")
    found = parts.groupBy("cluster", "component").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    total = {(r.cluster, r.component): int(r.total) for r in found}
    return [
        [total.get((c, i), 0) // total[c, size] for i in range(size)] if (c, size) in total else old
        for c, old in enumerate(centroids)
    ]


def clustered(frame: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly ``size`` (a power of two) components, none of them null, infinite
    or no number; component x counts as floor(256 * x), and all that follows is in whole numbers.
    Centroids 0, 1, ... start as the k kept vectors whose ids have the smallest SHA-256 of
    ``<seed>:<id>`` (fewer vectors: as many centroids). Each round gives every vector to its nearest
    centroid (ties: the smaller number) and moves a centroid to the floor of its vectors' mean; one
    without vectors stays. At the end vectors are given to their nearest centroid once more.

    distance is squared; cluster_inertia and inertia are its sums over the cluster and over all
    vectors; centroid_sha256 is of the final components, as decimal numbers joined by commas.
    Vectors of repeated ids are vectors like any other; null ids start no centroid unless there are
    too few others. An empty table, or one without kept vectors, gives an empty result; other
    columns are ignored. Components are expected below 2**62 / 256; a distance beyond 64 bits fails.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    vectors = stored(whole_vectors(only(frame, vec_id=vec_id, vector=vector), size))
    centroids = _first(vectors, k, size, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(vectors, centroids, size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, cluster, distance = _search(batch.column("packed"), size, centroids)
            columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    given = stored(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    # At most k rows from here on, the centroids.
    of_cluster = given.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = sum(r.cluster_inertia for r in of_cluster)
    facts = [(r.cluster, r.cluster_inertia, inertia, digests[r.cluster]) for r in of_cluster]
    facts = frame.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return given.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

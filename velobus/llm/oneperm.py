"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low bits."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.llm.arrays import PIECE, mix, shingles, slices, text_run, words
from velobus.llm.shared import only, partitions

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densified(bins: np.ndarray) -> np.ndarray:
    """Empty bins filled from full ones: bin i tries the bins of a sequence that depends on i alone,
    so two texts borrow alike, and each borrows from any full bin with equal chance."""
    out = bins.copy()
    n = bins.shape[1]
    row, place = np.nonzero((bins == EMPTY) & (bins != EMPTY).any(axis=1)[:, None])
    attempt = 1
    while len(row):
        donor = (mix(place.astype(np.uint64), attempt) % np.uint64(n)).astype(np.int64)
        value = bins[row, donor]
        full = value != EMPTY
        out[row[full], place[full]] = value[full]
        row, place = row[~full], place[~full]
        attempt += 1
    return out


def fingerprints(column: pa.Array, bins: int, bits: int, size: int) -> np.ndarray:
    """One row of ``bins`` low-bit values per text; a text without words has zeros, and is marked
    by a last value of 1 (others: 0)."""
    run, starts = text_run(column)
    out = np.zeros((len(column), bins + 1), np.uint8)
    shift = np.uint64(64 - (bins - 1).bit_length())
    for first, last in slices(starts, 2 * PIECE):
        own = starts[first : last + 1] - starts[first]
        hashes, owner, _ = words(run[starts[first] : starts[last]], own)
        found, of = shingles(hashes, owner, last - first, size)
        least = np.full((last - first) * bins, EMPTY, np.uint64)
        np.minimum.at(least, of * bins + (found >> shift).astype(np.int64), found << (np.uint64(64) - shift) >> (np.uint64(64) - shift))
        least = densified(least.reshape(last - first, bins))
        empty = (least == EMPTY).all(axis=1)
        out[first:last, :bins] = np.where(empty[:, None], 0, mix(least, 5) & np.uint64((1 << bits) - 1))
        out[first:last, bins] = empty
    return out


def packed(values: np.ndarray, bits: int) -> list[str]:
    """The low bits, one after the other, as hexadecimal digits; no digits for no words."""
    low = np.unpackbits(values[:, :-1, None], axis=2, bitorder="little", count=bits).reshape(len(values), -1)
    return ["" if v[-1] else b.tobytes().hex() for v, b in zip(values, np.packbits(low, axis=1), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Estimated share of common shingles: equal values less those that agree by chance."""
    equal = (a[:, :-1] == b[:, :-1]).mean(axis=1)
    chance = 0.5**bits
    estimate = np.clip((equal - chance) / (1 - chance), 0, 1)
    empty = a[:, -1].astype(int) + b[:, -1]
    return np.where(empty == 0, estimate, (empty == 2).astype(float))


def _compare(bins: int, bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for the text that follows it
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            yield from _fingerprinted(table, bins, bits, size)
            held = table.slice(table.num_rows - 1) if table.num_rows else held

    return run


def _fingerprinted(table: pa.Table, bins: int, bits: int, size: int) -> Iterator[pa.RecordBatch]:
    """All rows but the last, each with the row after it; guests only lend their text."""
    guest = np.array(table.column("guest").to_pylist(), bool)
    text = pc.fill_null(table.column("text").combine_chunks(), "")
    begin = 0
    step = 512
    while begin + 1 < table.num_rows:
        end = min(begin + step, table.num_rows - 1)
        own, following = text.slice(begin, end - begin), text.slice(begin + 1, end - begin)
        length = pc.utf8_length(own).to_numpy().astype(np.int64)
        edited = [o[: n - n // 3] + f[: n // 3] for o, f, n in zip(own.to_pylist(), following.to_pylist(), length.tolist(), strict=True)]
        mine = fingerprints(text.slice(begin, end - begin + 1), bins, bits, size)
        other = fingerprints(pa.array(edited, pa.string()), bins, bits, size)
        real = pa.array(~guest[begin:end])
        columns = [
            table.column("doc_id").combine_chunks().slice(begin, end - begin),
            pa.array(length),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(packed(mine[:-1], bits)),
            pa.array(packed(other, bits)),
            pa.array(likeness(mine[:-1], other, bits)),
            pa.array(likeness(mine[:-1], mine[1:], bits)),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(real)
        begin = end


def fingerprinted(docs: DataFrame, bins: int = 512, bits: int = 4, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A shingle's hash chooses one of ``bins`` bins and a value in it; a bin keeps its least value,
    empty bins borrow from full ones, and ``bits`` low bits of each are packed into hexadecimal
    digits. Likenesses are corrected for bits that agree by chance. The edited text has its last
    floor(n / 3) code points replaced by the first as many of the next document, which is the next
    smaller doc_id, and for the smallest the largest.

    Equal texts have equal fingerprints; a text without words (null, blank) has an empty one, like
    only to another empty one. Rows with equal doc_id follow each other by text, rows without one
    come last, by text. A single row is its own next. An empty table gives an empty result; other
    columns are ignored.

    Documents are divided by ranges of doc_id, whose borders are found on the ids alone. Each range
    also gets the first document of the next one, so no range waits for another and texts are
    shuffled once.
    """
    docs = only(docs, doc_id=doc_id, text=text)
    width = partitions(docs.sparkSession)
    ids = docs.select("doc_id").where("doc_id is not null")
    ranges = ids.repartitionByRange(width, F.desc("doc_id")).groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    # One number per shuffle partition: the smallest id of each range.
    lows = sorted({r.low for r in ranges.collect()}, reverse=True)
    steps = [1 << k for k in reversed(range(max(1, len(lows).bit_length())))]
    borders = F.array(*[F.lit(x).cast("long") for x in lows]) if lows else F.array().cast("array<long>")

    def jump(found, step):
        return F.when(F.get(borders, found + step - 1) > F.col("doc_id"), found + step).otherwise(found)

    # The range of an id: how many ranges end above it; rows without id form the last one.
    number = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), jump)
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), len(lows)).otherwise(number))
    heads = _first_of_each(placed)
    last = heads.agg(F.max("range").alias("m")).first().m
    if last is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    # The ranges that have rows, in a circle: each lends its first row to the one before it.
    there = sorted(r["range"] for r in heads.select("range").collect())
    to = {r: there[k - 1] for k, r in enumerate(there)}
    lender = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    guests = heads.select("doc_id", "text", F.element_at(lender, F.col("range")).alias("range"), F.lit(True).alias("guest"))
    all_rows = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    sorted_rows = all_rows.repartitionById(last + 1, F.col("range")).sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))
    return sorted_rows.select("doc_id", "text", "guest").mapInArrow(_compare(bins, bits, size), SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _first_of_each(placed: DataFrame) -> DataFrame:
    """The first document of every range: one row per shuffle partition."""
    first = placed.groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    chosen = placed.join(F.broadcast(first), placed["doc_id"].eqNullSafe(first["doc_id"]) & (placed["range"] == first["range"]), "left_semi")
    return chosen.groupBy("range", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

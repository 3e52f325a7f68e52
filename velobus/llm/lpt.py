"""Shards of near equal size by longest-processing-time scheduling."""

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velobus.llm.shared import checkpointed, partitions, stored

LARGE = 32_000  # a group with more than this part of all rows is looked up by broadcast


def dealt(heap: list[tuple[int, int]], weight: int, count: int) -> list[int]:
    """How many of ``count`` groups of one weight each shard gets, one by one to the least loaded.

    ``heap`` holds (load, shard), equal loads by number, and is brought up to date. Equal groups need
    not be pushed one by one: shard s is picked at loads load, load + weight, ..., and the ``count``
    smallest of all these picks are made. Up to which load is found by halving.
    """
    got = [0] * len(heap)
    if count <= 2 * len(heap):
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + weight, shard))
            got[shard] += 1
        return got
    loads = {shard: load for load, shard in heap}

    def picks(level: int) -> int:
        return sum(max(0, -((load - level) // weight)) for load in loads.values())

    low = min(loads.values())
    high = low + weight * count + 1
    while high - low > 1:  # picks(low) <= count < picks(high)
        middle = (low + high) // 2
        low, high = (middle, high) if picks(middle) <= count else (low, middle)
    for shard, load in loads.items():
        got[shard] = max(0, -((load - low) // weight))
    rest = count - sum(got)
    for shard in sorted(loads):
        if rest and loads[shard] + got[shard] * weight == low:
            got[shard] += 1
            rest -= 1
    heap[:] = [(load + got[shard] * weight, shard) for shard, load in loads.items()]
    heapq.heapify(heap)
    return got


def assign(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size: the largest first, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = dealt(heap, sizes[k], 1).index(1)
    return out


def _plan(groups: DataFrame, shards: int) -> DataFrame:
    """(weight, ends): groups of a weight go to shard s from its end of shard s - 1 on.

    Longest processing time needs only how many groups there are of each weight, as equal ones are
    interchangeable. That table has a row per distinct weight, at most the square root of twice all
    bytes, and streams through one task from the heaviest down, with one heap of the shards.
    """

    def heaviest_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, s) for s in range(shards)]
        for batch in batches:
            ends = []
            for weight, count in zip(batch.column("weight").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total, row = 0, []
                for n in dealt(heap, weight, count):
                    total += n
                    row.append(total)
                ends.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("weight"), pa.array(ends, pa.list_(pa.int64()))], ["weight", "ends"])

    sizes = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).repartition(1).sortWithinPartitions(F.desc("weight"))
    return stored(sizes.mapInArrow(heaviest_first, "weight long, ends array<long>"))


def _numbered(rows: DataFrame, key: str, part: Column, by: list) -> DataFrame:
    """Rows with their number (n, from 0) among those of a key, without gathering a key anywhere:
    rows are numbered within parts, whose counts say where each part begins."""
    rows = rows.withColumn("_part", part)
    before = F.sum("count").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.groupBy(key, "_part").count().select(key, "_part", F.coalesce(before, F.lit(0)).alias("_begin"))
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by)) - 1
    numbered = rows.withColumn("_rank", rank).join(begins, [key, "_part"])
    return numbered.withColumn("n", F.col("_begin") + F.col("_rank")).drop("_part", "_rank", "_begin")


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", order: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Rows of equal text form a group and stay together; a row's size is its UTF-8 bytes plus 1, and a
    group's weight the sum of its rows' sizes. All groups, from the heaviest down, go to the least
    loaded shard through a heap; groups of one weight are dealt in one step, which gives the loads
    of dealing them one by one. So the law is ``bytes``: the spread of the shards is at most the
    weight of the group that closed the fullest. grown_shard is null, as another shard count moves
    groups.

    slot numbers the rows of a shard without gaps from 0: by ``order``, a whole number per row, where
    one is given (null first, equal ones by id), else in any order. Even steps of it, such as
    positions, share the numbering out evenly; others are numbered right too. Null texts count as
    empty ones; very long ones are read whole for their size and digests only. Rows that repeat an
    id are rows like any other. An empty table gives an empty result; other columns are ignored.
    """
    return _placed(docs, shards, text, doc_id, order).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _placed(docs: DataFrame, shards: int, text: str, doc_id: str, order: Column | None) -> DataFrame:
    parts = partitions(docs.sparkSession)
    utf8 = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(utf8) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.unhex(F.md5(utf8)).alias("_group"),
        *([] if order is None else [order.cast("long").alias("_order")]),
    )
    rows = checkpointed(rows)
    same = ["_group", "text_crc32"]
    groups = stored(rows.groupBy(*same).agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("_rows")))
    groups = _numbered(groups, "weight", F.pmod(F.xxhash64(*same), F.lit(parts)), same)
    chosen = groups.join(_plan(groups, shards), "weight")
    chosen = stored(chosen.select(*same, "_rows", F.size(F.filter("ends", lambda e: e <= F.col("n"))).alias("shard")))
    span = [F.lit(0), F.lit(0)] if order is None else [F.min("_order"), F.max("_order")]
    total, least, most = (x or 0 for x in rows.agg(F.count(F.lit(1)), *span).first())
    # At most LARGE groups are larger than their part of all rows; the others are joined by shuffle.
    large = F.col("_rows") * LARGE > total
    few = F.broadcast(chosen.where(large).select(*same, "shard"))
    many = chosen.where(~large).select(*same, "shard")
    placed = rows.join(few, same).unionByName(rows.join(few.drop("shard"), same, "left_anti").join(many, same))
    if order is None:
        part, by = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)), []
    else:  # parts are stretches of the order
        step = F.lit((most - least) // parts + 1)
        part, by = F.coalesce(F.floor((F.col("_order") - least) / step), F.lit(-1)), ["_order"]
    placed = _numbered(placed, "shard", part, [*by, "doc_id", "text_crc32"])
    return placed.withColumnRenamed("n", "slot").withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})

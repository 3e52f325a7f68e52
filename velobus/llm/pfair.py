"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only."""

import json
from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velobus.llm.shared import partitions, stored

UNIT = 10**12  # target weights are whole numbers of this in sum: what a double holds, about
CHUNK = 1 << 14  # blocks of a source that one row unfolds to
# One slot after the other, as far as a stretch goes: what is released joins what is open, and of
# that the job due first runs. Jobs are (deadline, source, block); `fresh` has them by release.
EARLIEST_DEADLINE_FIRST = """
aggregate(
  sequence(0L, slots - 1),
  struct(pending AS open, 0 AS seen, cast(array() AS array<struct<source:int,block:bigint>>) AS ran),
  (a, t) -> transform(
    array(if(get(fresh, a.seen).release = first + t,
             struct(concat(a.open, get(fresh, a.seen).jobs) AS open, a.seen + 1 AS seen),
             struct(a.open AS open, a.seen AS seen))),
    b -> transform(array(array_min(b.open)), pick -> struct(
      array_remove(b.open, pick) AS open, b.seen AS seen,
      concat(a.ran, array(struct(pick.source AS source, pick.block AS block))) AS ran))[0])[0],
  a -> struct(sort_array(a.open) AS open, a.ran AS ran))
"""
JOB = "struct<deadline:bigint,source:int,block:bigint>"


def whole_weights(target: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole numbers of UNIT in sum, at least 1 each."""
    total = sum(map(Fraction, target.values()))
    return {s: max(1, round(Fraction(w) / total * UNIT)) for s, w in target.items()}


def _leading(entries: str, size: int, condition: str) -> str:
    """SQL for how many entries (e) of a sorted array meet the condition, by halving; those that do
    come first."""
    return f"""
aggregate(sequence(1, {size.bit_length()}), struct(0 AS low, {size} AS high), (a, step) ->
  if(a.low >= a.high, a, transform(array(int((a.low + a.high) div 2)), m -> transform(array(get({entries}, m)), e ->
    if({condition}, struct(m + 1 AS low, a.high AS high), struct(a.low AS low, m AS high)))[0])[0])).low"""


def _entries(rows: Sequence[Mapping[str, int]]) -> str:
    """SQL for a constant array of structs of whole numbers: one element per source, at most."""
    fields = ",".join(f"{name}:bigint" for name in rows[0])
    return f"from_json('{json.dumps(rows)}', 'array<struct<{fields}>>')"


def _timed(jobs: DataFrame, blocks: Sequence[int], weights: Sequence[int]) -> DataFrame:
    """Release and deadline of each (source, weight, block).

    In the fluid mixture every running source gets slots in proportion to its weight. When each has
    got v times its weight, or run out, sum(min(blocks, weight * v)) slots are over: a line between
    the points where sources run out. Block i of a source with weight w starts at v = i / w and ends
    at v = (i + 1) / w; it is released and due in whole slots around that. All is in whole numbers.
    """
    order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
    out = [{"n": blocks[s], "w": weights[s]} for s in order]
    before, rate = 0, sum(weights)
    lines = [{"before": before, "rate": rate}]
    for s in order:
        before, rate = before + blocks[s], rate - weights[s]
        lines.append({"before": before, "rate": rate})
    ends, lines = _entries(out), _entries(lines)
    big = "cast({} AS decimal(19,0))".format

    def slots(place: str, up: str) -> str:
        gone = _leading(ends, len(out), f"{big('e.n')} * {big('weight')} <= {big(place)} * {big('e.w')}")
        return f"""
transform(array(get({lines}, {gone})), g ->
  g.before + (cast(g.rate AS decimal(16,0)) * {big(place)} + {up}) div cast(weight AS decimal(16,0)))[0]"""

    release, deadline = slots("block", "0"), slots("(block + 1)", "weight - 1")
    return jobs.withColumns({"release": F.expr(release), "deadline": F.expr(deadline)})


def _before(counts: DataFrame, index: str, value: str, span: int = 4096) -> DataFrame:
    """Rows (index, value) with the sum of all values of smaller index, summed in two steps."""
    parts = counts.withColumn("_part", F.expr(f"`{index}` div {span}"))
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_total"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("_part", F.coalesce(F.sum("_total").over(earlier.orderBy("_part")), F.lit(0)).alias("_begin"))
    own = F.coalesce(F.sum(value).over(earlier.partitionBy("_part").orderBy(index)), F.lit(0))
    return parts.withColumn("_own", own).join(begins, "_part").withColumn("before", F.col("_begin") + F.col("_own")).drop("_part", "_own", "_begin")


def schedule(spark: SparkSession, blocks: Sequence[int], weights: Sequence[int], stretch: int = 1024) -> DataFrame:
    """(source, block, slot): earliest deadline first over all blocks of sources 0, 1, ...

    The slots are cut into stretches, and every stretch runs at once, from a guess of which jobs are
    open when it begins: those due last of the ones that span its first slot. Where the stretch
    before ends with other open jobs than were guessed, the stretch runs again from those, until all
    agree; each round settles one more stretch at least, and jobs that are due soon make most agree
    at once. So the result is the schedule that one pass over all slots would give.
    """
    rows = [(s, n, w) for s, (n, w) in enumerate(zip(blocks, weights, strict=True))]
    total = sum(blocks)
    sources = spark.createDataFrame(rows, "source int, n long, weight long")
    chunks = sources.withColumn("_chunk", F.expr(f"explode(sequence(0L, n - 1, {CHUNK}L))")).repartition("source", "_chunk")
    jobs = chunks.withColumn("block", F.expr(f"explode(sequence(_chunk, least(_chunk + {CHUNK}, n) - 1))"))
    jobs = _timed(jobs, blocks, weights).select("release", F.struct("deadline", "source", "block").alias("job"))
    jobs = stored(jobs.withColumn("part", F.expr(f"release div {stretch}")))

    by_slot = jobs.groupBy("part", "release").agg(F.collect_list("job").alias("jobs"))
    by_part = by_slot.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("release", "jobs"))).alias("fresh"), F.sum(F.size("jobs")).alias("n"))
    every = spark.range(-(-total // stretch)).withColumnRenamed("id", "part")
    every = every.withColumns({"first": F.expr(f"part * {stretch}"), "slots": F.expr(f"least({stretch}L, {total} - part * {stretch})")})
    parts = every.join(by_part, "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Which jobs span the first slot of a stretch: at most two per source.
    over = jobs.where(f"job.deadline > (part + 1) * {stretch}")
    over = over.select(F.expr(f"explode(sequence(part + 1, (job.deadline - 1) div {stretch}))").alias("part"), "job")
    over = over.groupBy("part").agg(F.sort_array(F.collect_list("job")).alias("over"))
    parts = _before(parts, "part", "n").join(over, "part", "left").withColumn("open", F.expr("int(before - first)"))
    guess = f"if(open > 0, slice(over, -open, open), cast(array() AS array<{JOB}>))"
    parts = stored(parts.select("part", "first", "slots", F.coalesce("fresh", F.expr("cast(array() AS array<struct<release:bigint,jobs:array<struct<deadline:bigint,source:int,block:bigint>>>>)")).alias("fresh"), F.expr(guess).alias("pending")))

    def run(some: DataFrame) -> DataFrame:
        done = some.withColumn("end", F.expr(EARLIEST_DEADLINE_FIRST))
        return stored(done.select("part", "pending", "end.open", "end.ran"))

    runs = [run(parts)]
    states = runs[0].select("part", "pending", "open")
    while True:
        left = states.select((F.col("part") + 1).alias("part"), F.col("open").alias("given"))
        wrong = stored(states.join(left, "part").where("given != pending").select("part", F.col("given").alias("pending")))
        if wrong.isEmpty():
            break
        runs.append(run(parts.drop("pending").join(wrong, "part")))
        again = runs[-1].select("part", "pending", "open")
        states = stored(states.join(again, "part", "left_anti").unionByName(again))
    final = runs[0].select("part", "ran")
    if len(runs) > 1:
        rounds = [r.select("part", F.struct(F.lit(k).alias("round"), "ran").alias("last")) for k, r in enumerate(runs)]
        final = reduce(DataFrame.unionByName, rounds).groupBy("part").agg(F.max_by("last.ran", "last.round").alias("ran"))
    ran = final.select("part", F.posexplode("ran").alias("place", "job"))
    return ran.select("job.source", "job.block", F.expr(f"part * {stretch} + place").alias("slot"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 4, tempering: float = 0.5, seed: int = 0, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, block, place, slot, position) of every row of ``docs``.

    The rows of a source, in the order of a hash of their ids, are cut into blocks of ``block``
    rows (the last may be shorter). With target weights w, block i of a source is released when the
    ideal fluid mixture would start it and due when it would end it; the released block that is due
    first runs. So after any number of slots, every source has had less than one block more or less
    than its given weight asks for, among the sources that still have rows. When a source runs out,
    the others share its part. Neither the error nor the work per slot grows with the rows.

    ``weights`` are by source, for sources it leaves out half the smallest of them; without weights
    a source weighs its number of rows to the power of ``tempering``. A share is taken to the 12th
    decimal, at least 10**-12; the driver holds one row per source.

    slot is the block's place among all blocks, position (from 0, without gaps) the row's among all
    rows, place the row's in its block. A null source is a source of its own, named null in the
    result. Rows that repeat an id keep their own places, in any order. Empty and very long texts
    are rows like any other, as texts are not read. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"))
    return _placed(rows, weights, block, tempering, seed).select("doc_id", "source", "block", "place", "slot", "position")


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """Rows with their number in their source (column i), without gathering a source anywhere.

    A source is cut by the hash of the ids into as many parts as there are shuffle partitions; the
    rows are numbered within a part, and parts are counted to know where each begins.
    """
    parts = partitions(docs.sparkSession)
    hashed = docs.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_part", F.pmod(F.shiftright("_h", 16), F.lit(parts)))
    sizes = hashed.groupBy("_key", "_part").count()
    before = F.sum("count").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("_key", "_part", F.coalesce(before, F.lit(0)).alias("_begin"))
    rank = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_h", "doc_id")) - 1
    return hashed.withColumn("_rank", rank).join(begins, ["_key", "_part"]).withColumn("i", F.col("_begin") + F.col("_rank")).drop("_h", "_part", "_rank", "_begin")


def _key(source: str) -> Column:
    """A name that no null shares: null sources get one of their own."""
    named = F.col(f"`{source}`").cast("string")
    return F.when(named.isNull(), "null:").otherwise(F.concat(F.lit("name:"), named))


def _placed(docs: DataFrame, weights, block: int, tempering: float, seed: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.withColumn("_key", _key("source"))
    # One row per source: what a configuration file of the mixture would hold.
    counted = {r["_key"]: r["count"] for r in rows.groupBy("_key").count().collect()}
    if not counted:
        return docs.withColumns({c: F.lit(None).cast("long") for c in ("block", "place", "slot", "position")})
    if weights is None:
        target = {s: n**tempering for s, n in counted.items()}
    else:
        given = {"null:" if s is None else f"name:{s}": w for s, w in weights.items() if w > 0}
        rest = min(given.values(), default=1.0) / 2
        target = {s: given.get(s, rest) for s in counted}
    whole, names = whole_weights(target), sorted(counted)
    blocks = [-(-counted[s] // block) for s in names]
    ran = schedule(spark, blocks, [whole[s] for s in names])
    keys = spark.createDataFrame(list(enumerate(names)), "source int, _key string")
    numbered = _numbered(rows, seed).join(F.broadcast(keys.withColumnRenamed("source", "_source")), "_key")
    numbered = numbered.withColumns({"block": F.expr(f"i div {block}"), "place": F.expr(f"i % {block}")})
    ran = ran.select(F.col("source").alias("_source"), "block", "slot")
    # The schedule grows with the rows, so it is never broadcast, however small its files look.
    placed = numbered.join(ran.hint("merge"), ["_source", "block"])
    # Only a source's last block can be short: so many rows are missing before a later slot.
    short = spark.createDataFrame([(k, b - 1, b * block - counted[s]) for k, (s, b) in enumerate(zip(names, blocks, strict=True)) if counted[s] % block], "_source int, block long, gap long")
    missing, gaps = 0, [{"slot": -1, "missing": 0}]
    for r in ran.join(F.broadcast(short), ["_source", "block"]).orderBy("slot").collect():
        missing += r.gap
        gaps.append({"slot": r.slot, "missing": missing})
    gaps_sql = _entries(gaps)
    gone = f"get({gaps_sql}, {_leading(gaps_sql, len(gaps), 'e.slot < slot')} - 1).missing"
    placed = placed.withColumn("position", F.expr(f"slot * {block} + place - {gone}"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], "block", "place", "slot", "position")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 4, tempering: float = 0.5, seed: int = 0, key: str | None = None) -> DataFrame:
    """All rows of ``docs`` with all their columns, sorted by their position in the mixture.

    Partition k holds the k-th stretch of positions, so written files keep the order. Positions
    have no gaps, so the stretches are equal whatever the sources. Where a column ``key`` tells all
    rows apart, only it travels through the schedule; it is not part of the result.
    """
    kept = [c for c in docs.columns if c != key]
    n = docs.count()
    parts = partitions(docs.sparkSession)
    if key is None:
        packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
        placed = _placed(packed, weights, block, tempering, seed).select("_row", "position")
    else:
        placed = _placed(docs.select("doc_id", "source", key), weights, block, tempering, seed).select(key, "position")
        placed = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")).join(placed, key)
    stretch = F.expr(f"int(position * {parts} div {max(n, 1)})")
    return placed.repartitionById(parts, stretch).sortWithinPartitions("position").select("_row.*")

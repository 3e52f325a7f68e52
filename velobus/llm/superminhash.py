"""Near-duplicate documents by SuperMinHash, banding, exact verification and component grouping."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.llm.arrays import mix, shingle_sets
from velobus.llm.graph import components
from velobus.llm.shared import only, stored

RANK_SHIFT = np.uint32(25)  # a signature value: 7 bits of rank, then 25 random bits
ELEMENTS = 1 << 18  # shingles worked on at a time


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, width: int) -> np.ndarray:
    """The SuperMinHash signature (width <= 127 values) of every set; no set repeats an element.

    Each element owns a random permutation of the ranks 0..width-1 over the slots; a slot keeps the
    smallest rank + random fraction. Step j places the rank j of all elements at once. A set is
    finished as soon as no slot holds more than j + 1, for later ranks cannot lower it: large sets
    stop after one or two steps. The permutation is drawn by swaps, of which only the partners are
    kept; a slot is found by tracing them back.
    """
    signature = np.full(n_sets * width, 0xFFFFFFFF, np.uint32)
    partners: list[np.ndarray] = []
    for j in range(width):
        if not len(elements):
            break
        drawn = mix(elements, j + 1)
        partner = (j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(width - j)) >> np.uint64(32)).astype(np.int64)).astype(np.uint8)
        slot = partner.copy()
        for step in range(j - 1, -1, -1):
            slot[slot == partners[step]] = step
        value = (drawn >> np.uint64(39)).astype(np.uint32) | (np.uint32(j) << RANK_SHIFT)
        np.minimum.at(signature, owner * width + slot, value)
        worst = signature.reshape(n_sets, width).max(axis=1) >> RANK_SHIFT
        more = (worst > j)[owner]
        if not more.all():
            elements, owner = elements[more], owner[more]
            partners = [p[more] for p in partners]
            partner = partner[more]
        partners.append(partner)
    return signature.reshape(n_sets, width)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        key = mix(key + parts[:, :, r], r + 1)
    return mix(key + np.arange(bands, dtype=np.uint64)[None, :], 99)


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found, of, sizes in shingle_sets(batch.column("text"), size):
                n = last - first
                keys = np.empty((n, bands), np.uint64)
                ends = np.cumsum(sizes)
                begin = 0
                while begin < n:  # whole sets, about ELEMENTS shingles at a time
                    before = ends[begin] - sizes[begin]
                    end = max(begin + 1, int(np.searchsorted(ends, before + ELEMENTS, side="right")))
                    part = slice(before, ends[end - 1])
                    signature = signatures(found[part], of[part] - begin, end - begin, bands * rows)
                    keys[begin:end] = band_keys(signature, bands, rows)
                    begin = end
                marks = []
                for seed in (51, 52):  # two sums over the set: equal for equal sets
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found, seed), dtype=np.uint64)])
                    marks.append((sums[ends] - sums[ends - sizes]).view(np.int64))
                offsets = pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "mark1", "mark2", "keys"],
                )

    return run


def _verify(percent: int, size: int):
    """Of each pair (a, b): the sizes of b and of what both share, whether they are linked, and for
    crowded pairs the first of b's shingles that a lacks, in the order of their hashes.

    A text c linked with b has at least percent / 100 of b's size, so b and c share at least that
    many shingles less those that b shares with a, among the ones that a lacks: if they share any
    number t of those, the first |rest| - t + 1 of b and of c have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            right = [s for *_, found, of, sizes in shingle_sets(batch.column("text_b"), size) for s in np.split(found, np.cumsum(sizes)[:-1])]
            rows = []
            for i, (a, b, crowded) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "crowded")), strict=True)):
                if a != held[0]:  # rows of one a come together
                    (*_, found, _, _), = shingle_sets(batch.column("text_a").slice(i, 1), size)
                    held = (a, found)
                own = right[i]
                rest = np.setdiff1d(own, held[1], assume_unique=True)
                both = len(own) - len(rest)
                linked = 100 * both >= percent * (len(held[1]) + len(own) - both)
                needed = max(1, -(-percent * len(own) // 100) - both)
                rows.append((a, b, len(own), both, linked, rest[: max(0, len(rest) - needed + 1)].view(np.int64) if crowded else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], names=["a", "b", "n", "shared", "linked", "rest"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """_verify() of pairs (a, b, crowded)."""
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return stored(both.select("a", "b", "crowded", "text_a", "text_b").mapInArrow(_verify(percent, size), "a long, b long, n long, shared long, linked boolean, rest array<long>"))


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 25, rows: int = 5, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Words are runs of bytes other than blanks, A-Z as a-z; a document's set holds its distinct
    shingles of ``size`` words, the whole sequence if it has fewer. Documents are linked if
    100 * shared >= percent * union, components are named by their smallest doc_id, and that
    document is kept. With the defaults a pair at the limit shares no band with probability 4e-7.

    Work on candidates goes by classes of equal sets, never by copies, and a band's bucket is not
    expanded into pairs. Its hub, the member that meets most others in all its buckets, is compared
    with every member. Two members linked with the hub need no more. If x is not, then it can only
    be linked with a y that shares a shingle which the hub lacks, or that is so small that
    85 * (|x| + |y|) <= 185 * |x and hub| (for 85 percent): the shingles that a hub lacks form
    buckets of their own. In those, some members lead, the others are compared with the leaders
    outside their component, and leaders then leave; a bucket of one component is done, the rest go
    on with four times as many leaders. A pair is compared only if it could be linked with the
    bucket's shingle as the first that both have and the hub lacks: of any two, one bucket is that.

    Null or blank texts have n_shingles 0 and are linked with nothing. Rows with a null doc_id are
    linked with nothing and kept, with a null component_id. Repeated doc_ids count as one vertex.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = only(docs, doc_id=doc_id, text=text)
    signed = docs.mapInArrow(_sign(bands, rows, size), "doc_id long, n_shingles long, mark1 long, mark2 long, keys array<long>")
    signed = stored(signed)
    mark = ["mark1", "mark2", "n_shingles"]
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(linked.groupBy(*mark).agg(F.min("doc_id").alias("rep")))
    reps = linked.join(classes.select(F.col("rep").alias("doc_id"), *mark), ["doc_id", *mark], "left_semi")
    spread = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key")).distinct()
    full = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = stored(spread.join(full, "key"))
    texts = docs.where("doc_id is not null").join(bucket.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = stored(texts.groupBy("doc_id").agg(F.max("text").alias("text")))

    # Every bucket's hub meets its members.
    mass = bucket.groupBy("rep").agg(F.sum("size").alias("mass"))
    hubs = bucket.join(mass, "rep").groupBy("key").agg(F.max(F.struct("mass", (-F.col("rep")).alias("r"))).alias("hub"))
    star = bucket.join(hubs, "key").select((-F.col("hub.r")).alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    star = stored(star)
    crowd = star.groupBy("a").agg((F.count("*") > 1).alias("crowded"))
    met = _verified(star.join(crowd, "a"), texts, percent, size)
    edges = met.where("linked").select("a", "b")
    root = stored(components(edges))

    # What can still be linked: members that share what their hub lacks, or small ones.
    # beyond: how many of its shingles that the hub lacks are not before this one.
    beside = met.select("a", F.col("b").alias("rep"), "n", "shared", "linked", F.posexplode("rest").alias("place", "s"))
    beside = beside.select(F.xxhash64("a", "s").alias("key"), "rep", "n", "shared", (F.col("n") - F.col("shared") - F.col("place")).alias("beyond"), "linked")
    some = beside.groupBy("key").agg(F.count("*").alias("size"), F.bool_and("linked").alias("done")).where("size > 1 and not done")
    member = ["key", "rep", "n", "shared", "beyond"]
    bucket = stored(beside.join(some, "key").select(*member))
    far = met.where("not linked and rest is not null").select("a", F.col("b").alias("x"), F.floor((100 + percent) * F.col("shared") / percent - F.col("n")).alias("most"), F.ceil(percent * F.col("n") / 100).alias("least"))
    small = met.select("a", F.col("b").alias("y"), F.col("n").alias("ny")).join(far.where("most >= least"), "a").where("x <> y and ny <= most and ny >= least")
    extra = small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    leaders = 1
    while True:
        named = root.withColumnRenamed("node", "rep")
        now = bucket.join(named, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        state = now.groupBy("key").agg(F.count("*").alias("left"), F.min("rep").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
        now = now.join(state.where("low <> high"), "key")
        lead = (F.col("rep") == F.col("least")) | (F.pmod(F.xxhash64("rep", F.lit(leaders)), F.col("left")) < leaders - 1)
        now = stored(now.select(*member, "root", lead.alias("leads")))
        led = now.where("leads").select("key", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("sx"), F.col("beyond").alias("ox"), F.col("root").alias("rx"))
        most = "least(shared, sx) + least(beyond, ox)"  # that two can share, if this is their first
        pairs = now.join(led, "key").where(f"root <> rx AND {100 + percent} * ({most}) >= {percent} * (n + nx)").select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()
        if leaders == 1:
            pairs = pairs.union(extra).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty() and now.isEmpty():
            break
        tested = tested.union(pairs)
        found = _verified(pairs.withColumn("crowded", F.lit(False)), texts, percent, size).where("linked").select("a", "b")
        if not found.isEmpty():
            edges = edges.union(found)
            root = stored(components(edges))
        bucket = now.where("not leads").select(*member)
        leaders *= 4
    classes = classes.join(root.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*mark, F.coalesce("root", "rep").alias("component_id"))
    out = signed.select("doc_id", *mark).join(classes, mark, "left")
    own = F.coalesce("component_id", "doc_id")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(docs: DataFrame, percent: int = 80, bands: int = 31, rows: int = 4) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns: one per component.

    Of rows that repeat a doc_id one stays if that id is kept; rows without doc_id stay.
    """
    kept = near_duplicates(docs, percent, bands, rows).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))

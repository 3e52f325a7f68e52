"""Repeated passages: a sparse suffix array, sorted in range partitions by sampled splitters.

Every byte string of ``span`` bytes holds one anchor, the place whose ``gram`` bytes have the
smallest hash among all such places in the string. Equal strings have equal anchors at the same
place inside, so it is enough to sort the suffixes that begin at anchors, about one in 35. The
strings that share one anchor form a stretch; stretches are sorted by the bytes their suffix leads
with, then by hashes of the anchor and of the stretch.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.llm.arrays import mix, prefix_sums, slices, span_hashes, text_run
from velobus.llm.shared import checkpointed, only, partitions

PIECE = 1 << 19  # bytes worked on at a time: a dozen arrays of eight bytes for each of them
ROWS = 2_000  # stretches taken apart at a time, each into some seventy strings
PLACE = np.uint64((1 << 24) - 1)  # low bits of a hash that make room for a place in a piece


def stretches(run: np.ndarray, starts: np.ndarray, span: int, gram: int):
    """Head, anchor hash, body hash, text number, first string and number of strings of each stretch.

    Texts longer than a piece are cut, and so may stretches be; strings are not.
    """
    out = []
    for first, last in slices(starts, PIECE):
        for begin in range(int(starts[first]), int(starts[last]), PIECE):
            end = min(int(starts[last]), begin + PIECE + span - 1) if last == first + 1 else int(starts[last])
            if end - begin >= span:
                own = np.clip(starts[first : last + 1], begin, end) - begin
                out.append((*_piece(run[begin:end], own, span, gram), first, begin - starts))
    if not out:
        return [np.zeros(0, k) for k in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    columns = [[] for _ in range(6)]
    for head, lead, body, text, begin, count, first, shift in out:
        text = text + first
        for c, x in zip(columns, (head, lead, body, text, begin + shift[text], count), strict=True):
            c.append(x)
    return [np.concatenate(c) for c in columns]


def _piece(run: np.ndarray, starts: np.ndarray, span: int, gram: int):
    sums, inverse = prefix_sums(run)
    n = len(run) - span + 1
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(run) - gram + 1], 7)
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, have = span - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: n], least[width - have : width - have + n])
    anchor = (least[:n] & PLACE).astype(np.int64)
    edge = np.zeros(len(run) + 1, np.int32)  # strings that would cross the end of a text
    low, high = np.maximum(starts[:-1], starts[1:] - span + 1), starts[1:]
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    whole = np.cumsum(edge)[:n] == 0
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(change & whole)
    stop = np.ones(n, bool)
    stop[:-1] = (anchor[1:] != anchor[:-1]) | ~whole[1:]
    end = np.flatnonzero(stop & whole)
    at = anchor[begin]
    head = np.zeros(len(at), np.uint64)
    for j in range(8):
        head = (head << np.uint64(8)) | run[at + j].astype(np.uint64)
    body = mix(span_hashes(sums, inverse, begin, end + span) + (end - begin).astype(np.uint64), 3)
    return head, grams[at], body, np.searchsorted(starts, begin, side="right") - 1, begin, end - begin + 1


def _fresh(held: tuple | None, *columns: np.ndarray) -> np.ndarray:
    """Rows of sorted columns that differ from the row before; repeated table rows give none."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = held is None or any(h != c[0] for h, c in zip(held, columns, strict=True)) if len(out) else False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _suffixes(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            data, starts = text_run(batch.column("text"))
            for first, last in slices(starts, 8 * PIECE):
                head, lead, body, text, begin, count = stretches(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first], span, gram)
                # What repeats within these texts is settled here; only firsts of a kind go on.
                doc = ids[first + text]
                order = np.lexsort((begin, doc, body, lead))
                head, lead, body, doc, begin, count = (c[order] for c in (head, lead, body, doc, begin, count))
                again = np.zeros(len(order), bool)
                again[1:] = (lead[1:] == lead[:-1]) & (body[1:] == body[:-1])
                fresh = _fresh(None, lead, body, doc, begin)
                head, lead, body, doc, begin, count, again = (c[fresh] for c in (head, lead, body, doc, begin, count, again))
                head, lead = np.where(again, mix(doc.view(np.uint64)), head), np.where(again, mix(body), lead)
                columns = [pa.array(c.view(np.int64)) for c in (head, lead, body)] + [pa.array(doc), pa.array(begin), pa.array(count.astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "lead", "body", "doc_id", "begin", "count", "again"])

    return run


def _repeats(span: int):
    """Over sorted suffixes: the stretches seen before, and those whose anchor has other bodies.

    An anchor's run may begin in the partition before or go on in the next. Equal bodies never are
    in two partitions, but whether the run has several bodies can't be told at its rim: there it
    counts as having them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last lead and body, the lead's number of bodies, its stretch if it has but one
        before = None
        for batch in batches:
            keep = ~np.array(batch.column("again").to_numpy(zero_copy_only=False), bool)
            lead, body, doc, begin, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "body", "doc_id", "begin", "count"))
            yield _spans(lead[~keep], doc[~keep], begin[~keep], count[~keep], np.ones((~keep).sum(), bool))
            lead, body, doc, begin, count = (c[keep] for c in (lead, body, doc, begin, count))
            fresh = _fresh(before, lead, body, doc, begin)
            lead, body, doc, begin, count = (c[fresh] for c in (lead, body, doc, begin, count))
            if not len(lead):
                continue
            before = (lead[-1], body[-1], doc[-1], begin[-1])
            new = np.ones(len(lead), bool)
            new[1:] = lead[1:] != lead[:-1]
            new[0] = held is None or held[0] != lead[0]
            other = new.copy()
            other[1:] |= body[1:] != body[:-1]
            other[0] |= held is not None and held[1] != body[0]
            group = np.cumsum(new)  # 0: the lead held
            bodies = np.bincount(group[other], minlength=group[-1] + 1)
            if held is None:
                bodies[1] = 2  # the rim
            else:
                bodies[0] += held[2]
                if bodies[0] > 1 and held[3] is not None:
                    yield _spans(*held[3], np.zeros(1, bool))
            final = group == group[-1]
            alone = bodies[group[-1]] == 1
            only_one = held[3] if held is not None and group[-1] == 0 else None
            if alone and (final & other).any():
                k = int(np.flatnonzero(final & other)[0])
                only_one = tuple(c[k : k + 1] for c in (lead, doc, begin, count))
            held = (lead[-1], body[-1], int(bodies[group[-1]]), only_one if alone else None)
            chosen = ~other | (bodies[group] > 1)
            yield _spans(lead[chosen], doc[chosen], begin[chosen], count[chosen], ~other[chosen])
        if held is not None and held[3] is not None:
            yield _spans(*held[3], np.zeros(1, bool))

    def _spans(lead, doc, begin, count, repeated):
        columns = [pa.array(lead), pa.array(doc), pa.array(begin), pa.array(begin + count + span - 1), pa.array(repeated)]
        return pa.RecordBatch.from_arrays(columns, names=["lead", "doc_id", "begin", "end", "repeated"])

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches in question."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        data, starts = text_run(batch.column("text"))
        rows: list[tuple] = []
        for k, parts in enumerate(batch.column("parts").to_pylist()):
            low, high = int(starts[k]), int(starts[k + 1])
            for part in parts:
                rows.append((part["lead"], ids[k], part["begin"], data[low + part["begin"] : min(high, low + part["end"])].tobytes()))
            if len(rows) > 20_000:
                yield _body_rows(rows)
                rows = []
        yield _body_rows(rows)


def _body_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(4)], names=["lead", "doc_id", "begin", "body"])


def _strings(table: pa.Table, span: int) -> tuple[np.ndarray, ...]:
    """Row, place in the document and hash of every string of the rows' bodies."""
    run, starts = text_run(table.column("body"))
    sums, inverse = prefix_sums(run)
    count = np.maximum(np.diff(starts) - span + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[row] + offset
    return row, table.column("begin").to_numpy()[row] + offset, span_hashes(sums, inverse, at, at + span)


def _matched(span: int, limit: int):
    """Over stretches sorted by anchor: the strings that an earlier stretch of the same anchor has.

    Anchors with more than ``limit`` stretches pass their strings on by hash, to be sorted by
    themselves: no anchor is ever held whole.
    """

    def settle(table: pa.Table) -> pa.RecordBatch:
        row, place, key = _strings(table, span)
        lead, doc = (table.column(c).to_numpy()[row] for c in ("lead", "doc_id"))
        order = np.lexsort((np.arange(len(row)), key, lead))
        new = np.ones(len(order), bool)
        new[1:] = (lead[order][1:] != lead[order][:-1]) | (key[order][1:] != key[order][:-1])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = np.zeros(len(row), bool)
        again[order] = (doc[order] != doc[first]) | (place[order] != place[first])
        row, place, doc = row[again], place[again], doc[again]
        cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
        end = np.append(cut[1:], len(row))[: len(cut)] - 1
        none = pa.nulls(len(cut), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(doc[cut]), pa.array(place[cut]), pa.array(place[end] + span)], names=["lead", "body", "doc_id", "begin", "end"])

    def passed(table: pa.Table) -> pa.RecordBatch:
        row, place, key = _strings(table, span)
        lead, doc = (table.column(c).to_numpy()[row] for c in ("lead", "doc_id"))
        return pa.RecordBatch.from_arrays([pa.array(lead), pa.array(key.view(np.int64)), pa.array(doc), pa.array(place), pa.array(place + span)], names=["lead", "body", "doc_id", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            lead = table.column("lead").to_numpy()
            if large is not None:  # the rest of an anchor that has begun to pass on
                more = int(np.searchsorted(lead, large, side="right"))
                if more:
                    yield passed(table.slice(0, more).combine_chunks())
                table, lead = table.slice(more).combine_chunks(), lead[more:]
                held = None
                if not len(lead):
                    continue
                large = None
            last = int(np.searchsorted(lead, lead[-1]))
            if last:
                yield settle(table.slice(0, last).combine_chunks())
            held = table.slice(last).combine_chunks()
            if held.num_rows > limit:
                yield passed(held)
                held, large = None, lead[-1]
        if held is not None and held.num_rows:
            yield settle(held)

    return run


def _seen(span: int):
    """Over sorted strings: those that are equal to the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = before = None
        for batch in batches:
            lead, body, doc, begin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "body", "doc_id", "begin"))
            fresh = _fresh(before, lead, body, doc, begin)
            lead, body, doc, begin = (c[fresh] for c in (lead, body, doc, begin))
            if not len(lead):
                continue
            before = (lead[-1], body[-1], doc[-1], begin[-1])
            same = np.zeros(len(lead), bool)
            same[1:] = (lead[1:] == lead[:-1]) & (body[1:] == body[:-1])
            same[0] = held == (lead[0], body[0])
            held = (lead[-1], body[-1])
            doc, begin = doc[same], begin[same]
            if not len(doc):
                continue
            # Strings of one document that follow each other come as one span.
            order = np.lexsort((begin, doc))
            doc, begin = doc[order], begin[order]
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + span)]))
            end = np.append(cut[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(begin[cut]), pa.array(begin[end] + span)], names=["doc_id", "begin", "end"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_run(batch.column("text"))
        rows = [[], [], [], []]
        for k, parts in enumerate(batch.column("parts").to_pylist()):
            text = data[starts[k] : starts[k + 1]]
            runs, removed = 0, 0
            digest = hashlib.sha256()
            reach = 0
            for part in sorted((p["begin"], p["end"]) for p in parts or []):
                low, high = part[0], min(part[1], len(text))
                if low >= high:
                    continue
                if low > reach or not runs:
                    digest.update(text[reach:low])
                    runs += 1
                    removed += high - low
                else:
                    removed += max(0, high - reach)
                reach = max(reach, high)
            digest.update(text[reach:])
            for r, x in zip(rows, (len(text), removed, runs, digest.hexdigest()), strict=True):
                r.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, span: int = 100, gram: int = 32, limit: int = 4_096) -> tuple[DataFrame, DataFrame]:
    """Byte spans (doc_id, begin, end) whose every string of ``span`` bytes occurs earlier, and the
    documents by doc_id as they were joined.

    Sampled splitters of Spark's range partitioning divide the suffixes, each partition sorts its
    own, and neighbours in the order are compared. A stretch equal to the one before is repeated as
    a whole. Stretches that share an anchor but not their bytes, where passages begin and end, are
    taken apart into their single strings: within the task that has the anchor's stretches, or if
    there are more than ``limit``, each string for itself, sorted and compared in the same way.
    """
    width = partitions(docs.sparkSession)
    known = docs.where("doc_id is not null")
    suffixes = known.mapInArrow(_suffixes(span, gram), "head long, lead long, body long, doc_id long, begin long, count int, again boolean")
    order = ["head", "lead", "body"]
    ranged = suffixes.repartitionByRange(width, *order).sortWithinPartitions(*order, "doc_id", "begin")
    found = checkpointed(ranged.mapInArrow(_repeats(span), "lead long, doc_id long, begin long, end long, repeated boolean"))
    by_id = known.repartition(width, "doc_id")
    doubtful = found.where("not repeated").groupBy("doc_id").agg(F.collect_list(F.struct("lead", "begin", "end")).alias("parts"))
    bodies = by_id.join(doubtful, "doc_id").select("doc_id", "text", "parts").mapInArrow(_bodies, "lead long, doc_id long, begin long, body binary")
    placed = bodies.repartition(width, "lead").sortWithinPartitions("lead", "doc_id", "begin")
    matched = placed.mapInArrow(_matched(span, limit), "lead long, body long, doc_id long, begin long, end long")
    strings = matched.where("body is not null").repartition(width, "lead", "body").sortWithinPartitions("lead", "body", "doc_id", "begin")
    single = strings.select("lead", "body", "doc_id", "begin").mapInArrow(_seen(span), "doc_id long, begin long, end long")
    spans = [f.select("doc_id", "begin", "end") for f in (found.where("repeated"), matched.where("body is null"), single)]
    return spans[0].union(spans[1]).union(spans[2]), by_id


def without_repeats(docs: DataFrame, span: int = 100, gram: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``.

    Texts are UTF-8 bytes (null: none). Every byte goes that lies in a string of ``span`` bytes
    which also starts earlier: in a smaller doc_id or before in the same document. n_spans counts
    the maximal runs removed, kept_sha256 is of the bytes left. Texts shorter than ``span`` stay.
    Rows without doc_id are compared with nothing. Equal rows get equal results; rows with the same
    doc_id but other texts count as one document, and lose what any of them loses. An empty table
    gives an empty result; other columns are ignored.
    """
    docs = only(docs, doc_id=doc_id, text=text)
    spans, by_id = repeated_spans(docs, span, gram)
    parts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("parts"))
    joined = by_id.join(parts, "doc_id", "left").select("doc_id", "text", "parts")
    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("parts"))
    return joined.union(rest).mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

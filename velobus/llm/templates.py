"""Benchmark decontamination by template windows: questions are found with other numbers or names."""

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velobus.llm.arrays import LOWER, PIECE, SEPARATOR, mix, prefix_sums, slices, span_hashes, text_run
from velobus.llm.shared import only

# Words taken as units of measure.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet mg g kg lb lbs "
    "oz gram grams kilogram kilograms pound pounds ml l liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes hour hours day days week weeks month months year years usd eur "
    "dollar dollars euro euros cent cents percent kmh mph degrees"
).split()

DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
CORE = DIGIT | (np.arange(256) >= 128)  # what belongs to a word when its rim is cut off
CORE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?:;")] = True
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3


def _hash_of(words: list[str]) -> np.ndarray:
    run, starts = text_run(pa.array(words))
    return np.sort(span_hashes(*prefix_sums(run), starts[:-1], starts[1:]))


def tokens(run: np.ndarray, starts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, kind and text number of every word of a run of texts, without its punctuation, and
    whether it may be a name or not: a capitalised word that begins a sentence, kept as plain.

    A number begins with a digit and has at most three letters after it; a name is a capitalised
    word that begins no sentence; a unit is in the list. Words without a letter or digit are none.
    """
    inside = ~SEPARATOR[run]
    edge = np.zeros(len(run) + 1, bool)
    edge[starts] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    core = CORE[run]
    places = np.flatnonzero(core)
    low, high = np.searchsorted(places, begin), np.searchsorted(places, end) - 1
    real = high >= low
    owner = np.searchsorted(starts, begin, side="right") - 1
    opens = np.ones(len(begin), bool)  # no word before, or one that ends a sentence
    opens[1:] = (owner[1:] != owner[:-1]) | STOP[run[end[:-1] - 1]]
    begin, end, owner, opens = places[low[real]], places[high[real]] + 1, owner[real], opens[real]
    value = span_hashes(*prefix_sums(LOWER[run]), begin, end)
    capitals = np.concatenate([np.zeros(1, np.int64), np.cumsum(UPPER[run])])
    digits = np.concatenate([np.zeros(1, np.int64), np.cumsum(DIGIT[run])])
    cores = np.concatenate([np.zeros(1, np.int64), np.cumsum(core)])
    letters = cores[end] - cores[begin] - digits[end] + digits[begin]
    kind = np.zeros(len(begin), np.int8)
    capital = UPPER[run[begin]] & (capitals[end] - capitals[begin] == 1)
    kind[capital & ~opens] = NAME
    kind[np.isin(value, units)] = UNIT
    kind[DIGIT[run[begin]] & (letters <= 3)] = NUMBER
    return value, kind, owner, capital & opens & (kind == PLAIN)


def windows(value: np.ndarray, kind: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on, slots by their kind; 0 where a text ends."""
    canonical = np.where(kind == PLAIN, value, mix(kind.astype(np.uint64), 77))
    n = max(0, len(value) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = mix(total + canonical[j : j + n], j + 1)
    total[owner[:n] != owner[size - 1 : size - 1 + n]] = 0
    return np.concatenate([total, np.zeros(len(value) - n, np.uint64)])


def loosened(value: np.ndarray, kind: np.ndarray, owner: np.ndarray, loose: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the windows in which one or more ``loose`` words are read as names, in
    every choice of these words."""
    canonical = np.where(kind == PLAIN, value, mix(kind.astype(np.uint64), 77))
    name = mix(np.array([NAME], np.uint64), 77)
    n = max(0, len(value) - size + 1)
    bits = np.zeros(n, np.int64)
    for j in range(size):
        bits |= loose[j : j + n].astype(np.int64) << j
    bits[owner[:n] != owner[size - 1 : size - 1 + n]] = 0
    place = np.flatnonzero(bits)
    bits = bits[place]
    masks = set()
    for code in np.unique(bits).tolist():
        mask = code
        while mask:
            masks.add(mask)
            mask = (mask - 1) & code
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask in sorted(masks):
        own = place[bits & mask == mask]
        total = np.zeros(len(own), np.uint64)
        for j in range(size):
            total = mix(total + (name if mask >> j & 1 else canonical[own + j]), j + 1)
        hashes.append(total)
        places.append(own)
    return np.concatenate(hashes), np.concatenate(places)


class Block:
    """The template windows of a bounded number of benchmark items, sorted for lookup."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        self.ids, self.size, self.units = ids, size, _hash_of(UNITS)
        run, starts = text_run(pa.array(texts, pa.string()))
        self.value, self.kind, owner, loose = tokens(run, starts, self.units)
        keys = windows(self.value, self.kind, owner, size)
        place = np.flatnonzero(keys)
        # A word that begins a sentence may be a name, and so may an item's first word, which reads
        # as one if it stands inside a sentence of a document.
        loose[:1] = True
        loose[1:] |= owner[1:] != owner[:-1]
        named, again = loosened(self.value, self.kind, owner, loose, size)
        all_keys, all_places = np.concatenate([keys[place], named]), np.concatenate([place, again])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.place = all_keys[order], all_places[order]
        self.item = owner
        self.total = np.bincount(owner[place], minlength=len(ids))

    def find(self, column: pa.Array, share: float) -> Iterator[tuple[int, int, float, bool]]:
        """(text, item, share of the item's windows found, whether slots changed)."""
        run, starts = text_run(column)
        for first, last in slices(starts, PIECE):
            own = starts[first : last + 1] - starts[first]
            value, kind, owner, loose = tokens(run[starts[first] : starts[last]], own, self.units)
            keys = windows(value, kind, owner, self.size)
            named, again = loosened(value, kind, owner, loose, self.size)
            whole = np.flatnonzero(keys)
            keys, places = np.concatenate([keys[whole], named]), np.concatenate([whole, again])
            low = np.searchsorted(self.keys, keys, side="left")
            known = np.flatnonzero(low < len(self.keys))
            hit = known[self.keys[low[known]] == keys[known]]
            count = np.searchsorted(self.keys, keys[hit], side="right") - low[hit]
            skip = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            here = self.place[np.repeat(low[hit], count) + skip]
            # Two windows may match in several readings.
            both = np.unique(np.repeat(places[hit], count) * max(len(self.value), 1) + here)
            there, here = both // max(len(self.value), 1), both % max(len(self.value), 1)
            # Distinct windows of an item that a text has, before slots are looked at.
            pair = owner[there] * len(self.ids) + self.item[here]
            order = np.argsort(pair, kind="stable")
            pairs, begins = np.unique(pair[order], return_index=True)
            for both, chosen in zip(pairs, np.split(order, begins[1:]), strict=bool(len(pairs))):
                item = int(both) % len(self.ids)
                least = share * self.total[item]
                if len(np.unique(here[chosen])) >= least:
                    found, changed = self._best(there[chosen], here[chosen], value, kind)
                    if found >= least:
                        yield first + int(both) // len(self.ids), item, found / self.total[item], changed

    def _best(self, there: np.ndarray, here: np.ndarray, value: np.ndarray, kind: np.ndarray) -> tuple[int, bool]:
        """_consistent() of the occurrence that gives most of the item, an unchanged one first.

        An occurrence is a run of windows whose places in text and item are about equally far apart,
        so that several variants of an item in one text are judged each for itself. All windows of
        the text together count too, as an occurrence may have been pulled apart.
        """
        item = self.item[here[0]]
        words = np.searchsorted(self.item, item, side="right") - np.searchsorted(self.item, item)
        # Stretches of half an item, each overlapping the next by half: a run that is drawn out by
        # less than a quarter of the item lies in one, and the next variant does not.
        step = (there - here) // max(1, words // 4)
        order = np.argsort(step, kind="stable")
        sorted_steps = step[order]
        firsts = np.unique(np.concatenate([sorted_steps - 1, sorted_steps]))
        low, high = np.searchsorted(sorted_steps, firsts), np.searchsorted(sorted_steps, firsts + 1, side="right")
        best = self._consistent(there, here, value, kind)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if best == (self.total[item], False):
                break
            own = order[a:b]
            if len(np.unique(here[own])) >= best[0]:
                best = max(best, self._consistent(there[own], here[own], value, kind), key=lambda x: (x[0], not x[1]))
        return best

    def _consistent(self, there: np.ndarray, here: np.ndarray, value: np.ndarray, kind: np.ndarray) -> tuple[int, bool]:
        """How many of the item's windows agree on what stands for each slot value, and whether any
        slot differs from the item's. A value's stand-in is the one that most windows give it."""
        votes: dict[int, Counter] = defaultdict(Counter)
        bound = []
        for t, h in zip(there.tolist(), here.tolist(), strict=True):
            # Plain words that differ have matched as names.
            slots = [
                (int(self.value[h + j]), int(value[t + j]))
                for j in range(self.size)
                if kind[t + j] != PLAIN or self.kind[h + j] != PLAIN or self.value[h + j] != value[t + j]
            ]
            bound.append((h, slots))
            for mine, other in slots:
                votes[mine][other] += 1
        stands = {mine: max(c.items(), key=lambda x: (x[1], x[0] == mine, x[0]))[0] for mine, c in votes.items()}
        good = {h for h, slots in bound if all(stands[mine] == other for mine, other in slots)}
        return len(good), any(mine != other for mine, other in stands.items())


def blocks(benchmark: DataFrame, size: int, limit: int, item_id: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of at most about ``limit`` characters, one at a time on the driver."""
    items = only(benchmark, item_id=item_id, text=text).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // limit)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = part.dropDuplicates().orderBy("item_id", "text").collect()
        if rows:
            yield Block([r.item_id for r in rows], [r.text for r in rows], size)


def _pairs(block: Block, share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(block.find(batch.column("text"), share))
            ids = batch.column("doc_id")
            rows = [[ids[t].as_py() for t, *_ in found], [block.ids[i] for _, i, *_ in found], [float(s) for *_, s, _ in found], [bool(c) for *_, c in found]]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc_id", "item_id", "share", "reparameterised"])

    return run


def _leaks(block: Block, share: float) -> Callable:
    def run(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        out[[t for t, *_ in block.find(column, share)]] = True
        return pa.array(out)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, limit: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, share, reparameterised): the benchmark items each document gives away.

    Numbers, units and names of both sides become typed placeholders. A capitalised word that begins
    a sentence counts both as itself and as a name, on both sides. An item is given away if at
    least ``share`` of its windows of ``size`` words are in the text and agree on what stands for
    each number, unit and name, in one place or over the whole text; reparameterised says that some
    stand-in differs from the item's own in the place that gives most of the item.
    The benchmark is taken in blocks of ``limit`` characters, which bounds what tasks receive; each
    block meets all documents, so no join on windows leaves a task and no window is left out.

    Items with fewer than ``size`` words match nothing, nor do null and blank texts. Repeated rows
    of documents give repeated results, copies of an item under other ids one row each. An empty
    table on either side gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, share double, reparameterised boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, size, limit):
        out = out.union(docs.mapInArrow(_pairs(block, share), schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, limit: int = 8_000_000) -> DataFrame:
    """The documents that give no benchmark item away, with all their columns; nothing is shuffled."""
    for block in blocks(benchmark, size, limit):
        docs = docs.where(~F.arrow_udf(_leaks(block, share), T.BooleanType())(F.col("text")))
    return docs

"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velobus.llm.arrays import PIECE, SEPARATOR, slices, text_run
from velobus.llm.shared import only

PROBES = 1 << 20  # places compared at a time
LONGEST = 256  # words in the longest gram that is numbered


def word_spans(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a run of bytes begin and end."""
    inside = np.concatenate([[False], ~SEPARATOR[run], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def numbered(run: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words and no others."""
    offsets = np.stack([begin, end], axis=1).ravel()
    if not len(offsets):
        return np.zeros(0, np.int64)
    # Words and what lies between them take turns; every second is a word.
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(run))]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)
    words = pieces.take(pa.array(np.arange(0, len(offsets) - 1, 2)))
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def needed(length: int, shortest: int) -> int:
    """How often a word must occur in a segment of so many words to be part of a qualifying run.

    A run of period q and length n holds each of its words at least n // q times, and n is at least
    max(shortest, 2 * q).
    """
    half = length // 2
    return min((max(shortest, 2 * q) // q for q in range(1, min(half, shortest) + 1)), default=0)


def segments(word: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of words that may hold a run, after splitting to stability.

    A segment is split at every word that occurs too rarely within it; pieces of fewer than
    ``shortest`` words go. All texts are split at once, round by round, until nothing changes.
    """
    n = len(word)
    place = np.arange(n)
    segment = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])]) if n else np.zeros(0, np.int64)
    word = word.copy()
    while len(place):
        size = np.bincount(segment)
        lengths, which = np.unique(size, return_inverse=True)
        need = np.array([needed(int(x), shortest) if x >= shortest else x + 1 for x in lengths])[which]
        order = np.lexsort((word, segment))
        s, w = segment[order], word[order]
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])])
        group = np.cumsum(first) - 1
        count = np.empty(len(place), np.int64)
        count[order] = np.bincount(group)[group]
        keep = count >= need[segment]
        if keep.all():
            break
        # Neighbours stay together if they were and no word between them has gone.
        place, word, old = place[keep], word[keep], segment[keep]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (old[1:] != old[:-1])
        segment = np.cumsum(new) - 1
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(segment[1:] != segment[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(place)]]) - 1
    return place[first], place[last] + 1


def _grams(word: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words, up to LONGEST or half of all: numbers, equal where the grams are."""
    out, size = [np.unique(word, return_inverse=True)[1]], 1
    while 2 * size <= min(LONGEST, max(1, len(word) // 2)):
        a, b = out[-1][:-size], out[-1][size:]
        out.append(np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1])
        size *= 2
    return out


def _reach(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and from b on (step 1), or before them (step -1), are the same; a < b."""
    n = len(grams[0])
    reach = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for level in range(len(grams) - 1, -1, -1):
        gram, size = grams[level], 1 << level
        while len(active):
            x, y = a[active] + step * reach[active], b[active] + step * reach[active]
            if step < 0:
                x, y = x - size, y - size
            fits = (x >= 0) & (y + size <= n)
            same = np.zeros(len(active), bool)
            same[fits] = gram[x[fits]] == gram[y[fits]]
            reach[active[same]] += size
            if level < len(grams) - 1:
                break  # a shorter gram fits once at most
            active = active[same]
        active = np.arange(len(a))
    return reach


def scanned(word: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every qualifying run of one segment, by start and period.

    A run of period q is a stretch of at least s = max(shortest - q, q) places that equal the place
    q further on. A gram of g words is compared with the one q further on at every (s - g + 1)-th
    place, which no such stretch escapes; what agrees is followed to both sides. All lags together
    are n log n comparisons, not n * n.
    """
    n = len(word)
    grams = _grams(word)
    found: dict[tuple[int, int], int] = {}
    long: list[tuple[int, int, int]] = []  # runs with their periods, for skipping multiples
    lag, pending = 1, []

    def settle():
        place = np.concatenate([p for p, _ in pending])
        by = np.concatenate([np.full(len(p), q) for p, q in pending])
        pending.clear()
        right = _reach(grams, place, place + by, 1)
        left = _reach(grams, place, place + by, -1)
        length = right + left + by
        good = length >= np.maximum(shortest, 2 * by)
        for start, size, q in np.unique(np.stack([(place - left)[good], length[good], by[good]], axis=1), axis=0).tolist():
            # The same stretch with a shorter lag: q is a multiple of its period.
            if q < found.get((start, size), n):
                if (start, size) not in found:
                    long.append((start, size, q))
                found[start, size] = q

    waiting = 0
    while 2 * lag <= n and max(shortest, 2 * lag) <= n:
        stretch = max(shortest - lag, lag)
        level = min(len(grams) - 1, max(0, (stretch // 2).bit_length() - 1))
        size = 1 << level
        place = np.arange(0, n - lag - size + 1, stretch - size + 1)
        agree = place[grams[level][place] == grams[level][place + lag]]
        for start, length, q in long:
            if len(agree) and lag > q and lag % q == 0 and length >= lag + q:
                agree = agree[(agree < start) | (agree + lag >= start + length)]
        if len(agree):
            pending.append((agree, lag))
            waiting += len(agree)
        # Short lags are settled at once: their runs spare the multiples a comparison.
        if pending and (waiting >= PROBES or lag <= 2 * shortest or 2 * (lag + 1) > n):
            settle()
            waiting = 0
        lag += 1
    if pending:
        settle()
    return sorted((start, size, q) for (start, size), q in found.items())


def runs_of_words(word: np.ndarray, owner: np.ndarray, n_texts: int, shortest: int = 12) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, length, period) of its maximal runs, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    first = np.searchsorted(owner, np.arange(n_texts))
    for begin, end in zip(*segments(word, owner, shortest), strict=True):
        text = int(owner[begin])
        shift = int(begin - first[text])
        found[text] += [(shift + start, size, q) for start, size, q in scanned(word[begin:end], shortest)]
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, size, q in runs:
        change[start + q] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) == 0


def _collapsed(run: np.ndarray, begin: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words joined by one space."""
    begin, end = begin[keep], end[keep]
    size = end - begin + 1
    if not len(size):
        return b""
    target = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(target[-1]) + np.repeat(begin - target[:-1], size)
    out = run[np.minimum(source, len(run) - 1)].copy()
    out[target[1:] - 1] = 0x20
    return out[:-1].tobytes()


def without_periods(frame: DataFrame, shortest: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs of words, and its text without their
    repetitions.

    Words are runs of anything but the six ASCII white spaces, as they are written, numbered from 0.
    A run is a stretch of consecutive words of smallest period q (words q apart are the same) and
    at least max(``shortest``, 2 * q) words that can't be made longer to either side; runs may
    overlap. ``runs`` lists (start, length, period) by start and period. ``collapsed`` is the text
    without the words that any run holds after its first period, joined by one space.

    Texts without words, null ones included, have no runs and an empty collapsed text. Texts of any
    length are worked on whole, in memory that grows with the longest single text only. Rows that
    repeat an id are rows like any other, a null id stays null; an empty table gives an empty
    result, and other columns are ignored.
    """
    if shortest < 2:
        raise ValueError("shortest must be 2 or more")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, starts = text_run(batch.column("text"))
            for first, last in slices(starts, 4 * PIECE):
                own = run[starts[first] : starts[last]]
                edges = starts[first : last + 1] - starts[first]
                begin, end = _spans_by_text(own, edges)
                owner = np.searchsorted(edges, begin, side="right") - 1
                bounds = np.searchsorted(owner, np.arange(last - first + 1))
                found = runs_of_words(numbered(own, begin, end), owner, last - first, shortest)
                counts, texts = [], []
                for k, runs in enumerate(found):
                    a, b = bounds[k], bounds[k + 1]
                    counts.append(int(b - a))
                    texts.append(_collapsed(own, begin[a:b], end[a:b], kept_words(b - a, runs)))
                shapes = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                columns = [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(counts, pa.int64()),
                    pa.array(shapes, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    given = only(frame, doc_id=doc_id, text=text)
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(detect, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _spans_by_text(run: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_spans(), but no word runs over the end of a text."""
    begin, end = word_spans(run)
    owner = np.searchsorted(edges, begin, side="right") - 1
    over = end > edges[owner + 1]
    if not over.any():
        return begin, end
    inner = [e for b, e in zip(begin[over], end[over], strict=True) for e in np.unique(edges[np.searchsorted(edges, b, side="right") : np.searchsorted(edges, e)])]
    return np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))

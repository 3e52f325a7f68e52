"""Words and shingles of whole texts as numpy arrays, for code that runs inside tasks.

A batch of texts is one run of bytes. Words are hashed by prefix sums over that run, a few
megabytes at a time, so the memory in use depends neither on the number nor on the length of texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21  # bytes worked on at a time
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = values + np.uint64((seed * GOLDEN + GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_sums(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which span_hashes() reads the hash of any span of the run."""
    sums = np.zeros(len(run) + 1, np.uint64)
    np.cumsum((run.astype(np.uint64) + np.uint64(1)) * _powers(len(run), BASE), out=sums[1:])
    return sums, _powers(len(run) + 1, pow(BASE, -1, 1 << 64))


def span_hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, whatever its place."""
    return mix((sums[end] - sums[start]) * inverse[start], 7)


def text_run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after the other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most limit bytes, or one longer text alone."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _cut(run: np.ndarray, starts: np.ndarray, begin: int, separator: np.ndarray) -> int:
    """Where the next piece ends: after a separator or with a text, wherever words allow."""
    end = min(len(run), begin + PIECE)
    if end == len(run):
        return end
    text = int(starts[np.searchsorted(starts, end, side="right") - 1])
    if text > begin:
        return text
    while begin < end < len(run):
        found = np.flatnonzero(separator[run[begin:end]])
        if len(found):
            return begin + int(found[-1]) + 1
        end = min(len(run), end + PIECE)
    return end


def words(run: np.ndarray, starts: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first byte of every run without separators; A-Z count as a-z."""
    hashes, places = [], []
    begin = 0
    while begin < len(run):
        end = _cut(run, starts, begin, separator)
        piece = LOWER[run[begin:end]]
        inside = ~separator[piece]
        edge = np.zeros(len(piece) + 1, bool)
        edge[0] = edge[-1] = True
        own = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, end)] - begin
        edge[own] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        head = np.flatnonzero(first)
        hashes.append(span_hashes(*prefix_sums(piece), head, np.flatnonzero(last) + 1))
        places.append(head + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(starts, place, side="right") - 1, place


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all runs of ``size`` words.

    A text with fewer words gives one shingle, its whole sequence; one without words gives none.
    The result is ordered by text and may repeat a shingle.
    """
    weights = _powers(1 << 6, 0xD1342543DE82EF95)
    count = np.bincount(owner, minlength=n_texts)
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * weights[j + 1]
    whole = owner[:n] == owner[size - 1 : size - 1 + n]
    found, of = mix(total[whole], size), owner[:n][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return found, of
    first = np.searchsorted(owner, short)
    total = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = count[short] > j
        total[has] += hashes[first[has] + j] * weights[j + 1]
    alone = mix(total + count[short].astype(np.uint64), size + 1)
    order = np.argsort(np.concatenate([of, short]), kind="stable")
    return np.concatenate([found, alone])[order], np.concatenate([of, short])[order]


def shingle_sets(column: pa.Array, size: int = 5, limit: int = 4 * PIECE):
    """For each run of texts of a batch: first and last text, distinct sorted shingles, their texts."""
    run, starts = text_run(column)
    for first, last in slices(starts, limit):
        own = starts[first : last + 1] - starts[first]
        hashes, owner, _ = words(run[starts[first] : starts[last]], own)
        found, of = shingles(hashes, owner, last - first, size)
        bounds = np.searchsorted(of, np.arange(last - first + 1))
        sets = [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.array([len(s) for s in sets])
        joined = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        yield first, last, joined, np.repeat(np.arange(last - first), sizes), sizes

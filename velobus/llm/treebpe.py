"""Encoding by byte pairs, with long unsplit text encoded in halves that are joined exactly."""

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from velobus.llm.arrays import PIECE
from velobus.llm.shared import only

LEAF = 32  # symbols encoded in one go; longer words are halved
WINDOW = 4  # tokens on each side of a join that are encoded again at first
KNOWN = 400_000  # words a task remembers
NEVER = np.int32(2**31 - 1)
WHITE = regex.compile("[\t\n\x0b\x0c\r ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the
    others, in order, for the code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What tasks need of a tokenizer file: bounded by the vocabulary, never by the data.

    The file must describe words found by a pattern in NFC lower case text, their bytes as letters
    and merges with an end-of-word suffix; anything else is refused.
    """
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, steps = given["model"], given["pre_tokenizer"]["pretokenizers"]
    split = steps[0]
    shape = [n["type"] for n in given["normalizer"]["normalizers"]], [s["type"] for s in steps]
    if model["type"] != "BPE" or shape != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not split["invert"] or split["behavior"] != "Removed":
        raise ValueError("not a vocabulary of lower case words with byte pair merges")
    if given["decoder"] or given["post_processor"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
        raise ValueError("the vocabulary asks for a step that is not built")
    ids, suffix = dict(model["vocab"]), model["end_of_word_suffix"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([[ids[a], ids[b], ids[a + b]] for a, b in merges], np.int64)
    letters = byte_letters()
    added = {t["content"]: t["id"] for t in given["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in given["added_tokens"]):
        raise ValueError("added tokens must be taken from the text as they are")
    made = np.full(max(ids.values()) + 1, -1, np.int64)
    made[pairs[:, 2]] = np.arange(len(pairs))
    if (np.maximum(made[pairs[:, 0]], made[pairs[:, 1]]) >= np.arange(len(pairs))).any():
        raise ValueError("a merge comes before the merges that make its parts")
    return {
        "pattern": split["pattern"]["Regex"],
        "inner": [ids[c] for c in letters],
        "final": [ids[c + suffix] for c in letters],
        "pairs": pairs,
        "added": added,
        "tokens": {i: t for t, i in (ids | added).items()},
    }


class Merges:
    """The merges of a vocabulary, applied to many words at a time."""

    def __init__(self, vocabulary: dict):
        self.inner = np.array(vocabulary["inner"], np.int32)
        self.final = np.array(vocabulary["final"], np.int32)
        left, right, self.result = vocabulary["pairs"].T
        self.result = self.result.astype(np.int32)
        # An open hash table of the pairs: a few probes find the rank of any pair.
        self.bits = max(4, int(2 * len(left)).bit_length() + 1)
        key = (left << 32) | right
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NEVER, np.int32)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.key[slot[todo]] < 0]
            chosen, first = np.unique(slot[free], return_index=True)
            self.key[chosen], self.rank[chosen] = key[free[first]], free[first]
            todo = np.setdiff1d(todo, free[first], assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        spread = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return spread.astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER where there is none."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = np.where(self.key[slot] == key, self.rank[slot], NEVER)
        open_ = np.flatnonzero((found == NEVER) & (self.key[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            here = self.key[slot[open_]]
            hit = here == key[open_]
            found[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return found

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words given as symbols, one word after the other, and their numbers.

        Every round applies, in each word, the merge of lowest rank that occurs in it, at all places
        from the left: parts of a merge are made by earlier ones, so no round makes a pair that
        should have come before.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words = [], []
        symbol = symbols
        while len(symbol):
            rank = np.full(len(symbol), NEVER, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            ready = least == NEVER
            if ready.any():
                done_symbols.append(symbol[ready])
                done_words.append(word[ready])
                symbol, word, rank, least = symbol[~ready], word[~ready], rank[~ready], least[~ready]
            at = np.flatnonzero(rank == least) if len(symbol) else np.zeros(0, np.int64)
            # A pair of the same symbol overlaps itself: every second place counts, from the left.
            if len(at) > 1:
                linked = np.concatenate([[False], (at[1:] == at[:-1] + 1)])
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            if len(at):
                symbol = symbol.copy()
                symbol[at] = self.result[rank[at]]
                stay = np.ones(len(symbol), bool)
                stay[at + 1] = False
                symbol, word = symbol[stay], word[stay]
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(sizes))


def _cut(tokens: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Words to token ids, by a vocabulary's merges."""

    def __init__(self, vocabulary: dict, leaf: int = LEAF, window: int = WINDOW):
        self.merges, self.leaf, self.window = Merges(vocabulary), leaf, window
        # The symbols of every token, to encode a window of tokens again.
        self.parts: dict[int, tuple[int, ...]] = {i: (i,) for i in (*vocabulary["inner"], *vocabulary["final"])}
        for left, right, token in vocabulary["pairs"].tolist():
            self.parts[token] = self.parts[left] + self.parts[right]

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.merges.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.merges.final[data[last]]
        return symbols, sizes

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (not empty) word.

        A word of more than ``leaf`` symbols is halved until its pieces are no longer; all pieces of
        all words are encoded together, then neighbours are joined, level by level.
        """
        if not words:
            return []
        symbols, sizes = self._symbols(words)
        leaves = -(-sizes // self.leaf)
        owner = np.repeat(np.arange(len(words)), leaves)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(leaves) - leaves, leaves)) * self.leaf
        tokens, counts = self.merges.merged(symbols, np.minimum(self.leaf, sizes[owner] - begin))
        pieces = _cut(tokens, counts)
        if len(pieces) == len(words):
            return pieces
        out: list = [None] * len(words)
        row: dict[int, list[np.ndarray]] = {}
        for o, piece in zip(owner.tolist(), pieces, strict=True):
            if leaves[o] == 1:
                out[o] = piece
            else:
                row.setdefault(o, []).append(piece)
        while any(len(r) > 1 for r in row.values()):
            places = [(o, i) for o, r in row.items() for i in range(0, len(r) - 1, 2)]
            joined = iter(self.join([(row[o][i], row[o][i + 1]) for o, i in places]))
            row = {o: [next(joined) if i + 1 < len(r) else r[i] for i in range(0, len(r), 2)] for o, r in row.items()}
        for o, (whole,) in row.items():
            out[o] = whole
        return out

    def join(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of each left part followed by its right part, both encoded on their own.

        A window of tokens around the join is encoded again. If its first and last token come out
        as before (or the window reaches the end on that side), every two neighbouring tokens are
        what their own text encodes to; then the whole is, too, as the first merge across a border
        of two tokens would also be made in these two alone. Else the window is doubled.
        """
        out: list = [None] * len(sides)
        open_, width = list(range(len(sides))), self.window
        while open_:
            windows = [(sides[k][0][-width:], sides[k][1][:width]) for k in open_]
            symbols = [[p for t in np.concatenate(w).tolist() for p in self.parts[t]] for w in windows]
            sizes = np.array([len(s) for s in symbols], np.int64)
            tokens, counts = self.merges.merged(np.array([p for s in symbols for p in s], np.int32), sizes)
            rest = []
            for k, (left, right), new in zip(open_, windows, _cut(tokens, counts), strict=True):
                a, b = sides[k]
                if (len(left) == len(a) or new[0] == left[0]) and (len(right) == len(b) or new[-1] == right[-1]):
                    out[k] = np.concatenate([a[: len(a) - len(left)], new, b[len(right) :]])
                else:
                    rest.append(k)
            open_, width = rest, 2 * width
        return out


def _lower(text: str) -> str:
    """Lower case letter by letter: no letter's form depends on its neighbours."""
    return text.replace("Σ", "σ").lower()


def stretches(text: str, size: int = PIECE // 2) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each cut before white space, where neither
    words nor normal forms reach across; text without any stays in one part."""
    begin = 0
    while len(text) - begin > size:
        found = WHITE.search(text, begin + size)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


class Tokenizer:
    """Texts to ids and back; remembers a bounded number of words."""

    def __init__(self, vocabulary: dict, **options):
        self.encoder = Encoder(vocabulary, **options)
        self.found = regex.compile(vocabulary["pattern"]).findall
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary["added"].items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = vocabulary["tokens"]
        self.known: dict[str | tuple[str], bytes] = {}

    def words(self, text: str) -> list[str | tuple[str]]:
        """The words of a text, in order; an added token is a tuple of itself."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append((part,))
            else:
                out += self.found(_lower(part if part.isascii() else unicodedata.normalize("NFC", part)))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        found = [self.words(t) for t in texts]
        new = list(set().union(*found) - self.known.keys()) if found else []
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = list(set().union(*found))
        plain = [word for word in new if isinstance(word, str)]
        self.known |= {word: self.added[word[0]] for word in new if not isinstance(word, str)}
        for word, ids in zip(plain, self.encoder.encode([w.encode() for w in plain]), strict=True):
            self.known[word] = ids.astype("<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in found]

    def text(self, ids: bytes) -> str:
        """The tokens of the ids, joined by spaces: the vocabulary names no other decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tokenizer(vocabulary: dict) -> Tokenizer:
    """Kept with the broadcast tables, so that a worker process builds it once for all its tasks."""
    if "tokenizer" not in vocabulary:
        vocabulary["tokenizer"] = Tokenizer(vocabulary)
    return vocabulary["tokenizer"]


def _groups(texts: list[str], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts, about ``size`` characters at a time, with the number of each part's text."""
    owners, parts, total = [], [], 0
    for k, text in enumerate(texts):
        for part in stretches(text, size):
            owners.append(k)
            parts.append(part)
            total += len(part)
            if total >= size:
                yield owners, parts
                owners, parts, total = [], [], 0
    if parts:
        yield owners, parts


def encoded(frame: DataFrame, vocabulary: str, packed: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: its token ids, as an array or ``packed`` into
    little-endian unsigned 32-bit numbers, and the text they decode to.

    ``vocabulary`` is the path of a tokenizer file, read by the driver and broadcast; its size
    bounds all that is sent. Added tokens in a text count as such, the rest is put into NFC, lower
    cased and split by the file's pattern, and the words' bytes are merged. The tokens have no
    decoder, so decoding joins them by spaces.

    Words are encoded all together; a long word is halved, its pieces are encoded side by side and
    joined over growing windows, which gives exactly what encoding it at once would. Null and empty
    texts, and texts of white space, have no ids and decode to an empty text. Letters newer than
    Python's Unicode tables are taken for signs, a very long text for as many parts as white space allows. Rows that repeat an
    id are rows like any other; an empty table gives an empty result; other columns are ignored.
    """
    shared = frame.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, decoded = [[] for _ in texts], [[] for _ in texts]
            for owners, parts in _groups(texts, PIECE // 2):
                for k, found in zip(owners, tokenizer.ids(parts), strict=True):
                    if found:
                        ids[k].append(found)
                        decoded[k].append(tokenizer.text(found))
            joined = pa.array([b"".join(x) for x in ids], pa.binary())
            if not packed:
                joined = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in joined.to_pylist()], pa.list_(pa.int32()))
            texts = pa.array([" ".join(x) for x in decoded], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), joined, texts], ["doc_id", "ids", "decoded"])

    given = only(frame, doc_id=doc_id, text=text)
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(work, f"doc_id {kind}, ids {'binary' if packed else 'array<int>'}, decoded string")

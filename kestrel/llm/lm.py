"""Interpolated modified Kneser-Ney n-grams: counted in Spark, kept as tries of word numbers, mapped by workers."""

from __future__ import annotations

import json
import mmap
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import dealt, keep, shared_path, text_bytes, text_or_empty
from kestrel.llm.words import LOWER, Lanes, by_lane, chunks, mix, present, rows_of, squeeze, unsqueeze, word_hashes

CHUNK_WORDS = 1_000_000
#: Texts whose words are hashed together.
LOT_BYTES = 2 << 20
#: Hashes of the marks before and after each text. No word hash is set aside for them: a word would have to hit
#: one of two 64-bit numbers.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: A word that makes more than 1/HOT of all tokens is hot; n-grams whose inner words are all hot are spread over all lanes.
HOT = 1000
#: Since Python 3.13 a mapped file needn't stay open.
_CLOSED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: Files that a task keeps mapped at once: processes may have 1,024 files open, or 65,530 mapped.
MOST_MAPPED = 16_000 if _CLOSED else 900

#: A node's run of children is found from the start of the run of every BLOCK-th node.
BLOCK = 8
#: What is known of contexts with more followers is kept; of others it is added up when it is read.
SHORT = 16

_FACTS = "lane int, sub int, n int, data binary"
_CLASSES = "types long, n1 long, n2 long, n3 long, n4 long"
_SENT = f"kind int, level int, {_FACTS}, {_CLASSES}"
#: What is known of a context: followers seen once, twice, more often, and all occurrences of followers.
CONTEXT_FACTS = 4


@dataclass(frozen=True)
class Numbers:
    """Words' numbers: the ranks of their hashes among all, BEGIN after them, unknown words last."""

    lanes: Lanes
    words: int
    #: The number of the first word of each lane.
    first: np.ndarray
    #: The hot words and BEGIN, sorted.
    hot: np.ndarray

    @property
    def sent(self) -> str:
        return "<u4" if self.words + 2 <= 1 << 32 else "<u8"

    @property
    def high(self) -> str:
        """The type of what a number has above 16 bits."""
        return "<u1" if self.words + 2 <= 1 << 24 else "<u2" if self.words + 2 <= 1 << 32 else "<u4"


@dataclass
class Model:
    """Where a model's arrays lie, and its totals. Bounded: the arrays stay in their files."""

    path: str
    order: int
    numbers: Numbers
    tokens: int = 0
    #: Level (number of words) -> different n-grams, and the discounts of counts 1, 2 and 3 or more.
    types: dict[int, int] = field(default_factory=dict)
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    word_left: float = 1.0
    base_add: float = 0.1
    mapped: OrderedDict = field(default_factory=OrderedDict, repr=False, compare=False)

    @property
    def lanes(self) -> Lanes:
        return self.numbers.lanes

    @property
    def distinct(self) -> int:
        return self.numbers.words


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from how many items have counts 1 to 4; fixed ones where a class is empty."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.0), k)) for k, d in enumerate(raw, 1))


def _hash(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams, given as one array of word numbers for each place."""
    key = np.zeros(len(words[0]), np.uint64)
    for w in words:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64) + np.uint64(1))
    return key


def _all_hot(words: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w for w in words])


def _gram_place(words: list[np.ndarray], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where an n-gram is counted, whether its inner words are all hot, and whether its context is.

    It goes by its inner words (of two, the first): all of its context and all that differ in the first word come together.
    Where these are all hot it goes by its context, and where that is all hot by all its words.
    """
    inner = words[1:-1] or words[:1]
    key, hot = _hash(inner), _all_hot(inner, numbers.hot)
    spread = hot.copy()
    at = np.flatnonzero(hot)
    if len(at):
        some = [w[at] for w in words]
        spread[at] = _all_hot(some[:1], numbers.hot)
        key[at] = np.where(spread[at], _hash(some), _hash(some[:-1]))
    return numbers.lanes.place(key), hot, spread


def _path(words: list[np.ndarray]) -> list[np.ndarray]:
    """An n-gram's words in the order of a trie's layers: inner words, first, last."""
    return [*words[1:-1], words[0], words[-1]]


def _words(path: list[np.ndarray]) -> list[np.ndarray]:
    return [path[-2], *path[:-2], path[-1]]


def _joint(columns: list[np.ndarray]) -> tuple[np.ndarray, list[int] | None]:
    """One whole number for each row, in the order of the columns, and the columns' sizes if it can be taken apart by them."""
    sizes = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    key, size, whole = columns[0].astype(np.uint64), sizes[0], True
    for c, most in zip(columns[1:], sizes[1:], strict=True):
        if size * most > 1 << 64:
            different, key = np.unique(key, return_inverse=True)
            key, size, whole = key.astype(np.uint64), len(different), False
        if size * most > 1 << 64:
            different, c = np.unique(c, return_inverse=True)
            most = len(different)
        key = key * np.uint64(most) + c.astype(np.uint64)
        size *= most
    return key, sizes if whole else None


def _different(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns, in order, and how often each occurs."""
    key, sizes = _joint(columns)
    if sizes is None:
        _, at, counts = np.unique(key, return_index=True, return_counts=True)
        return [c[at] for c in columns], counts
    key.sort()
    at = _firsts(key)
    left, out = key[at], []
    for size in sizes[:0:-1]:
        left, x = np.divmod(left, np.uint64(size))
        out.append(x.astype(np.int64))
    return [left.astype(np.int64), *out[::-1]], np.diff(np.append(at, len(key)))


def _layers(path: list[np.ndarray], also: np.ndarray | None = None) -> list[np.ndarray]:
    """Of sorted paths: for each layer, where its nodes begin. `also` parts paths besides their words."""
    new = np.zeros(len(path[0]), bool)
    new[:1] = True
    out = []
    for x in path if also is None else [also, *path]:
        new[1:] |= x[1:] != x[:-1]
        out.append(np.flatnonzero(new))
    return out[len(out) - len(path) :]


def _lens(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """How many nodes of the lower layer each of the upper has."""
    return np.diff(np.append(np.searchsorted(lower, upper), len(lower)))


def _encode(path: list[np.ndarray], counts: np.ndarray, sent: str) -> bytes:
    """Sorted different paths as a trie of differences, with counts."""
    layers = _layers(path)
    out, parents = [], np.zeros(1, np.int64)
    for k, (x, at) in enumerate(zip(path, layers, strict=True)):
        node = x[at]
        step = np.diff(node, prepend=0)
        first = np.searchsorted(at, parents)
        step[first] = node[first]
        out.append(step.astype(sent))
        parents = at
        if k < len(path) - 1:
            out.append(_lens(at, layers[k + 1]).astype(sent))
    head = np.array([len(at) for at in layers], np.int64)
    return head.tobytes() + squeeze(*out, counts.astype("<u8"))


def _decode(data: bytes, level: int, sent: str) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = np.frombuffer(data, np.int64, level).tolist()
    kinds = [(sent, n) for n in sizes for _ in (0, 1)][:-1]
    *got, counts = unsqueeze(data[8 * level :], *kinds, ("<u8", sizes[-1]))
    out: list[np.ndarray] = []
    lens = np.array([sizes[0]])
    for k in range(level):
        first = np.cumsum(lens) - lens
        step = got[2 * k].astype(np.int64)
        add = np.cumsum(step)
        node = add - np.repeat(add[first] - step[first], lens)
        out = [np.repeat(x, lens) for x in out] if k else []
        out.append(node)
        lens = got[2 * k + 1].astype(np.int64) if k < level - 1 else None
    return out, counts.astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Chunks of texts: their other columns, hashes of all words after order - 1 BEGIN and before END, and each text's start."""
    before = [BEGIN] * (order - 1)

    def lots() -> Iterator[list[tuple]]:
        held, size = [], 0
        for row in rows_of(batches):
            if held and size + len(row[-1]) > LOT_BYTES:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
        if held:
            yield held

    def hashed() -> Iterator[tuple[tuple, np.ndarray]]:
        for lot in lots():
            start, out = word_hashes(b" ".join(row[-1] for row in lot).translate(LOWER))
            ends = np.cumsum([len(row[-1]) + 1 for row in lot])
            for row, some in zip(lot, np.split(out, np.searchsorted(start, ends[:-1])), strict=True):
                yield row[:-1], np.concatenate([before, some, [END]])

    for values, arrays in chunks(hashed(), CHUNK_WORDS):
        lens = np.array([len(a) for a in arrays])
        yield values, np.concatenate(arrays), np.cumsum(lens) - lens


def _tokens(h: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """Places of the tokens: all but the BEGIN marks."""
    token = np.ones(len(h), bool)
    for k in range(order - 1):
        token[begin + k] = False
    return np.flatnonzero(token)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, the sums of their columns of values, and a place of each key."""
    o = np.argsort(keys)
    at = _firsts(keys[o])
    return keys[o][at], np.add.reduceat(values[:, o], at, axis=1) if len(at) else values[:, :0], o[at]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [name for name, _ in fields]
    )


def _pack_facts(key: np.ndarray, facts: np.ndarray, lanes: Lanes, fine: bool = False) -> list[tuple]:
    """Rows of _FACTS."""
    split = lanes.split(lanes.place(key), fine)
    return [(lane, sub, len(x), squeeze(key[x], facts[:, x].reshape(-1))) for lane, sub, x in split]


def _unpack_facts(rows: Iterable[tuple], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed facts of rows (n, data)."""
    got = [unsqueeze(data, ("<u8", n), ("<i8", n * width)) for n, data in rows]
    facts = np.concatenate([f.reshape(width, -1) for _, f in got], axis=1)
    return _sum_by(np.concatenate([k for k, _ in got]), facts)[:2]


def _split_facts(batches: Iterator[pa.RecordBatch], width: int, lanes: Lanes) -> Iterator[pa.RecordBatch]:
    """Packed facts of lanes to packed facts of subs, a bounded number at a time."""
    held, size = [], 0
    for *_, n, data in rows_of(batches, 64):
        held.append((n, data))
        size += n
        if size >= CHUNK_WORDS:
            yield _batch(_pack_facts(*_unpack_facts(held, width), lanes, True), _FACTS)
            held, size = [], 0
    if held:
        yield _batch(_pack_facts(*_unpack_facts(held, width), lanes, True), _FACTS)


def _pack_grams(words: list[np.ndarray], counts: np.ndarray, numbers: Numbers, fine: bool = False) -> list[tuple]:
    """Rows of _FACTS of different n-grams in the order of their paths."""
    split = numbers.lanes.split(_gram_place(words, numbers)[0], fine)
    return [(lane, sub, len(x), _encode(_path([w[x] for w in words]), counts[x], numbers.sent)) for lane, sub, x in split]


def _unpack_grams(rows: Iterable[tuple], level: int, numbers: Numbers) -> tuple[list[np.ndarray], np.ndarray]:
    """Different paths, in order, and their summed counts, of rows (n, data)."""
    got = [_decode(data, level, numbers.sent) for _, data in rows]
    path = [np.concatenate(x) for x in zip(*(p for p, _ in got), strict=True)]
    counts = np.concatenate([c for _, c in got])
    key, total, at = _sum_by(_joint(path)[0], counts[None, :])
    return [x[at] for x in path], total[0]


def _split_grams(batches: Iterator[pa.RecordBatch], level: int, numbers: Numbers) -> Iterator[pa.RecordBatch]:
    """Packed n-grams of lanes to packed n-grams of subs, a bounded number at a time."""

    def again(held: list[tuple]) -> pa.RecordBatch:
        path, counts = _unpack_grams(held, level, numbers)
        return _batch(_pack_grams(_words(path), counts, numbers, True), _FACTS)

    held, size = [], 0
    for *_, n, data in rows_of(batches, 64):
        held.append((n, data))
        size += n
        if size >= CHUNK_WORDS:
            yield again(held)
            held, size = [], 0
    if held:
        yield again(held)


def _count_words(batches: Iterator[pa.RecordBatch], lanes: Lanes) -> Iterator[pa.RecordBatch]:
    for _, h, begin in _texts(batches, 2):
        keys, counts = np.unique(h[_tokens(h, begin, 2)], return_counts=True)
        yield _batch(_pack_facts(keys, counts[None, :].astype(np.int64), lanes), _FACTS)


def _own_counts(batches: Iterator[pa.RecordBatch], path: str, subs: int) -> Iterator[pa.RecordBatch]:
    """Add up a lane's words and keep them, sorted; pass on the counts, after the place of a sub's first word in its lane."""
    for lane, some in by_lane(batches):
        out = Writer(path, f"words-{lane}", subs)
        for sub, rows in some:
            key, facts = _unpack_facts(rows, 1)
            row = (lane, out.size("keys"), len(key), squeeze(facts[0]), int(facts[0].sum()))
            out.begin(sub, len(key))
            out.add("keys", key)
            out.add_small("count", facts[0])
            yield _batch([row], "lane int, place long, n int, data binary, tokens long")
        out.close()


def _hot_words(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for lane, place, n, data in rows_of(batches, 64):
        at = np.flatnonzero(unsqueeze(data, ("<i8", n))[0] > least)
        yield _batch([(lane, place + int(k)) for k in at], "lane int, place long")


def _count_grams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    order = model.order
    for _, h, begin in _texts(batches, order):
        words, back = np.unique(h, return_inverse=True)
        number = _number(model, words)[0]
        o = np.argsort(number)
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o))
        back, number = rank[back], number[o]
        at = _tokens(h, begin, order)
        path, counts = _different(_path([back[at - k] for k in range(order - 1, -1, -1)]))
        yield _batch(_pack_grams(_words([number[x] for x in path]), counts, model.numbers), _FACTS)


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    """Writes a lane's arrays, each as it comes; they go into one file when the lane is done.

    A repeated task writes the same file and the last move wins.
    """

    def __init__(self, path: str, name: str, subs: int = 1) -> None:
        self.fs, inside = _store(path)
        self.fs.create_dir(inside, recursive=True)
        self.name, self.part = f"{inside}/{name}", f"{inside}/.{name}.{uuid.uuid4().hex}"
        self.arrays: dict[str, list] = {}
        self.starts = np.zeros(subs + 1, np.int64)

    def begin(self, sub: int, n: int) -> None:
        """So many entries that are searched first belong to a sub."""
        self.starts[sub + 1] = n

    def size(self, name: str) -> int:
        return self.arrays[name][2] if name in self.arrays else 0

    def add(self, name: str, x: np.ndarray) -> None:
        if name not in self.arrays:
            self.arrays[name] = [self.fs.open_output_stream(f"{self.part}.{len(self.arrays)}"), x.dtype.str, 0]
        self.arrays[name][0].write(x.tobytes())
        self.arrays[name][2] += len(x)

    def add_small(self, name: str, x: np.ndarray) -> None:
        """Counts as a byte each, with those above 254 apart."""
        over = np.flatnonzero(x > 254)
        self.add(f"{name}@", self.size(name) + over)
        self.add(f"{name}#", x[over].astype(np.int64))
        self.add(name, np.minimum(x, 255).astype(np.uint8))

    def add_trie(self, sub: int, path: list[np.ndarray], counts: np.ndarray, high: str) -> None:
        """Sorted different paths and their counts. The second layer, which has the longest runs, is searched faster whole."""
        layers = _layers(path)
        last = len(path) - 1
        self.begin(sub, len(layers[0]))
        long = None
        for k, (x, at) in enumerate(zip(path, layers, strict=True)):
            before = self.size(f"low{k}")
            if k < last:
                lens = _lens(at, layers[k + 1])
                starts = self.size(f"low{k + 1}") + np.cumsum(lens) - lens
                self.add(f"start{k}", starts[-before % BLOCK :: BLOCK])
                self.add_small(f"len{k}", lens)
                if k == last - 1:
                    long = np.flatnonzero(lens > SHORT)
                    facts = np.add.reduceat(_facts_of(counts), at, axis=1)[:, long]
                    self.add("long", before + long)
                    self.add("facts", np.ascontiguousarray(facts.T).reshape(-1))
            if k == 1:
                self.add("low1", x[at].astype("<u4" if np.dtype(high).itemsize < 4 else "<u8"))
            else:
                self.add(f"low{k}", x[at].astype("<u2"))
                self.add(f"high{k}", (x[at] >> 16).astype(high))
        self.add_small("count", counts)

    def close(self) -> None:
        self.add("starts", np.cumsum(self.starts))
        index, end = {}, 0
        with self.fs.open_output_stream(self.part) as out:
            for k, (name, (stream, dtype, n)) in enumerate(self.arrays.items()):
                stream.close()
                with self.fs.open_input_stream(f"{self.part}.{k}") as src:
                    while piece := src.read(1 << 22):
                        out.write(piece)
                self.fs.delete_file(f"{self.part}.{k}")
                index[name] = (dtype, end, n)
                size = np.dtype(dtype).itemsize * n
                out.write(bytes(-size % 8))
                end += size + -size % 8
            said = json.dumps(index).encode()
            out.write(said + np.array([len(said)], np.int64).tobytes())
        self.fs.move(self.part, self.name)


def _facts_of(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts == 1, counts == 2, counts > 2, counts]).astype(np.int64)


class Table:
    """A lane's arrays, memory-mapped."""

    def __init__(self, raw: np.ndarray) -> None:
        said = int(np.frombuffer(raw[-8:].tobytes(), np.int64)[0])
        index = json.loads(raw[-8 - said : -8].tobytes())
        self.arrays = {k: raw[at : at + np.dtype(t).itemsize * n].view(t) for k, (t, at, n) in index.items()}

    def small(self, name: str, place: np.ndarray) -> np.ndarray:
        got = self.arrays[name][place]
        cut = np.flatnonzero(got == 255)
        got = got.astype(np.int64)
        if len(cut):
            got[cut] = self.arrays[f"{name}#"][np.searchsorted(self.arrays[f"{name}@"], place[cut])]
        return got

    def range(self, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.arrays["starts"][sub], self.arrays["starts"][sub + 1]

    def search(self, keys: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys (sorted in each sub) are there, and their places."""
        have = self.arrays["keys"]
        if len(self.arrays["starts"]) == 2:
            low = np.searchsorted(have, keys)
            hit = np.flatnonzero(low < len(have))
            hit = hit[have[low[hit]] == keys[hit]]
            return hit, low[hit]
        place = _search(lambda at: have[at], *self.range(sub), keys)
        hit = np.flatnonzero(place >= 0)
        return hit, place[hit]

    def node(self, layer: int, place: np.ndarray) -> np.ndarray:
        if layer == 1:
            return self.arrays["low1"][place]
        return self.arrays[f"low{layer}"][place] | self.arrays[f"high{layer}"][place].astype(np.int64) << 16

    def runs(self, layer: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of nodes begin and end."""
        name = f"len{layer}"
        start = self.arrays[f"start{layer}"][place // BLOCK]
        back = place % BLOCK
        for k in range(BLOCK - 1):
            x = np.flatnonzero(back > k)
            start[x] += self.small(name, place[x] - back[x] + k)
        return start, start + self.small(name, place)

    def context(self, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CONTEXT_FACTS of contexts, given their place and where their followers begin and end."""
        out = np.zeros((CONTEXT_FACTS, len(place)), np.int64)
        short = end - start <= SHORT
        x = np.flatnonzero(short)
        for k in range(SHORT):
            x = x[start[x] + k < end[x]]
            if not len(x):
                break
            counts = self.small("count", start[x] + k)
            out[np.minimum(counts, 3) - 1, x] += 1
            out[3, x] += counts
        x = np.flatnonzero(~short)
        if len(x):
            at = np.searchsorted(self.arrays["long"], place[x])
            out[:, x] = self.arrays["facts"].reshape(-1, CONTEXT_FACTS)[at].T
        return out

    def grams(self, path: list[np.ndarray], sub: np.ndarray) -> np.ndarray:
        """Of different paths in order: their counts, then what is known of their contexts; zeros where there is nothing."""
        out = np.zeros((1 + CONTEXT_FACTS, len(sub)), np.int64)
        start, end = self.range(sub)
        layers = _layers(path, None if len(self.arrays["starts"]) == 2 else sub)
        for k, at in enumerate(layers):
            place = _search(lambda p, k=k: self.node(k, p), start[at], end[at], path[k][at])
            lens = np.diff(np.append(at, len(sub)))
            hit = np.flatnonzero(place >= 0)
            if k == len(layers) - 1:
                out[0, at[hit]] = self.small("count", place[hit])
            if k == len(layers) - 1 or not len(hit):
                break
            start_, end_ = np.zeros((2, len(at)), np.int64)
            start_[hit], end_[hit] = self.runs(k, place[hit])
            if k == len(layers) - 2:
                facts = np.zeros((CONTEXT_FACTS, len(at)), np.int64)
                facts[:, hit] = self.context(place[hit], start_[hit], end_[hit])
                out[1:] = np.repeat(facts, lens, axis=1)
            start, end = np.repeat(start_, lens), np.repeat(end_, lens)
        return out


def _search(value, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Where `want` is in sorted ranges, by halving all of them together; -1 where it isn't."""
    out = low.copy()
    live = np.flatnonzero(high > low)
    low, left, asked = low[live], (high - low)[live], want[live]
    some = live
    while len(some):
        half = left >> 1
        mid = low + half
        low = np.where(value(mid) <= asked, mid, low)
        left = left - half
        go = left > 1
        n = np.count_nonzero(go)
        if 2 * n < len(some):  # those that are done drop out in large lots
            out[some] = low
            some, low, left, asked = some[go], low[go], left[go], asked[go]
    found = np.full(len(want), -1, np.int64)
    at = out[live]
    hit = value(at) == want[live]
    found[live[hit]] = at[hit]
    return found


def _table(model: Model, name: str) -> Table | None:
    """A lane's table; None if it got nothing. At most MOST_MAPPED stay mapped, those used last.

    Of a store that isn't mounted the lane's file is read instead, and only a few are kept.
    """
    if name in model.mapped:
        model.mapped.move_to_end(name)
        return model.mapped[name]
    fs, inside = _store(model.path)
    mounted = isinstance(fs, pa.fs.LocalFileSystem)
    try:
        if mounted:
            with open(f"{inside}/{name}", "rb") as src:
                raw = np.frombuffer(mmap.mmap(src.fileno(), 0, access=mmap.ACCESS_READ, **_CLOSED), np.uint8)
        else:
            with fs.open_input_file(f"{inside}/{name}") as src:
                raw = np.frombuffer(src.read(), np.uint8)
        table = Table(raw)
    except FileNotFoundError:
        table = None
    model.mapped[name] = table
    while len(model.mapped) > (MOST_MAPPED if mounted else 4):
        model.mapped.popitem(last=False)
    return table


def _number(model: Model, words: np.ndarray, facts: bool = False) -> np.ndarray:
    """The numbers of sorted hashes; with facts also how often they occur, and after how many different words."""
    numbers = model.numbers
    out = np.zeros((3 if facts else 1, len(words)), np.int64)
    out[0] = np.where(words == BEGIN, numbers.words, numbers.words + 1)
    place = numbers.lanes.place(words)
    for lane, _, x in numbers.lanes.split(place, False):
        table = _table(model, f"words-{lane}")
        if table is not None:
            hit, at = table.search(words[x], place[x] % numbers.lanes.subs)
            out[0, x[hit]] = numbers.first[lane] + at
            if facts:
                out[1, x[hit]] = table.small("count", at)
                before = _table(model, f"before-{lane}")
                out[2, x[hit]] = 0 if before is None else before.small("count", at)
    return out


def _grams(model: Model, words: list[np.ndarray]) -> np.ndarray:
    """Of different n-grams in the order of their paths: counts, and CONTEXT_FACTS of their contexts."""
    level, numbers = len(words), model.numbers
    out = np.zeros((1 + CONTEXT_FACTS, len(words[0])), np.int64)
    place, hot, spread = _gram_place(words, numbers)
    sub = place % numbers.lanes.subs
    ways = [(np.flatnonzero(hot), "grams2"), (np.flatnonzero(~hot), "pairs")] if level == 2 < model.order else None
    for some, name in ways or [(np.arange(len(place)), f"grams{level}")]:
        for lane, _, x in numbers.lanes.split(place[some], False):
            x = some[x]
            x = x[np.argsort(sub[x], kind="stable")] if numbers.lanes.subs > 1 else x
            table = _table(model, f"{name}-{lane}")
            if table is not None:
                out[:, x] = table.grams(_path([w[x] for w in words]), sub[x])
    x = np.flatnonzero(spread)
    key, back = np.unique(_hash([w[x] for w in words[:-1]]), return_inverse=True)
    facts = np.zeros((CONTEXT_FACTS, len(key)), np.int64)
    place = numbers.lanes.place(key)
    for lane, _, at in numbers.lanes.split(place, False):
        table = _table(model, f"contexts{level}-{lane}")
        if table is not None:
            hit, found = table.search(key[at], place[at] % numbers.lanes.subs)
            facts[:, at[hit]] = table.arrays["facts"].reshape(-1, CONTEXT_FACTS)[found].T
    out[1:, x] = facts[:, back]
    return out


def _own_grams(batches: Iterator[pa.RecordBatch], path: str, level: int, numbers: Numbers) -> Iterator[pa.RecordBatch]:
    """Add up a lane's n-grams, keep them as a trie, and pass on what isn't settled here.

    Kind 1: CONTEXT_FACTS of contexts that are all hot. Kind 2: n-grams less their first word, counted once for each
    different first word. Kind 3: after how many different words a word comes. Kind 4: counts of counts. Pairs inside
    three words that don't begin with a hot word have all their three words here, and are kept as another trie.
    """
    none = (None,) * 5

    def classes(of: int, counts: np.ndarray) -> tuple:
        return (4, of, 0, 0, 0, None, len(counts), *(int((counts == k).sum()) for k in (1, 2, 3, 4)))

    def before(last: np.ndarray) -> list[tuple]:
        (word,), times = _different([last])
        lane = np.searchsorted(numbers.first, word, "right") - 1
        return [
            (3, 1, int(k), 0, len(x), squeeze(np.diff(word[x], prepend=0), times[x].astype(np.int64)), *none) for k, x in present(lane)
        ]

    for lane, subs in by_lane(batches):
        out = Writer(path, f"grams{level}-{lane}", numbers.lanes.subs)
        pairs = Writer(path, f"pairs-{lane}", numbers.lanes.subs) if level == 3 else None
        for sub, rows in subs:
            steps, counts = _unpack_grams(rows, level, numbers)
            out.add_trie(sub, steps, counts, numbers.high)
            made = [classes(level, counts)]
            words = _words(steps)
            _, hot, spread = _gram_place(words, numbers)
            x = np.flatnonzero(spread)
            context, facts, _ = _sum_by(_hash([w[x] for w in words[:-1]]), _facts_of(counts[x]))
            made += [(1, level, *row, *none) for row in _pack_facts(context, facts, numbers.lanes)]
            if level == 2:
                made += before(words[1])
            else:
                here = ~hot if pairs else np.zeros(len(hot), bool)
                if here.any():
                    pair, times = _different([w[here] for w in words[1:]])
                    pairs.add_trie(sub, pair, times, numbers.high)
                    made += [classes(2, times), *before(pair[1])]
                if not here.all():
                    shorter, times = _different(_path([w[~here] for w in words[1:]]))
                    made += [(2, level - 1, *row, *none) for row in _pack_grams(_words(shorter), times, numbers)]
            yield _batch(made, _SENT)
        out.close()
        if pairs:
            pairs.close()


def _own_facts(batches: Iterator[pa.RecordBatch], path: str, name: str, subs: int) -> Iterator[pa.RecordBatch]:
    """Add up what is known of a lane's contexts and keep it."""
    for lane, some in by_lane(batches):
        out = Writer(path, f"{name}-{lane}", subs)
        for sub, rows in some:
            key, facts = _unpack_facts(rows, CONTEXT_FACTS)
            out.begin(sub, len(key))
            out.add("keys", key)
            out.add("facts", np.ascontiguousarray(facts.T).reshape(-1))
        out.close()
        yield _batch([(lane,)], "lane int")


def _own_before(batches: Iterator[pa.RecordBatch], path: str, numbers: Numbers) -> Iterator[pa.RecordBatch]:
    """Add up, for each word of a lane, after how many different words it comes; holds a number for each word of the lane."""
    ends = np.append(numbers.first, numbers.words)
    for lane, subs in by_lane(batches):
        total = np.zeros(int(ends[lane + 1] - ends[lane]), np.int64)
        for _, rows in subs:
            for n, data in rows:
                step, times = unsqueeze(data, ("<i8", n), ("<i8", n))
                total[np.cumsum(step) - ends[lane]] += times
        out = Writer(path, f"before-{lane}")
        out.add_small("count", total)
        out.close()
        row = (len(total), *(int((total == k).sum()) for k in (1, 2, 3, 4)), int((total > 2).sum()))
        yield _batch([row], f"{_CLASSES}, more long")


def train(
    docs: DataFrame,
    *,
    order: int = 2,
    text_col: str = "text",
    bucket_bytes: int = 8 << 20,
    most_lanes: int = 4096,
    base_add: float = 0.1,
) -> Model:
    """Count a model of n-grams of up to `order` (2 or more) words over all texts of docs, left in the shared folder.

    Words are lower-cased (A-Z); each text is order - 1 marks BEGIN, its words, END. Tasks count words of their own chunks
    and send them packed to lanes of hashes, at most most_lanes; a lane's owner takes its rows in order of subs, of
    bucket_bytes of text each, so its memory is bounded, adds them up and writes the sorted hashes, one file for a lane and
    table. A word's number is its rank among them. n-grams are sent as tries of numbers, by their inner words: their
    owner has whole contexts, and all first words of what follows. Shorter n-grams count in how many different longer
    ones they end (modified Kneser-Ney), level by level; pairs are counted by the owners of three words. n-grams with
    inner words that each make over 1/1000 of all tokens are spread over the lanes, and what is known of them is sent
    once more. What the driver holds are totals, counts of counts, the lanes' numbers of words and those fewer than
    1,000 words. Work and what is sent grow in proportion to the texts.

    A null text is empty. An empty table gives a model that knows no words. Two words of equal 64-bit hashes count as one.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    lanes = Lanes.of(text_bytes(docs, text_col), bucket_bytes, most_lanes)
    several = lanes.subs > 1
    texts = docs.select(text_or_empty(text_col).cast("binary").alias("text"))
    path = shared_path(spark, "lm")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_words(batches, lanes)

    def own_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _own_counts(batches, path, lanes.subs)

    def split_facts(width: int):
        return (lambda batches: _split_facts(batches, width, lanes)) if several else None

    counted = dealt(texts.mapInArrow(count_words, _FACTS), split_facts(1))
    words = keep(counted.mapInArrow(own_counts, "lane int, place long, n int, data binary, tokens long"), "lm-words")
    first = np.zeros(lanes.lanes + 1, np.int64)
    tokens = 0
    for lane, n, k in words.groupBy("lane").agg(F.sum("n"), F.sum("tokens")).collect():  # a row for each lane
        first[lane + 1], tokens = n, tokens + k
    first = np.cumsum(first)
    least = tokens / HOT

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hot_words(batches, least)

    often = words.select("lane", "place", "n", "data").mapInArrow(hot_words, "lane int, place long").collect()  # < HOT
    hot = np.array(sorted(int(first[r["lane"]]) + r["place"] for r in often) + [int(first[-1])], np.int64)
    numbers = Numbers(lanes, int(first[-1]), first[:-1], hot)
    model = Model(path, order, numbers, tokens, base_add=base_add)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_grams(batches, model)

    def own_grams(level: int):
        return lambda batches: _own_grams(batches, path, level, numbers)

    def split_grams(level: int):
        return (lambda batches: _split_grams(batches, level, numbers)) if several else None

    def own_facts(name: str):
        return lambda batches: _own_facts(batches, path, name, lanes.subs)

    def own_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _own_before(batches, path, numbers)

    names = ("types", "n1", "n2", "n3", "n4")
    facts = ["lane", "sub", "n", "data"]
    seen = {k: [0] * 5 for k in range(2, order + 1)}
    grams, before = texts.mapInArrow(count_grams, _FACTS), []
    for level in range(order, 1, -1):
        sent = keep(dealt(grams, split_grams(level)).mapInArrow(own_grams(level), _SENT), f"lm-grams{level}")
        for r in sent.where("kind = 4").groupBy("level").agg(*[F.sum(c).alias(c) for c in names]).collect():
            seen[r["level"]] = [a + r[c] for a, c in zip(seen[r["level"]], names, strict=True)]
        contexts = dealt(sent.where("kind = 1").select(*facts), split_facts(CONTEXT_FACTS))
        contexts.mapInArrow(own_facts(f"contexts{level}"), "lane int").count()
        grams = sent.where("kind = 2").select(*facts)
        before.append(sent.where("kind = 3").select(*facts))
    for level, (types, *classes) in seen.items():
        model.types[level], model.discounts[level] = types, discounts(*classes)
    every = before[-1] if order == 2 else before[-2].unionByName(before[-1])
    known = dealt(every).mapInArrow(own_before, f"{_CLASSES}, more long")
    k = known.agg(*[F.sum(c).alias(c) for c in (*names, "more")]).first()
    model.discounts[1] = d = discounts(*(k[c] or 0 for c in names[1:]))
    if model.types[2]:
        model.word_left = (d[0] * k["n1"] + d[1] * k["n2"] + d[2] * k["more"]) / model.types[2]
    return model


def _off(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.select([counts == 0, counts == 1, counts == 2], [0.0, by[0], by[1]], by[2])


def _score(model: Model, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text of a chunk: tokens, known tokens, base score and model score."""
    words, back = np.unique(h, return_inverse=True)
    number, count, before = _number(model, words, True)
    even = 1 / (model.distinct + 1)
    unigram = (before - _off(before, model.discounts[1])) / max(model.types[2], 1) + model.word_left * even
    at = _tokens(h, begin, model.order)
    p = unigram[back[at]]
    for level in range(2, model.order + 1):
        d = model.discounts[level]
        path = _path([back[at - k] for k in range(level - 1, -1, -1)])
        key = _joint(path)[0].view(np.int64)  # whatever its order: equal ones come together
        o = np.argsort(key)
        first = _firsts(key[o])
        times = np.diff(np.append(first, len(o)))
        seen, once, twice, more, total = _grams(model, _words([number[x[o[first]]] for x in path]))
        known = total > 0
        own = np.divide(seen - _off(seen, d), total, out=np.zeros(len(first)), where=known)
        left = np.divide(d[0] * once + d[1] * twice + d[2] * more, total, out=np.ones(len(first)), where=known)
        p[o] = np.repeat(own, times) + np.repeat(left, times) * p[o]
    c = count[back[at]]
    base = np.log10((c + model.base_add) / (model.tokens + model.base_add * (model.distinct + 1)))
    cut = begin - np.arange(len(begin)) * (model.order - 1)
    add = np.add.reduceat
    return np.diff(np.append(cut, len(at))), add((c > 0).astype(np.int64), cut), add(base, cut), add(np.log10(p), cut)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text: id_col, n_tokens (words and one END), n_known (seen in training), base_score, score, perplexity.

    base_score is the sum of log10((c + a) / (N + a (V + 1))) over the tokens, a = model.base_add. score is the log10
    probability of the text under the model: an n-gram's discounted share of its context, plus what the discounts left
    over times the probability given a word less of context, down to the word's share of different pairs, which itself is
    discounted towards 1 / (V + 1). perplexity is 10 ** (-score / n_tokens).

    Tasks map the model's files and look up the different n-grams of a chunk of texts lane by lane. A null or empty text is
    one END. Ids may be null, repeat and be of any type. An empty table gives no rows. Other columns are not read.
    """
    field_ = docs.select(F.col(id_col).alias("id")).schema[0]
    kind = field_.dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                yield batch

        for values, h, begin in _texts(seen(), model.order):
            ids = pa.array([v[0] for v in values], types[0])
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, _score(model, h, begin))], ["id", "n_tokens", "n_known", "base_score", "score"]
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.withColumn("perplexity", perplexity).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 10):
    """Whether a document is kept out of training: CRC-32 of its id as text, modulo folds, is 0. A null id is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0

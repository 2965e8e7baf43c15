"""Words of texts as 64-bit hashes, in bounded chunks, inside tasks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CACHED_WORDS = 300_000
LONG_WORD = 64
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordHashes(dict):
    """Hashes of words, remembered while there are at most CACHED_WORDS."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 512) -> Iterator[tuple]:
    """Rows as tuples of Python values, converting few at a time so that long texts don't add up."""
    for batch in batches:
        for k in range(0, batch.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, at_once).columns), strict=True)


def chunks(rows: Iterator[tuple[tuple, np.ndarray]], most: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows (values, array) gathered until their arrays hold `most` entries; a longer array is a chunk of its own."""
    values: list[tuple] = []
    arrays: list[np.ndarray] = []
    held = 0
    for value, array in rows:
        if held and held + len(array) > most:
            yield values, arrays
            values, arrays, held = [], [], 0
        values.append(value)
        arrays.append(array)
        held += len(array)
    if values:
        yield values, arrays


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and their hashes, all at once: 8 bytes a step, words of over LONG_WORD one by one."""
    raw = np.frombuffer(text + bytes(8), np.uint8)
    space = _SPACES[raw]
    space[len(text) :] = True
    edge = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1]]))
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = mix(size.astype(np.uint64))
    live = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]))
    for at in np.flatnonzero(size > LONG_WORD).tolist():
        out[at] = xxhash.xxh64_intdigest(text[start[at] : start[at] + size[at]])
    return start, out


def planes(x: np.ndarray) -> bytes:
    """Integers, the first bytes of all, then the second bytes: small values compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.copy().view(dtype).reshape(n)


def squeeze(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(map(planes, arrays)), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize * n for t, n in kinds]
    raw = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
    out, at = [], 0
    for (dtype, n), size in zip(kinds, sizes, strict=True):
        out.append(from_planes(raw[at : at + size], dtype, n))
        at += size
    return out


def present(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value that occurs, in order, and where it occurs."""
    if not len(place):
        return
    order = np.argsort(place.astype(np.uint16) if place.max() < 65536 else place, kind="stable")
    by = place[order]
    cuts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
        yield int(by[a]), order[a:b]


@dataclass(frozen=True)
class Lanes:
    """How hashes are dealt out: by ranges, `lanes` that tasks send to, each of `subs` that an owner holds at once.

    The number of lanes is bounded, so what a chunk sends is; subs grow with the data, so that one fits in memory.
    """

    lanes: int
    subs: int

    @classmethod
    def of(cls, total: int, each: int, most: int = 4096) -> Lanes:
        n = max(1, -(-total // each))
        lanes = min(n, most)
        return cls(lanes, -(-n // lanes))

    def place(self, u: np.ndarray) -> np.ndarray:
        """lane * subs + sub of uniform 64-bit hashes, rising with the hash."""
        return (((u >> np.uint64(32)) * np.uint64(self.lanes * self.subs)) >> np.uint64(32)).astype(np.int64)

    def split(self, place: np.ndarray, fine: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """(lane, sub, where) of those that occur; of lanes only, sub 0, unless fine."""
        if fine:
            for p, x in present(place):
                yield p // self.subs, p % self.subs, x
        else:
            for lane, x in present(place // self.subs):
                yield lane, 0, x


def by_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, Iterator[tuple]]]]]:
    """Of rows (lane, sub, ...) in that order: each lane, and inside it each sub with its rows' other values, one by one."""
    for lane, rows in itertools.groupby(rows_of(batches, 64), key=lambda r: r[0]):
        yield lane, ((sub, (r[2:] for r in some)) for sub, some in itertools.groupby(rows, key=lambda r: r[1]))

"""Byte-level BPE with padded numpy matrices, from a public rank file."""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import text_or_empty
from kestrel.llm.words import rows_of

NONE = np.int32(2**31 - 1)
#: Matrices have at most so many cells; pieces of more bytes than LONG are merged with a heap instead.
CELLS = 1 << 20
LONG = 1024
#: Pieces remembered by a task, about 70 MB.
CACHED = 300_000


class PairTable:
    """An open-addressing hash table from pairs of token ids to the rank of their merge."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(rank) * 2 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo = np.arange(len(rank))
        keys = self._key(left, right)
        slot = self._slot(keys)
        self.longest = 0
        while len(todo):
            self.longest += 1
            free = todo[self.keys[slot[todo]] == -1]
            took, first = np.unique(slot[free], return_index=True)
            self.keys[took], self.ranks[took] = keys[free[first]], rank[free[first]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair doesn't merge. Negative ids are padding."""
        keys = self._key(left, right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        for _ in range(self.longest + 1):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            open_ = ~hit & (held != -1)
            if not open_.any():
                break
            todo, slot = todo[open_], (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


def read_tokens(rank_file: bytes) -> list[bytes]:
    """Tokens by rank of a rank file (lines of base64 token and rank; ranks are ids)."""
    pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Vocabulary:
    """The merges of a rank file."""

    def __init__(self, rank_file: bytes):
        self.tokens = read_tokens(rank_file)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        merges = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*merges, strict=True)))

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of pieces: each is a token, or its bytes merged from the lowest rank up, leftmost first."""
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = (rank,)
            elif len(piece) > LONG:
                out[k] = self._merge_long(piece)
            else:
                by_length.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in by_length.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for place, ids in zip(some, self._merge_rows([pieces[p] for p in some], width), strict=True):
                    out[place] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """All pieces at once, one row each: every round merges each row's leftmost pair of least rank."""
        lens = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < lens[:, None], self.single[raw], -1)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))  # the piece that a row holds
        done: list[tuple[int, ...]] = [()] * len(pieces)
        while len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            over = best == NONE
            if over.any():
                for k, x, n in zip(row[over].tolist(), ids[over].tolist(), lens[over].tolist(), strict=True):
                    done[k] = tuple(x[:n])
                live = ~over
                row, ids, ranks, lens, at, best = row[live], ids[live], ranks[live], lens[live], at[live], best[live]
                if not len(row):
                    break
            r = np.arange(len(row))
            lens = lens - 1
            # close the gap that the merge leaves, for ids and for the ranks between them
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[r, at] = best
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if ids.shape[1] == 1:
                for k in r:
                    done[row[k]] = (int(ids[k, 0]),)
                break
            ids[:, max(1, int(lens.max())) :] = -1
            tail = np.arange(ids.shape[1]) >= lens[:, None]
            ids[tail] = -1
            for side in (at - 1, at):
                inside = np.flatnonzero((side >= 0) & (side + 1 < lens))
                ranks[inside, side[inside]] = self.pairs.find(ids[inside, side[inside]], ids[inside, side[inside] + 1])
            ranks[tail[:, 1:]] = NONE
            if lens.max() < ids.shape[1] // 2:  # compaction
                keep = max(2, int(lens.max()))
                ids, ranks = ids[:, :keep].copy(), ranks[:, : keep - 1].copy()
        return done

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        found = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(rank, k, ids[k], ids[k + 1]) for k, rank in enumerate(found) if rank != NONE]
        heapq.heapify(heap)

        def push(k: int) -> None:
            rank = self.ranks.get(self.tokens[ids[k]] + self.tokens[ids[after[k]]])
            if rank is not None:
                heapq.heappush(heap, (rank, k, ids[k], ids[after[k]]))

        while heap:
            rank, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt >= len(ids) or ids[nxt] != right:
                continue
            ids[k], ids[nxt] = rank, -1
            after[k] = after[nxt]
            if after[k] < len(ids):
                before[after[k]] = k
                push(k)
            if before[k] >= 0:
                push(before[k])
        return tuple(x for x in ids if x >= 0)


class Pieces(dict):
    """Ids of pieces of text. When half of CACHED are new, those not met since the last time are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def learn(self, lists: list[list[str]]) -> None:
        if len(self) > CACHED // 2:
            self.older = dict(self)
            self.clear()
        new = set().union(*lists).difference(self)
        again = new.intersection(self.older)
        self.update((p, self.older[p]) for p in again)
        new = list(new - again)
        self.update(zip(new, self.vocabulary.encode([p.encode() for p in new]), strict=True))


_loaded: dict[bytes, Vocabulary] = {}


def _vocabulary(rank_file: bytes) -> Vocabulary:
    """One parsed vocabulary per worker process, about 25 MB."""
    if rank_file not in _loaded:
        _loaded.clear()
        _loaded[rank_file] = Vocabulary(rank_file)
    return _loaded[rank_file]


def _some(rows: Iterator[tuple], most: int = 1 << 21) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_ranks(spark, path: str) -> bytes:
    """A rank file's bytes, through Spark, so that any store will do; its size is that of the vocabulary."""
    if "://" not in path:
        path = f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, *, round_trip: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, ids array<int>): the tokens of each text, each match of `pattern` encoded by itself.

    Pieces of up to LONG bytes are merged in length-bucketed matrices. For longer ones, whose matrices would cost the square
    of their length, a heap over one piece at a time does the same merges exactly.

    With round_trip a further column decoded (binary) holds the bytes that the ids stand for, by the same rule as
    decode() but without another pass. `ranks` is a rank file's content; it is broadcast, as its size is that of the
    vocabulary. No special tokens. A null or empty text has no tokens. Rows may repeat, and ids may be null. An
    empty table gives no rows. Other columns are not read. Needs every single byte in the vocabulary.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(held.value)
        token = vocabulary.tokens.__getitem__
        known, find = Pieces(vocabulary), regex.compile(pattern).findall
        for batch in batches:
            done = 0
            for rows in _some(rows_of(iter([batch]))):
                lists = [find(text) for _, text in rows]
                known.learn(lists)
                each = [list(itertools.chain.from_iterable(map(known.__getitem__, x))) for x in lists]
                ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(each), np.int32, ends[-1])
                columns = [batch.column(0).slice(done, len(rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if round_trip:
                    columns.append(pa.array([b"".join(map(token, ids)) for ids in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(rows)

    names = ["id", "ids", "decoded"] if round_trip else ["id", "ids"]
    schema = f"id {kind}, ids array<int>" + ", decoded binary" * round_trip
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, *, id_col: str = "doc_id") -> DataFrame:
    """encoded with a further column decoded (binary): the bytes that the ids stand for."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = read_tokens(held.value).__getitem__
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, ends = part.column(1).flatten().to_numpy().tolist(), part.column(1).offsets.to_numpy()
                cuts = itertools.pairwise((ends - ends[0]).tolist())
                out = pa.array([b"".join(map(token, ids[a:b])) for a, b in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)

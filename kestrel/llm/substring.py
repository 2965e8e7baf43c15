"""Substring dedup: repeated windows of words are found by Rabin-Karp hashes and removed."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kestrel.llm.shared import dealt, keep, lane_tasks, running, text_or_empty
from kestrel.llm.words import Lanes, WordHashes, by_lane, chunks, mix, rows_of, squeeze, unsqueeze

CHUNK_WORDS = 500_000
#: Odd bases of the two polynomial hashes; odd numbers have inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = -(2**63)

_WINDOWS = "lane int, sub int, runs int, n int, hashes binary, places binary"
#: The rows of a document lane: flags (kind 0, places of repeats) come before texts (kind 1).
_ROWS = "lane int, sub int, kind int, runs int, n int, places binary, id long, text binary"
_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all windows of `width` hashes, from prefix sums."""
    n = len(h)
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * np.multiply.accumulate(up), out=sums[1:])
    return (sums[width:] - sums[: n - width + 1]) * np.multiply.accumulate(down)[: n - width + 1]


def _doc_place(ids: np.ndarray, docs: Lanes) -> np.ndarray:
    """lane * subs + sub of documents."""
    u = ids.view(np.uint64)
    folded = ((u ^ (u >> np.uint64(15)) ^ (u >> np.uint64(31))) & np.uint64(0x7FFFFFFF)).astype(np.int64)
    return folded % docs.lanes * docs.subs + folded // docs.lanes % docs.subs


def _doc_columns(docs: Lanes):
    folded = "((id ^ shiftrightunsigned(id, 15) ^ shiftrightunsigned(id, 31)) & 2147483647L)"
    lane = F.expr(f"cast({folded} % {docs.lanes} as int)").alias("lane")
    return lane, F.expr(f"cast({folded} div {docs.lanes} % {docs.subs} as int)").alias("sub")


def _pack(ids: np.ndarray, pos: np.ndarray) -> tuple[int, int, bytes]:
    """Places (id, position), those of an id together and in order: runs of ids, positions as differences."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    steps = np.diff(pos, prepend=0)
    steps[at] = pos[at]
    lens = np.diff(np.append(at, len(ids)))
    return len(at), len(ids), squeeze(ids[at], lens.astype(np.uint32), steps.astype(np.uint32))


def _unpack(runs: int, n: int, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, lens, steps = unsqueeze(places, ("<i8", runs), ("<u4", runs), ("<u4", n))
    lens = lens.astype(np.int64)
    total = np.cumsum(steps.astype(np.int64))
    at = np.cumsum(lens) - lens
    return np.repeat(ids, lens), total - np.repeat(total[at] - steps[at], lens)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [name for name, _ in fields]
    )


def _send(batches: Iterator[pa.RecordBatch], width: int, lanes: Lanes) -> Iterator[pa.RecordBatch]:
    """Windows of a task's documents: first ones of each hash go to the hash's lane, later ones are known repeats."""
    known = WordHashes()
    rows = (((doc,), known.of(text.split())) for doc, text in rows_of(batches))
    for values, arrays in chunks(rows, CHUNK_WORDS):
        ids = np.array([v[0] for v in values], np.int64)
        order = np.argsort(ids, kind="stable")
        ids, arrays = ids[order], [arrays[k] for k in order]
        lens = np.array([len(a) for a in arrays])
        h = np.concatenate(arrays)
        if len(h) < width:
            continue
        begin = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(ids)), lens)
        at = np.arange(len(h))
        start = np.flatnonzero(at + width <= np.repeat(begin + lens, lens))
        if not len(start):
            continue
        w, other = rolling(h, width, BASES[0])[start], rolling(h, width, BASES[1])[start]
        wid, pos = ids[doc[start]], start - begin[doc[start]]
        o = np.argsort(w, kind="stable")  # equal windows stay in order of id and position
        new = np.concatenate([[True], w[o][1:] != w[o][:-1]])
        lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
        later = o[~new & ((wid[o] != wid[lead]) | (pos[o] != pos[lead]))]
        first = np.sort(o[new])
        out: list[tuple] = []
        for lane, x in ((lane, first[x]) for lane, _, x in lanes.split(lanes.place(mix(other[first])), False)):
            runs, n, places = _pack(wid[x], pos[x])
            out.append((lane, 0, runs, n, w[x].tobytes(), places))
        if len(later):
            later = np.sort(later)
            runs, n, places = _pack(wid[later], pos[later])
            out.append((out[0][0], 0, runs, n, None, places))
        yield _batch(out, _WINDOWS)


def _split_windows(batches: Iterator[pa.RecordBatch], lanes: Lanes) -> Iterator[pa.RecordBatch]:
    """Packed windows of lanes to packed windows of subs, by bits of the hash that no lane depends on."""
    for lane, sub, runs, n, hashes, places in rows_of(batches, 16):
        if hashes is None:
            yield _batch([(lane, sub, runs, n, hashes, places)], _WINDOWS)
            continue
        w, (ids, pos) = np.frombuffer(hashes, np.uint64), _unpack(runs, n, places)
        one = Lanes(1, lanes.subs)
        rows = [(lane, s, *_pack(ids[x], pos[x]), x) for _, s, x in one.split(one.place(mix(w)), True)]
        yield _batch([(a, s, r, m, w[x].tobytes(), p) for a, s, r, m, p, x in rows], _WINDOWS)


def _own(batches: Iterator[pa.RecordBatch], docs: Lanes) -> Iterator[pa.RecordBatch]:
    """All windows of a sub: every one but the first of its hash is a repeat, and goes to its document's lane."""
    for _, subs in by_lane(batches):
        for _, rows in subs:
            done, held = [], []
            for runs, n, h, places in rows:
                found = _unpack(runs, n, places)
                done.append(found) if h is None else held.append((np.frombuffer(h, np.uint64), *found))
            if held:
                w, i, p = map(np.concatenate, zip(*held, strict=True))
                o = np.argsort(w)
                same = w[o][1:] == w[o][:-1]
                several = o[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
                o = several[np.lexsort((p[several], i[several], w[several]))]
                new = np.concatenate([[True], w[o][1:] != w[o][:-1]]) if len(o) else np.zeros(0, bool)
                lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
                later = o[~new & ((i[o] != i[lead]) | (p[o] != p[lead]))]
                done.append((i[later], p[later]))
            yield _batch(_flags(done, docs, False), _ROWS)


def _flags(found: list[tuple[np.ndarray, np.ndarray]], docs: Lanes, fine: bool) -> list[tuple]:
    """Rows of _ROWS, kind 0, of places (ids, positions)."""
    i, p = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((p, i))
    i, p = i[o], p[o]
    return [(lane, sub, 0, *_pack(i[x], p[x]), None, None) for lane, sub, x in docs.split(_doc_place(i, docs), fine)]


def _split_flags(batches: Iterator[pa.RecordBatch], docs: Lanes) -> Iterator[pa.RecordBatch]:
    """Flags of lanes to flags of subs, a bounded number at a time."""
    held, size = [], 0
    for _, _, _, runs, n, places, *_ in rows_of(batches, 64):
        held.append(_unpack(runs, n, places))
        size += n
        if size >= CHUNK_WORDS:
            yield _batch(_flags(held, docs, True), _ROWS)
            held, size = [], 0
    if held:
        yield _batch(_flags(held, docs, True), _ROWS)


def _remove(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Texts of a lane without the words that repeated windows cover; a sub's flags come before its texts."""
    out: list[tuple] = []
    size = 0
    for _, subs in by_lane(batches):
        ids = pos = np.zeros(0, np.int64)
        for _, rows in subs:
            found: list[tuple[np.ndarray, np.ndarray]] | None = []
            for kind, runs, n, places, doc, text in rows:
                if kind == 0:
                    found.append(_unpack(runs, n, places))
                    continue
                if found is not None:
                    ids, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                    o = np.argsort(ids, kind="stable")
                    ids, pos, found = ids[o], pos[o], None
                out.append((doc, *_without(text, pos[np.searchsorted(ids, doc) : np.searchsorted(ids, doc, "right")], width)))
                size += len(text)
                if size > 8 << 20 or len(out) >= 5000:
                    yield _texts(out)
                    out, size = [], 0
    if out:
        yield _texts(out)


def _without(text: bytes, repeats: np.ndarray, width: int) -> tuple[int, int, list[dict], bytes]:
    """n_words, n_removed, spans and what is left of a text whose windows at some places are repeats."""
    words = text.split()
    repeats = repeats[repeats + width <= len(words)]
    if not len(repeats):
        return len(words), 0, [], b" ".join(words)
    step = np.bincount(repeats, minlength=len(words) + 1) - np.bincount(repeats + width, minlength=len(words) + 1)
    gone = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return len(words), int(gone.sum()), spans, b" ".join(itertools.compress(words, (~gone).tolist()))


def _texts(out: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def remove_repeats(
    docs: DataFrame,
    width: int = 20,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 4 << 20,
    most_lanes: int = 4096,
) -> DataFrame:
    """Remove each word that a window of `width` words covers whose words also start earlier.

    Earlier means in a smaller id, or in the same document at an earlier word. Each task hashes all windows of its
    documents by a Rabin-Karp polynomial and sends the first window of each hash to the hash's lane, packed; copies
    inside a task are settled there. A lane's owner takes its windows in order of subs, keeps the first window of a hash
    and sends the places of the others to the lanes of their documents, where they merge into maximal removal intervals.
    Two windows are equal when two independent polynomial hashes agree: 64 bits of one and the lane number of the other;
    words aren't compared again. There are at most most_lanes lanes, with as many subs of bucket_bytes of text each as
    the texts need, so what a chunk sends and what an owner holds are bounded at any size.

    Returns id_col, n_words, n_removed, spans (intervals of word places, end excluded), kept_text (remaining words
    joined by one space). A null or empty text has no words. A null id sorts first. Texts of fewer than `width` words stay
    whole. An empty table gives no rows. Other columns are not read. Ids may be of any type that can be ordered. Rows that repeat
    id and text are one document: they get equal results and never remove each other. Rows that repeat an id with different texts are
    documents of their own, in order of a 64-bit hash of the text. Both such ids and ids that aren't whole numbers cost
    a shuffle of the texts more, as documents get numbers in their order first.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    each = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"), F.sum(F.octet_length("text").cast("long")).alias("n"))
    found = each.agg(F.sum("n").alias("n"), F.max(F.col("a") != F.col("b")).alias("several")).first()
    lanes = Lanes.of(found["n"] or 0, bucket_bytes, most_lanes)
    if not found["several"] and isinstance(rows.schema["id"].dataType, IntegralType):
        out = _removed(rows.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), "text"), width, lanes)
        return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(rows.schema["id"].dataType).alias(id_col), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept_text"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    different = keyed.select("id", "key").distinct().withColumn("one", F.lit(1))
    placed = running(different, [F.col("id").asc_nulls_first(), F.col("key")], ["one"], "repeats-order")
    order = keep(placed.select("key", F.col("id").alias("own"), F.col("before_one").alias("number")), "repeats-numbers")
    same = F.col("id").eqNullSafe(F.col("own"))
    numbered = keyed.join(order.withColumnRenamed("key", "own_key"), same & (F.col("key") == F.col("own_key")))
    out = _removed(numbered.select(F.col("number").alias("id"), "text"), width, lanes)
    return out.join(order, F.col("doc_id") == F.col("number")).select(F.col("own").alias(id_col), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept_text"))


def _removed(rows: DataFrame, width: int, lanes: Lanes) -> DataFrame:
    """_OUT of rows (id long, text binary) in which no id has two texts."""
    several, tasks = lanes.subs > 1, lane_tasks(rows.sparkSession, lanes.lanes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(batches, width, lanes)

    def split_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _split_windows(batches, lanes)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _own(batches, lanes)

    def split_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _split_flags(batches, lanes)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _remove(batches, width)

    flags = dealt(rows.mapInArrow(send, _WINDOWS), split_windows if several else None, tasks).mapInArrow(own, _ROWS)
    if several:
        flags = flags.repartition(tasks, "lane").mapInArrow(split_flags, _ROWS)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("runs", "int"), ("n", "int"), ("places", "binary"))]
    texts = rows.select(*_doc_columns(lanes), F.lit(1).alias("kind"), *none, "id", "text")
    return flags.unionByName(texts).repartition(tasks, "lane").sortWithinPartitions("lane", "sub", "kind").mapInArrow(remove, _OUT)

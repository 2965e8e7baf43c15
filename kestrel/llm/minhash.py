"""MinHash near-dedup through an LSH forest, with links confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.graph import components
from kestrel.llm.shared import SALTS, hand_back, keep, text_or_empty
from kestrel.llm.substring import BASES, rolling
from kestrel.llm.words import LOWER, WordHashes, mix, rows_of

#: Minhashes of a signature, 16 bits each.
HASHES = 96
#: Sorted orders of the signatures. Order o starts at minhash o * STEP and goes round.
ORDERS, STEP = 24, 4
#: Depths (minhashes in common) at which a region of an order may close.
LEAST_DEPTH, MOST_DEPTH = 4, 6
#: A region of more documents or shingles than these goes deeper, or is dealt in blocks at the last depth.
REGION, REGION_SHINGLES = 256, 2_000_000
#: Regions of up to so many documents give pairs, screened by their signatures; larger ones are compared as they are.
SMALL = 8
#: Standard deviations by which the signatures of a pair may fall short of the similarity asked for.
MARGIN = 5.5
#: Columns of a block's incidence matrix that are multiplied at once.
COLUMNS = 8192

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(BASES[0])) | np.uint64(1)


def shingle_set(text: bytes, width: int, known: WordHashes) -> np.ndarray:
    """Different hashes, in order, of a text's windows of `width` lower-cased words; of all words if there are fewer."""
    h = known.of(text.translate(LOWER).split())
    return np.unique(mix(rolling(h, min(width, len(h)), BASES[0]))) if len(h) else h


def signature(shingles: np.ndarray) -> bytes:
    """HASHES minhashes of 16 bits: the least of each permutation, hashed again so that all 16 bits tell apart."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 512):
        np.minimum(least, (shingles[k : k + 512, None] * _FACTORS).min(0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _digest(shingles: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers that tell sets apart."""
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8")


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        n, digests, sigs = [], [], []
        for (text,) in rows_of(iter([batch.select(["text"])])):
            shingles = shingle_set(text, width, known)
            n.append(len(shingles))
            digests.append(_digest(shingles))
            sigs.append(signature(shingles))
        s = np.array(digests, np.int64).reshape(-1, 2)
        arrays = [pa.array(n, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], batch["text_key"], *arrays], ["id", "row", "text_key", "n", "s1", "s2", "sig"])


def _region(depth: int) -> Column:
    """The region of a set in order o: what its first `depth` minhashes there hash to."""
    return F.xxhash64("o", F.expr(f"substring(concat(sig, sig), o * {2 * STEP} + 1, {2 * depth})")).alias("region")


def regions(sets: DataFrame, region: int, region_shingles: int) -> DataFrame:
    """(region, o, node, docs, blocks) of the sets that share a region with others, written once.

    sets: rows (node, n, sig). In each order, those whose first LEAST_DEPTH minhashes agree make up a region. One of more
    than `region` sets or region_shingles shingles is parted by one minhash more, and so on until its parts are small enough
    or MOST_DEPTH is reached; there, blocks says in how many blocks it is to be dealt. Only crowded regions go deeper.
    """
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("o")
    at = sets.select("node", "n", "sig", orders).select("node", "n", "o", _region(LEAST_DEPTH))
    closed = []
    for depth in range(LEAST_DEPTH, MOST_DEPTH + 1):
        sizes = at.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
        need = F.greatest(F.ceil(F.col("docs") / region), F.ceil(F.col("shingles") / region_shingles))
        sizes = keep(sizes.select("region", "docs", F.least(need, "docs").cast("int").alias("blocks")), f"minhash-regions-{depth}")
        found = keep(at.join(sizes, "region"), f"minhash-members-{depth}")
        closed.append(found if depth == MOST_DEPTH else found.where("blocks = 1"))
        crowded = found.where("blocks > 1")
        if crowded.isEmpty():
            break
        at = crowded.select("node", "n", "o").join(sets.select("node", "sig"), "node").select("node", "n", "o", _region(depth + 1))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select("region", "o", "node", "docs", "blocks")


def _pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (region, node, key) in order: pairs of one region whose signatures agree in a share of at least `least`."""
    found: list[tuple[int, int]] = []
    for _, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
        _, nodes, keys = zip(*rows, strict=True)
        sigs = np.frombuffer(b"".join(keys), "<u2").reshape(-1, HASHES)
        for k in range(len(nodes) - 1):
            for j in np.flatnonzero((sigs[k + 1 :] == sigs[k]).mean(1) >= least).tolist():
                a, b = nodes[k], nodes[k + 1 + j]
                found.append((min(a, b), max(a, b)))
        if len(found) > 50_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed under their keys; of copies that a task meets, the first."""
    met: set[int] = set()
    for batch in batches:
        keys, packed = [], []
        for key, text in rows_of(iter([batch])):
            if key not in met:
                met.add(key)
                keys.append(key)
                packed.append(len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True))
        if len(met) > 1_000_000:
            met.clear()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["text_key", "packed"])


def _set_of(packed: bytes, s1: int, width: int, known: WordHashes) -> np.ndarray | None:
    """The set of a packed text; None if it isn't the one meant (two texts may have one 64-bit key)."""
    size = int.from_bytes(packed[:8], "little")
    shingles = shingle_set(pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True), width, known)
    return shingles if _digest(shingles)[0] == s1 else None


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of rows (a, b, a_s1, a_packed, b_s1, b_packed) whose whole sets are similar enough."""
    known, last, x = WordHashes(), None, None
    for batch in batches:
        found = []
        for a, b, a_s1, a_packed, b_s1, b_packed in rows_of(iter([batch])):
            if a != last:
                x, last = _set_of(a_packed, a_s1, width, known), a
            y = _set_of(b_packed, b_s1, width, known)
            if x is not None and y is not None:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((a, b))
        yield _edges(found)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets are similar enough, each against each, by products of their incidence matrix."""
    lens = np.array(list(map(len, sets)))
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = np.repeat(np.arange(len(sets)), lens)[shared], (np.cumsum(times > 1) - 1)[column][shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for k in range(0, int((times > 1).sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [k, k + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[some], column[some] - k] = 1
        both += has @ has.T
    return 100 * both >= percent * (lens[:, None] + lens - both)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (region, low, high, node, s1, packed) in order: edges that connect what the links in each block connect."""
    known = WordHashes()
    for _, rows in itertools.groupby(rows_of(batches, 64), key=lambda r: r[:3]):
        nodes, sets = [], []
        for *_, node, s1, packed in rows:
            shingles = _set_of(packed, s1, width, known)
            if shingles is not None:
                nodes.append(node)
                sets.append(shingles)
        if len(nodes) < 2:
            continue
        near, label = linked(sets, percent), np.arange(len(nodes))
        np.fill_diagonal(near, True)
        while True:
            low = np.where(near, label, len(nodes)).min(1)
            if (low == label).all():
                break
            label = low
        yield _edges([(nodes[k], nodes[j]) for k, j in enumerate(label.tolist()) if k != j])


def _needed_texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s1, packed): a compressed text for each of some nodes, written once."""
    packed = docs.select("text_key", "text").mapInArrow(_pack, "text_key long, packed binary")
    wanted = sets.join(nodes.distinct(), "node", "left_semi").select("node", "text_key", "s1")
    return keep(packed.join(wanted, "text_key").select("node", "s1", "packed").dropDuplicates(["node", "packed"]), "minhash-texts")


def similar(docs: DataFrame, sets: DataFrame, *, width: int, percent: int, region: int, region_shingles: int) -> DataFrame:
    """Edges (a, b) between nodes of sets (node, text_key, n, s1, sig), written once; they connect what links connect.

    docs: rows (text_key, text). A region of up to SMALL sets gives its pairs whose signatures agree well enough: these are
    confirmed on the whole sets of both texts. A larger one is compared whole, each set against each.
    """
    members = regions(sets, region, region_shingles)
    key = F.expr(f"substring(concat(sig, sig), o * {2 * STEP} + 1, {2 * HASHES})").alias("key")
    small = members.where(F.col("docs") <= SMALL).join(sets.select("node", "sig"), "node").select("region", "node", key)
    share = percent / 100
    least = share - MARGIN * (share * (1 - share) / HASHES) ** 0.5
    sorted_ = small.repartition("region").sortWithinPartitions("region", "key")
    pairs = keep(sorted_.mapInArrow(partial(_pairs, least=least), "a long, b long").distinct(), "minhash-pairs")
    large = members.where(F.col("docs") > SMALL)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = _needed_texts(docs, sets, nodes.unionByName(large.select("node")))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("s1").alias(f"{c}_s1"), F.col("packed").alias(f"{c}_packed"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_s1", "a_packed", "b_s1", "b_packed")
    close = both.mapInArrow(partial(_confirm, width=width, percent=percent), "a long, b long")
    # a set meets each block of its region once: its own block is b, the other goes through all
    own = F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int")
    dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")
    blocks = dealt.join(texts, "node").select("region", "low", "high", "node", "s1", "packed")
    blocks = blocks.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")
    more = blocks.mapInArrow(partial(_blocks, width=width, percent=percent), "a long, b long")
    return keep(close.unionByName(more).distinct(), "minhash-edges")


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    region: int = REGION,
    region_shingles: int = REGION_SHINGLES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The group of near-duplicates of every document: chains of documents of Jaccard similarity percent / 100 or more.

    A document's set has its different shingles of `width` lower-cased words, or all its words as one if they are fewer; sets are
    compared as 64-bit hashes of shingles. Different sets are signed by 96 minhashes and sorted in 24 orders of them. Those with
    the longest common prefixes are candidates: the depth that counts starts at four minhashes and grows to six where a
    region of the order is crowded; still crowded regions are dealt in blocks that meet each other. Two sets of
    similarity 0.85 have no common region in 2 of 10**8 cases, and 1 of 10**5 where all their regions are crowded. All
    links are confirmed on whole sets.

    Returns id_col, n_shingles (size of the set), component_id (the smallest id that links reach, its own included),
    kept (whether that is the row's own). A null or empty text has no shingles and no links. A null id is passed over for component_id
    unless the group has no other. Ids may repeat and be of any type that can be ordered; rows of equal texts are linked. An empty table
    gives no rows. Other columns are not read.
    """
    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    kind = dict(read.dtypes)["id"]
    schema = f"id {kind}, row long, text_key long, n long, s1 long, s2 long, sig binary"
    signed = keep(read.mapInArrow(partial(_sign, width=width), schema), "minhash-signed")
    groups = signed.where("n > 0").groupBy("s1", "s2")
    sets = groups.agg(F.min("id").alias("first"), F.min(F.struct("text_key", "n", "sig")).alias("one"))
    sets = keep(sets.select("s1", "s2", "first", "one.*", F.monotonically_increasing_id().alias("node")), "minhash-sets")
    edges = similar(read.select("text_key", "text"), sets, width=width, percent=percent, region=region, region_shingles=region_shingles)
    named = _first_of_component(sets, edges)
    known = hand_back(signed.where("n > 0"), named, ["s1", "s2"], "row").select("id", "n", "first")
    out = known.unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("first")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first").alias("component_id"),
        F.col("id").eqNullSafe(F.col("first")).alias("kept"),
    )


def _first_of_component(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(s1, s2, first) with the least `first` of all sets in a component."""
    roots = keep(components(edges), "minhash-roots")
    least = roots.join(sets.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    # a component may hold a large share of all sets: its row is copied for SALTS tasks
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    found = mine.join(salted, ["root", "salt"]).select("node", "least")
    return sets.join(found, "node", "left").select("s1", "s2", F.coalesce("least", "first").alias("first"))

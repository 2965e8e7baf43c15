"""SimHash near-dedup through a popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.graph import components
from kestrel.llm.shared import ROW, SALTS, chosen, hand_back, keep, text_or_empty
from kestrel.llm.words import LOWER, rows_of

#: Shingles whose bits are counted at once.
BLOCK = 65536


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of lower-cased word shingles, repeats included; 0 for no words."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = [b" ".join(words)] if n < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(joined), BLOCK):
        h = np.array([digest(s, seed) for s in joined[k : k + BLOCK]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(joined), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text, shingle, seed) for _, text in rows_of(iter([batch.select(["id", "text"])]))]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch[ROW], pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", ROW, "fp"]
        )


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ROW, fp): the SimHash of each document as a signed 64-bit number. A null text counts as empty.

    ROW is that of docs where they are numbered, else a number of its own.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(
        F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"), row.alias(ROW)
    )
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), f"id {kind}, {ROW} long, fp long")


def _half(k: int):
    """Bit counts of the 16 two-bit segments of a half, side by side in two bits each, under the half's number."""
    bits = "fp & 4294967295L" if k else "shiftrightunsigned(fp, 32)"
    return F.expr(f"({bits}) - (shiftrightunsigned(({bits}), 1) & 1431655765L) + {k << 34}L")


def links(prints: DataFrame, *, most: int = 3, small_cell: int = 64, block: int = 4096) -> DataFrame:
    """Edges (a, b) that join different fingerprints at `most` (3 or fewer) differing bits, from rows (fp).

    A fingerprint is embedded as the bit counts of 32 two-bit segments. The Manhattan distance of two embeddings is
    a lower bound of the Hamming distance, so for 3 differing bits one of the halves of the embeddings is at distance
    0 or 1: fingerprints sit in the grid cells of their halves, look into their own cell and those one step up, and
    what they meet is verified exactly. Cells of up to small_cell fingerprints are joined directly. The
    others are dealt in blocks of about `block`, and each pair of blocks gives a spanning forest of its links instead
    of all of them, so the edges connect what the links connect.
    """
    if most > 3:
        raise ValueError("the grid covers up to 3 differing bits")
    inside = prints.select("fp", F.explode(F.array(_half(0), _half(1))).alias("cell"))
    steps = [
        F.when(F.expr(f"(shiftrightunsigned(cell, {2 * i}) & 3) < 2"), F.col("cell") + (1 << (2 * i)))
        for i in range(16)
    ]
    looks = inside.select(
        F.col("fp").alias("other"), F.posexplode(F.array_compact(F.array(F.col("cell"), *steps))).alias("step", "cell")
    )
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most) & (F.col("fp") != F.col("other"))
    near &= (F.col("step") > 0) | (F.col("fp") < F.col("other"))  # each pair of one cell once
    crowded = keep(inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_cell), "crowded")
    if crowded.isEmpty():
        return inside.join(looks, "cell").where(near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    plain = inside.join(crowded, "cell", "left_anti").join(looks, "cell").where(near)
    looking = looks.select("cell", F.col("other").alias("fp")).join(crowded.select("cell"), "cell")
    counts = looking.groupBy("cell").agg(F.count(F.lit(1)).alias("lookers"))
    cells = keep(
        crowded.join(counts, "cell").select(
            "cell",
            F.ceil(F.col("n") / block).cast("int").alias("ins"),
            F.ceil(F.col("lookers") / block).cast("int").alias("outs"),
        ),
        "crowded-blocks",
    )
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("fp", "cell"), F.col(n)).cast("int")
    held = inside.join(cells, "cell").select(
        "cell", "fp", F.lit(0).alias("looks"), mine("ins").alias("i"), F.explode(each("outs")).alias("o")
    )
    met = looking.join(cells, "cell").select(
        "cell", "fp", F.lit(1).alias("looks"), F.explode(each("ins")).alias("i"), mine("outs").alias("o")
    )

    def forest_of(table: pa.Table) -> pa.Table:
        return _forest(table, most)

    forest = held.unionByName(met).groupBy("cell", "i", "o").applyInArrow(forest_of, "a long, b long")
    return plain.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(forest)


def _forest(table: pa.Table, most: int) -> pa.Table:
    """A star per component of the links between the looking and the held fingerprints of a block."""
    fp, looks = table["fp"].to_numpy().view(np.uint64), table["looks"].to_numpy()
    nodes = np.unique(fp)
    held, met = (np.searchsorted(nodes, np.unique(fp[looks == k])) for k in (0, 1))
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = label.copy()
        for k in range(0, len(met), 256):
            m = met[k : k + 256]
            near = np.bitwise_count(nodes[m][:, None] ^ nodes[held][None, :]) <= most
            np.minimum.at(low, m, np.where(near, label[held][None, :], len(nodes)).min(1))
            np.minimum.at(low, held, np.where(near, label[m][:, None], len(nodes)).min(0))
        np.minimum.at(label, before, low)  # a root takes the least label that its members meet
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    apart = np.flatnonzero(label != np.arange(len(nodes)))
    signed = nodes.view(np.int64)
    return pa.table({"a": signed[apart], "b": signed[label[apart]]})


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 3,
    seed: int = 42,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The group of near-duplicates of every document.

    Returns id_col, fp (signed 64-bit SimHash), component_id (the smallest id that links reach, its own included),
    kept (true for one row of the group, of those with that id).
    Documents of equal fingerprints are linked; texts without words have fingerprint 0 and are linked like any
    other. Shorter texts than a shingle are one shingle. Null ids are passed over for component_id unless the group
    has no other. Ids may be of any type that can be ordered. Rows may repeat. An empty table gives no rows. Of other columns only ROW is read, and returned, where docs
    are numbered.
    """
    marked = keep(fingerprints(docs, shingle, seed, id_col=id_col, text_col=text_col), "simhash")
    place = F.struct(F.col("id").isNull().alias("none"), "id", ROW)  # null ids come last
    distinct = keep(marked.groupBy("fp").agg(F.min(place).alias("first")), "simhash-distinct")
    roots = keep(components(links(distinct.select("fp"), most=most)), "simhash-roots")
    firsts = roots.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("stands"))
    # a component may hold a large share of all fingerprints: its row is copied for SALTS tasks
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    linked = mine.join(salted, ["root", "salt"]).select(F.col("node").alias("fp"), "stands")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("stands", "first").alias("stands"))
    return hand_back(marked, named, ["fp"], ROW).select(
        F.col("id").alias(id_col),
        "fp",
        F.col("stands.id").alias("component_id"),
        (F.col(ROW) == F.col(f"stands.{ROW}")).alias("kept"),
        *[c for c in docs.columns if c == ROW],
    )


def one_of_each(docs: DataFrame, groups: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """The documents that stand for their groups. Columns are those of docs.

    `by` tells rows apart: ROW of numbered documents, or an id that never repeats.
    """
    return chosen(docs, groups.where("kept"), by)

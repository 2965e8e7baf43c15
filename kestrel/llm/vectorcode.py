"""Vector code compression: product codes whose codebooks are searched through kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import hand_back, keep

#: Entries of a leaf of a tree.
LEAF = 8
#: Whole numbers are held between -LIMIT and LIMIT, so squared distances of up to 8,192 components fit in 64 bits.
LIMIT = 1 << 24


@dataclass
class Node:
    """A box (low and high corner) around some entries; a leaf names them, others have two halves."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    halves: tuple[Node, Node] | None = None

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the box: no entry inside is nearer."""
        out = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (out * out).sum(1)


def build_tree(book: np.ndarray, which: np.ndarray | None = None) -> Node:
    """A kd-tree over the rows of a codebook, cut at the median of the widest component."""
    which = np.arange(len(book)) if which is None else which
    some = book[which]
    node = Node(some.min(0), some.max(0))
    width = node.high - node.low
    if len(which) <= LEAF or not width.any():  # equal entries can't be parted
        node.entries = which
        return node
    at = int(width.argmax())
    middle = np.sort(some[:, at])[(len(which) - 1) // 2]
    middle = middle if middle < node.high[at] else middle - 1
    left = some[:, at] <= middle
    node.halves = build_tree(book, which[left]), build_tree(book, which[~left])
    return node


def nearest(tree: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row of x; of equally near ones, the lower index.

    Branch and bound over all rows at once: rows go to the nearer half first, then to the other unless their best so
    far is less than its bound. A half at just that bound is visited, as it may hold a lower index at the same distance.
    """
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), len(book))

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.halves is None:
            mine = x[rows]
            for entry in node.entries.tolist():
                apart = mine - book[entry]
                d = (apart * apart).sum(1)
                least = best[rows]
                wins = (d < least) | ((d == least) & (entry < index[rows]))
                won = rows[wins]
                best[won], index[won] = d[wins], entry
            return
        bounds = [half.bound(x[rows]) for half in node.halves]
        left_first = bounds[0] <= bounds[1]
        for near, some in ((0, left_first), (1, ~left_first)):
            mine = rows[some]
            if len(mine):
                visit(node.halves[near], mine)
                other = mine[bounds[1 - near][some] <= best[mine]]
                if len(other):
                    visit(node.halves[1 - near], other)

    visit(tree, np.arange(len(x)))
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries as whole numbers: [part, entry, component]. entries are at most 256, so a code is a byte a part."""

    books: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Approximate vectors of codes, shape (n, parts)."""
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1) / self.scale


def kept_vectors(df: DataFrame, vector_col: str = "embedding") -> Column:
    """Whether a row's vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector_col).isNotNull() & F.coalesce(F.forall(vector_col, finite), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held between -LIMIT and LIMIT."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def _vectors(batch: pa.RecordBatch, scale: int, width: int) -> np.ndarray:
    return whole(batch["vector"].flatten().to_numpy(zero_copy_only=False), scale).reshape(batch.num_rows, width)


def _parts(x: np.ndarray, trees, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components of all rows, index, distance)."""
    each = books.shape[2]
    for part, tree in enumerate(trees):
        mine = x[:, part * each : (part + 1) * each]
        yield part, mine, *nearest(tree, books[part], mine)


def train(
    df: DataFrame,
    *,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Codebooks | None:
    """Codebooks for `parts` equal consecutive parts of the vectors, or None where there is no vector.

    Components become whole numbers floor(scale * x), so all sums are exact and no order of rows matters. A codebook starts
    as that part of the vectors of the `entries` smallest ids (null ids last, equal ids by vector). In each round every part of every
    row goes to its nearest entry, by the kd-tree that the driver builds and broadcasts, and each task gives counts and
    sums of its entries; an entry becomes floor(sum / count), one without parts stays. What is broadcast and
    collected is entries x components, whatever the number of rows. See encode for rows that are passed over.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has between 1 and 256 entries")
    rows = df.where(kept_vectors(df, vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["vector"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    start = whole(np.array([r["vector"] for r in first if len(r["vector"]) == width], np.float64), scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).swapaxes(0, 1))
    for _ in range(rounds):
        books = _improved(rows.where(F.size("vector") == width), books, scale)
    return Codebooks(books, scale)


def _improved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, each = books.shape
    shared = rows.sparkSession.sparkContext.broadcast([build_tree(book) for book in books])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, each), np.int64)
        for batch in batches:
            for part, mine, index, _ in _parts(_vectors(batch, scale, parts * each), shared.value, books):
                n[part] += np.bincount(index, minlength=entries)
                np.add.at(total[part], index, mine)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
             pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    found = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    each_sum = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(each)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each_sum).collect():  # a row per entry
        out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(each)]
    shared.unpersist()
    return out


def encode(
    df: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Codes of all vectors: id_col, label_col, code binary (a byte a part), error long (squared distance in whole numbers).

    Rows whose vector is null, or has null or non-finite components, or another length than the codebooks', give no row;
    ids and labels may be null or repeat, and equal vectors get equal codes. Whole numbers are held within 2**24, so
    components of over 65,536 in size (at a scale of 256) count as that. Of other columns none is read.
    """
    width, spark = books.width, df.sparkSession
    rows = df.where(kept_vectors(df, vector_col) & (F.size(vector_col) == width))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    shared = spark.sparkContext.broadcast([build_tree(book) for book in books.books])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((batch.num_rows, len(books.books)), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for part, _, index, d in _parts(_vectors(batch, books.scale, width), shared.value, books.books):
                code[:, part] = index
                error += d
            packed = pa.array([row.tobytes() for row in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], packed, pa.array(error)], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")


def with_label_errors(coded: DataFrame, *, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """coded plus label_error: the error of all rows of the same label, null being a label.

    Errors are summed before the shuffle and handed back by salted joins, so a label may hold any share of the rows.
    """
    rows = keep(coded.withColumn("__kestrel_label", F.struct(F.col(label_col).alias("l"))), "vector-codes")
    sums = rows.groupBy("__kestrel_label").agg(F.sum("error").alias("label_error"))
    return hand_back(rows, sums, ["__kestrel_label"], id_col).drop("__kestrel_label")

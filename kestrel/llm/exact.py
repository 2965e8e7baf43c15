"""Exact dedup through an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.shared import ROW, SALTS, SPACE, chosen, hand_back, keep, text_or_empty


def normalised(text: Column) -> Column:
    """Each run of the six ASCII spaces becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


def _prefix(depth: int) -> Column:
    """The first `depth` bits of the 64-bit key."""
    return F.expr(f"shiftrightunsigned(key, {64 - depth})").cast("long") if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int) -> DataFrame:
    """The directory of an extendible-hash index over rows (key long, n long: entries under the key).

    It starts with one bucket of depth 0. In each round the directory doubles: keys of overfull buckets look at one
    bit more, all other buckets are closed as they are; keys that are still open are written each round. A bucket of one
    key can't be split, however many entries chain there, and 64 bits tell any two keys apart. Returns the buckets: depth int, bucket long (the first depth bits), n long.
    """
    open_keys = keys.groupBy("key").agg(F.sum("n").alias("n"))
    closed: list[DataFrame] = []
    depth = 0
    while True:
        at = open_keys.withColumn("depth", F.lit(depth)).withColumn("bucket", _prefix(depth))
        buckets = at.groupBy("depth", "bucket").agg(
            F.sum("n").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        buckets = keep(buckets, f"directory-{depth}")
        over = (F.col("n") > capacity) & (F.col("low") != F.col("high"))
        closed.append(buckets.where(~over).select("depth", "bucket", "n"))
        overfull = buckets.where(over).select("bucket")
        if overfull.isEmpty():
            break
        open_keys = keep(at.join(overfull, "bucket", "left_semi").select("key", "n"), f"directory-keys-{depth}")
        depth += 1
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def route(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """Narrow rows (key, ...) with the depth and bucket that the directory gives their key."""
    depths = [r["depth"] for r in directory.select("depth").distinct().collect()]  # 65 at most
    slots = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("bucket")) for d in sorted(depths) or [0]])
    probes = rows.withColumn("slot", F.explode(slots)).select("*", "slot.depth", "slot.bucket").drop("slot")
    # MOST_BUCKETS at most
    return probes.join(F.broadcast(directory.select("depth", "bucket")), ["depth", "bucket"], "left_semi")


def hashed(norm: Column) -> Column:
    """The 64-bit key of a normalised text."""
    return F.xxhash64(norm)


#: A directory has at most about so many buckets, which makes it small enough to send to every task.
MOST_BUCKETS = 65_536
#: Keys with more than a share of 1 / HOT_SHARE of all rows are combined before they go to their owner.
HOT_SHARE = 10_000


def chain_of() -> Column:
    """The place of a text among those of its key, found by comparing them."""
    return F.dense_rank().over(Window.partitionBy("owner", "key").orderBy("norm"))


def owned_texts(keyed: DataFrame, keys: DataFrame, owners: int, hot: int) -> DataFrame:
    """(key, chain, sha, keep_id, group_size): one row per different text of keyed (id, key, norm), from the owners of key ranges.

    keys: rows (key, n). Each owner takes a range of keys, sorts its texts by key and text, and chains the different texts of a
    key by comparing them whole. Rows of keys that more than `hot` rows have are combined in tasks and once
    more by salts, so an owner gets SALTS copies of a text at most; at most HOT_SHARE keys can be that frequent.
    """
    rows = keys.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    busy = keys.where(F.col("n") > max(hot, -(-rows // HOT_SHARE))).select("key", F.lit(True).alias("busy"))
    marked = keyed.join(F.broadcast(busy), "key", "left")  # HOT_SHARE rows at most
    plain = marked.where("busy is null").select("key", "norm", F.col("id").alias("first"), F.lit(1).cast("long").alias("n"))
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    copies = marked.where("busy").groupBy("key", "norm", salt.alias("salt")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    texts = plain.unionByName(copies.select("key", "norm", "first", "n"))
    # ranges of the key's upper half: equal in size, as keys are hashes
    owner = F.expr(f"cast((shiftrightunsigned(key, 32) * {owners}L) >> 32 as int)")
    dealt = texts.withColumn("owner", owner).repartition(owners, "owner")
    chained = dealt.select("owner", "key", chain_of().alias("chain"), F.unhex(F.sha2("norm", 256)).alias("sha"), "first", "n")
    found = chained.groupBy("owner", "key", "chain").agg(F.min("sha").alias("sha"), F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))
    return found.drop("owner")


def build_index(
    docs: DataFrame, *, capacity: int = 50_000, hot: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, directory, index) over the normalised texts of docs.

    entries: one row per document: id, key (64-bit hash of the normalised text), sha (its SHA-256), ROW (that of docs
    where they are numbered, else a number of its own). directory: the buckets that build_directory makes of the different
    keys; capacity grows where there would be over MOST_BUCKETS. index: one row per different text: bucket, depth, key,
    chain (place among the texts of one key), sha, keep_id, group_size, written to the shared folder, files holding ranges of keys.

    The directory says how many owners there are, and under which bucket an owner files a text. Owners decide: see owned_texts.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("norm"), row.alias(ROW))
    keyed = rows.select("id", hashed(F.col("norm")).alias("key"), "norm", ROW)
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    entries = keep(keyed.select("id", "key", sha, ROW), "exact-entries")
    keys = keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    capacity = max(capacity, -(-keys.count() // (MOST_BUCKETS // 2)))
    directory = build_directory(keys.withColumn("n", F.lit(1).cast("long")), capacity)
    owners = max(directory.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = route(owned_texts(keyed.drop(ROW), keys, owners, hot), directory)
    index = index.select("depth", "bucket", "key", "sha", "keep_id", "group_size", "chain")
    return entries, directory, keep(index.repartitionByRange("key").sortWithinPartitions("key", "chain"), "exact-index")


def exact_duplicates(
    docs: DataFrame, *, capacity: int = 50_000, hot: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Which documents are copies: texts are equal when identical after normalised().

    Returns, per document, id_col, keep_id (the smallest id of its group), group_size, kept, text_sha256. A null text
    counts as empty. Of rows that repeat an id and a text one is kept. Null ids are ignored for keep_id unless the
    group has no other. An empty table gives no rows. Of other columns only ROW is read, and returned, where docs are
    numbered.
    """
    entries, _, index = build_index(docs, capacity=capacity, hot=hot, id_col=id_col, text_col=text_col)
    ties = Window.partitionBy("key", "sha", "id").orderBy(ROW)
    # a key's texts are chained in the index; the digest says which of them a document has
    found = hand_back(
        entries.withColumn("tie", F.row_number().over(ties)),
        index.select("key", "sha", "keep_id", "group_size"),
        ["key", "sha"],
        ROW,
    )
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *[c for c in docs.columns if c == ROW],
    )


def first_copies(docs: DataFrame, marks: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """The documents that exact_duplicates keeps. Columns are those of docs.

    `by` tells rows apart: ROW of numbered documents, or an id that never repeats.
    """
    return chosen(docs, marks.where("kept"), by)

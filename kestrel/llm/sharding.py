"""Contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import keep, running, text_or_empty


def assign_shards(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_overhead: int = 16,
) -> DataFrame:
    """Cut the documents, in the order of their ids, into n_shards contiguous shards of near equal bytes.

    A row weighs its text's UTF-8 bytes plus row_overhead. Rows are range-partitioned by id and written without their
    texts; totals of the partitions give each partition's offset, a running sum inside a partition gives each row's,
    and the row goes to the shard that holds the middle of its bytes. The number of partitions only spreads the
    work: the result doesn't depend on it.

    Returns id_col, size, text_crc32, shard, slot (gapless from 0 in each shard), start_byte.

    A null or empty text weighs row_overhead and has checksum 0. A null id sorts first. Rows with equal ids are
    ordered by checksum, then size; rows equal in all three are interchangeable. An empty table gives no rows. A
    row larger than a shard takes that shard and leaves neighbours empty. Other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + F.lit(row_overhead)).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    dealt = running(rows, [F.col(c) for c in ("id", "text_crc32", "size")], ["size", "one"], "shard-sizes")
    all_bytes = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    middle = (F.col("before_size") * 2 + F.col("size")).cast("decimal(38,0)") * n_shards
    placed = dealt.select(
        "id",
        "size",
        "text_crc32",
        F.floor(middle / F.lit(max(all_bytes, 1) * 2).cast("decimal(19,0)")).cast("int").alias("shard"),
        F.col("before_one").alias("rank"),
        F.col("before_size").alias("start_byte"),
    )
    placed = keep(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows at most
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        "start_byte",
    )

"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import hand_back, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds hang every node on the smallest neighbour it knows; each round is
    written to the shared folder. A node of many neighbours hands its least one to them by salted joins. Rounds go on until one changes nothing, however many that takes (about the logarithm
    of the longest path). Self loops and repeats do no harm; null ends are left out; an empty table gives no rows.
    """
    pairs = keep(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen, now = None, _signature(pairs)
    while now[0] and now != seen:
        seen = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            hand_back(both, least, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hand_back(large, least, ["u"], "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _signature(pairs)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(pairs: DataFrame) -> tuple:
    x = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(x), F.sum(x.bitwiseAND(0xFFFFFFFF))).first())

"""Mixing sources to target weights by exact token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.shared import ROW, WORD, fresh, keep, running, text_or_empty


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), *, most_repeats: int = 3, share: float = 1.0
) -> DataFrame:
    """Targets of sources, from one row per source (source, source_size).

    Sources in code point order (null last) weigh weights[0], weights[1], ... in turn. They share `share` of all
    sizes by weight, but none gets more than most_repeats times its own size; the excess is shared again until
    nobody is above. That is water filling: sources sorted by size per weight are full up to some rank, and the
    rest get one level times their weight.

    Returns source, source_size, weight, target double. An empty table gives no rows; sources of size 0 get 0.
    """
    sizes = sizes.withColumn("one", F.lit(1).cast("long"))
    # UTF-8 bytes compare as code points do
    named = running(sizes, [F.col("source").asc_nulls_last()], ["one"], "mix-places")
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("before_one"), F.lit(len(weights))))
    rows = named.withColumn("weight", w).withColumn("cap", F.col("source_size") * most_repeats)
    rows = rows.withColumn("rate", F.col("cap") / F.col("weight")).drop("one", "before_one")
    filled = running(rows, [F.col("rate"), F.col("weight"), F.col("source").asc_nulls_last()], ["cap", "weight"], "mix-fill")
    all_ = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, weight = (all_["size"] or 0) * share, all_["weight"] or 0
    rows = (
        # the level that would hold if exactly the sources before this one were full
        filled.withColumn("level", (F.lit(float(budget)) - F.col("before_cap")) / (F.lit(weight) - F.col("before_weight")))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    least = rows.agg(F.min(F.when(~F.col("full"), F.struct("before_cap", "level")))["level"].alias("level")).first()["level"]
    return rows.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full"), F.col("cap").cast("double"))
        .otherwise(F.lit(least).cast("double") * F.col("weight"))
        .cast("double")
        .alias("target"),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    *,
    most_repeats: int = 3,
    share: float = 1.0,
    slice_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "",
) -> DataFrame:
    """How many words of every document a mix to the weights takes.

    A document's size is its number of words. Its random key is the MD5 of seed and id, so runs agree. A source takes
    every document floor(target / size) times, then documents in the order of their keys until the rest of the
    target, rounded down, is used up exactly: the document at the cut is taken in part. Keys are uniform, so their
    first digits cut each source into balanced ranges of about slice_rows rows or fewer; totals of the ranges give
    offsets and a running sum goes on inside each. slice_rows only spreads the work.

    Returns id_col, source_col, size, source_size, target, taken.

    A null text counts as empty and a document of no words is taken 0 times. A null source is a source of its own,
    the last. Documents with equal ids are ordered by size; rows equal in id and size by ROW, or as it comes. An empty
    table gives no rows. Of other columns only ROW is read, and returned, where docs are numbered.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    row = [c for c in docs.columns if c == ROW]
    rows = keep(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_or_empty(text_col)).alias("size"),
            key.alias("key"),
            *row,
        ),
        "mix-sizes",
    )
    digits = max(1, len(f"{rows.count() // slice_rows:x}"))
    rows = rows.withColumn("slice", F.substring("key", 1, digits))
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = totals.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sizes, weights, most_repeats=most_repeats, share=share)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .alias("o")
        .join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select("o.source", "o.slice", "o.before", "t.source_size", "t.target")
    )
    offsets = keep(offsets, "mix-offsets")
    walk = Window.partitionBy("r.source", "r.slice").orderBy("r.key", "r.id", "r.size", *row)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        rows.alias("r")
        .join(
            offsets.alias("o"),
            F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.slice") == F.col("o.slice")),
        )
        .withColumn("epochs", whole)
        .withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
        .withColumn("start", F.col("before") + F.sum("r.size").over(walk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("r.size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("r.size"), F.col("rest") - F.col("start"))))
        .select(
            F.col("r.id").alias(id_col),
            F.col("r.source").alias(source_col),
            F.col("r.size").alias("size"),
            F.col("source_size").cast("long").alias("source_size"),
            "target",
            (F.col("epochs") * F.col("r.size") + F.col("part")).cast("long").alias("taken"),
            *row,
        )
    )


def mixed_documents(docs: DataFrame, mix: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """The documents of a mix, each as often as it is taken; one cut in part counts as taken whole.

    Documents that the mix doesn't take are left out. Columns are those of docs. `by` tells rows apart: ROW of numbered
    documents, or an id that never repeats.
    """
    key, copies = fresh(docs, by), fresh(docs, "copies")
    take = mix.where(F.col("taken") > 0).select(
        F.col(by).alias(key), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(copies)
    )
    found = docs.join(take, F.col(by).eqNullSafe(F.col(key)))
    each = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(fresh(found, "copy"))
    return found.select("*", each).select(*[F.col(f"`{c}`") for c in docs.columns])

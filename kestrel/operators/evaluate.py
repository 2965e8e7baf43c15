"""Evaluation: confusion counts, rates, curves, sweeps, quantiles, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, hit: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn with recall, precision, fpr, f1 and acc, in all or by columns."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = (
        counts.withColumn("recall", ratio(tp, tp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("fpr", ratio(fp, fp + tn))
        .withColumn("acc", ratio(tp + tn, tp + fp + tn + fn))
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_family(df: DataFrame, hits: dict[str, Column], family: str = "family") -> DataFrame:
    """Rows and hits of each family, and of ALL."""
    return df.rollup(family).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(hit).alias(name) for name, hit in hits.items()]
    ).withColumn(family, F.coalesce(family, F.lit("ALL")))


def recall_by(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """(by, n, recall) of each value of a column, the most frequent first."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("recall"))
    return counts.orderBy(F.desc("n"), by)


def macro_average(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """macro: the mean over groups of the share of hits."""
    return recall_by(df, by, hit).agg(F.avg("recall").alias("macro"))


def wild_recall(df: DataFrame, hit: Column, resembling: Column) -> DataFrame:
    """n, flagged, resembling, flagged_resembling: how many rows there are, are hit, resemble a brand, and both."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("flagged"), F.count_if(resembling).alias("resembling"),
        F.count_if(hit & resembling).alias("flagged_resembling"),
    )


def latency(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, mean, worst) of a measure."""
    return df.groupBy(by).agg(F.avg(column).alias("mean"), F.max(column).alias("worst"))


#: Rows that a range or slice should hold at most.
RANGE_ROWS = 1_000_000


def in_ranges(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """df plus part: the range of a numeric column, by cuts at its approximate quantiles.

    There are as many ranges as hold RANGE_ROWS rows each (8 at least, 4,096 at most), unless buckets says how many.

    The part is a plain function of the value, so a running sum over everything becomes one inside each part after the
    totals of the parts before, and no task has to sort all rows. Equal values share a part.
    """
    if buckets is None:
        buckets = min(4096, max(8, -(-df.count() // RANGE_ROWS)))
    wanted = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(df.agg(F.percentile_approx(column, wanted, 100 * buckets).alias("c")).first()["c"] or []))

    def search(low: int, high: int) -> Column:
        """By halves, so that the condition of a row has as many steps as the logarithm of the ranges."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) < cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    if len(cuts) <= 256:
        return df.withColumn("part", search(0, len(cuts)))
    # more cuts than code should spell: those of the row's own block of 64, found by the blocks' first cuts
    blocks = [cuts[k : k + 64] for k in range(0, len(cuts), 64)]
    at = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda c: c <= F.col(column)))
    mine = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.greatest(at - 1, F.lit(0)))
    inside = F.size(F.filter(mine, lambda c: c <= F.col(column)))
    return df.withColumn("part", F.greatest(at - 1, F.lit(0)) * 64 + inside)


def _before(parts: DataFrame, descending: bool, **sums: str) -> DataFrame:
    """Totals of the parts before each part; a row per part."""
    w = Window.orderBy(F.desc("part") if descending else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    return F.broadcast(totals.select("part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums]))


def exact_quantiles(df: DataFrame, column: str, at: list[float], buckets: int | None = None) -> DataFrame:
    """(p, value): the value at place min(n - 1, floor(p n)) of the sorted column, counted from 0.

    Only the ranges of values that hold a wanted place are sorted. Nulls are left out.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    dealt = in_ranges(values, "v", buckets).withColumn("one", F.lit(1))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    held = sizes.join(_before(dealt, False, start="one"), "part")
    spark, n = df.sparkSession, values.count()
    if not n:
        return spark.createDataFrame([], "p double, value double")
    wanted = spark.createDataFrame([(p, min(n - 1, int(p * n))) for p in at], "p double, place long")
    holds = wanted.join(F.broadcast(held), (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("m")))
    ranked = dealt.join(F.broadcast(holds.select("part", "start").distinct()), "part").withColumn(
        "place", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
    )
    return holds.select("p", "place").join(ranked.select("place", "v"), "place").select("p", F.col("v").alias("value"))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """auc by the rank sum of positives, ties at their mean rank. Aggregated to scores first, so ties cost one row."""
    groups = df.select(F.col(score).alias("s"), positive.cast("long").alias("y")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    dealt = in_ranges(groups, "s")
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(_before(dealt, False, start="n"), "part").withColumn(
        "rank", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2
    )
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    p, q = F.col("p"), F.col("q")
    return sums.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).otherwise(0.0).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: Column, order: str) -> DataFrame:
    """ap: mean precision at each positive, by score from high to low, ties in the order of a column."""
    rows = df.select(F.col(score).alias("s"), F.col(order).alias("o"), positive.cast("long").alias("y"), F.lit(1).alias("one"))
    dealt = in_ranges(rows, "s")
    walk = Window.partitionBy("part").orderBy(F.desc("s"), "o").rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        dealt.join(_before(dealt, True, tp_before="y", k_before="one"), "part")
        .withColumn("tp", F.col("tp_before") + F.sum("y").over(walk))
        .withColumn("k", F.col("k_before") + F.count(F.lit(1)).over(walk))
    )
    return seen.where("y = 1").agg(F.coalesce(F.avg(F.col("tp") / F.col("k")), F.lit(0.0)).alias("ap"))


def threshold_grid(low: float, high: float, step: float = 0.01) -> list[float]:
    """low, low + step, ... below high, by running sums in floating point."""
    out, t = [], low
    while t < high:
        out.append(t)
        t += step
    return out


def sweep(df: DataFrame, score: str, positive: Column, grid: list[float]) -> DataFrame:
    """(t, tp, fp, fn, f1) of every threshold: rows are counted once by how many thresholds they reach."""
    reached = sum((F.when(F.col("s") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    counts = (
        df.select(F.col(score).alias("s"), positive.cast("long").alias("y"))
        .groupBy(reached.alias("k"))
        .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    )
    levels = df.sparkSession.createDataFrame(list(enumerate(grid, 1)), "level int, t double")
    total = F.broadcast(counts.agg(F.sum("p").alias("all_p")))
    joined = levels.join(F.broadcast(counts), F.col("k") >= F.col("level"), "left").groupBy("level", "t").agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("q"), F.lit(0)).alias("fp")
    )
    out = joined.crossJoin(total).withColumn("fn", F.coalesce("all_p", F.lit(0)) - F.col("tp"))
    return out.select("t", "tp", "fp", "fn", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the best f1; the first of equal ones."""
    return swept.orderBy(F.desc("f1"), "t").limit(1)


def block_threshold(df: DataFrame, score: str, positive: Column, warn: float) -> DataFrame:
    """Above warn and above every negative, at most 0.995."""
    worst = F.coalesce(F.max(F.when(~positive, F.col(score))), F.lit(0.0))
    return df.agg(F.least(F.lit(0.995), F.greatest(F.lit(warn + 0.02), worst + 0.001)).alias("block"))


def shuffled_rank(df: DataFrame, by: str, key: str, seed: str = "", digits: int | None = None) -> DataFrame:
    """df plus rank (from 1) in each stratum's order of the key's MD5, and of, the stratum's size.

    MD5 is uniform, so its first digits cut every stratum into balanced slices that are ranked apart; the sizes of the
    slices before are added. A stratum may hold most rows.
    """
    if digits is None:
        digits = max(1, len(f"{df.count() // RANGE_ROWS:x}"))
    turn = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    rows = df.withColumn("__turn", turn).withColumn("__slice", F.substring("__turn", 1, digits)).withColumn("__by", F.col(by))
    sizes = rows.groupBy("__by", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__by")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(
        F.col("__by").alias("__ob"), F.col("__slice").alias("__os"), before.alias("__before"), F.sum("__n").over(w).alias("of")
    )
    placed = rows.join(offsets, F.col("__by").eqNullSafe(F.col("__ob")) & (F.col("__slice") == F.col("__os")))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__by", "__slice").orderBy("__turn", key))
    return placed.withColumn("rank", rank).select(*[F.col(f"`{c}`") for c in df.columns], "rank", "of")


def stratified_split(df: DataFrame, by: str, key: str, share: float = 0.7, seed: str = "") -> DataFrame:
    """df plus train: the first floor(share * n) of each stratum in the order of the key's MD5; sizes are exact."""
    ranked = shuffled_rank(df, by, key, seed)
    return ranked.withColumn("train", F.col("rank") <= F.floor(F.lit(share) * F.col("of"))).drop("rank", "of")


def folds(df: DataFrame, by: str, key: str, k: int = 5, seed: str = "") -> DataFrame:
    """df plus fold: place in the stratum's shuffled order, modulo k."""
    return shuffled_rank(df, by, key, seed).withColumn("fold", (F.col("rank") - 1) % k).drop("rank", "of")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    least = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__x"))
    return least.select(*keys, "__x.*").select(*df.columns)


def signal_tally(verdicts: DataFrame, examples: int = 25) -> DataFrame:
    """How many verdicts carry each first signal, with and without a brand, and the first hosts without one as examples.

    Examples are `examples` different hosts at most, in order, with their level. The first of each task are found before the shuffle, so a
    label that most verdicts carry is no burden.
    """
    label = F.get("signals", F.lit(0))["label"].alias("label")
    counts = verdicts.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("brand").isNotNull()).alias("pinned"), F.count_if(F.col("brand").isNull()).alias("unpinned")
    )
    free = verdicts.where(F.col("brand").isNull()).select(label, F.concat("host", F.lit(" ["), "level", F.lit("]")).alias("example")).distinct()
    first = free.withColumn("__k", F.row_number().over(Window.partitionBy("label").orderBy("example"))).where(F.col("__k") <= examples)
    some = first.groupBy(F.col("label").alias("__label")).agg(F.sort_array(F.collect_list("example")).alias("examples"))
    joined = counts.join(some, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
    return joined.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def complexity(spark: SparkSession, brand_length: int = 14) -> DataFrame:
    """(n, ops): cells filled for labels of 4 to 24 characters."""
    return spark.range(4, 25).select(F.col("id").cast("int").alias("n"), (F.col("id") * brand_length).cast("int").alias("ops"))


def out_of_fold(df: DataFrame, names: list[str], k: int = 5, rounds: int = 300, used: list[str] | None = None) -> DataFrame:
    """df (with y and fold) plus probability, each row scored by the model of the other folds.

    The k models are trained in the same passes. Of names only `used` ones, where given, are features.
    """
    from kestrel.operators.features import probability, train_models

    fits, _ = train_models(df, names, leave_out="fold", groups=list(range(k)), used=[used] * k if used else None, rounds=rounds)
    return df.withColumn("probability", F.coalesce(*[F.when(F.col("fold") == f, probability(*fit)) for f, fit in enumerate(fits)]))


def ablation(df: DataFrame, names: list[str], sets: dict[str, list[str]], k: int = 5, rounds: int = 300, places: int = 6) -> DataFrame:
    """(features, auc) of out-of-fold probabilities with each of several sets of features; all models in the same passes.

    Probabilities are rounded to `places` before they are ranked.
    """
    from kestrel.operators.features import probability, train_models

    fits, _ = train_models(
        df, names, leave_out="fold", groups=list(range(k)) * len(sets), used=[u for u in sets.values() for _ in range(k)], rounds=rounds
    )
    out = None
    for j, name in enumerate(sets):
        mine = F.coalesce(*[F.when(F.col("fold") == f, probability(*fits[j * k + f])) for f in range(k)])
        scored = df.select("y", F.round(mine, places).alias("p"))
        part = roc_auc(scored, "p", F.col("y") == 1).select(F.lit(name).alias("features"), F.round("auc", places).alias("auc"))
        out = part if out is None else out.unionByName(part)
    return out


def overfitting(df: DataFrame, names: list[str], k: int = 5, rounds: int = 300, grid: list[float] | None = None) -> DataFrame:
    """(threshold, resubstitution_f1, out_of_fold_f1, gap) of df (with y and fold): how much better a model is on rows that it was fitted on.

    The threshold is that of the best F1 of out-of-fold probabilities. The models of the folds and that of all rows are fitted in the
    same passes.
    """
    from kestrel.operators.features import probability, train_models

    fits, _ = train_models(df, names, leave_out="fold", groups=[*range(k), None], rounds=rounds)
    mine = F.coalesce(*[F.when(F.col("fold") == f, probability(*fits[f])) for f in range(k)])
    scored = df.select("y", F.round(mine, 9).alias("out"), F.round(probability(*fits[k]), 9).alias("all"))
    at = best_threshold(sweep(scored, "out", F.col("y") == 1, grid or threshold_grid(0.05, 0.95))).select(F.col("t").alias("threshold"))
    held = scored.join(F.broadcast(at))  # one row
    f1 = lambda c: 2 * F.count_if((F.col("y") == 1) & (F.col(c) >= F.col("threshold"))) / (
        F.count_if(F.col("y") == 1) + F.count_if(F.col(c) >= F.col("threshold"))
    )
    out = held.groupBy("threshold").agg(f1("all").alias("resubstitution_f1"), f1("out").alias("out_of_fold_f1"))
    return out.withColumn("gap", F.col("resubstitution_f1") - F.col("out_of_fold_f1"))


def leave_one_out(
    df: DataFrame, names: list[str], group: str = "brand", threshold: float | None = None, rounds: int = 400
) -> DataFrame:
    """(group, n, warn, recall): positives of each group scored by a model that never saw the group.

    The threshold warn is each model's best F1 on its own rows, unless one is given. All models are trained in the same
    passes; their number is that of the groups.
    """
    from kestrel.operators.features import probability, train_models

    held = sorted(r[group] for r in df.where("y = 1").select(group).distinct().collect())  # brands
    fits, best = train_models(df, names, leave_out=group, groups=held, rounds=rounds, grid=threshold_grid(0.05, 0.95))
    mine = lambda values: F.coalesce(*[F.when(F.col(group) == g, v) for g, v in zip(held, values, strict=True)])
    warn = mine([F.lit(float(t)) for t in best]) if threshold is None else F.lit(threshold)
    scored = df.where("y = 1").select(group, warn.alias("warn"), mine([probability(*fit) for fit in fits]).alias("p"))
    return scored.groupBy(group, "warn").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") >= F.col("warn")).cast("double")).alias("recall"))

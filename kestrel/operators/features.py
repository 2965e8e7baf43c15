"""The 20 features, bigram models, logistic inference and training."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.dims import BLOCK_AT, MODEL_BIAS, WARN_AT, Brand
from kestrel.functions import hosts
from kestrel.operators.match import match_brands, nearest_columns, with_glyphs
from kestrel.operators.parse import parse_hosts

NAMES = [name for name, *_ in dims.model_table()]
ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0123456789-"


def bigram_counts(labels: DataFrame, column: str = "label") -> DataFrame:
    """(a, b, n): neighbouring symbols of labels of 2 letters or more between ^ and $."""
    text = F.concat(F.lit("^"), F.lower(column), F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda k: F.substring(F.col("t"), k, F.lit(2)))
    return (
        labels.where(F.length(column) >= 2)
        .select(text.alias("t"))
        .select(F.explode(pairs).alias("p"))
        .groupBy(F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def train_bigrams(labels: DataFrame, column: str = "label", alphabet: str = ALPHABET) -> DataFrame:
    """(a, b, logp) over the whole grid of the alphabet: log of (n + 1) / (total of a + symbols)."""
    spark = labels.sparkSession
    symbols = spark.createDataFrame([(c,) for c in alphabet], "c string")
    grid = symbols.select(F.col("c").alias("a")).crossJoin(F.broadcast(symbols.select(F.col("c").alias("b"))))  # alphabet squared
    counts = bigram_counts(labels, column)
    filled = grid.join(counts, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = filled.groupBy("a").agg(F.sum("n").alias("total"))
    size = len(alphabet)
    return filled.join(F.broadcast(totals), "a").select(
        "a", "b", F.log((F.col("n") + 1) / (F.col("total") + size)).alias("logp")
    )


def bigram_map(spark: SparkSession, model: DataFrame) -> dict[str, float]:
    """A trained grid as a map from two symbols to logp; its size is that of the alphabet, squared."""
    return {r["a"] + r["b"]: r["logp"] for r in model.collect()}


def improbability(label: Column, model: dict[str, float], symbols: int = len(ALPHABET)) -> Column:
    """Mean of -logp over the pairs of ^label$; a pair off the grid counts as log(symbols).

    The grid is one array of constants that the two symbols of a pair point into.
    """
    unseen = F.lit(math.log(symbols))
    if not model:
        return unseen
    text = F.concat(F.lit("^"), F.lower(label), F.lit("$"))
    known = "".join(sorted({symbol for pair in model for symbol in pair}))
    cells = [model.get(a + b) for a in known for b in known]
    # spelt as one expression: a call for each cell would take seconds
    grid = F.expr("array(" + ", ".join("double(null)" if x is None else f"{float(x)!r}D" for x in cells) + ")")
    place = lambda k: F.instr(F.lit(known), F.substring(text, k, F.lit(1)))

    def cost(k: Column) -> Column:
        a, b = place(k), place(k + 1)
        return F.coalesce(F.when((a > 0) & (b > 0), -F.get(grid, (a - 1) * len(known) + b - 1)), unseen)

    costs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), cost)
    return F.aggregate(costs, F.lit(0.0), lambda a, x: a + x) / F.size(costs)


def feature_columns(model: dict[str, float] | None = None) -> list[Column]:
    """The features of matched hosts, in order. Without a bigram model every pair counts as unseen."""
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    near = nearest_columns()
    official = flag(F.col("official").isNotNull())
    embedded = flag(F.col("embedded").isNotNull() & (F.col("embedded_core") != F.col("sld")))
    sub = flag(F.col("in_subdomain").isNotNull())
    lured = F.size("lures").cast("double")
    digits = F.regexp_count("sld", F.lit("[0-9]"))
    values = [
        near["similarity"],
        flag(near["visual"]),
        flag(near["swapped"]),
        flag(F.col("homoglyph")),
        flag(F.col("mixed")),
        F.size("folds").cast("double"),
        flag(F.col("skeleton_core").isNotNull() & F.col("exact_core").isNull()),
        flag(F.col("exact_core").isNotNull() & F.col("official").isNull()),
        embedded,
        sub,
        flag(F.col("tld_suspicious")),
        lured,
        F.length("sld").cast("double"),
        F.when(F.length("sld") > 0, digits / F.length("sld")).otherwise(0.0),
        F.regexp_count("sld", F.lit("-")).cast("double"),
        official,
        near["similarity"] * (1 - official),
        embedded * flag(lured > 0),
        sub * (1 - official),
        improbability(F.col("skeleton"), model or {}),
    ]
    return [v.alias(n) for v, n in zip(values, NAMES, strict=True)]


def extract_features(
    df: DataFrame, column: str = "input", bigrams: dict[str, float] | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """df plus the 20 feature columns of each host."""
    brands = dims.brands()
    matched = match_brands(with_glyphs(parse_hosts(df, column, rules)), brands)
    # a label may hold several cores; a longer one than the label itself can't be, so one other core suffices
    others = [F.when(F.col("skeleton").contains(b.core) & (F.col("sld") != b.core), F.lit(b.core)) for b in brands if len(b.core) >= 4]
    matched = matched.withColumn("embedded_core", F.coalesce(*others)).withColumn("host_name", F.col("host"))
    return matched.select(*[F.col(f"`{c}`") for c in df.columns], *feature_columns(bigrams if bigrams is not None else dims.bigram_grid()))


def predict(features: DataFrame, weights: list[tuple[str, float, float, float]] | None = None, bias: float = MODEL_BIAS,
            warn: float = WARN_AT, block: float = BLOCK_AT) -> DataFrame:
    """features plus logit, probability, level and contributions (feature, value, contribution), largest first."""
    rows = weights if weights is not None else dims.model_table()
    terms = [
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), (F.lit(w) * ((F.col(n) - F.lit(m)) / F.lit(s or 1.0))).alias("contribution"))
        for n, m, s, w in rows
    ]
    out = features.withColumn("contributions", F.array(*terms))
    logit = F.aggregate("contributions", F.lit(bias), lambda a, t: a + t["contribution"])
    out = out.withColumn("logit", logit).withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))
    level = F.when(F.col("probability") >= block, "dangerous").when(F.col("probability") >= warn, "suspicious").otherwise("safe")
    placed = F.transform("contributions", lambda t, k: F.struct((-F.abs(t["contribution"])).alias("o"), k.alias("k"), t.alias("t")))
    return out.withColumn("level", level).withColumn("contributions", F.transform(F.array_sort(placed), lambda x: x["t"]))


def top_contributions(most: int = 4, least: float = 0.05) -> Column:
    return F.slice(F.filter("contributions", lambda t: F.abs(t["contribution"]) > least), 1, most)


def standardised_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, mean, std): mean and population deviation of a column in each group; a deviation of 0 counts as 1."""
    s = F.stddev_pop(column)
    return df.groupBy(by).agg(F.avg(column).alias("mean"), F.when(s != 0, s).otherwise(1.0).alias("std"))


def standardiser(df: DataFrame, names: list[str]) -> list[tuple[str, float, float]]:
    """(feature, mean, population deviation) of a table; a deviation of 0 counts as 1."""
    row = df.agg(*[F.avg(n).alias(f"m{k}") for k, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{k}") for k, n in enumerate(names)]).first()
    return [(n, row[f"m{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, n in enumerate(names)]


#: So many partial sums go straight to the driver; those of more tasks are added up first.
FEW_TASKS = 256
#: Numbers of different rows that a fit takes to the driver, to go through its rounds there; larger tables stay where they are.
LOCAL_VALUES = 4_000_000


def _values(batch) -> tuple[np.ndarray, ...]:
    x = batch.column(0).combine_chunks() if isinstance(batch, pa.Table) else batch.column(0)
    return (x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), *(batch.column(k).to_numpy() for k in (1, 2, 3)))


def summed(rows: DataFrame, values, shape: tuple[int, int], tasks: int) -> np.ndarray:
    """Sums over rows (x array, y, group, times) of what values(x, y, group, times) gives for each batch: an array of that shape.

    Batches are summed in their tasks, which are `tasks` in number, then by place in the array, whose size the models fix.
    """
    few = tasks <= FEW_TASKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += values(*_values(batch))
        if few:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "part"])

    out = np.zeros(shape)
    if few:
        for r in rows.mapInArrow(run, "part binary").collect():
            out += np.frombuffer(r["part"]).reshape(shape)
    else:
        parts = rows.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("total"))
        for r in parts.collect():
            out.ravel()[r["place"]] = r["total"]
    return out


Fitted = tuple[list[tuple[str, float, float, float]], float]


def train_models(
    df: DataFrame,
    names: list[str],
    label: str = "y",
    *,
    leave_out: str | None = None,
    groups: list | None = None,
    used: list[list[str]] | None = None,
    rounds: int = 300,
    rate: float = 0.5,
    penalty: float = 1e-4,
    grid: list[float] | None = None,
) -> tuple[list[Fitted], np.ndarray | None]:
    """Class-weighted logistic regressions by full-batch gradient descent, all models in the same passes over the rows.

    Model k leaves out rows whose column leave_out is groups[k] (None: no row) and uses the features used[k] (by default
    all). Each standardises on its own rows, which weigh n / (2 * rows of their class). Equal rows are counted and go as one. Where the
    different ones are few (LOCAL_VALUES numbers in all), they are taken to the driver once, and rounds are array products there; else a round is one
    aggregation over the cached table for all models, and only sums of the models' size reach the driver. Null features count as 0.

    Returns, of each model, its table (feature, mean, deviation, weight) and bias, and with a grid of thresholds the
    one that gives each model's best F1 on its own rows, the first of equals.
    """
    groups = groups if groups is not None else [None]
    n_models, n = len(groups), len(names)
    known = list(dict.fromkeys(map(str, groups)))
    which = np.array([known.index(str(g)) for g in groups])
    place = F.array_position(F.array(*map(F.lit, known)), F.col(leave_out).cast("string")) - 1 if leave_out else F.lit(-1)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.coalesce(place, F.lit(-1)).cast("int").alias("g"))
    rows = rows.groupBy("x", "y", "g").agg(F.count(F.lit(1)).cast("double").alias("times"))
    rows = rows.hint("rebalance").cache()  # as few balanced tasks as the size asks for: each round is a job
    mask = np.array([[c in (u if used else names) for c in names] for u in (used or [names] * n_models)], float)
    own = lambda g, times: (g[:, None] != which) * times[:, None]
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -700, 700)))

    held = _values(rows.toArrow()) if 0 < rows.count() * (n + 3) <= LOCAL_VALUES else None
    tasks = rows.rdd.getNumPartitions() if held is None else 0
    sums = lambda values, shape: summed(rows, values, shape, tasks) if held is None else values(*held)
    first = sums(lambda x, y, g, c: np.column_stack([own(g, c).T @ x, own(g, c).sum(0), own(g, c).T @ y]), (n_models, n + 2))
    total, positive = first[:, n], first[:, n + 1]
    mean = first[:, :n] / np.maximum(total, 1)[:, None]
    squares = sums(lambda x, y, g, c: np.stack([own(g, c)[:, k] @ (x - mean[k]) ** 2 for k in range(n_models)]), (n_models, n))
    std = np.sqrt(squares / np.maximum(total, 1)[:, None])
    std[std == 0] = 1.0
    heavy, light = total / (2 * np.maximum(positive, 1)), total / (2 * np.maximum(total - positive, 1))
    w, b = np.zeros((n_models, n)), np.zeros(n_models)
    weight = np.maximum(positive * heavy + (total - positive) * light, 1e-300)

    def logits(x: np.ndarray) -> np.ndarray:
        return x @ (w / std).T + (b - (w * mean / std).sum(1))

    def gradient(x: np.ndarray, y: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        error = (sigmoid(logits(x)) - y[:, None]) * np.where(y[:, None] > 0, heavy, light) * own(g, c)
        return np.column_stack([error.T @ x, error.sum(0)])

    both = (positive > 0) & (positive < total)
    for _ in range(rounds if both.any() else 0):
        found = sums(gradient, (n_models, n + 1))
        slope = (found[:, :n] - mean * found[:, n:]) / std / weight[:, None]
        w = (w - rate * (slope + penalty * w)) * mask * both[:, None]
        b = (b - rate * found[:, n] / weight) * both
    best = None
    if grid is not None:
        steps = np.array(grid)

        def reached(x: np.ndarray, y: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
            p, mine = sigmoid(logits(x)), own(g, c)
            hits = [[((p[:, k] >= t) & (y == good)) @ mine[:, k] for good in (1, 0) for t in steps] for k in range(n_models)]
            return np.array(hits, float)

        hits = sums(reached, (n_models, 2 * len(steps)))
        tp, fp = hits[:, : len(steps)], hits[:, len(steps) :]
        best = steps[(2 * tp / np.maximum(positive[:, None] + tp + fp, 1)).argmax(1)]
    rows.unpersist()
    tables = [[(c, *map(float, v)) for c, *v in zip(names, mean[k], std[k], w[k], strict=True) if mask[k][names.index(c)]] for k in range(n_models)]
    return [(t, float(x)) for t, x in zip(tables, b, strict=True)], best


def train_logistic(df: DataFrame, names: list[str], label: str = "y", *, rounds: int = 300, rate: float = 0.5, penalty: float = 1e-4) -> Fitted:
    """One model of train_models, over all rows: the model table (feature, mean, deviation, weight) and the bias."""
    return train_models(df, names, label, rounds=rounds, rate=rate, penalty=penalty)[0][0]


def probability(weights: list[tuple[str, float, float, float]], bias: float) -> Column:
    """The probability that a model gives to rows with its feature columns."""
    logit = F.lit(bias)
    for name, mean, std, weight in weights:
        logit = logit + F.lit(weight) * ((F.col(name) - F.lit(mean)) / F.lit(std or 1.0))
    return 1 / (1 + F.exp(-logit))


def compared(df: DataFrame, models: dict[str, tuple[Fitted, float]], by: str) -> DataFrame:
    """Rows of each value of a column, and how many of them each model (with its threshold) finds."""
    hits = {name: F.count_if(probability(*model) >= at) for name, (model, at) in models.items()}
    return df.groupBy(by).agg(*[h.alias(n) for n, h in hits.items()], F.count(F.lit(1)).alias("n"))


def fit_pipeline(df: DataFrame, names: list[str], label: str = "y"):
    """The same model by pyspark.ml (assembler, scaler, class-weighted logistic regression)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts.get(1, total))).otherwise(total / (2 * counts.get(0, total)))
    stages = [
        VectorAssembler(inputCols=names, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, weightCol="class_weight", regParam=1e-4, maxIter=100),
    ]
    return Pipeline(stages=stages).fit(df.withColumn("class_weight", weight))

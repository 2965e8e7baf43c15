"""The rule engine: evidence to a verdict with a level, a score, the impersonated brand and named signals."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.dims import LEARNED, Brand
from kestrel.functions import distance, unicode
from kestrel.functions.hosts import level_of, round_half_up, similarity
from kestrel.operators.match import match_brands, nearest_columns, picker, settle, with_glyphs
from kestrel.operators.parse import parse_hosts

VERDICT = (
    "host", "sld", "suffix", "skeleton", "level", "score", "brand", "similarity", "distance", "trace", "signals",
    "homoglyphs", "ops",
)


def _signal(when: Column, label: str, detail: Column, weight: Column) -> Column:
    return F.when(when, F.struct(F.lit(label).alias("label"), detail.alias("detail"), weight.cast("double").alias("weight")))


def judge(df: DataFrame, brands: list[Brand] | None = None, learned: str | None = None, of=None) -> DataFrame:
    """Matched hosts plus impersonated (a brand's place), attached (whether only by a disguise), signals, score and level.

    Tests of the label are tried in a fixed order, and the first whose outer condition holds ends the search, even
    when it then lacks corroboration. Weights are added in the order of the signals. `of` looks up a brand's field by its place.
    """
    of = of or picker(brands if brands is not None else dims.brands(), learned)
    core, name, domain = "core", "name", "domain"
    lured = F.size("lures") > 0
    bad_tld, hidden = F.col("tld_suspicious"), F.col("homoglyph")
    free = F.col("official").isNull()
    near = nearest_columns()
    near_core = of("near_ord", core)

    # which test ends the search, and whether it stands
    is_skeleton = F.col("skeleton_core").isNotNull() & F.col("exact_core").isNull()
    is_exact = F.col("exact_core").isNotNull() & free
    is_token = F.col("token").isNotNull() & free & (lured | bad_tld)
    arm = (
        F.when(is_skeleton, "skeleton")
        .when(is_exact, "exact")
        .when(F.col("embedded").isNotNull(), "embedded")
        .when(is_token, "token")
        .when(near["distance"] > 0, "nearest")
    )
    strict = of("exact_core", "category") != LEARNED
    short_swap = (F.length(near_core) <= 5) & (near["distance"] <= 1) & near["swapped"]
    typo = F.length("skeleton") - F.length(of("embedded", core)) <= 2
    stands = (
        F.when(F.col("arm") == "exact", strict | bad_tld | lured | hidden)
        .when(F.col("arm") == "embedded", (F.col("sld") != of("embedded", core)) & (lured | bad_tld | hidden | typo))
        .when(F.col("arm") == "nearest", (near["similarity"] >= 0.8) | short_swap)
        .otherwise(F.col("arm").isNotNull())
    )
    pinned = (
        F.when(~F.col("stands"), None)
        .when(F.col("arm") == "skeleton", F.col("skeleton_core"))
        .when(F.col("arm") == "exact", F.col("exact_core"))
        .when(F.col("arm") == "embedded", F.col("embedded"))
        .when(F.col("arm") == "token", F.col("token"))
        .when(F.col("arm") == "nearest", near["ord"])
    )
    out = settle(settle(df, arm=arm), stands=F.coalesce(stands, F.lit(False)))
    sub = F.col("in_subdomain").isNotNull() & free
    attached = F.when(hidden & (near["similarity"] >= 0.7) & (near["ord"] >= 0), near["ord"])
    pinned = F.coalesce(pinned, F.when(sub, F.col("in_subdomain")))
    out = settle(out, impersonated=F.coalesce(pinned, attached), attached=pinned.isNull() & attached.isNotNull())
    named = F.col("impersonated").isNotNull()
    took = lambda a: F.col("stands") & (F.col("arm") == a)
    seen = F.array_join(F.transform("folds", lambda f: F.concat_ws("", f["orig"], F.lit("="), f["canon"])), " ")
    percent = round_half_up(near["similarity"] * 100).cast("string")
    how = F.when(near["visual"], " by look-alike characters").when(near["swapped"], " by swapped letters").otherwise("")
    signals = F.array_compact(
        F.array(
            _signal(hidden, "Homoglyph characters", F.concat(F.lit("folds: "), seen), F.lit(0.45)),
            _signal(took("skeleton"), "Skeleton matches a brand", F.concat_ws(" looks like ", "sld", of("skeleton_core", core)), F.lit(0.4)),
            _signal(took("exact"), "Brand name on a non-official domain",
                    F.concat(F.col("registrable"), F.lit(" instead of "), of("exact_core", domain)), F.when(bad_tld, 0.5).otherwise(0.32)),
            _signal(took("embedded"), "Brand hidden in a longer name", F.concat_ws(" inside ", of("embedded", core), "sld"), F.lit(0.4)),
            _signal(took("token"), "Brand name combined with other words", F.concat_ws(" as a word of ", of("token", core), "sld"),
                    F.when(bad_tld, 0.5).otherwise(0.4)),
            _signal(took("nearest"), "Look-alike of a brand", F.concat(percent, F.lit("% like "), near_core, how),
                    F.when(near["visual"], 0.45).otherwise(0.3)),
            _signal(sub, "Brand in a sub-domain", F.concat(of("in_subdomain", name), F.lit(" before "), F.col("registrable")), F.lit(0.3)),
            _signal(bad_tld, "Suspicious top-level domain", F.concat(F.lit("."), F.col("last_label")), F.lit(0.12)),
            _signal(lured & named, "Urgency / lure keywords", F.array_join("lures", ", "), F.lit(0.15)),
        )
    )
    out = settle(out, signals=signals)
    risk = F.aggregate("signals", F.lit(0.0), lambda total, s: total + s["weight"])
    out = settle(out, score=round_half_up(F.least(F.lit(1.0), risk) * 100).cast("int"))
    raw = level_of(F.col("score"))
    disguised = hidden & named
    level = (
        F.when(disguised, "dangerous").when((named | hidden) & (raw == "safe"), "suspicious").otherwise(raw)
    )
    default = F.array(
        F.struct(
            F.lit("No brand impersonation detected").alias("label"),
            F.lit("nothing resembles a protected brand").alias("detail"),
            F.lit(0.0).alias("weight"),
        )
    )
    ours = ~free & ~hidden
    official = F.array(
        F.struct(F.lit("Official domain").alias("label"), of("official", domain).alias("detail"), F.lit(0.0).alias("weight"))
    )
    return settle(
        out,
        level=F.when(ours, "safe").otherwise(level),
        score=F.when(ours, 2).when(disguised, F.greatest("score", F.lit(80))).otherwise(F.col("score")),
        signals=F.when(ours, official).when(F.size("signals") == 0, default).otherwise(F.col("signals")),
        impersonated=F.when(ours, F.col("official")).otherwise(F.col("impersonated")),
        is_official=ours,
    )


def verdicts(df: DataFrame, brands: list[Brand] | None = None, learned: str | None = None, of=None) -> DataFrame:
    """Judged hosts plus brand (core), similarity, distance and trace, in the verdict's columns."""
    of = of or picker(brands if brands is not None else dims.brands(), learned)
    core = of("impersonated", "core")
    shown = settle(df, brand=core, __core=F.when(~F.col("is_official"), core))
    shown = shown.withColumn("__a", distance.align(F.col("skeleton"), F.col("__core")))
    none = F.array().cast(distance.OPS)
    near = nearest_columns()
    kept = [c for c in df.columns if c not in VERDICT]
    return shown.select(
        *[F.col(f"`{c}`") for c in kept],
        "host",
        "sld",
        "suffix",
        F.col("host_skeleton").alias("skeleton"),
        "level",
        "score",
        "brand",
        F.when(F.col("is_official"), F.lit(1.0))
        .when(F.col("brand").isNotNull(), similarity(F.col("__a.distance"), F.col("skeleton"), F.col("brand")))
        .otherwise(near["similarity"])
        .alias("similarity"),
        F.when(F.col("is_official"), F.lit(0.0))
        .when(F.col("brand").isNotNull(), F.col("__a.distance"))
        .otherwise(F.coalesce(near["distance"], F.lit(float("inf"))))
        .alias("distance"),
        F.coalesce(F.when(~F.col("is_official"), F.col("__a.trace")), none).alias("trace"),
        "signals",
        F.when(F.col("homoglyph") & ~F.col("is_official"), F.col("folds"))
        .otherwise(F.array().cast("array<struct<orig:string,canon:string,script:string>>"))
        .alias("homoglyphs"),
        "ops",
    )


# What a level is called, and its colour.
TITLES = {"safe": ("Looks Safe", "#34d399"), "suspicious": ("Suspicious", "#f59e0b"), "dangerous": ("Likely Phishing", "#f43f5e")}


def display(verdicts: DataFrame, most: int = 3) -> DataFrame:
    """What people are shown of verdicts: host, level, score, title, color, reasons, distance, similarity, ops.

    reasons are the first `most` signals as structs of label, detail and points (their weight in hundredths); distance has two decimals,
    similarity is a whole percentage, ops have separators of thousands. The distance of a host that is like no brand is null.
    """
    reason = lambda s: F.struct(s["label"].alias("label"), s["detail"].alias("detail"), round_half_up(s["weight"] * 100).cast("int").alias("points"))
    named = [F.create_map(*[F.lit(x) for level, shown in TITLES.items() for x in (level, shown[k])])[F.col("level")] for k in (0, 1)]
    near = F.when(F.col("distance") < float("inf"), F.format_number("distance", 2))
    return verdicts.select(
        "host", "level", "score", named[0].alias("title"), named[1].alias("color"), F.transform(F.slice("signals", 1, most), reason).alias("reasons"),
        near.alias("distance"), F.concat(round_half_up(F.col("similarity") * 100).cast("string"), F.lit("%")).alias("similarity"), F.format_number("ops", 0).alias("ops"),
    )


def score_hosts(
    inputs: DataFrame,
    column: str = "input",
    extra_brands: list[Brand] | None = None,
    rules: DataFrame | None = None,
    table: dict[str, str] | None = None,
    learned: str | None = None,
) -> DataFrame:
    """Verdicts of the rows of inputs, each row scored by itself; also for streams.

    `learned` names a column array<struct<core,domain>> of brands that each row has for itself, such as its device's sites.
    """
    brands = dims.brands() + list(extra_brands or [])
    parsed = with_glyphs(parse_hosts(inputs, column, rules), table)
    return verdicts(judge(match_brands(parsed, brands, learned), brands, learned), brands, learned)


#: An input with more than one in SHARE rows, and more than BUSY rows, is busy: less than SHARE inputs are.
SHARE, BUSY = 10_000, 1_000_000


def hand_back(df: DataFrame, column: str, told: DataFrame, sizes: DataFrame, busy: int = BUSY) -> DataFrame:
    """df plus the columns of told (a row for each __input), of the input that each row has; null is an input of its own.

    sizes: rows (__input, __rows) of all inputs. Rows of a busy input are dealt to a task for each SHARE-th of all rows that it has, and
    its row of told is copied to them. Rows are dealt by their partition and their values, so a task that runs again deals alike.
    """
    total = sizes.agg(F.sum("__rows")).scalar()
    often = sizes.where((F.col("__rows") > busy) & (F.col("__rows") * SHARE > total))
    often = often.select(F.col("__input").alias("__often"), F.ceil(F.col("__rows") * SHARE / total).cast("int").alias("__tasks"))
    often = F.broadcast(often)  # less than SHARE rows
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = F.when(F.col("__tasks") > 1, F.pmod(F.xxhash64(F.spark_partition_id(), *hashed), F.col("__tasks")).cast("int"))
    rows = df.join(often, F.col(column).eqNullSafe(F.col("__often")), "left").withColumn("__salt", F.coalesce(dealt, F.lit(0))).drop("__often", "__tasks")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1))
    spread = told.join(often, F.col("__input").eqNullSafe(F.col("__often")), "left").withColumn("__copy", copies).drop("__often", "__tasks")
    same = F.col(column).eqNullSafe(F.col("__input")) & (F.col("__salt") == F.col("__copy"))
    return rows.join(spread, same, "left").drop("__input", "__salt", "__copy")


def _inputs(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("__input")).agg(F.count(F.lit(1)).alias("__rows"))


def analyze(
    df: DataFrame,
    column: str = "input",
    extra_brands: list[Brand] | None = None,
    rules: DataFrame | None = None,
    table: dict[str, str] | None = None,
    busy: int = BUSY,
) -> DataFrame:
    """df joined with the verdict of its column, as a struct column verdict. Each different input is scored once.

    An input of more than `busy` rows that makes up a large share of them gets its verdicts in several tasks.
    """
    sizes = _inputs(df, column)
    scored = score_hosts(sizes.select("__input"), "__input", extra_brands, rules, table)
    return hand_back(df, column, scored.select("__input", F.struct(*VERDICT).alias("verdict")), sizes, busy)


def fingerprint(brands: list[Brand] | None = None, version: str = "1") -> str:
    """What verdicts depend on besides the host: brands, word lists, thresholds of the rules, as a digest."""
    told = (version, brands if brands is not None else dims.brands(), dims.LURE_WORDS, dims.SUSPICIOUS_TLDS, sorted(dims.confusables().items()))
    return hashlib.sha256(repr(told).encode()).hexdigest()[:16]


def analyze_new(df: DataFrame, path: str, column: str = "input", extra_brands: list[Brand] | None = None) -> DataFrame:
    """analyze, with verdicts kept in a table under path: only inputs that the table doesn't know are scored, and added to it.

    The table holds a verdict for each input under the fingerprint of brands and rules, so others start anew. New inputs are
    found by an anti join on the input and are appended in one write; two runs at once may score an input twice, which
    gives equal rows, of which one is read. Null inputs are kept like any other.
    """
    spark = df.sparkSession
    at = f"{path}/rules={fingerprint(dims.brands() + list(extra_brands or []))}"
    sizes = _inputs(df, column)
    inputs = sizes.select("__input")
    known = _read_or_none(spark, at)
    if known is not None:
        inputs = inputs.join(known.select(F.col("__input").alias("__known")), F.col("__input").eqNullSafe(F.col("__known")), "left_anti")
    scored = score_hosts(inputs, "__input", extra_brands).select("__input", F.struct(*VERDICT).alias("verdict"))
    scored.write.mode("append").parquet(at)
    every = spark.read.schema(scored.schema).parquet(at).dropDuplicates(["__input"])
    return hand_back(df, column, every, sizes)


def _read_or_none(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def register(spark) -> None:
    """SQL functions skeleton(text) and weighted_distance(a, b)."""
    folds = dims.confusables()

    @F.pandas_udf("string")
    def skeleton(s: pd.Series) -> pd.Series:
        return unicode.each_once(s, lambda x: unicode.fold(x, folds))

    @F.pandas_udf("double")
    def weighted_distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), a.index)
        known = a.notna() & b.notna()
        if known.any():
            out[known] = distance.alignments(list(a[known]), list(b[known]))[0]
        return out

    spark.udf.register("skeleton", skeleton)
    spark.udf.register("weighted_distance", weighted_distance)

"""Readers of host lists and feeds, and the sinks of results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import urls


_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; on a cluster it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="kestrel-")
        told = _own[key]
    return f"{told.rstrip('/')}/kestrel-engine/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that what reads it several times doesn't work it out again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one(spark: SparkSession, host: str) -> DataFrame:
    return spark.createDataFrame([(host,)], "input string")


def ranked_csv(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(rank, host) of the first `most` lines of a rank,domain file, lower case, blanks left out."""
    return clean_ranked(spark.read.csv(path, schema="rank int, host string"), most)


def clean_ranked(rows: DataFrame, most: int) -> DataFrame:
    return rows.select("rank", F.lower(F.trim("host")).alias("host")).where("host <> ''").orderBy("rank").limit(most)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("host")).where("host <> ''")


def feed_hosts(feed: DataFrame, column: str = "url") -> DataFrame:
    """(host): different hosts of a URL feed, of any scheme, without a leading www., that have a dot."""
    host = F.regexp_replace(urls.url_hostname(F.trim(column)), r"^www\.", "")
    return feed.select(F.lower(host).alias("host")).where(F.col("host").contains(".")).distinct()


def unreadable(feed: DataFrame, column: str = "url") -> DataFrame:
    """How many lines of a feed, empty ones left out, aren't URLs."""
    url = F.trim(column)
    return feed.where(url != "").agg(F.count_if(urls.url_hostname(url).isNull()).alias("unreadable"))


def permutations(spark: SparkSession, path: str) -> DataFrame:
    """(brand, fuzzer, domain, core) of a brand,fuzzer,domain,... file: no comments, originals or official domains."""
    rows = spark.read.csv(path, schema="brand string, fuzzer string, domain string, dns_a string, dns_aaaa string")
    return clean_permutations(rows.withColumn("n", F.monotonically_increasing_id()), "n")


def clean_permutations(rows: DataFrame, order: str) -> DataFrame:
    rows = rows.withColumn("domain", F.lower(F.trim("domain"))).where(
        ~F.col("brand").startswith(">>") & (F.col("fuzzer") != "fuzzer") & ~F.col("fuzzer").contains("original") & (F.col("domain") != "")
    )
    spark = rows.sparkSession
    rows = rows.join(F.broadcast(official_domains(spark)), "domain", "left_anti")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(order))).where("k = 1")
    return brand_cores(first.select("brand", "fuzzer", "domain"))


def official_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for b in dims.brands() for d in b.official], "domain string").distinct()


def brand_cores(df: DataFrame, column: str = "brand") -> DataFrame:
    """df plus core: of the brand whose official domain the column holds, else its first label."""
    known = df.sparkSession.createDataFrame([(b.domain, b.core) for b in dims.brands()], "__d string, __c string")
    joined = df.join(F.broadcast(known), F.col(column) == F.col("__d"), "left")
    return joined.withColumn("core", F.coalesce("__c", F.split(column, r"\.")[0])).drop("__d", "__c")


def read_confusables(spark: SparkSession, path: str, rounds: int = 12) -> DataFrame:
    """(ch, target): single characters that look like one ASCII letter or digit, from a UTS #39 file.

    Lines are `SOURCE ; TARGET ... ; type # ...` in code points. Chains are followed for up to `rounds` steps.
    """
    bare = F.regexp_replace(F.substring_index("value", "#", 1), "﻿", "")
    parts = spark.read.text(path).select(F.split(bare, ";").alias("p")).where(F.size("p") >= 3)
    spelt = lambda k: F.array_join(F.transform(F.split(F.trim(F.col("p")[k]), r"\s+"), lambda x: F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")), "")
    return chase(parts.select(spelt(0).alias("ch"), spelt(1).alias("target")), rounds)


def follow(table: DataFrame, steps: int) -> DataFrame:
    """(node, target): where each node of table (node, target) comes to in up to `steps` steps.

    A step replaces a node by its target; one without a row or with a null target stays. Steps are doubled: tables of 1, 2, 4, ... steps
    are joined for the bits of `steps`, so joins grow with its logarithm. In a cycle, the place after just that many steps counts. Of
    rows that repeat a node the least target counts.
    """
    once = table.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("target").alias("target"))
    once = stored(once.select("node", F.coalesce("target", "node").alias("target")), "chain")

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.select(F.col("node").alias("__node"), F.col("target").alias("__target"))
        return first.join(on, F.col("target") == F.col("__node"), "left").select("node", F.coalesce("__target", "target").alias("target"))

    out, power, left = None, once, steps
    while left:
        if left & 1:
            out = power if out is None else then(out, power)
        left >>= 1
        if left:
            power = stored(then(power, power), "chain")
    return out if out is not None else once.select("node", F.col("node").alias("target"))


def chase(table: DataFrame, rounds: int = 12) -> DataFrame:
    """(ch, target) with targets replaced by their own targets, `rounds` times at most, that are one ASCII letter or digit."""
    ends = follow(table.where(F.length("ch") == 1).select(F.col("ch").alias("node"), "target"), rounds + 1)
    final = ends.select(F.col("node").alias("ch"), F.lower("target").alias("target"))
    return final.where(F.col("target").rlike("^[a-z0-9]$") & (F.col("target") != F.lower("ch")))


def write_verdicts(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_hosts(df: DataFrame, path: str, column: str = "host") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_model(spark: SparkSession, weights: list[tuple[str, float, float, float]], bias: float, warn: float, block: float, path: str) -> None:
    """One row: names, means, deviations and weights rounded to 6 places, thresholds to 3."""
    names, mean, std, w = (list(x) for x in zip(*weights, strict=True))
    row = (names, [round(x, 6) for x in mean], [round(x, 6) for x in std], [round(x, 6) for x in w], round(bias, 6), round(warn, 3), round(block, 3))
    spark.createDataFrame([row], "features array<string>, mean array<double>, std array<double>, weights array<double>, bias double, warn double, block double").write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> tuple[list[tuple[str, float, float, float]], float, float, float]:
    r = spark.read.parquet(path).first()
    return list(zip(r["features"], r["mean"], r["std"], r["weights"], strict=True)), r["bias"], r["warn"], r["block"]


def upsert_state(new: DataFrame, path: str, keys: list[str], buckets: int = 64, versions: int = 2) -> None:
    """Replace the rows of new's keys in a state table, by buckets of the keys' hash.

    Only buckets that new has keys of are written, each as its next version `bucket=B/v=N`; of a bucket's versions the
    last few are left, so a reader under way isn't disturbed.
    """
    spark = new.sparkSession
    rows = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most `buckets`
    old, version = read_state(spark, path, touched)
    if old is not None:
        mine = rows.select(*[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)])
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)]  # a null key is a key
        rows = old.join(mine, same, "left_anti").unionByName(rows)
    rows.withColumn("v", F.lit(version + 1)).write.mode("append").partitionBy("bucket", "v").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for bucket in touched:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        fs = folder.getFileSystem(conf)
        found = sorted(int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(folder))
        for v in found[:-versions]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"v={v}"), True)


def read_state(spark: SparkSession, path: str, buckets: list[int] | None = None) -> tuple[DataFrame | None, int]:
    """The current rows of a state table and its version; with buckets only theirs, with the column bucket. None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        known = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0
    newest = known.groupBy("bucket").agg(F.max("v").alias("v"))  # a row per bucket
    version = newest.agg(F.max("v")).first()[0]
    if buckets is not None:
        known = known.where(F.col("bucket").isin(buckets))
    rows = known.join(F.broadcast(newest), ["bucket", "v"], "left_semi").drop("v")
    return (rows if buckets is not None else rows.drop("bucket")), version

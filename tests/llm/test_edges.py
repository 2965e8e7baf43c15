"""Repeated rows, null ids, clashing names and empty tables, for operators and stages."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import bpe, exact, media, mixing, shared, sharding, simhash, substring

NAMES = ["__id", "__by", "__copies", "__copy", "__row", "copies", "copy", "one", "part", "fp", "key", "keep_id", "rate", "Payload", "slot", "sha"]
ROWS = [(1, "a b c d", "s"), (1, "a b c d", "s"), (1, "a b c d", None), (None, "x y", "s"), (None, "x y", "s"), (2, None, "t"), (3, "", "t")]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return docs.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.lit(7).alias(c) for c in NAMES])


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_columns_of_clashing_names(spark, clashing, sf_dir):
    step = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == clashing.columns
        assert all(r[c] == 7 for r in step.collect() for c in NAMES)
    assert rows(step)
    assert corpus_pipeline.STAGES[-1][1](spark, step, sf_dir).count() == step.count()


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_operators_on_clashing_names(clashing, spark):
    numbered = shared.numbered(clashing, "rows")
    assert rows(exact.first_copies(numbered, exact.exact_duplicates(numbered), by=shared.ROW)) == Counter({(1, "a b c d"): 1, (None, "x y"): 1, (2, None): 1})
    assert rows(simhash.one_of_each(numbered, simhash.near_duplicates(numbered), by=shared.ROW)) == Counter({(1, "a b c d"): 1, (None, "x y"): 1, (2, None): 1})
    mix = mixing.mix_sources(numbered)
    got = mixing.mixed_documents(numbered, mix, by=shared.ROW)
    assert got.columns == numbered.columns
    assert got.count() == sum(-(-r["taken"] // r["size"]) for r in mix.collect() if r["taken"])
    assert sharding.assign_shards(clashing, 3).count() == len(ROWS)
    read = media.read_media(media.store_texts(clashing).select("*", F.lit("mine").alias("rate"), F.lit(1).alias("Payload"), F.lit(2).alias("k")))
    assert read.columns == ["doc_id", "n_bytes", "media", "k", "rate", "scale", "n_frames", "payload", "clips"]
    assert {r["rate"] for r in read.collect()} == {media.RATE} and {r["k"] for r in read.collect()} == {2}


def test_repeated_rows_and_null_ids(spark, clashing):
    docs = clashing.select("doc_id", "text", "source")
    near = Counter(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()))
    assert near == Counter({(1, 1, False): 2, (1, 1, True): 1, (None, None, True): 1, (None, None, False): 1, (2, 2, True): 1, (3, 2, False): 1})
    mix = mixing.mix_sources(docs).collect()
    assert len(mix) == len(ROWS) and sum(r["taken"] for r in mix) == sum({r["source"]: int(r["target"]) for r in mix}.values())
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = Counter((r["doc_id"], len(r["ids"])) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect())
    assert ids == Counter({(1, 4): 3, (None, 2): 2, (2, 0): 1, (3, 0): 1})
    assert Counter(r["doc_id"] for r in substring.remove_repeats(docs).collect()) == Counter(r[0] for r in ROWS)


def test_a_hot_group_is_handed_back_by_several_tasks(spark):
    many = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("row"))
    groups = many.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = shared.hand_back(many, groups, ["g"], "row")
    assert Counter(map(tuple, got.select("n").collect())) == Counter({(3000,): 3000, (1,): 1000})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = shared.hand_back(many, groups, ["g"], "row").where("g = 0").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts == 4  # all partitions of the tests' session


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.col("id").alias("x"))
    want, total = {}, 0
    for r in sorted(df.collect()):
        want[r["k"]] = total
        total += r["x"]
    got = shared.running(df.repartition(5), [F.col("k")], ["x"], "sums")
    assert got.columns == ["k", "x", "before_x"] and {r["k"]: r["before_x"] for r in got.collect()} == want


def test_clear(spark):
    kept = shared.keep(spark.range(3), "gone")
    assert kept.count() == 3 and shared.clear(spark) and not shared.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles())


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())

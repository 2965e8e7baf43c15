import pytest
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.operators import rules

GOLDEN = [
    *[(h, "safe", 2, c) for h, c in [
        ("paypal.com", "paypal"), ("google.com", "google"), ("hdfcbank.com", "hdfcbank"), ("amazon.in", "amazon"),
        ("microsoft.com", "microsoft"), ("flipkart.com", "flipkart"), ("amazon.co.jp", "amazon"), ("goo.gl", "google"),
        ("www.amazon.in", "amazon")]],
    *[(h, "dangerous", 85, c) for h, c in [
        ("pаypal.com", "paypal"), ("xn--pypal-4ve.com", "paypal"), ("аррӏе.com", "apple"),
        ("xn--80ak6aa92e.com", "apple"), ("gооgle.com", "google"), ("phonepе.com", "phonepe"),
        ("microsоft.com", "microsoft"), ("hdfcbаnk.com", "hdfcbank"), ("аmazon.in", "amazon")]],
    ("secure-pаypal.com", "dangerous", 100, "paypal"),
    ("paypa1.com", "suspicious", 45, "paypal"), ("g00gle.com", "suspicious", 45, "google"),
    ("faceb00k.com", "suspicious", 45, "facebook"), ("amaz0n.in", "suspicious", 45, "amazon"),
    ("googel.com", "suspicious", 30, "google"), ("gapy.in", "suspicious", 30, "gpay"), ("googlee.com", "suspicious", 40, "google"),
    ("secure-paypal.xyz", "dangerous", 67, "paypal"), ("paypal-login.tk", "dangerous", 67, "paypal"),
    ("hdfcbank-kyc.xyz", "dangerous", 67, "hdfcbank"), ("secure-paypal.tk", "dangerous", 67, "paypal"),
    ("amazon-kyc-update.xyz", "dangerous", 67, "amazon"), ("paytm-kyc-update.tk", "dangerous", 67, "paytm"),
    ("paytm-cashback.online", "suspicious", 52, "paytm"), ("sbi-rewards.tk", "dangerous", 77, "sbi"),
    ("sbi-rewards.online", "dangerous", 77, "sbi"), ("hdfcbank.account-verify.com", "suspicious", 45, "hdfcbank"),
    ("paypal.com.evil.ru", "suspicious", 30, "paypal"), ("paytm.xyz", "suspicious", 62, "paytm"),
    ("google.tk", "suspicious", 62, "google"), ("kotak.in", "suspicious", 32, "kotak"), ("amazonvideo.com", "safe", 0, None),
    ("randomblog.xyz", "safe", 12, None), ("randomblog.dev", "safe", 0, None), ("mycoolwebsite.com", "safe", 0, None),
    ("example.org", "safe", 0, None), ("notabank.net", "safe", 0, None), ("münchen.de", "safe", 0, None),
    ("straße.de", "suspicious", 45, None), ("", "safe", 0, None), ("com", "safe", 0, None),
]


def test_golden_verdicts(spark):
    df = spark.createDataFrame([(h,) for h, *_ in GOLDEN] + [(None,), ("paypal.com",)], "input string")
    rows = rules.analyze(df).collect()
    assert len(rows) == len(GOLDEN) + 2
    got = {r["input"]: r["verdict"] for r in rows}
    wrong = [
        (h, v["level"], v["score"], v["brand"], want)
        for h, *want in GOLDEN
        if [(v := got[h])["level"], v["score"], v["brand"]] != want
    ]
    assert not wrong
    assert got["paypa1.com"]["similarity"] == pytest.approx(0.958333, abs=1e-6)
    assert got["googel.com"]["trace"][-1]["type"] == "transpose" and len(got["googel.com"]["trace"]) == 5
    assert got["paypal.com"]["signals"][0]["label"] == "Official domain"
    assert got["example.org"]["signals"][0]["weight"] == 0
    assert [h["canon"] for h in got["gооgle.com"]["homoglyphs"]] == ["o", "o"]


def test_learned_brands(spark):
    learned = [dims.Brand("github", "github", "github.com", dims.LEARNED)]
    df = spark.createDataFrame([("github.io",), ("github.xyz",)], "input string")
    got = {r["input"]: r["verdict"] for r in rules.analyze(df, extra_brands=learned).collect()}
    assert (got["github.io"]["level"], got["github.io"]["score"]) == ("safe", 0)
    assert (got["github.xyz"]["level"], got["github.xyz"]["score"], got["github.xyz"]["brand"]) == ("suspicious", 62, "github")


def test_counts_of_the_dimensions():
    assert len(dims.brands()) == 29 and sum(len(b.core) >= 4 for b in dims.brands()) == 28
    assert (len(dims.SUSPICIOUS_TLDS), len(dims.LURE_WORDS), len(dims.VISUAL_PAIRS), len(dims.model_table())) == (26, 21, 17, 20)


def test_sql_functions(spark):
    rules.register(spark)
    row = spark.sql("select skeleton('Pаypal') a, weighted_distance('g00gle', 'google') b").first()
    assert (row["a"], row["b"]) == ("paypal", 0.5)
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_busy_hosts_get_verdicts_in_many_tasks(spark):
    """One host has a third of all rows, null another; both are spread, and nothing is lost or doubled."""
    hosts = F.expr("CASE id % 3 WHEN 0 THEN 'paypa1.com' WHEN 1 THEN NULL ELSE concat('h', id % 50, '.org') END")
    df = spark.range(0, 6000, numPartitions=6).select("id", hosts.alias("input"), F.create_map(F.lit("k"), "id").alias("m"))
    got = rules.analyze(df, busy=100)
    assert df.columns + ["verdict"] == got.columns
    want = {r["input"]: r["verdict"] for r in rules.analyze(df.select("input").distinct()).collect()}
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in rows) == list(range(6000)) and all(r["verdict"] == want[r["input"]] for r in rows)
    sizes = df.groupBy(F.col("input").alias("__input")).agg(F.count(F.lit(1)).alias("__rows"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = rules.hand_back(df, "input", sizes.select("__input", F.lit(1).alias("told")), sizes, 100)
        dealt = told.select("input", "told", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    for busy in (None, "paypa1.com"):
        tasks = [r["task"] for r in dealt if r["input"] == busy and r["told"] == 1]
        assert len(tasks) == 2000 and max(map(tasks.count, set(tasks))) < 1000
    assert rules.analyze(df.limit(0)).count() == 0

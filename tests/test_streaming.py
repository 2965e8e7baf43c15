import datetime as dt

from pyspark.sql import functions as F

from kestrel.operators import state
from kestrel.plans.inputs import navigation
from kestrel.sources.readers import read_state
from kestrel.streaming import navigation as nav


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_states_equal_batch_operators(spark, sf_dir, tmp_path):
    events = navigation(spark, sf_dir).cache()
    edges = [r[0] for r in events.select(F.percentile_approx("event_id", [0.33, 0.66])).collect()][0]
    low = None
    for k, edge in enumerate([*edges, 10**9]):
        part = events.where(F.col("event_id") <= edge)
        part = part if low is None else part.where(F.col("event_id") > low)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        low = edge
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = run(nav.device_states(stream), "device_states").cache()
    newest = {}
    for r in got.collect():
        newest[r["device"]] = max(newest.get(r["device"], r), r, key=lambda x: x["scanned"] + x["blocked"])
    assert {r["event_id"]: r["latched"] for r in got.collect()} == {r["event_id"]: r["latched"] for r in state.block_latch(events).collect()}
    for r in state.counters(events).collect():
        assert (newest[r["device"]]["scanned"], newest[r["device"]]["blocked"]) == (r["scanned"], r["blocked"])
    recent = {}
    for r in sorted(state.recent_threats(events.where("kind = 'block'")).collect(), key=lambda r: r["place"]):
        recent.setdefault(r["device"], []).append(r["host"])
    final = {}
    for r in sorted(got.join(events.select("event_id", "ts"), "event_id").collect(), key=lambda r: (r["ts"], r["event_id"])):
        final[r["device"]] = r
    assert {d: list(r["recent"]) for d, r in final.items() if r["recent"]} == recent
    visits = state.visits(events).groupBy("device").count().collect()
    assert {d: r["visits"] for d, r in final.items() if r["visits"]} == {r["device"]: r["count"] for r in visits}


def test_scored_batches_learn(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    first = [(1, 0, k, t, "complete", "https://github.com/x") for k in range(3)] + [(2, 0, 9, t, "complete", "http://secure-paypal.xyz/login")]
    first += [(1, 0, 10 + k, t, "loading", "https://gitlab.com/x") for k in range(3)]
    first += [(d, 0, 1000 * d + s + 100 * k, t, "complete", f"https://site{d}x{s}.com/") for d in range(3, 13) for s in range(100) for k in range(3)]
    second = [(1, 0, 20, t, "complete", "http://github.xyz/"), (2, 0, 21, t, "complete", "http://github.xyz/?2"), (1, 0, 22, t, "complete", "http://gitlab.xyz/"),
              (1, 0, 23, t, "complete", "http://g1thub.com/"), (3, 0, 24, t, "complete", "http://site3x7.tk/"), (4, 0, 25, t, "complete", "http://site3x7.tk/?4")]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, nav.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = nav.scored_batches(nav.read_events(spark, f"{tmp_path}/in", 10), f"{tmp_path}/out", f"{tmp_path}/ck", f"{tmp_path}/sites")
        q.awaitTermination(120)
    out = {r["url"]: (r["level"], r["brand"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out["http://secure-paypal.xyz/login"] == ("dangerous", "paypal")
    assert out["https://github.com/x"] == ("safe", None)
    assert out["http://github.xyz/"] == ("suspicious", "github") and out["http://g1thub.com/"] == ("suspicious", "github")
    assert out["http://github.xyz/?2"] == ("safe", None) and out["http://gitlab.xyz/"] == ("safe", None)  # another device, no completed load
    assert out["http://site3x7.tk/"] == ("suspicious", "site3x7") and out["http://site3x7.tk/?4"][1] != "site3x7"
    sites = read_state(spark, f"{tmp_path}/sites")[0]
    assert sites.where("count >= 3").count() == 1001 and sites.where("device = 3").count() == 100


def test_a_device_keeps_its_most_visited_sites(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nav, "MOST_SITES", 3)
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 10 * s + k, t, "complete", f"https://site{s}.com/") for s in range(5) for k in range(s + 1)]
    spark.createDataFrame(rows, nav.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    nav.scored_batches(nav.read_events(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", f"{tmp_path}/sites").awaitTermination(120)
    got = {r["registrable"]: r["count"] for r in read_state(spark, f"{tmp_path}/sites")[0].collect()}
    assert got == {"site2.com": 3, "site3.com": 4, "site4.com": 5}


def test_learned_columns_equal_extra_brands(spark, sf_dir):
    from kestrel.operators import rules
    from kestrel.plans.inputs import derived_hosts
    from kestrel.plans.verdicts import LEARNED

    hosts = derived_hosts(spark, sf_dir).select(F.col("host").alias("input")).distinct()
    more = [(h,) for h in ("example.xyz", "my-example-site.top", "examp1e.com", "example.evil.ru", "ехample.com", "blue-anvil.tk", "small-widgett.com")]
    hosts = hosts.unionByName(spark.createDataFrame(more, "input string"))
    listed = rules.score_hosts(hosts, "input", LEARNED)
    entries = F.array(*[F.struct(F.lit(b.core).alias("core"), F.lit(b.domain).alias("domain")) for b in LEARNED])
    each = rules.score_hosts(hosts.withColumn("mine", entries), "input", learned="mine").drop("mine")
    key = lambda df: sorted(str(r) for r in df.select(listed.columns).collect())
    assert key(listed) == key(each)
    none = rules.score_hosts(hosts.withColumn("mine", F.lit(None).cast("array<struct<core:string,domain:string>>")), "input", learned="mine").drop("mine")
    assert key(none) == key(rules.score_hosts(hosts, "input"))


def test_sessions_and_links(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(milliseconds=m), "u") for m in (0, 300, 700, 5000)] + [(1, t + dt.timedelta(hours=1), "v")]
    df = spark.createDataFrame(rows, "device long, ts timestamp, url string").coalesce(1)
    df.write.parquet(f"{tmp_path}/c")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/c")
    want = {r["started"]: r["changes"] for r in state.rescans(df).collect()}
    got = {r["started"]: r["changes"] for r in run(nav.rescan_windows(stream), "windows").collect()}
    assert got.items() <= want.items() and got[t] == 3
    assert run(nav.once_per_link(stream), "links").count() == 2

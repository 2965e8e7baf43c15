"""The navigation source, table functions, chains, kept verdicts, sites that devices keep and their histories as streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import tables
from kestrel.operators import rules, state
from kestrel.sources import navigation as sources
from kestrel.sources import readers
from kestrel.streaming import navigation as nav


def write_log(path, rows, extra=()):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + "".join(extra))


def logs(folder, n=4, each=50):
    folder.mkdir(exist_ok=True)
    for k in range(n):
        rows = [{"device": i % 3, "tab": 0, "event_id": k * each + i, "ts": 10**15 + i, "kind": "complete", "url": f"https://h{i}.com/é"} for i in range(each)]
        write_log(folder / f"log-{k:03}.json", rows)


def test_batch_reads_of_pieces(spark, tmp_path):
    logs(tmp_path / "in")
    write_log(tmp_path / "in" / "log-100.json", [{"device": 9, "kind": "block", "ts": None, "tab": "x"}], ["not json\n", "[1]\n", '{"device": 1, "kind": "odd"}\n', '{"device": 7, "kind": "url"}'])
    (tmp_path / "in" / "_hidden").write_text('{"device": 1, "kind": "url"}\n')
    sources.register(spark)
    got = spark.read.format("navigation").load(str(tmp_path / "in")).collect()
    assert sorted(r["event_id"] for r in got if r["event_id"] is not None) == list(range(200))
    assert sorted((r["device"], r["kind"], r["tab"], r["ts"]) for r in got if r["event_id"] is None) == [(7, "url", None, None), (9, "block", None, None)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("navigation").load(str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("split", [1, 7, 64, 100_000])
def test_every_line_belongs_to_one_piece(tmp_path, monkeypatch, split):
    monkeypatch.setattr(sources, "SPLIT", split)
    text = b"aa\n\nbbbb\nc\n" + b"d" * 90 + b"\nlast"
    (tmp_path / "x").write_bytes(text)
    lines = [x for p in sources._cut(f"file://{tmp_path}/x", len(text)) for x in sources._lines(p)]
    assert [x for x in lines if x] == [x for x in text.split(b"\n") if x]


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    logs(tmp_path / "in", n=2)
    sources.register(spark)

    def run():
        stream = spark.readStream.format("navigation").option("logs_at_once", 1).load(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").start(f"{tmp_path}/out")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    logs(tmp_path / "in", n=4)
    run()
    got = [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == list(range(200))


def loop(events, most):
    """device -> [(registrable, count)] by the rule of the browser: sort by count, stable, and drop from the front."""
    kept = {}
    for device, _, site in sorted(events):
        sites = kept.setdefault(device, {})
        sites[site] = min(sites.get(site, 0) + 1, 999)
        for gone in sorted(sites, key=sites.get)[: max(0, len(sites) - most)]:
            del sites[gone]
    return {d: sorted(s.items()) for d, s in kept.items()}


@pytest.fixture(scope="module")
def visits():
    rng = random.Random(2)
    return [(rng.randrange(4), k, f"site{int(rng.expovariate(0.2))}.com") for k in range(1500)]


def as_events(spark, visits):
    t = dt.datetime(2024, 1, 1)
    rows = [(d, 0, k, t + dt.timedelta(seconds=k), "complete", "safe", s, s, s[:-4]) for d, k, s in visits]
    rows += [(0, 1, 9000 + k, t + dt.timedelta(seconds=k), kind, "dangerous", f"b{k // 3}.com", f"b{k // 3}.com", "bbbb") for k, kind in enumerate(["block", "loading", "block"] * 5)]
    return spark.createDataFrame(rows, "device long, tab int, event_id long, ts timestamp, kind string, level string, host string, registrable string, sld string")


@pytest.mark.parametrize("most", [5, 12, 300])
def test_sites_are_forgotten_in_order(spark, visits, most):
    got = {}
    for r in state.kept_sites(as_events(spark, visits).repartition(3), most).collect():
        got.setdefault(r["device"], []).append((r["registrable"], r["count"]))
    assert {d: sorted(s) for d, s in got.items()} == loop(visits, most)


def test_histories_equal_the_states_in_one(spark, visits, tmp_path):
    """The processor with states of its own, over a table and as a stream that is stopped midway."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = as_events(spark, visits)
    key = lambda rows: {r["event_id"]: (r["latched"], r["visits"], r["trusted"], tuple(r["recent"]), r["scanned"], r["blocked"]) for r in rows}
    whole = key(nav.device_histories(events, most_sites=6).collect())
    assert len(whole) == events.count()
    last = {d: max(k for e, k, _ in visits if e == d) for d in range(4)}
    assert {d: whole[last[d]][1] for d in range(4)} == {d: len(s) for d, s in loop(visits, 6).items()}
    edges = [0, 400, 401, 1000, 10_000]
    at = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(dt.datetime(2024, 1, 1)))

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = nav.device_histories(stream, most_sites=6)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").start(f"{tmp_path}/out")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        events.where((at >= low) & (at < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 3):
            run()
    assert key(spark.read.parquet(f"{tmp_path}/out").collect()) == whole


def test_histories_of_a_table_need_no_state_store(spark, visits):
    """Rows of a table go by in the order of time; null devices are one device, events without a time come last."""
    t = dt.datetime(2024, 1, 1)
    rows = [(None, 0, 1, t, "complete"), (None, 0, 2, None, "block"), (None, 0, 3, t, "complete"), (7, 0, 4, t, "block"), (7, 0, 5, t, "loading"), (7, 1, 6, t, "complete")]
    events = spark.createDataFrame([(*r, "safe", "h.com", "h.com", None) for r in rows], as_events(spark, visits).schema)
    histories = nav.device_histories(events.repartition(3))
    assert "TransformWithState" not in histories._jdf.queryExecution().toString()
    got = {r["event_id"]: (r["latched"], r["visits"], r["scanned"], r["blocked"]) for r in histories.collect()}
    assert got == {1: (False, 0, 1, 0), 3: (False, 0, 2, 0), 2: (True, 0, 2, 1), 4: (True, 0, 0, 1), 5: (False, 0, 0, 1), 6: (False, 0, 1, 1)}


def test_following_chains(spark):
    rows = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, None), (400, 5), (400, 9), (None, 1)]
    table = spark.createDataFrame(rows, "node int, target int")
    step = {k: v for k, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -(r[1] or 0))) if k is not None and v is not None}
    for steps in (0, 1, 5, 13):
        want = {}
        for node in {k for k, _ in rows if k is not None}:
            at = node
            for _ in range(steps):
                at = step.get(at, at)
            want[node] = at
        assert {r["node"]: r["target"] for r in readers.follow(table, steps).collect()} == want


def test_only_new_inputs_are_scored(spark, tmp_path, monkeypatch):
    scored = []
    score = rules.score_hosts
    monkeypatch.setattr(rules, "score_hosts", lambda df, *a, **k: (scored.append(sorted(r[0] or "" for r in df.collect())), score(df, *a, **k))[1])
    first = spark.createDataFrame([("paypal.com",), ("paypa1.com",), (None,), ("paypa1.com",)], "input string")
    more = spark.createDataFrame([("paypa1.com",), ("gogle.com",), (None,)], "input string")
    rules.analyze_new(first, f"{tmp_path}/v")
    got = rules.analyze_new(more, f"{tmp_path}/v")
    assert scored == [["", "paypa1.com", "paypal.com"], ["gogle.com"]]
    want = {r["input"]: r["verdict"] for r in rules.analyze(more).collect()}
    assert {r["input"]: r["verdict"] for r in got.collect()} == want and got.count() == 3
    scored.clear()
    rules.analyze_new(more, f"{tmp_path}/v", extra_brands=[dims.Brand("x", "gogle", "gogle.com", "Tech")])
    assert scored == [["", "gogle.com", "paypa1.com"]]  # other brands, other table


def test_null_keys_of_state_tables(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(1, n), (None, n)], "k int, n int")
    readers.upsert_state(rows(1), f"{tmp_path}/s", ["k"])
    readers.upsert_state(rows(2), f"{tmp_path}/s", ["k"])
    assert sorted(map(str, readers.read_state(spark, f"{tmp_path}/s")[0].collect())) == ["Row(k=1, n=2)", "Row(k=None, n=2)"]


def test_table_functions(spark):
    tables.register(spark)
    near = {(r["kind"], r["label"]) for r in spark.sql("SELECT * FROM look_alikes('pay')").collect()}
    assert {("swap", "apy"), ("delete", "py"), ("double", "ppay"), ("glyph", "pаy")} <= near and not any(label == "pay" for _, label in near)
    assert spark.sql("SELECT * FROM look_alikes(NULL)").collect() == []
    got = spark.sql("SELECT p.id, l.* FROM VALUES (1, 'https://a.com/', '<a href=//b.com/x>'), (2, NULL, '<a href=/x>'), (3, 'https://a.com/', NULL) AS p(id, url, html), LATERAL page_links(p.url, p.html) AS l")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, 0, "//b.com/x", "https://b.com/x", "b.com", True), (2, 0, "/x", None, None, False)]

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import hosts, unicode, urls
from kestrel.operators import evaluate, features, generate, pages, rules, state
from kestrel.operators.parse import parse_hosts
from kestrel.sources import readers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("host,sld,suffix,registrable", [
    ("amazon.co.jp", "amazon", "co.jp", "amazon.co.jp"), ("www.ck", "www", "ck", "www.ck"), ("foo.ck", "", "foo.ck", "foo.ck"),
    ("a.foo.ck", "a", "foo.ck", "a.foo.ck"), ("com", "", "com", "com"), ("1.2.3.4", "3", "4", "3.4"), ("", "", "", ""),
    ("x.y.unknown", "y", "unknown", "y.unknown"), ("..a..co.uk.", "a", "co.uk", "a.co.uk")])
def test_suffixes(spark, host, sld, suffix, registrable):
    r = parse_hosts(spark.createDataFrame([(host,)], "input string")).first()
    assert (r["sld"], r["suffix"], r["registrable"]) == (sld, suffix, registrable)


def test_host_functions(spark):
    assert one(spark, hosts.clean_host(F.lit("HTTPS://WWW.PayPal.com:443/a?b#c"))) == "www.paypal.com"
    assert one(spark, urls.url_host(F.lit("http://u:p@Ex.com:80/x"))) == "ex.com"
    assert one(spark, urls.url_host(F.lit("ftp://ex.com"))) is None
    assert one(spark, hosts.positions(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert one(spark, hosts.positions(F.lit("aaaa"), F.lit(""))) == []
    assert one(spark, hosts.escape_html(F.lit("<a href='x'>&\"</a>"))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"
    assert one(spark, hosts.round_half_up(F.lit(66.5))) == 67


def test_folds(spark):
    table = dims.confusables()
    assert [unicode.fold(c, table) for c in ("á", "ａ", "а", "ӏ")] == ["a", "a", "a", "l"]
    assert unicode.decode_label("xn--pypal-4ve") == "pаypal"
    assert unicode.decode_label("XN--80ak6aa92e") == "аррӏе"
    assert unicode.decode_label("xn--\x80") == "xn--\x80" and unicode.decode_label("plain") == "plain"
    assert one(spark, unicode.decode_host(F.lit("a.xn--pypal-4ve.com"))) == "a.pаypal.com"


def test_features_and_model(spark):
    # the published example has a surprisal of 3.237157 for this label
    f = features.extract_features(spark.createDataFrame([("paypa1.com",), ("paypal.com",)], "input string"))
    rows = {r["input"]: r for r in f.collect()}
    want = {"bestSim": 0.958333, "nearestVisual": 1, "sldLen": 6, "digitRatio": 0.166667, "simUnofficial": 0.958333}
    for name in features.NAMES[:-1]:
        assert rows["paypa1.com"][name] == pytest.approx(want.get(name, 0), abs=1e-6), name
    scored = features.predict(f.withColumn("ngramImprob", F.when(F.col("input") == "paypa1.com", 3.237157).otherwise(2.737257)))
    got = {r["input"]: r for r in scored.collect()}
    assert (got["paypa1.com"]["level"], got["paypal.com"]["level"]) == ("dangerous", "safe")
    assert got["paypa1.com"]["logit"] == pytest.approx(6.902249, abs=1e-4)
    assert got["paypal.com"]["logit"] == pytest.approx(-4.444594, abs=1e-4)
    sizes = [abs(t["contribution"]) for t in got["paypa1.com"]["contributions"]]
    assert sizes == sorted(sizes, reverse=True)


def test_training(spark):
    rows = [(float(k % 10), float(k % 3), int(k % 10 > 5)) for k in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    weights, bias = features.train_logistic(df, ["a", "b"], rounds=60)
    auc = evaluate.roc_auc(features.predict(df, weights, bias), "probability", F.col("y") == 1).first()["auc"]
    assert auc > 0.99
    fitted = features.fit_pipeline(df, ["a", "b"]).transform(df.withColumn("class_weight", F.lit(1.0)))
    assert fitted.where("prediction = y").count() > 190


def test_bigrams(spark):
    labels = spark.createDataFrame([("paypal",), ("google",), ("x",)], "label string")
    grid = features.bigram_map(spark, features.train_bigrams(labels))
    assert len(grid) == 39 * 39
    assert grid["^p"] == pytest.approx(math.log(2 / 41))
    assert one(spark, features.improbability(F.lit("é"), grid)) == pytest.approx(math.log(39))


def test_lookalikes_are_caught(spark):
    made = generate.lookalikes(spark)
    assert made.count() == made.select("family", "domain").distinct().count() > 300
    hit = rules.analyze(made, "domain").groupBy("family").agg(F.avg((F.col("verdict.level") != "safe").cast("int")).alias("r")).collect()
    got = {r["family"]: r["r"] for r in hit}
    assert set(got) == set(generate.FAMILIES)
    assert all(r >= 0.95 for f, r in got.items() if f not in ("homoglyph", "typo", "digit-swap"))
    assert got["typo"] > 0.8 and got["digit-swap"] > 0.8 and got["homoglyph"] > 0.8


def test_page_scan(spark):
    html = "".join(f"<a class=x href='https://{h}/p'>x</a>" for h in ("hdfcbank-kyc.xyz", "secure-paypal.tk", "sbi-rewards.online", "phonepе.com", "www.amazon.in", "www.google.com", "github.com", "demo.org"))
    html += '<a href="/local">l</a><a href="mailto:x@y.z">m</a><a href="#top">t</a><a href="//paypa1.com/a">p</a>'
    df = spark.createDataFrame([(1, "http://demo.org/a/b?c", html), (2, None, None)], "page_id int, url string, html string")
    links = pages.page_links(df)
    assert links.count() == 12
    flagged = {r["host"]: r["flag"] for r in pages.flag_links(links).collect()}
    assert flagged == {"hdfcbank-kyc.xyz": "danger", "secure-paypal.tk": "danger", "sbi-rewards.online": "danger", urls.host_of("phonepе.com"): "danger",
                       "www.amazon.in": None, "www.google.com": None, "github.com": None, "paypa1.com": "warn"}
    report = pages.page_report(pages.flag_links(links)).first()
    assert (report["links"], report["danger"], report["warn"]) == (8, 4, 1)


def test_state(spark):
    t = dt.datetime(2024, 1, 1)
    blocks = spark.createDataFrame([(1, k, t + dt.timedelta(seconds=k), h) for k, h in enumerate("AABAA")], "device int, event_id int, ts timestamp, host string")
    for spans in (None, 1, 3):
        assert [r["host"] for r in state.recent_threats(blocks, spans=spans).orderBy("place").collect()] == ["A", "B", "A"]
    other = [(1, "safe", "x.co", "x", t, "complete"), (1, "suspicious", "abcd.com", "abcd", t, "complete")]
    other += [(1, "safe", "abcd.com", "abcd", t, k) for k in ("loading", "block", "url", "activated")]
    visit = spark.createDataFrame([(1, "safe", "github.com", "github", t, "complete")] * 1005 + other,
                                  "device int, level string, registrable string, sld string, ts timestamp, kind string")
    assert [(r["registrable"], r["count"]) for r in state.visits(visit).collect()] == [("github.com", 999)]
    assert [(r["device"], [tuple(b) for b in r["learned"]]) for r in state.learned(state.visits(visit)).collect()] == [(1, [("github", "github.com")])]
    message = spark.createDataFrame([("h" * 300, "b", 250.0), ("h", None, float("nan")), ("", "b", 1.0)], "host string, brand string, score double")
    got = state.clean_message(message).collect()
    assert [(len(r["host"]), r["brand"], r["score"]) for r in got] == [(253, "b", 100.0), (1, "a brand", 0.0)]
    tab = [("loading",), ("block",), ("complete",), ("loading",), ("complete",)]
    rows = [(1, 0, k, t + dt.timedelta(seconds=k), x) for k, (x,) in enumerate(tab)] + [(1, 1, 9, t + dt.timedelta(seconds=2), "complete")]
    events = spark.createDataFrame(rows, "device int, tab int, event_id int, ts timestamp, kind string")
    for spans in (None, 1, 3):
        assert [r["latched"] for r in state.block_latch(events, spans).orderBy("event_id").collect()] == [False, True, True, False, False, False]


def test_spans_of_a_busy_device(spark):
    """Spans change nothing, whatever nulls, ties and gaps there are."""
    draw = random.Random(5)
    t = dt.datetime(2024, 1, 1)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.choice([0, 1]), k, draw.choice([None] + [t + dt.timedelta(seconds=draw.randrange(90))] * 9),
             draw.choice(["block", "loading", "complete", "complete", "url"]), draw.choice(["a", "b", None])) for k in range(400)]
    events = spark.createDataFrame(rows, "device int, tab int, event_id int, ts timestamp, kind string, host string").cache()
    order = lambda r: (r[3] is not None, r[3] or t, r[2])
    latched, shown = {}, {}
    for device, tab, k, _, kind, host in sorted(rows, key=order):
        if kind in ("block", "loading"):
            latched[device, tab] = kind == "block"
        shown[k] = latched.get((device, tab), False)
    hosts = {}
    for device, _, k, _, kind, host in sorted(rows, key=order):
        if kind == "block":
            run = hosts.setdefault(device, [])
            run.append((host, k, not run or host is None or run[-1][0] != host))
    newest = {(d, place + 1): k for d, run in hosts.items() for place, k in enumerate([k for _, k, fresh in run if fresh][::-1][:8])}
    for spans in (None, 7):
        assert {r["event_id"]: r["latched"] for r in state.block_latch(events, spans).collect()} == shown
        got = state.recent_threats(events.where("kind = 'block'"), spans=spans).collect()
        assert {(r["device"], r["place"]): r["event_id"] for r in got} == newest


def test_metrics(spark):
    df = spark.createDataFrame([(k, s, y) for k, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)])], "id int, s double, y int")
    assert evaluate.roc_auc(df, "s", F.col("y") == 1).first()["auc"] == pytest.approx(0.875)
    assert evaluate.average_precision(df, "s", F.col("y") == 1, "id").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)
    c = evaluate.confusion(df, F.col("s") >= 0.8, F.col("y") == 1).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"], c["recall"]) == (2, 1, 1, 0, 1.0)
    hundred = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert {r["p"]: r["value"] for r in evaluate.exact_quantiles(hundred, "v", [0.5, 0.95, 1.0], buckets=7).collect()} == {0.5: 50, 0.95: 95, 1.0: 99}
    assert evaluate.threshold_grid(0.05, 0.1) == [0.05, 0.060000000000000005, 0.07, 0.08, 0.09, 0.09999999999999999]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "top.csv").write_text("1,Google.com\n2, paypal.com \n3,\n4,x.org\n")
    assert [r["host"] for r in readers.ranked_csv(spark, f"{tmp_path}/top.csv", 2).collect()] == ["google.com", "paypal.com"]
    (tmp_path / "perm.csv").write_text("brand,fuzzer,domain,a,b\npaypal.com,*original,paypal.com,,\npaypal.com,omission,PAYPL.com,1,\npaypal.com,other,paypl.com,,\n>> x,y,z.com,,\nhdfcbank.com,x,goo.gl,,\n")
    assert [(r["domain"], r["core"]) for r in readers.permutations(spark, f"{tmp_path}/perm.csv").collect()] == [("paypl.com", "paypal")]
    (tmp_path / "psl.dat").write_text("// x\n// ===BEGIN ICANN DOMAINS===\ncom\n*.ck\n!www.ck\n\n// ===END ICANN DOMAINS===\nblog.example\n")
    got = {(r["suffix"], r["is_exact"], r["is_wild"], r["is_exception"]) for r in dims.read_suffix_rules(spark, f"{tmp_path}/psl.dat").collect()}
    assert got == {("com", True, False, False), ("ck", False, True, False), ("www.ck", False, False, True)}
    (tmp_path / "conf.txt").write_text("# c\n0430 ; 0061 ; MA # x\n0461 ; 0430 ; MA\n0041 ; 0061 ; MA\n0042 ; 0430 0061 ; MA\n")
    assert {(r["ch"], r["target"]) for r in readers.read_confusables(spark, f"{tmp_path}/conf.txt").collect()} == {("а", "a"), ("ѡ", "a")}
    readers.write_model(spark, dims.model_table(), dims.MODEL_BIAS, dims.WARN_AT, dims.BLOCK_AT, f"{tmp_path}/model")
    weights, bias, warn, block = readers.read_model(spark, f"{tmp_path}/model")
    assert weights == dims.model_table() and (bias, warn, block) == (dims.MODEL_BIAS, dims.WARN_AT, dims.BLOCK_AT)
    for rows in ([("a", 1)], [("a", 2), ("b", 1)]):
        readers.upsert_state(spark.createDataFrame(rows, "k string, v2 int"), f"{tmp_path}/state", ["k"])
    assert {tuple(r) for r in readers.read_state(spark, f"{tmp_path}/state")[0].collect()} == {("a", 2), ("b", 1)}
    for n in range(4):
        readers.upsert_state(spark.createDataFrame([("c", n)], "k string, v2 int"), f"{tmp_path}/state", ["k"])
    assert {tuple(r) for r in readers.read_state(spark, f"{tmp_path}/state")[0].collect()} == {("a", 2), ("b", 1), ("c", 3)}
    assert max(len(list(b.iterdir())) for b in (tmp_path / "state").glob("bucket=*")) == 2
    assert readers.read_state(spark, f"{tmp_path}/none") == (None, 0)
    readers.write_verdicts(rules.analyze(spark.createDataFrame([("paypal.com",)], "input string")), f"{tmp_path}/verdicts")
    assert spark.read.parquet(f"{tmp_path}/verdicts").select("verdict.level").first()[0] == "safe"
    readers.write_json(spark.createDataFrame([(1,)], "k int"), f"{tmp_path}/json")
    readers.write_hosts(spark.createDataFrame([("a.com",), (" ",)], "host string"), f"{tmp_path}/hosts")
    assert [r["host"] for r in readers.lines(spark, f"{tmp_path}/hosts").collect()] == ["a.com"]


def test_logistic_models_against_a_plain_loop(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [(k, k % 3, rng.random(), rng.gauss(0, 2), int(rng.random() < 0.3)) for k in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, y int").repartition(3)

    def plain(rows, used, rounds):
        x, y = np.array([[r[2], r[3]] for r in rows])[:, used], np.array([r[4] for r in rows])
        mean, std = x.mean(0), x.std(0)
        z, n, p = (x - mean) / std, len(y), y.sum()
        cw = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(rounds):
            e = cw * (1 / (1 + np.exp(-(z @ w + b))) - y)
            w, b = w - 0.5 * (z.T @ e / cw.sum() + 1e-4 * w), b - 0.5 * e.sum() / cw.sum()
        return w, b

    fits, best = features.train_models(df, ["a", "b"], leave_out="g", groups=[0, None, 0], used=[["a", "b"], ["a", "b"], ["b"]], rounds=25, grid=[0.2, 0.5])
    for (table, bias), (out, used) in zip(fits, ((0, [0, 1]), (None, [0, 1]), (0, [1]))):
        w, b = plain([r for r in rows if r[1] != out], used, 25)
        assert [t[3] for t in table] == pytest.approx(w.tolist()) and bias == pytest.approx(b)
    assert len(best) == 3
    left = evaluate.leave_one_out(df.withColumn("brand", F.concat(F.lit("b"), F.col("g"))), ["a", "b"], rounds=10).collect()
    assert sum(r["n"] for r in left) == sum(r[4] for r in rows) and {r["brand"] for r in left} == {"b0", "b1", "b2"}


def test_full_tables(spark):
    suffixes = dims.public_suffixes()
    kinds = [sum(r.startswith(k) for r in suffixes) for k in ("*.", "!")]
    assert (len(suffixes), kinds) == (6933, [16, 8])
    assert dims.suffix_rules(spark).agg(F.sum(F.col("is_exact").cast("int")), F.sum(F.col("is_wild").cast("int"))).first() == (6909, 16)
    assert len(dims.confusables()) == 1629 and len(dims.bigram_grid()) == 39 * 39
    assert unicode.fold("gøøgłe", dims.confusables()) == "google" and unicode.fold("đŧ", dims.confusables()) == "dt"
    df = spark.createDataFrame([("paypal.com.hk",), ("gøøgle.com",)], "input string")
    got = {r["input"]: r["verdict"] for r in rules.analyze(df, "input").collect()}
    assert (got["gøøgle.com"]["level"], got["gøøgle.com"]["score"], got["paypal.com.hk"]["level"]) == ("dangerous", 85, "safe")
    f = {r["input"]: r["ngramImprob"] for r in features.extract_features(spark.createDataFrame([("paypal.com",), ("paypa1.com",)], "input string")).collect()}
    assert f == pytest.approx({"paypal.com": 2.737257, "paypa1.com": 3.237157}, abs=1e-6)


def test_ranges_of_any_number(spark):
    df = spark.range(3000).select((F.col("id") % 997).cast("double").alias("v"))
    for buckets in (1, 5, 200, 900):
        parts = evaluate.in_ranges(df, "v", buckets).groupBy("part").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("part").collect()
        assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:])) and len(parts) >= buckets // 2
    assert {r["value"] for r in evaluate.exact_quantiles(df, "v", [0.5], buckets=700).collect()} == {497.0}

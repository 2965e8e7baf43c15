"""One query per operator of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import distance, hosts, tables, unicode, urls
from kestrel.operators import evaluate as ev
from kestrel.operators import features as ft
from kestrel.operators import generate, match, pages, patterns, rules, state
from kestrel.operators.parse import parse_hosts
from kestrel.plans import verdicts
from kestrel.plans.inputs import (
    ALL_SQL,
    BAD_TLDS_SQL,
    BRANDS_SQL,
    CORES,
    HOSTS_SQL,
    NAVIGATION_SQL,
    PARSED_SQL,
    SCORED_SQL,
    derived_hosts,
    navigation,
    scored_hosts,
    table,
)
from kestrel.sources import navigation as sources
from kestrel.sources import readers
from kestrel.streaming import navigation as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived hosts, each different one parsed once."""
    return parse_hosts(derived_hosts(spark, sf_dir).select("host").distinct(), "host")


def ascii_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed hosts with the skeletons that ASCII hosts have, for the operators on built-in functions."""
    p = parsed(spark, sf_dir)
    return p.withColumn("skeleton", F.lower("sld")).withColumn("sub_skeletons", F.col("subdomains"))


# ---- sources -------------------------------------------------------------------------------------------------------


@query("SRC2_ranked_hosts", "SELECT page_id AS rank, lower(trim(url)) AS host FROM pages ORDER BY page_id LIMIT 100")
def src2(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("rank"), F.col("url").alias("host"))
    return readers.clean_ranked(t, 100)


#: Page URLs are plain: scheme, host, path. The host is what stands between the slashes and the next mark.
_URL_HOST = "lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1))"


@query("SRC3_feed_hosts", f"SELECT DISTINCT CASE WHEN {_URL_HOST} LIKE 'www.%' THEN substr({_URL_HOST}, 5) ELSE {_URL_HOST} END AS host FROM pages")
def src3(spark, sf_dir):
    return readers.feed_hosts(table(spark, sf_dir, "pages"))


@query("SRC3_unreadable", "SELECT count(*) AS unreadable FROM (SELECT p_name AS url FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT url || ':x' FROM pages) "
       "WHERE NOT contains(url, '://') OR regexp_matches(url, '^[^/]*//[^/?#]*:x')")  # fmt: skip
def src3_unreadable(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("url"))
    urls_ = table(spark, sf_dir, "pages").select("url")
    return readers.unreadable(names.unionByName(urls_).unionByName(urls_.select(F.concat("url", F.lit(":x")).alias("url"))))


@query("SRC1_one_host", "SELECT 'https://Secure-PayPal.xyz/login' AS input")
def src1(spark, sf_dir):
    return readers.one(spark, "https://Secure-PayPal.xyz/login")


def _written(spark, name: str, write):
    """What a sink wrote, in a new folder that driver and executors share."""
    path = readers.shared_path(spark, name)
    write(path)
    return path


@query("SRC4_lines", "SELECT lower(trim(url)) AS host FROM pages")
def src4(spark, sf_dir):
    hosts_ = table(spark, sf_dir, "pages").select(F.lower(F.concat(F.lit("  "), "url", F.lit(" "))).alias("host"))
    return readers.lines(spark, _written(spark, "hosts", lambda path: readers.write_hosts(hosts_, path)))


@query("SNK1_verdicts", f"{verdicts.VERDICT_SQL} SELECT host, level, score, brand FROM judged")
def snk1(spark, sf_dir):
    scored = verdicts.analysed(spark, sf_dir).select("host", "level", "score", "brand")
    return spark.read.parquet(_written(spark, "verdicts", lambda path: readers.write_verdicts(scored, path)))


@query("SNK2_json", f"WITH {SCORED_SQL} SELECT family, count(*) AS n, count(*) FILTER (score >= 0.6) AS hits FROM scored GROUP BY family")
def snk2(spark, sf_dir):
    report = ev.by_family(scored_hosts(spark, sf_dir), {"hits": F.col("score") >= 0.6}).where("family <> 'ALL'")
    path = _written(spark, "report", lambda path: readers.write_json(report, path))
    return spark.read.schema("family string, n long, hits long").json(path)


@query("SNK3_model", "SELECT unnest([" + ", ".join(f"'{n}'" for n in ft.NAMES) + "]) AS feature, unnest([" + ", ".join(str(w) for *_, w in dims.model_table()) + "]::DOUBLE[]) AS weight")
def snk3(spark, sf_dir):
    path = _written(spark, "model", lambda path: readers.write_model(spark, dims.model_table(), dims.MODEL_BIAS, dims.WARN_AT, dims.BLOCK_AT, path))
    weights = readers.read_model(spark, path)[0]
    return spark.createDataFrame([(n, w) for n, _, _, w in weights], "feature string, weight double")


@query("SNK4_state", "SELECT c_custkey AS k, (CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END)::INT AS n FROM customer")
def snk4(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("n"))
    path = _written(spark, "state", lambda path: readers.upsert_state(first, path, ["k"]))
    readers.upsert_state(first.where("k % 3 = 0").withColumn("n", F.lit(2)), path, ["k"])
    return readers.read_state(spark, path)[0]


@query("SRC5_permutations", f"""WITH {ALL_SQL}, f AS (
  SELECT h.brand || '.com' AS brand, family AS fuzzer, host AS domain, row_number() OVER (PARTITION BY host ORDER BY id) AS k
  FROM hosts h WHERE h.brand <> '' AND host NOT IN (SELECT domain FROM official))
SELECT f.brand, fuzzer, f.domain, coalesce(b.core, string_split(f.brand, '.')[1]) AS core
FROM f LEFT JOIN brands b ON f.brand = b.domain WHERE k = 1""")
def src5(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).where("brand <> ''")
    rows = h.select("id", F.concat("brand", F.lit(".com")).alias("brand"), F.col("family").alias("fuzzer"), F.col("host").alias("domain"))
    return readers.clean_permutations(rows, "id")


@query("SRC7_suffix_rules", "SELECT DISTINCT regexp_replace(r, '^(!|\\*\\.)', '') AS suffix, r NOT LIKE '!%' AND r NOT LIKE '*.%' AS is_exact, "
       "r LIKE '*.%' AS is_wild, r LIKE '!%' AS is_exception FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '*.' ELSE '!' END || "
       "replace(p_name, ' ', '.') || p_partkey AS r FROM part)")  # fmt: skip
def src7(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.expr("case p_partkey % 3 when 0 then '' when 1 then '*.' else '!' end")
    return dims.classify_rules(p.select(F.concat(kind, F.replace("p_name", F.lit(" "), F.lit(".")), F.col("p_partkey").cast("string")).alias("rule")))


#: Characters of a path that a URL shows in percent form.
_PATH_SQL = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x20-\\x7E]') OR contains(' \"<>`{{}}^', c) THEN url_encode(c) ELSE c END), '')"

#: Pages hold plain anchors of absolute paths outside of scripts and comments.
_LINKS_SQL = f"""WITH a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages
)
SELECT page_id, href, regexp_extract(url, '^[a-z]+://') || {_URL_HOST} || {_PATH_SQL.format('href')} AS url, {_URL_HOST} AS host, false AS other FROM a"""


@query("SRC8_page_links", _LINKS_SQL)
def src8(spark, sf_dir):
    return pages.page_links(table(spark, sf_dir, "pages")).select("page_id", "href", "url", "host", "other")


#: Markup put before each page, with one anchor for each number; what they lead to is known by their making.
_ODD_MARKUP = (
    "<!-- <a href='/no'> --><script>var s = \"<a href='/no'>\";<!-- <script> </script><a href='/no'> --></script><template><a href='/no'></template>"
    "<style><a href='/no'></style><base href='/b/c/d?e'><base href='/no'><A class='x>y'\tHREF = '../p?q=1&amp;r=2&copy=3#f'>"
    "<a href=./x/%2e%2e/y/../z>0</a><a href='?only'><a href=#part><a href=''><a href='\\\\Other.Example\\up\\..\\down'>"
    "<a href='https://ex%61mple.com:443'><a href='javascript:void(0)'><a href='http://[::FFFF:0:1]:80/'><a href='//0x7f.1/a b'><a name=no>"
)
_ODD_LINKS = [
    "{o}/b/p?q=1&r=2&copy=3#f", "{o}/b/c/z", "{o}/b/c/d?only", "{o}/b/c/d?e#part", "{o}/b/c/d?e", "{s}other.example/down", "https://example.com/", None,
    "http://[::ffff:0:1]/", "{s}127.0.0.1/a%20b",
]
_ODD_SQL = "UNION ALL ".join(
    f"SELECT page_id, {k}::BIGINT AS place, " + ("NULL" if x is None else "'" + x.replace("{o}", f"' || regexp_extract(url, '^[a-z]+://') || {_URL_HOST} || '").replace("{s}", "' || regexp_extract(url, '^[a-z]+://') || '") + "'")
    + f" AS url, {str(k in (5, 6, 8, 9)).lower()} AS other FROM pages "
    for k, x in enumerate(_ODD_LINKS)
)


@query("SRC8_odd_markup", _ODD_SQL)
def src8_odd(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit(_ODD_MARKUP), F.replace("html", F.lit("<a "), F.lit("<b "))).alias("html"))
    return pages.page_links(t).select("page_id", F.col("place").cast("long").alias("place"), "url", "other")


@query("SRC10_url_host", f"SELECT page_id, {_URL_HOST} AS host FROM pages")
def src10(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"))


#: Spellings of a URL of host h and number n, and the host that a browser has, as SQL that Spark and DuckDB share.
_SPELT = {
    "upper": ("upper(url)", "h"),
    "backslashes": ("concat('http:', chr(92), chr(92), h, chr(92), 'x')", "h"),
    "no slashes": ("concat('https:', h)", "h"),
    "many slashes": ("concat('https:////', h, '//x')", "h"),
    "spaces and tabs": ("concat('  ht', chr(9), 'tp://', h, chr(10), '/ ')", "h"),
    "user and port": ("concat('https://u:p@ss@', h, ':8080')", "h"),
    "port out of range": ("concat('https://', h, ':', cast(65536 + n as varchar(20)))", "null"),
    "port of letters": ("concat('https://', h, ':8o80')", "null"),
    "escapes": ("concat('https://', replace(h, 'e', '%65'), '/')", "h"),
    "bad escapes": ("concat('https://', h, '%2/')", "null"),
    "wide letters": ("concat('https://', h, '．ｃｏｍ')", "concat(h, '.com')"),
    "umlaut": ("concat('https://Bücher.', h)", "concat('xn--bcher-kva.', h)"),
    "punycode": ("concat('https://XN--BCHER-KVA.', h)", "concat('xn--bcher-kva.', h)"),
    "bad punycode": ("concat('https://xn--a.', h)", "null"),
    "address as a number": ("concat('http://', cast(n as varchar(20)))", "concat('0.0.', cast(cast(floor(n / 256) as int) as varchar(20)), '.', cast(n % 256 as varchar(20)))"),
    "address in hexadecimal": ("concat('http://0x7f.0x', hex(n), '/')", "concat('127.0.', cast(cast(floor(n / 256) as int) as varchar(20)), '.', cast(n % 256 as varchar(20)))"),
    "five numbers": ("concat('http://1.2.3.4.', cast(n as varchar(20)))", "null"),
    "long address": ("concat('http://[2001:0DB8:0:0::', hex(n), ']:80/')", "concat('[2001:db8::', lower(hex(n)), ']')"),
    "open bracket": ("concat('http://[::', hex(n), '/')", "null"),
    "forbidden mark": ("concat('http://', h, '|x/')", "null"),
    "mail": ("concat('mailto:', h)", "null"),
    "no scheme": ("h", "null"),
}


@query("SRC10_spelt_hosts", "WITH p AS (SELECT page_id, url, 1 + page_id % 60000 AS n, " + _URL_HOST + " AS h FROM pages) "
       + " UNION ALL ".join(f"SELECT page_id, '{k}' AS spelling, {want.replace('null', 'NULL::VARCHAR')} AS host FROM p" for k, (_, want) in _SPELT.items()))
def src10_spelt(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("1 + page_id % 60000").alias("n"), F.lower(F.regexp_extract("url", "//([^/?#]*)", 1)).alias("h"))
    made = F.array(*[F.struct(F.lit(k).alias("spelling"), F.expr(sql).alias("url")) for k, (sql, _) in _SPELT.items()])
    return p.select("page_id", F.inline(made)).select("page_id", "spelling", urls.url_host(F.col("url")).alias("host"))


def navigation_log(spark, sf_dir) -> DataFrame:
    """Navigation events in the columns of the navigation source."""
    n = navigation(spark, sf_dir)
    url = F.concat(F.lit("https://"), "host", F.lit("/"))
    return n.select("device", "tab", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "kind", url.alias("url"))


@query("SRC9_events", f"WITH {NAVIGATION_SQL} SELECT device, tab, event_id, epoch_us(ts) AS us, kind, 'https://' || host || '/' AS url FROM nav")
def src9(spark, sf_dir):
    """Events written as logs of JSON lines and read through the source."""
    path = _written(spark, "events", lambda path: navigation_log(spark, sf_dir).write.json(path))
    sources.register(spark)
    return spark.read.format("navigation").load(path).withColumn("us", F.unix_micros("ts")).drop("ts")


@query("SRC8_sql_links", _LINKS_SQL)
def src8_sql(spark, sf_dir):
    """Links by the table function, in SQL text."""
    tables.register(spark)
    return spark.sql("SELECT page_id, l.href, l.url, l.host, l.other FROM {pages}, LATERAL page_links(url, html) AS l", pages=table(spark, sf_dir, "pages"))


@query("R13_sql_signals", f"{verdicts.VERDICT_SQL}, u AS (SELECT host, unnest(signals) AS s FROM judged) SELECT host, s.label, round(s.weight, 6) AS weight FROM u")
def r13_sql(spark, sf_dir):
    """Signals by the table function, in SQL text."""
    tables.register(spark)
    judged = verdicts.analysed(spark, sf_dir).select("host", "signals")
    return spark.sql("SELECT host, s.label, round(s.weight, 6) AS weight FROM {v} v, LATERAL verdict_signals(v.signals) AS s", v=judged)


@query("T6_sql_runs", f"WITH {NAVIGATION_SQL}, b AS (SELECT *, lag(host) OVER (PARTITION BY device ORDER BY ts, event_id) AS last FROM nav WHERE kind = 'block') "
       "SELECT device, event_id, host, (row_number() OVER (PARTITION BY device ORDER BY ts, event_id))::INT AS run FROM b WHERE last IS DISTINCT FROM host")  # fmt: skip
def t6_sql(spark, sf_dir):
    """Runs of blocked hosts by the table function over a partitioned table, in SQL text."""
    tables.register(spark)
    blocks = navigation(spark, sf_dir).where("kind = 'block'").select("device", "event_id", "ts", "host")
    return spark.sql("SELECT device, event_id, host, run FROM first_visits(TABLE(SELECT * FROM {b}) PARTITION BY device ORDER BY (ts, event_id))", b=blocks)


@query("SNK5_actions", f"WITH {NAVIGATION_SQL} SELECT event_id, CASE level WHEN 'dangerous' THEN 'block' WHEN 'suspicious' THEN 'warn_bar' ELSE 'none' END "
       "AS action, CASE level WHEN 'dangerous' THEN 'danger' WHEN 'suspicious' THEN 'warn' END AS flag FROM nav")  # fmt: skip
def snk5(spark, sf_dir):
    n = navigation(spark, sf_dir)
    return n.select("event_id", hosts.action_of(F.col("level")).alias("action"), hosts.flag_of(F.col("level")).alias("flag"))


# ---- hosts ---------------------------------------------------------------------------------------------------------


@query("P1_clean_host", "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(lower(trim(' ' || upper(url) || ':443/x')), "
       "'^[a-z][a-z0-9+.\\-]*://', ''), '^[^/?#]*'), ':[0-9]+$', '') AS host FROM pages")  # fmt: skip
def p1(spark, sf_dir):
    t = table(spark, sf_dir, "pages")
    return t.select("page_id", hosts.clean_host(F.concat(F.lit(" "), F.upper("url"), F.lit(":443/x"))).alias("host"))


@query("P2_labels", f"WITH {HOSTS_SQL} SELECT id, family, list_filter(string_split('.' || host || '..', '.'), lambda x: x <> '') AS labels FROM hosts")
def p2(spark, sf_dir):
    h = derived_hosts(spark, sf_dir)
    return h.select("id", "family", hosts.labels(F.concat(F.lit("."), "host", F.lit(".."))).alias("labels"))


@query("P3_punycode")
def p3(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).select("host").distinct()
    return h.withColumn("ascii", urls.to_ascii(F.col("host"))).withColumn("decoded", unicode.decode_host(F.col("ascii")))


@query("P4_suffix", f"WITH {ALL_SQL} SELECT host, suffix, sld, subdomains FROM parsed")
def p4(spark, sf_dir):
    return parsed(spark, sf_dir).select("host", "suffix", "sld", "subdomains")


_FULL_RULES_SQL = """rules AS (
  SELECT regexp_replace(r, '^(!|\\*\\.)', '') AS suffix, bool_or(left(r, 1) NOT IN ('!', '*')) AS e, bool_or(left(r, 1) = '*') AS w, bool_or(left(r, 1) = '!') AS x
  FROM (SELECT unnest(string_split('""" + " ".join(dims.public_suffixes()) + """', ' ')) AS r) GROUP BY 1
), hosts AS (
  SELECT unnest([suffix, 'shop.' || suffix, 'www.pay.shop.' || suffix]) AS host FROM rules
)"""


@query("P4_public_suffixes", f"WITH {_FULL_RULES_SQL}, {PARSED_SQL[PARSED_SQL.index('split AS ('):]} SELECT host, suffix, sld, subdomains, registrable FROM parsed")
def p4_full(spark, sf_dir):
    """Hosts under every rule of the list."""
    suffixes = dims.suffix_rules(spark).select("suffix")
    hosts_ = suffixes.select(F.explode(F.array("suffix", F.concat(F.lit("shop."), "suffix"), F.concat(F.lit("www.pay.shop."), "suffix"))).alias("host"))
    return parse_hosts(hosts_.distinct(), "host").select("host", "suffix", "sld", "subdomains", "registrable")


@query("P5_registrable", f"WITH {ALL_SQL} SELECT registrable, count(*) AS hosts, count(DISTINCT family) AS families FROM hosts JOIN parsed USING (host) GROUP BY registrable")
def p5(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).groupBy("host", "family").agg(F.count(F.lit(1)).alias("n"))
    return parse_hosts(h, "host").groupBy("registrable").agg(F.sum("n").alias("hosts"), F.countDistinct("family").alias("families"))


@query("P6_naive_parts", f"WITH {HOSTS_SQL} SELECT id, family, coalesce(CASE WHEN len(l) >= 2 THEN l[-2] END, '') AS sld, "
       "CASE WHEN len(l) >= 2 THEN l[-2] || '.' || l[-1] ELSE coalesce(l[-1], '') END AS registrable "
       "FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM hosts)")  # fmt: skip
def p6(spark, sf_dir):
    return derived_hosts(spark, sf_dir).select("id", "family", hosts.naive_parts(F.col("host")).alias("p")).select("id", "family", "p.*")


@query("P7_trainer_label", f"WITH {HOSTS_SQL} SELECT id, family, regexp_replace(coalesce(CASE WHEN len(l) >= 2 THEN l[-2] END, ''), '[^a-z0-9-]', '', 'g') AS label "
       "FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM hosts)")  # fmt: skip
def p7(spark, sf_dir):
    return derived_hosts(spark, sf_dir).select("id", "family", hosts.trainer_label(F.col("host")).alias("label"))


@query("P8_non_ascii", "SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii FROM documents")
def p8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hosts.has_non_ascii(F.col("text")).alias("non_ascii"))


@query("P9_glyphs", f"WITH {HOSTS_SQL}, g AS (SELECT id, family, unnest(string_split(host, '')) AS glyph FROM hosts) "
       "SELECT glyph, regexp_matches(glyph, '[^\\x00-\\x7F]') AS bad, 'U+' || lpad(upper(hex(ord(glyph))), 4, '0') AS code, count(*) AS n FROM g WHERE glyph <> '' GROUP BY glyph")  # fmt: skip
def p9(spark, sf_dir):
    g = derived_hosts(spark, sf_dir).select(F.explode(hosts.glyphs(F.col("host"))).alias("g")).select("g.*")
    return g.groupBy("glyph", "bad", "code").agg(F.count(F.lit(1)).alias("n"))


@query("P10_escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def p10(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hosts.escape_html(F.col("html")).alias("escaped"))


@query("P11_valid_candidate", "SELECT p_partkey, regexp_full_match(s, '[^\\s<>\"''&/\\\\]{1,253}') AS valid FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name "
       "WHEN 1 THEN replace(p_name, ' ', '-') || '.org' ELSE repeat(replace(p_name, ' ', ''), 30) END AS s FROM part)")  # fmt: skip
def p11(spark, sf_dir):
    s = F.expr("case p_partkey % 3 when 0 then p_name when 1 then concat(replace(p_name, ' ', '-'), '.org') else repeat(replace(p_name, ' ', ''), 30) end")
    return table(spark, sf_dir, "part").select("p_partkey", hosts.valid_candidate(s).alias("valid"))


@query("P12_percent", f"WITH {SCORED_SQL} SELECT id, family, floor(score * 100 + 0.5)::BIGINT AS percent, "
       "CASE WHEN score >= 0.65 THEN 'dangerous' WHEN score >= 0.3 THEN 'suspicious' ELSE 'safe' END AS level FROM scored")  # fmt: skip
def p12(spark, sf_dir):
    s = scored_hosts(spark, sf_dir)
    return s.select("id", "family", hosts.round_half_up(F.col("score") * 100).alias("percent"), hosts.level_of(F.col("score") * 100).alias("level"))


@query("P12_display", f"""{verdicts.VERDICT_SQL}, shown AS (
  SELECT host, level, score, CASE level WHEN 'safe' THEN 'Looks Safe' WHEN 'suspicious' THEN 'Suspicious' ELSE 'Likely Phishing' END AS title,
    CASE level WHEN 'safe' THEN '#34d399' WHEN 'suspicious' THEN '#f59e0b' ELSE '#f43f5e' END AS color,
    list_transform(signals[1:3], lambda s: s.label || ': ' || s.detail || CASE WHEN s.weight > 0 THEN ' +' || floor(s.weight * 100 + 0.5)::INT ELSE '' END) AS reasons FROM judged
)
SELECT s.host, s.level, s.score, title, color, reasons, floor(v.similarity * 100 + 0.5)::BIGINT || '%' AS similarity FROM shown s JOIN verdicts v ON v.host = s.host""")
def p12_display(spark, sf_dir):
    shown = rules.display(verdicts.analysed(spark, sf_dir))
    reasons = F.transform("reasons", lambda r: F.concat(r["label"], F.lit(": "), r["detail"], F.when(r["points"] > 0, F.concat(F.lit(" +"), r["points"].cast("string"))).otherwise("")))
    return shown.select("host", "level", "score", "title", "color", reasons.alias("reasons"), "similarity")


# ---- Unicode -------------------------------------------------------------------------------------------------------


@query("U1_skeleton", f"WITH {HOSTS_SQL} SELECT id, family, translate(lower(host), 'аео', 'aeo') AS skeleton FROM hosts")
def u1(spark, sf_dir):
    return derived_hosts(spark, sf_dir).select("id", "family", unicode.skeleton(F.col("host")).alias("skeleton"))


@query("U7_chains", """WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey * 13 + 7) % (SELECT max(c_custkey) FROM customer) END AS next FROM customer),
t AS (SELECT node, coalesce(next, node) AS target, 1 AS step FROM e UNION ALL SELECT t.node, e.next, step + 1 FROM t JOIN e ON e.node = t.target WHERE step < 13 AND e.next IS NOT NULL AND e.next <> t.target)
SELECT node, arg_max(target, step) AS target FROM t GROUP BY node""")
def u7_chains(spark, sf_dir):
    """Customers that point on to customers, up to 13 steps, cycles among them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    most = c.agg(F.max("node").alias("most"))
    following = F.when(F.expr("node % 5 > 0"), (F.col("node") * 13 + 7) % F.col("most"))
    return readers.follow(c.join(F.broadcast(most)).select("node", following.alias("target")), 13)


@query("U3_scripts", f"WITH {HOSTS_SQL}, g AS (SELECT id, family, unnest(string_split(host, '')) AS c FROM hosts) SELECT family, CASE WHEN ord(c) BETWEEN 1024 AND 1279 THEN 'Cyrillic' "
       "WHEN ord(c) BETWEEN 880 AND 1023 THEN 'Greek' WHEN ord(c) BETWEEN 65280 AND 65519 THEN 'Full-width' WHEN ord(c) > 127 THEN 'Unicode' ELSE 'Latin' END AS script, "
       "count(*) AS n FROM g WHERE c <> '' GROUP BY ALL")  # fmt: skip
def u3(spark, sf_dir):
    chars = derived_hosts(spark, sf_dir).select("family", F.explode(F.split("host", "")).alias("c")).where("c <> ''")
    return chars.groupBy("family", hosts.script_of(F.col("c")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


#: Letters that stand for a, e, o and p in labels of several scripts.
_SPELLINGS = ["aeop", "аеор", "αeορ", "ａｅｏｐ", "áéóp"]
_SPELT_LABELS = "SELECT id, k, translate(split_part(host, '.', 1), 'aeop', s) AS label FROM hosts, (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(_SPELLINGS)) + ") AS v(k, s)"


@query("U4_letter_scripts", f"""WITH {HOSTS_SQL}, spelt AS ({_SPELT_LABELS}), scripts AS (SELECT id, k, label, list_sort(list_distinct(list_filter(list_transform(string_split(label, ''), lambda c:
  CASE WHEN regexp_matches(c, '[a-záéó]') THEN 'Latin' WHEN c <> '' AND contains('аеор', c) THEN 'Cyrillic' WHEN c <> '' AND contains('αορ', c) THEN 'Greek'
  WHEN c <> '' AND contains('ａｅｏｐ', c) THEN 'Full-width' END), lambda x: x IS NOT NULL))) AS found FROM spelt)
SELECT id, k, label, array_to_string(found, ' ') AS scripts, len(found) > 1 AS mixed, translate(label, 'аеорαορａｅｏｐáéó', 'aeopaopaeopaeo') AS skeleton FROM scripts""")
def u4(spark, sf_dir):
    """Labels spelt in Latin, Cyrillic, Greek, full-width and accented letters: their scripts, and what they look like."""
    out = derived_hosts(spark, sf_dir).select("id", "host", F.explode(F.sequence(F.lit(0), F.lit(len(_SPELLINGS) - 1))).alias("k"))
    spelt = F.coalesce(*[F.when(F.col("k") == k, F.translate(F.substring_index("host", ".", 1), "aeop", x)) for k, x in enumerate(_SPELLINGS)])
    out = out.select("id", "k", spelt.alias("label"))
    scripts = unicode.letter_scripts(F.col("label"))
    return out.select("id", "k", "label", F.array_join(F.sort_array(scripts), " ").alias("scripts"), (F.size(scripts) > 1).alias("mixed"), unicode.skeleton(F.col("label")).alias("skeleton"))


@query("U6_folds", f"WITH {ALL_SQL} SELECT host, regexp_matches(sld, '[аео]') AND regexp_matches(sld, '[a-z]') AS mixed, "
       "len(regexp_extract_all(sld, '[аео]')) AS folds FROM parsed")  # fmt: skip
def u6(spark, sf_dir):
    g = match.with_glyphs(parsed(spark, sf_dir))
    return g.select("host", "mixed", F.size("folds").cast("long").alias("folds"))


# ---- distances and matches -----------------------------------------------------------------------------------------

_KIND_SQL = "CASE WHEN a = b THEN 'same' WHEN a || b IN (" + ", ".join(f"'{p}'" for p, k in dims.substitution_kinds().items() if k == "visual") + \
    ") THEN 'visual' WHEN a || b IN (" + ", ".join(f"'{p}'" for p, k in dims.substitution_kinds().items() if k == "keyboard") + ") THEN 'keyboard' ELSE 'different' END"
_COST_SQL = f"CASE {_KIND_SQL} WHEN 'same' THEN 0.0 WHEN 'visual' THEN 0.25 WHEN 'keyboard' THEN 0.6 ELSE 1.0 END"


@query("M1_substitution_cost", f"WITH c AS (SELECT DISTINCT unnest(string_split(p_name, '')) AS c FROM part UNION SELECT unnest(string_split('0123456789', ''))), "
       f"p AS (SELECT x.c AS a, y.c AS b FROM c x, c y) SELECT a, b, {_COST_SQL}::DOUBLE AS cost, {_KIND_SQL} AS kind FROM p WHERE a <> '' AND b <> ''")  # fmt: skip
def m1(spark, sf_dir):
    chars = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat("p_name", F.lit("0123456789")), "")).alias("c")).where("c <> ''").distinct()
    listed = chars.agg(F.collect_set("c").alias("l"))  # the alphabet
    pairs = listed.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b"))
    return pairs.select("a", "b", distance.substitution_cost(F.col("a"), F.col("b")).alias("cost"), distance.substitution_kind(F.col("a"), F.col("b")).alias("kind"))


_DISTANCE_SQL = f"""WITH RECURSIVE {HOSTS_SQL}, pairs AS (
  SELECT DISTINCT translate(string_split(host, '.')[1], 'аео', 'aeo') AS x, brand AS y FROM hosts WHERE brand <> ''
), rows AS (
  SELECT x, y, 0 AS i, []::DOUBLE[] AS above, []::DOUBLE[] AS prev, list_transform(range(0, length(y) + 1), lambda j: j::DOUBLE) AS cur FROM pairs
  UNION ALL
  SELECT x, y, i + 1, prev, cur, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, least(acc[-1] + 1, cur[j + 1] + 1,
      cur[j] + {_COST_SQL.replace('a = b', "substr(x, i + 1, 1) = substr(y, j, 1)").replace('a || b', "substr(x, i + 1, 1) || substr(y, j, 1)")},
      CASE WHEN i > 0 AND j > 1 AND substr(x, i + 1, 1) = substr(y, j - 1, 1) AND substr(x, i, 1) = substr(y, j, 1) THEN prev[j - 1] + 1 ELSE 1000.0 END)),
    [i + 1.0]::DOUBLE[]) FROM rows WHERE i < length(x)
)
SELECT x AS label, y AS core, round(cur[-1], 6) AS distance FROM rows WHERE i = length(x)"""


@query("M3_weighted_distance", _DISTANCE_SQL)
def m3(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).where("brand <> ''")
    pairs = h.select(F.translate(F.split("host", r"\.")[0], "аео", "aeo").alias("label"), F.col("brand").alias("core")).distinct()
    return pairs.withColumn("distance", F.round(distance.weighted_distance(F.col("label"), F.col("core")), 6))


@query("M5_cells", f"WITH {ALL_SQL} SELECT host, (length(sld) * (SELECT sum(length(core)) FROM brands WHERE length(core) >= 4))::BIGINT AS ops FROM parsed")
def m5(spark, sf_dir):
    return ascii_matched(spark, sf_dir).select("host", match.compared_cells(dims.brands(), F.col("skeleton")).cast("long").alias("ops"))


@query("M6_similarity", f"WITH {ALL_SQL} SELECT host, core, CASE WHEN greatest(length(sld), length(core)) = 0 THEN 1.0 ELSE greatest(0.0, 1 - levenshtein(translate(sld, 'аео', 'AEO'), core) / greatest(length(sld), length(core))::DOUBLE) END AS similarity "
       "FROM parsed, brands")  # fmt: skip
def m6(spark, sf_dir):
    return match.brand_distances(parsed(spark, sf_dir), "sld").select("host", "core", "similarity")


@query("M8_levenshtein", f"WITH {ALL_SQL} SELECT host, core, levenshtein(translate(sld, 'аео', 'AEO'), core) AS d FROM parsed, brands")
def m8(spark, sf_dir):
    return match.brand_distances(parsed(spark, sf_dir), "sld").select("host", "core", "d")


@query("M9_baseline", f"WITH {SCORED_SQL}, d AS (SELECT sld, min(levenshtein(translate(sld, 'аео', 'AEO'), core)) AS d FROM (SELECT DISTINCT sld FROM scored), brands WHERE length(core) >= 4 GROUP BY sld) "
       "SELECT id, family, d <= 1 AND NOT o AS t1, d <= 2 AND NOT o AS t2, d <= 3 AND NOT o AS t3 FROM (SELECT *, host IN (SELECT domain FROM brands) AS o FROM scored) JOIN d USING (sld)")  # fmt: skip
def m9(spark, sf_dir):
    h = scored_hosts(spark, sf_dir)
    return h.select("id", "family", *[match.within_distance(F.col("sld"), F.col("host"), t).alias(f"t{t}") for t in (1, 2, 3)])


@query("M10_positions", "SELECT p_partkey, list_filter(range(0, length(p_name)), lambda k: substr(p_name, (k + 1)::INT, 2) = 'in') AS places FROM part")
def m10(spark, sf_dir):
    places = hosts.positions(F.col("p_name"), F.lit("in"))
    return table(spark, sf_dir, "part").select("p_partkey", places.cast("array<long>").alias("places"))


@query("M11_patterns", f"""WITH {ALL_SQL}, t AS (SELECT host, sld || '-' || sld AS label FROM parsed), c AS (SELECT host, label, unnest(range(1, length(label) + 1)) AS k FROM t)
SELECT host, core, k - 1 AS start, k - 1 + length(core) AS stop FROM c, brands WHERE length(core) >= 4 AND substr(label, k, length(core)) = core""")
def m11(spark, sf_dir):
    twice = parsed(spark, sf_dir).withColumn("label", F.concat_ws("-", "sld", "sld"))
    return match.brand_patterns(twice, "label").select("host", "core", "start", "stop")


_PIECES_SQL = "substr(p_name, 1 + p_partkey % 5, 4 + p_partkey % 2)"


@query("M11_many_patterns", f"""WITH p AS (SELECT DISTINCT {_PIECES_SQL} AS pattern FROM part), k AS (SELECT DISTINCT length(pattern) AS m FROM p),
c AS (SELECT doc_id, text, m, unnest(range(1, length(text) - m + 2)) AS i FROM documents, k)
SELECT doc_id, pattern, i - 1 AS start, i - 1 + m AS stop FROM c JOIN p ON substr(text, i, m) = pattern""")
def m11_many(spark, sf_dir):
    """Pieces of all part names in all documents."""
    pieces = table(spark, sf_dir, "part").select(F.expr(_PIECES_SQL).alias("pattern"))
    return patterns.find_patterns(table(spark, sf_dir, "documents"), pieces, id_col="doc_id", text_col="text")


def _first_sql(test: str, extra: str = "") -> str:
    return f"WITH {ALL_SQL} SELECT host, (SELECT core FROM brands b WHERE {test} ORDER BY {extra} ord LIMIT 1) AS core FROM parsed p"


def _core_query(column: str):
    def run(spark, sf_dir):
        b = dims.brands()
        m = ascii_matched(spark, sf_dir)
        places = {
            "embedded": match.embedded_brand(b, F.col("skeleton")),
            "token": match.token_brand(b, F.col("skeleton"), F.col("sld")),
            "sub": match.sub_brand(b, F.col("sub_skeletons")),
            "official": match.official_brand(b),
            "exact": match.first_of(b, lambda x: F.col("sld") == x.core),
        }
        return m.select("host", match.attribute(places[column], [x.core for x in b]).alias("core"))

    return run


query("M12_longest_embedded", _first_sql("length(core) >= 4 AND contains(p.sld, core)", "-length(core),"))(_core_query("embedded"))
query("M13_token_brand", _first_sql("length(core) >= 3 AND core <> p.sld AND list_contains(regexp_split_to_array(p.sld, '[-_]+'), core)"))(_core_query("token"))
query("M14_subdomain_brand", _first_sql("length(core) >= 4 AND contains(array_to_string(p.subdomains, chr(10)), core)"))(_core_query("sub"))
query("M15_official_brand", _first_sql(f"EXISTS (SELECT 1 FROM official o WHERE o.ord = b.ord AND o.domain = p.registrable) OR (owns AND core = p.sld AND p.last_label NOT IN {BAD_TLDS_SQL})"))(_core_query("official"))
query("M16_exact_core", _first_sql("core = p.sld"))(_core_query("exact"))


@query("M17_lures", f"WITH {ALL_SQL} SELECT host, coalesce((SELECT list(word ORDER BY ord) FROM lure_words WHERE contains(sld || chr(10) || array_to_string(subdomains, chr(10)), word)), []) AS lures FROM parsed")
def m17(spark, sf_dir):
    return ascii_matched(spark, sf_dir).select("host", match.lures(F.col("skeleton"), F.col("sub_skeletons")).alias("lures"))


@query("M18_suspicious_tld", f"WITH {ALL_SQL} SELECT host, last_label IN {BAD_TLDS_SQL} AS suspicious FROM parsed")
def m18(spark, sf_dir):
    return parsed(spark, sf_dir).select("host", match.suspicious_tld(F.col("last_label")).alias("suspicious"))


@query("M19_resembling", f"WITH {ALL_SQL} SELECT DISTINCT host FROM parsed, brands WHERE length(core) >= 4 AND (regexp_matches(host, '[^\\x00-\\x7F]') OR contains(sld, core) "
       "OR (sld <> '' AND contains(core, sld)) OR levenshtein(translate(sld, 'аео', 'AEO'), core) <= 2)")  # fmt: skip
def m19(spark, sf_dir):
    return parsed(spark, sf_dir).where(match.resembling(F.col("sld"), F.col("host"))).select("host")


_BIGRAMS_SQL = """t AS (SELECT '^' || lower(replace(p_name, ' ', '')) || '$' AS t FROM part WHERE length(replace(p_name, ' ', '')) >= 2),
n AS (SELECT substr(t, k::INT, 1) AS a, substr(t, k::INT + 1, 1) AS b, count(*) AS n FROM t, range(1, 100) r(k) WHERE k < length(t) GROUP BY ALL),
c AS (SELECT unnest(string_split('^$abcdefghijklmnopqrstuvwxyz0123456789-', '')) AS c),
grid AS (SELECT x.c AS a, y.c AS b, coalesce(n.n, 0) AS n FROM c x CROSS JOIN c y LEFT JOIN n ON n.a = x.c AND n.b = y.c),
logs AS (SELECT a, b, ln((n + 1.0) / (sum(n) OVER (PARTITION BY a) + 39)) AS logp FROM grid)"""


def _part_bigrams(spark, sf_dir):
    return ft.train_bigrams(table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("label")))


@query("F9_bigrams", f"WITH {_BIGRAMS_SQL} SELECT a, b, round(logp, 9) AS logp FROM logs")
def f9(spark, sf_dir):
    return _part_bigrams(spark, sf_dir).withColumn("logp", F.round("logp", 9))


@query("M20_improbability", f"WITH {HOSTS_SQL}, {_BIGRAMS_SQL}, s AS (SELECT DISTINCT string_split(host, '.')[1] AS label FROM hosts), p AS (SELECT label, '^' || lower(label) || '$' AS t FROM s), "
       "e AS (SELECT label, substr(t, k::INT, 1) AS a, substr(t, k::INT + 1, 1) AS b FROM p, range(1, 200) r(k) WHERE k < length(t)) "
       "SELECT label, round(avg(coalesce(-logp, ln(39))), 6) AS improbability FROM e LEFT JOIN logs USING (a, b) GROUP BY label")  # fmt: skip
def m20(spark, sf_dir):
    grid = ft.bigram_map(spark, _part_bigrams(spark, sf_dir))
    s = derived_hosts(spark, sf_dir).select(F.split("host", r"\.")[0].alias("label")).distinct()
    return s.withColumn("improbability", F.round(ft.improbability(F.col("label"), grid), 6))


# ---- verdicts and models -------------------------------------------------------------------------------------------


@query("F1b_label_counts", f"WITH {ALL_SQL} SELECT host, length(sld) AS sld_len, CASE WHEN sld = '' THEN 0 ELSE len(regexp_extract_all(sld, '[0-9]')) / length(sld)::DOUBLE END AS digit_ratio, "
       "len(regexp_extract_all(sld, '-')) AS hyphens FROM parsed")  # fmt: skip
def f1b(spark, sf_dir):
    n = F.length("sld")
    return parsed(spark, sf_dir).select("host", n.cast("long").alias("sld_len"), F.when(n > 0, F.regexp_count("sld", F.lit("[0-9]")) / n).otherwise(0.0).alias("digit_ratio"),
                                        F.regexp_count("sld", F.lit("-")).cast("long").alias("hyphens"))


@query("F5_standardise", f"WITH {SCORED_SQL} SELECT family, round(avg(score), 9) AS mean, round(coalesce(nullif(stddev_pop(score), 0), 1), 9) AS std FROM scored GROUP BY family")
def f5(spark, sf_dir):
    by = ft.standardised_by(scored_hosts(spark, sf_dir), "score", "family")
    return by.select("family", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


_GRID = ev.threshold_grid(0.05, 0.95)
_SWEEP_SQL = f"{SCORED_SQL}, s AS (SELECT t, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp, count(*) FILTER (score < t AND y = 1) AS fn " \
    f"FROM scored, (SELECT unnest({_GRID}::DOUBLE[]) AS t) GROUP BY t)"


@query("F7_sweep", f"WITH {_SWEEP_SQL} SELECT round(t, 6) AS t, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1 FROM s")
def f7(spark, sf_dir):
    return ev.sweep(scored_hosts(spark, sf_dir), "score", F.col("y") == 1, _GRID).withColumn("f1", F.round("f1", 9)).withColumn("t", F.round("t", 6))


@query("F7_best_threshold", f"WITH {_SWEEP_SQL} SELECT round(t, 6) AS t, tp, fp, fn FROM s ORDER BY 2 * tp / (2 * tp + fp + fn)::DOUBLE DESC, t LIMIT 1")
def f7_best(spark, sf_dir):
    best = ev.best_threshold(ev.sweep(scored_hosts(spark, sf_dir), "score", F.col("y") == 1, _GRID))
    return best.select(F.round("t", 6).alias("t"), "tp", "fp", "fn")


@query("F8_block_threshold", f"WITH {SCORED_SQL} SELECT round(least(0.995, greatest(0.52, coalesce(max(score) FILTER (y = 0), 0) + 0.001)), 9) AS block FROM scored")
def f8(spark, sf_dir):
    return ev.block_threshold(scored_hosts(spark, sf_dir), "score", F.col("y") == 1, 0.5).select(F.round("block", 9).alias("block"))


# ---- generator -----------------------------------------------------------------------------------------------------


_LIKES_SQL = "likes AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in generate.look_alikes().items()) + ") t(letter, glyphs))"
_AT = lambda text, k, n=1: f"substr({text}, ({k})::INT + 1, {n})"
_PUT = lambda text, k, new, n=1: f"substr({text}, 1, ({k})::INT) || {new} || substr({text}, ({k})::INT + 1 + {n})"
_Q = lambda word: f"'{word}'"


def _made_sql() -> str:
    """Look-alikes of the families that change letters: made(core, tld, family, kind, made)."""
    rows = [line for line in dims.KEYBOARD_ROWS]
    beside = lambda c: "CASE " + " ".join(f"WHEN instr('{r}', {c}) > 0 THEN substr('{r}', greatest(instr('{r}', {c}) - 1, 1), least(instr('{r}', {c}) - 1, 1)) || substr('{r}', instr('{r}', {c}) + 1, 1)" for r in rows) + " END"
    n = "length(core)"
    draw = lambda size, *key: _draw_sql(size, "core", *map(_Q, key), "''")
    like = lambda c: f"(SELECT glyphs FROM likes WHERE letter = {c})"

    def change(text: str, k: str, tag: str) -> str:
        choice = like(_AT("core", k))
        return f"CASE WHEN {choice} IS NULL THEN {text} ELSE {_PUT(text, k, _AT(choice, draw(f'length({choice})', tag)))} END"

    return f"""{_LIKES_SQL}, p AS (
  SELECT *, {draw(n, 'neighbour')} AS slip, {draw(n, 'delete')} AS gone, {draw(n, 'double')} AS twice, {draw(f'({n} - 1)', 'swap')} AS sw, {draw(n, 'glyph')} AS g0, {draw(2, 'glyphs')} + 2 AS several,
    list_filter(range(0, {n}), lambda k: contains('{generate.digits()[0]}', substr(core, k::INT + 1, 1))) AS digits FROM b
), q AS (SELECT *, {beside(_AT('core', 'slip'))} AS keys FROM p
), g1 AS (SELECT *, {change('core', 'g0', 'glyph')} AS one, {change('core', f'((g0 + 1) % {n})', 'glyph0')} AS m1 FROM q
), g2 AS (SELECT *, {change('m1', f'((g0 + 3) % {n})', 'glyph1')} AS m2 FROM g1
), g3 AS (SELECT *, CASE WHEN several > 2 THEN {change('m2', f'((g0 + 5) % {n})', 'glyph2')} ELSE m2 END AS m3 FROM g2
), made AS (
  SELECT core, tld, 'homoglyph' AS family, CASE WHEN one <> core THEN one END AS made FROM g3
  UNION ALL SELECT core, tld, 'homoglyph', CASE WHEN m3 <> core THEN m3 END FROM g3
  UNION ALL SELECT core, tld, 'typo', {_PUT('core', 'slip', _AT('keys', draw('length(keys)', 'key')))} FROM q
  UNION ALL SELECT core, tld, 'typo', CASE WHEN {n} > 4 THEN {_PUT('core', 'gone', _Q(''))} END FROM q
  UNION ALL SELECT core, tld, 'typo', {_PUT('core', 'twice', _AT('core', 'twice') + ' || ' + _AT('core', 'twice'))} FROM q
  UNION ALL SELECT core, tld, 'typo', CASE WHEN {_AT('core', 'sw')} <> {_AT('core', 'sw + 1')} THEN {_PUT('core', 'sw', _AT('core', 'sw + 1') + ' || ' + _AT('core', 'sw'), 2)} END FROM q
  UNION ALL SELECT core, tld, 'digit-swap', CASE WHEN len(digits) > 0 THEN {_PUT('core', f"digits[{draw('greatest(len(digits), 1)', 'digit')} + 1]", f"translate({_AT('core', 'digits[' + draw('greatest(len(digits), 1)', 'digit') + ' + 1]')}, '{generate.digits()[0]}', '{generate.digits()[1]}')")} END FROM q
  UNION ALL SELECT core, tld, 'digit-swap', CASE WHEN len(digits) > 0 THEN translate(core, '{generate.digits()[0]}', '{generate.digits()[1]}') END FROM q
)"""


_GENERATED_SQL = "GENERATED"


@query("G2_homoglyph", _GENERATED_SQL)
def g2(spark, sf_dir):
    return generate.lookalikes(spark).where("family = 'homoglyph'").select("domain", "brand")


@query("G3_typo", _GENERATED_SQL)
def g3(spark, sf_dir):
    return generate.lookalikes(spark).where("family = 'typo'").select("domain", "brand")


@query("G1_lookalikes", _GENERATED_SQL)
def g1(spark, sf_dir):
    return generate.lookalikes(spark)


def _draw_sql(n: int, *key: str) -> str:
    return f"(('0x' || substr(md5({' || chr(124) || '.join(key)}), 1, 8))::BIGINT % {n})"


def _pick_sql(values: list[str], *key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{_draw_sql(len(values), *key)} + 1]"


_MAKE_SQL = f"""WITH {BRANDS_SQL}, b AS (SELECT core, substr(domain, instr(domain, '.') + 1) AS tld FROM brands WHERE length(core) >= 4)"""


@query("G4_digit_swap_all", f"{_MAKE_SQL} SELECT translate(core, '{generate.digits()[0]}', '{generate.digits()[1]}') || '.' || tld AS domain, core AS brand FROM b WHERE regexp_matches(core, '[{generate.digits()[0]}]')")
def g4(spark, sf_dir):
    rows = spark.createDataFrame([(b.core, b.domain.partition(".")[2]) for b in CORES], "brand string, tld string")
    made = rows.select(generate.digit_swap(F.col("brand"))["all"].alias("d"), "tld", "brand").where("d is not null")
    return made.select(F.concat_ws(".", "d", "tld").alias("domain"), "brand")


@query("G5_combosquat", f"{_MAKE_SQL} SELECT core || '-' || {_pick_sql(generate.LURES, 'core', chr(39) + 'lure' + chr(39), chr(39) * 2)} || '.com' AS domain, core AS brand FROM b "
       f"UNION ALL SELECT {_pick_sql(generate.LURES, 'core', chr(39) + 'lure2' + chr(39), chr(39) * 2)} || '-' || core || '.' || {_pick_sql(generate.TLDS, 'core', chr(39) + 'tld2' + chr(39), chr(39) * 2)}, core FROM b")  # fmt: skip
def g5(spark, sf_dir):
    return generate.lookalikes(spark).where("family = 'combosquat'").select("domain", "brand")


@query("G6_tld_swap", f"{_MAKE_SQL}, d AS (SELECT *, {_draw_sql(len(generate.TLDS), 'core', chr(39) + 'tld' + chr(39), chr(39) * 2)} AS k, {generate.TLDS} AS l FROM b) "
       "SELECT core || '.' || CASE WHEN l[k + 1] = tld THEN l[(k + 1) % len(l) + 1] ELSE l[k + 1] END AS domain, core AS brand FROM d")  # fmt: skip
def g6(spark, sf_dir):
    return generate.lookalikes(spark).where("family = 'tld-swap'").select("domain", "brand")


@query("G7_subdomain", f"{_MAKE_SQL} SELECT core || '.' || {_pick_sql(generate.OWNERS, 'core', chr(39) + 'owner' + chr(39), chr(39) * 2)} || '.com' AS domain, core AS brand FROM b")
def g7(spark, sf_dir):
    return generate.lookalikes(spark).where("family = 'subdomain'").select("domain", "brand")


_LETTERS_SQL = f"{_MAKE_SQL}, {_made_sql()}, letters AS (SELECT DISTINCT family, made || '.' || tld AS domain, core AS brand FROM made WHERE made IS NOT NULL AND made || '.' || tld NOT IN (SELECT domain FROM brands))"
SQL["G2_homoglyph"] = f"{_LETTERS_SQL} SELECT domain, brand FROM letters WHERE family = 'homoglyph'"
SQL["G3_typo"] = f"{_LETTERS_SQL} SELECT domain, brand FROM letters WHERE family = 'typo'"
_WHOLE = {"combosquat": "G5_combosquat", "tld-swap": "G6_tld_swap", "subdomain": "G7_subdomain"}
SQL["G1_lookalikes"] = f"{_LETTERS_SQL} SELECT domain, family, brand FROM letters" + "".join(
    f" UNION ALL SELECT domain, '{family}', brand FROM ({SQL[name]})" for family, name in _WHOLE.items()
)


@query("G8_seeded_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7' || c_custkey), c_custkey) AS place FROM customer")
def g8(spark, sf_dir):
    ranked = ev.shuffled_rank(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "7")
    return ranked.select("c_custkey", F.col("rank").alias("place"))


# ---- samples -------------------------------------------------------------------------------------------------------

_SEEDED = f"{SCORED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(key), key) AS k, count(*) OVER (PARTITION BY y) AS n FROM (SELECT *, family || ':' || id AS key FROM scored))"


def _keyed(spark, sf_dir):
    return scored_hosts(spark, sf_dir).withColumn("key", F.concat_ws(":", "family", F.col("id").cast("string")))


@query("S1_split", f"WITH {_SEEDED} SELECT key, k <= floor(0.7 * n) AS train FROM o")
def s1(spark, sf_dir):
    return ev.stratified_split(_keyed(spark, sf_dir), "y", "key").select("key", "train")


@query("S2_folds", f"WITH {_SEEDED} SELECT key, ((k - 1) % 5)::BIGINT AS fold FROM o")
def s2(spark, sf_dir):
    return ev.folds(_keyed(spark, sf_dir), "y", "key").select("key", F.col("fold").cast("long").alias("fold"))


@query("S5_slices", "SELECT c_custkey FROM customer WHERE c_custkey < 300 OR c_custkey BETWEEN 1000 AND 1199")
def s5(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey < 300 or c_custkey between 1000 and 1199").select("c_custkey")


@query("S6_first_wins", f"WITH {HOSTS_SQL} SELECT host, family, id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id, family) AS k FROM hosts) WHERE k = 1")
def s6(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).withColumn("o", F.struct("id", "family"))
    return ev.first_wins(h, ["host"], "o").select("host", "family", "id")


@query("S7_not_official", f"WITH {ALL_SQL} SELECT id, host, family FROM hosts WHERE host NOT IN (SELECT domain FROM official)")
def s7(spark, sf_dir):
    h = derived_hosts(spark, sf_dir)
    return h.join(F.broadcast(readers.official_domains(spark)), F.col("host") == F.col("domain"), "left_anti").select("id", "host", "family")


@query("S8_union", f"WITH {HOSTS_SQL} SELECT host, count(*) AS n FROM (SELECT host FROM hosts UNION ALL SELECT host FROM hosts WHERE family = 'glyph') GROUP BY host")
def s8(spark, sf_dir):
    h = derived_hosts(spark, sf_dir)
    return h.unionByName(h.where("family = 'glyph'")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("S9_head", f"WITH {SCORED_SQL} SELECT id, family, score FROM scored ORDER BY score DESC, family, id LIMIT 40")
def s9(spark, sf_dir):
    return scored_hosts(spark, sf_dir).orderBy(F.desc("score"), "family", "id").limit(40).select("id", "family", "score")


@query("S10_official_domains", f"WITH {ALL_SQL} SELECT DISTINCT domain FROM official")
def s10(spark, sf_dir):
    return readers.official_domains(spark)


@query("S11_brand_cores", f"WITH {ALL_SQL} SELECT DISTINCT host, coalesce(core, string_split(host, '.')[1]) AS core FROM hosts LEFT JOIN brands b ON host = domain")
def s11(spark, sf_dir):
    return readers.brand_cores(derived_hosts(spark, sf_dir).select("host").distinct(), "host")


# ---- metrics -------------------------------------------------------------------------------------------------------

_CM = "count(*) FILTER (score >= 0.6 AND y = 1) AS tp, count(*) FILTER (score >= 0.6 AND y = 0) AS fp, count(*) FILTER (score < 0.6 AND y = 0) AS tn, count(*) FILTER (score < 0.6 AND y = 1) AS fn"
_RATES = "round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 9) AS fpr, " \
    "round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 0), 9) AS acc, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("A1_confusion", f"WITH {SCORED_SQL} SELECT tp, fp, tn, fn, {_RATES} FROM (SELECT {_CM} FROM scored)")
def a1(spark, sf_dir):
    return _rounded(ev.confusion(scored_hosts(spark, sf_dir), F.col("score") >= 0.6, F.col("y") == 1), "recall", "precision", "fpr", "acc", "f1")


@query("A2_rates_by_family", f"WITH {SCORED_SQL} SELECT family, tp, fp, tn, fn, {_RATES} FROM (SELECT family, {_CM} FROM scored GROUP BY family)")
def a2(spark, sf_dir):
    return _rounded(ev.confusion(scored_hosts(spark, sf_dir), F.col("score") >= 0.6, F.col("y") == 1, ["family"]), "recall", "precision", "fpr", "acc", "f1")


@query("A3_families", f"WITH {SCORED_SQL} SELECT coalesce(family, 'ALL') AS family, count(*) AS n, count(*) FILTER (score >= 0.6) AS suspicious, count(*) FILTER (score >= 0.9) AS dangerous FROM scored WHERE y = 1 GROUP BY ROLLUP (family)")
def a3(spark, sf_dir):
    return ev.by_family(scored_hosts(spark, sf_dir).where("y = 1"), {"suspicious": F.col("score") >= 0.6, "dangerous": F.col("score") >= 0.9})


@query("A4_fuzzers", f"WITH {SCORED_SQL} SELECT family, count(*) AS n, round(avg((score >= 0.6)::INT), 9) AS recall FROM scored GROUP BY family ORDER BY n DESC, family")
def a4(spark, sf_dir):
    return _rounded(ev.recall_by(scored_hosts(spark, sf_dir), "family", F.col("score") >= 0.6), "recall")


@query("A5_quantiles", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events), p AS (SELECT unnest([0.5, 0.95, 0.99]) AS p) "
       "SELECT p::DOUBLE AS p, value FROM r, p WHERE k = least(n - 1, floor(p * n))")  # fmt: skip
def a5(spark, sf_dir):
    return ev.exact_quantiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], buckets=40)


@query("A5_latency", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS worst FROM events GROUP BY event_type")
def a5_latency(spark, sf_dir):
    t = ev.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return t.withColumn("mean", F.round("mean", 6))


@query("A6_roc_auc", f"WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored) "
       "SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM r")  # fmt: skip
def a6(spark, sf_dir):
    return ev.roc_auc(scored_hosts(spark, sf_dir), "score", F.col("y") == 1).select(F.round("auc", 9).alias("auc"))


@query("A7_average_precision", f"WITH {SCORED_SQL}, w AS (SELECT y, sum(y) OVER o AS tp, row_number() OVER o AS k FROM scored WINDOW o AS (ORDER BY score DESC, family || ':' || id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
       "SELECT round(avg(tp / k::DOUBLE), 9) AS ap FROM w WHERE y = 1")  # fmt: skip
def a7(spark, sf_dir):
    return ev.average_precision(_keyed(spark, sf_dir), "score", F.col("y") == 1, "key").select(F.round("ap", 9).alias("ap"))


@query("A8_fold_f1", f"WITH {_SEEDED}, f AS (SELECT (k - 1) % 5 AS fold, {_CM} FROM o GROUP BY 1), g AS (SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM f) "
       "SELECT round(avg(f1), 9) AS mean, round(stddev_pop(f1), 9) AS sd FROM g")  # fmt: skip
def a8(spark, sf_dir):
    f = ev.folds(_keyed(spark, sf_dir), "y", "key")
    c = ev.confusion(f, F.col("score") >= 0.6, F.col("y") == 1, ["fold"])
    return c.agg(F.round(F.avg("f1"), 9).alias("mean"), F.round(F.stddev_pop("f1"), 9).alias("sd"))


@query("A11_missed", f"WITH {SCORED_SQL} SELECT id, host, family FROM scored WHERE y = 1 AND score < 0.6 ORDER BY family, id LIMIT 40")
def a11(spark, sf_dir):
    return scored_hosts(spark, sf_dir).where("y = 1 and score < 0.6").orderBy("family", "id").limit(40).select("id", "host", "family")


@query("A12_wild_recall", f"WITH {SCORED_SQL}, r AS (SELECT *, regexp_matches(host, '[^\\x00-\\x7F]') OR EXISTS (SELECT 1 FROM brands b WHERE length(core) >= 4 AND (contains(p.sld, core) "
       "OR (p.sld <> '' AND contains(core, p.sld)) OR levenshtein(translate(p.sld, 'аео', 'AEO'), core) <= 2)) AS near FROM scored p) "
       "SELECT count(*) AS n, count(*) FILTER (score >= 0.6) AS flagged, count(*) FILTER (near) AS resembling, count(*) FILTER (near AND score >= 0.6) AS flagged_resembling FROM r WHERE y = 1")  # fmt: skip
def a12(spark, sf_dir):
    s = scored_hosts(spark, sf_dir).where("y = 1")
    return ev.wild_recall(s, F.col("score") >= 0.6, match.resembling(F.col("sld"), F.col("host")))


@query("A13_complexity", "SELECT n::INT AS n, (n * 14)::INT AS ops FROM range(4, 25) t(n)")
def a13(spark, sf_dir):
    return ev.complexity(spark)


#: A small labelled set: host, whether it is a look-alike, and of what kind.
LABELLED = [(h, 1, "homoglyph") for h in "pаypal.com аррӏе.com gооgle.com phonepе.com microsоft.com hdfcbаnk.com аmazon.in".split()]
LABELLED += [(h, 1, "typo") for h in "paypa1.com g00gle.com faceb00k.com amaz0n.in".split()]
LABELLED += [(h, 1, "embed") for h in "secure-paypal.xyz amazon-kyc-update.tk sbi-rewards.tk hdfcbank.account-verify.com paytm-cashback.online".split()]
LABELLED += [(h, 0, "legit") for h in "paypal.com google.com hdfcbank.com amazon.in microsoft.com flipkart.com".split()]
LABELLED += [(h, 0, "unrelated") for h in "randomblog.dev mycoolwebsite.com example.org notabank.net".split()]


@query("A14_labelled_set", "SELECT kind, n, hits FROM (VALUES ('homoglyph', 7, 7), ('typo', 4, 4), ('embed', 5, 5), ('legit', 6, 0), ('unrelated', 4, 0), ('ALL', 26, 16)) t(kind, n, hits)")
def a14(spark, sf_dir):
    scored = rules.analyze(spark.createDataFrame(LABELLED, "host string, y int, kind string"), "host")
    return ev.by_family(scored, {"hits": F.col("verdict.level") != "safe"}, "kind")


@query("A15_macro_average", f"WITH {SCORED_SQL} SELECT round(avg(r), 9) AS macro FROM (SELECT brand, avg((score >= 0.6)::INT) AS r FROM scored WHERE y = 1 GROUP BY brand)")
def a15(spark, sf_dir):
    s = scored_hosts(spark, sf_dir).where("y = 1")
    return _rounded(ev.macro_average(s, "brand", F.col("score") >= 0.6), "macro")


# ---- state ---------------------------------------------------------------------------------------------------------

_VISITS_SQL = f"{NAVIGATION_SQL}, visits AS (SELECT device, host AS registrable, max(sld) AS sld, least(count(*), 999) AS count, max(ts) AS last_seen FROM nav WHERE kind = 'complete' AND level = 'safe' AND length(sld) >= 4 GROUP BY device, host)"


@query("T1_visits", f"WITH {_VISITS_SQL} SELECT * FROM visits")
def t1(spark, sf_dir):
    return state.visits(navigation(spark, sf_dir))


@query("T2_remembered", f"WITH {_VISITS_SQL} SELECT device, registrable, sld, count, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY count DESC, last_seen DESC, registrable) AS k FROM visits) WHERE k <= 300")
def t2(spark, sf_dir):
    return state.remembered(state.visits(navigation(spark, sf_dir)))


@query("T3_trusted", f"WITH {_VISITS_SQL} SELECT device, registrable, sld, count FROM visits WHERE count >= 3")
def t3(spark, sf_dir):
    return state.trusted(state.visits(navigation(spark, sf_dir))).select("device", "registrable", "sld", "count")


@query("T4_trusted_count", f"WITH {_VISITS_SQL} SELECT device, count(*) FILTER (count >= 3) AS trusted FROM visits GROUP BY device")
def t4(spark, sf_dir):
    return state.trusted_count(state.visits(navigation(spark, sf_dir)))


@query("T5_counters", f"WITH {NAVIGATION_SQL} SELECT device, count(*) FILTER (kind = 'complete') AS scanned, count(*) FILTER (kind = 'block') AS blocked FROM nav GROUP BY device")
def t5(spark, sf_dir):
    return state.counters(navigation(spark, sf_dir))


@query("T6_recent_threats", f"WITH {NAVIGATION_SQL}, b AS (SELECT *, lag(host) OVER (PARTITION BY device ORDER BY ts, event_id) AS last FROM nav WHERE kind = 'block'), "
       "r AS (SELECT device, host, event_id, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS place FROM b WHERE last IS DISTINCT FROM host) SELECT * FROM r WHERE place <= 8")  # fmt: skip
def t6(spark, sf_dir):
    blocks = navigation(spark, sf_dir).where("kind = 'block'")
    return state.recent_threats(blocks).select("device", "host", "event_id", F.col("place").cast("long").alias("place"))


@query("T7_messages", f"WITH {NAVIGATION_SQL} SELECT event_id, left(host, 253) AS host, coalesce(left(nullif(brand, ''), 60), 'a brand') AS brand, greatest(0.0, least(100.0, score)) AS score FROM nav WHERE kind = 'block'")
def t7(spark, sf_dir):
    return state.clean_message(navigation(spark, sf_dir).where("kind = 'block'")).select("event_id", "host", "brand", "score")


_LATCH_SQL = f"{NAVIGATION_SQL}, l AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('block', 'loading') THEN kind END IGNORE NULLS) OVER (PARTITION BY device, tab ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'block', false) AS latched FROM nav)"


@query("T8_block_latch", f"WITH {_LATCH_SQL} SELECT event_id, latched, CASE WHEN latched OR level = 'dangerous' THEN '!' WHEN level = 'suspicious' THEN '?' ELSE '' END AS badge FROM l")
def t8(spark, sf_dir):
    latched = state.block_latch(navigation(spark, sf_dir))
    return latched.select("event_id", "latched", state.badge(F.col("latched"), F.col("level")).alias("badge"))


@query("T8_histories", f"{'WITH ' if not _LATCH_SQL.startswith('WITH') else ''}{_LATCH_SQL} SELECT event_id, latched, count(*) FILTER (kind = 'complete') OVER w AS scanned, count(*) FILTER (kind = 'block') OVER w AS blocked FROM l "
       "WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")  # fmt: skip
def t8_histories(spark, sf_dir):
    """Latches and counters after every event, by the steps of the stateful processor over the table."""
    return streams.device_histories(navigation(spark, sf_dir)).select("event_id", "latched", "scanned", "blocked")


@query("T9_enabled", f"WITH {NAVIGATION_SQL} SELECT device, count(*) AS n FROM nav WHERE device % 3 <> 0 GROUP BY device")
def t9(spark, sf_dir):
    n = navigation(spark, sf_dir)
    settings = n.select("device").distinct().withColumn("enabled", F.expr("device % 3 <> 0"))
    return state.enabled_only(n, settings).groupBy("device").agg(F.count(F.lit(1)).alias("n"))


#: Of every k-th event the page changes again some milliseconds later.
_AGAIN = ((3, 400), (6, 900))


@query("T10_rescans", f"WITH {NAVIGATION_SQL}, c AS (SELECT device, ts FROM nav " + " ".join(f"UNION ALL SELECT device, ts + INTERVAL {ms} MILLISECOND FROM nav WHERE event_id % {k} = 0" for k, ms in _AGAIN) + "), g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY device ORDER BY ts) + INTERVAL 600 MILLISECOND, true)::INT AS fresh FROM c), "
       "s AS (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts) AS s FROM g) "
       "SELECT device, min(ts) AS started, max(ts) + INTERVAL 600 MILLISECOND AS ended, count(*) AS changes FROM s GROUP BY device, s")  # fmt: skip
def t10(spark, sf_dir):
    n = navigation(spark, sf_dir).select("device", "event_id", "ts")
    again = [n.where(f"event_id % {k} = 0").withColumn("ts", F.col("ts") + F.expr(f"interval {ms} milliseconds")) for k, ms in _AGAIN]
    return state.rescans(n.unionByName(again[0]).unionByName(again[1]))


#: The site that a visit of an event goes to, of 40 by its number, so that devices with room for 5 forget some.
_SITE = "event_id * 7919 % 40"


@query("T2_forgotten", f"""WITH RECURSIVE {NAVIGATION_SQL}, v AS (
  SELECT device, 'site' || ({_SITE}) || '.com' AS site, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS n FROM nav WHERE kind = 'complete' AND level = 'safe'
), s AS (
  SELECT DISTINCT device, 0::BIGINT AS n, []::STRUCT(site VARCHAR, c INT)[] AS kept FROM v
  UNION ALL
  SELECT device, n, CASE WHEN len(l) > 5 THEN list_filter(l, lambda x, i: i <> list_position(list_transform(l, lambda y: y.c), list_min(list_transform(l, lambda y: y.c)))) ELSE l END
  FROM (SELECT s.device, v.n, CASE WHEN list_contains(list_transform(kept, lambda x: x.site), v.site)
    THEN list_transform(kept, lambda x: {{'site': x.site, 'c': CASE WHEN x.site = v.site THEN least(x.c + 1, 999) ELSE x.c END}})
    ELSE list_append(kept, {{'site': v.site, 'c': 1}}) END AS l FROM s JOIN v ON v.device = s.device AND v.n = s.n + 1)
), f AS (
  SELECT device, arg_max(kept, n) AS kept FROM s GROUP BY device
), u AS (SELECT device, unnest(kept) AS x FROM f)
SELECT device, x.site AS registrable, x.c AS count FROM u""")
def t2_forgotten(spark, sf_dir):
    """Devices that keep 5 sites forget the oldest of the least visited, visit by visit."""
    site = F.concat(F.lit("site"), F.expr(_SITE).cast("string"))
    n = navigation(spark, sf_dir).withColumn("sld", site).withColumn("registrable", F.concat(site, F.lit(".com")))
    return state.kept_sites(n, most=5).select("device", "registrable", "count")


@query("T11_scanned_once", f"WITH {NAVIGATION_SQL} SELECT DISTINCT device, host FROM nav")
def t11(spark, sf_dir):
    return navigation(spark, sf_dir).select("device", "host").dropDuplicates()


QUERIES |= verdicts.QUERIES
SQL |= verdicts.SQL

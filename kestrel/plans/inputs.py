"""Hosts, scores and navigation events derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import hosts
from kestrel.operators.match import attribute

CORES = [b for b in dims.brands() if len(b.core) >= 4]
FAMILIES = ["official", "hyphen", "lure-tld", "bad-tld", "subdomain", "digit", "swap", "glyph", "far-glyph", "token"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, host, family, brand): look-alikes from customers, benign hosts from parts, and page hosts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    c = c.withColumn("b", F.expr(f"cast(id % {len(CORES)} as int)")).withColumn("f", F.expr(f"cast((id div {len(CORES)}) % {len(FAMILIES)} as int)"))
    c = c.withColumn("l", F.expr(f"cast((id div {len(FAMILIES) * len(CORES)}) % {len(dims.LURE_WORDS)} as int)"))
    core, lure = attribute(F.col("b"), [b.core for b in CORES]), attribute(F.col("l"), dims.LURE_WORDS)
    c = c.withColumn("core", core).withColumn("lure", lure)
    core, lure, f = F.col("core"), F.col("lure"), F.col("f")
    swapped = F.concat(F.substring(core, 2, 1), F.substring(core, 1, 1), F.substring(core, 3, 100))
    made = [
        attribute(F.col("b"), [b.domain for b in CORES]),
        F.concat(core, F.lit("-"), lure, F.lit(".com")),
        F.concat(lure, F.lit("-"), core, F.lit(".xyz")),
        F.concat(core, F.lit(".tk")),
        F.concat(core, F.lit(".account-verify.com")),
        F.concat(F.replace(core, F.lit("o"), F.lit("0")), F.lit(".com")),
        F.concat(swapped, F.lit(".in")),
        F.concat(F.translate(core, "aeo", "аео"), F.lit(".com")),
        F.concat(F.translate(F.substring(core, 1, 2), "aeo", "аео"), F.lit("zz"), F.substring(core, 3, 100), F.lit(".com")),
        F.concat(F.lit("sbi-"), lure, F.lit(".tk")),
    ]
    host = F.coalesce(*[F.when(f == k, m) for k, m in enumerate(made)])
    c = c.select("id", host.alias("host"), attribute(f, FAMILIES).alias("family"), F.when(f == 9, "sbi").otherwise(core).alias("brand"))
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit(".org")).alias("host"),
        F.lit("benign").alias("family"),
        F.lit("").alias("brand"),
    )
    g = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), hosts.clean_host(F.col("url")).alias("host"), F.lit("page").alias("family"), F.lit("").alias("brand")
    )
    return c.unionByName(p).unionByName(g)


def varied_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host): different hosts, several for each derived one: its label with a few letters put in. For measuring."""
    h = derived_hosts(spark, sf_dir)
    tag = F.lower(F.conv((F.col("id") % 46656).cast("string"), 10, 36))
    label, rest = F.substring_index("host", ".", 1), F.expr("substring(host, instr(host, '.'))")
    made = [F.concat(F.substring(label, 1, 3), F.lit(x), F.expr("substring(substring_index(host, '.', 1), 4)"), tag, rest) for x in ("", "a", "b", "ce", "do", "xi", "q2", "z")]
    return h.select(F.explode(F.array(*made)).alias("host")).distinct()


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


HOSTS_SQL = f"""
hosts AS (
  SELECT id, CASE f WHEN 0 THEN {_list([b.domain for b in CORES])}[b + 1] WHEN 1 THEN core || '-' || lure || '.com'
    WHEN 2 THEN lure || '-' || core || '.xyz' WHEN 3 THEN core || '.tk' WHEN 4 THEN core || '.account-verify.com'
    WHEN 5 THEN replace(core, 'o', '0') || '.com' WHEN 6 THEN substr(core, 2, 1) || substr(core, 1, 1) || substr(core, 3) || '.in'
    WHEN 7 THEN translate(core, 'aeo', 'аео') || '.com' WHEN 8 THEN translate(substr(core, 1, 2), 'aeo', 'аео') || 'zz' || substr(core, 3) || '.com'
    ELSE 'sbi-' || lure || '.tk' END AS host, {_list(FAMILIES)}[f + 1] AS family, CASE f WHEN 9 THEN 'sbi' ELSE core END AS brand
  FROM (SELECT c_custkey AS id, c_custkey % {len(CORES)} AS b, (c_custkey // {len(CORES)}) % {len(FAMILIES)} AS f,
    {_list([b.core for b in CORES])}[c_custkey % {len(CORES)} + 1] AS core,
    {_list(dims.LURE_WORDS)}[(c_custkey // {len(FAMILIES) * len(CORES)}) % {len(dims.LURE_WORDS)} + 1] AS lure FROM customer)
  UNION ALL SELECT p_partkey, replace(lower(p_name), ' ', '-') || '.org', 'benign', '' FROM part
  UNION ALL SELECT page_id, regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://', ''),
    '^[^/?#]*'), ':[0-9]+$', ''), 'page', '' FROM pages
)"""


def brands_sql(brands: list[dims.Brand]) -> str:
    """The tables brands and official."""
    rows = ", ".join(f"({k}, '{b.name}', '{b.core}', '{b.domain}', '{b.category}', {str(b.owns_name).lower()})" for k, b in enumerate(brands))
    owned = ", ".join(f"({k}, '{d}')" for k, b in enumerate(brands) for d in b.official)
    return (
        f"brands AS (SELECT * FROM (VALUES {rows}) t(ord, name, core, domain, category, owns)), "
        f"official AS (SELECT * FROM (VALUES {owned}) t(ord, domain))"
    )


BRANDS_SQL = brands_sql(dims.brands())

LURES_SQL = "lure_words AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{w}')" for k, w in enumerate(dims.LURE_WORDS)) + ") t(ord, word))"

BAD_TLDS_SQL = "(" + ", ".join(f"'{t}'" for t in dims.SUSPICIOUS_TLDS) + ")"


def _rules_sql() -> str:
    rows = []
    for rule in dims.SUFFIX_RULES:
        rows.append(f"('{rule.lstrip('!').removeprefix('*.')}', {str(rule[0] not in '!*').lower()}, {str(rule.startswith('*.')).lower()}, {str(rule[0] == '!').lower()})")
    return "rules AS (SELECT suffix, bool_or(e) AS e, bool_or(w) AS w, bool_or(x) AS x FROM (VALUES " + ", ".join(rows) + ") t(suffix, e, w, x) GROUP BY suffix)"


#: parsed(host, labels, suffix, sld, subdomains, last_label, registrable) of the different hosts.
PARSED_SQL = _rules_sql() + """,
split AS (
  SELECT host, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM (SELECT DISTINCT host FROM hosts)
), tails AS (
  SELECT host, k, array_to_string(labels[len(labels) - k + 1:], '.') AS tail, len(labels) AS n
  FROM split, range(1, 5) t(k) WHERE k <= len(labels)
), lens AS (
  SELECT host, coalesce(max(CASE WHEN x THEN k - 1 END),
    greatest(1, coalesce(max(CASE WHEN e THEN k END), 1), coalesce(max(CASE WHEN w AND n > k THEN k + 1 END), 1))) AS m
  FROM tails LEFT JOIN rules ON tail = suffix GROUP BY host
), cut AS (
  SELECT s.host, labels, len(labels) AS n, least(coalesce(m, 1), len(labels)) AS m FROM split s LEFT JOIN lens USING (host)
), named AS (
  SELECT host, labels, array_to_string(labels[n - m + 1:], '.') AS suffix, CASE WHEN n > m THEN labels[n - m] ELSE '' END AS sld,
    labels[1:greatest(n - m - 1, 0)] AS subdomains, coalesce(labels[-1], '') AS last_label FROM cut
), parsed AS (
  SELECT *, CASE WHEN sld <> '' THEN sld || '.' ELSE '' END || suffix AS registrable FROM named
)"""

ALL_SQL = f"{HOSTS_SQL}, {PARSED_SQL}, {BRANDS_SQL}, {LURES_SQL}"


def scored_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, host, family, brand, sld, y, score): plain similarity to the nearest core, to 6 places, and the label."""
    h = derived_hosts(spark, sf_dir).withColumn("sld", hosts.naive_parts(F.col("host"))["sld"])
    sims = [1 - F.levenshtein("sld", F.lit(b.core)) / F.greatest(F.length("sld"), F.lit(len(b.core))) for b in CORES]
    y = (~F.col("family").isin("official", "benign", "page")).cast("int")
    return h.withColumn("y", y).withColumn("score", F.round(F.greatest(F.lit(0.0), *sims), 6))


SCORED_SQL = f"""{HOSTS_SQL}, {BRANDS_SQL}, slds AS (
  SELECT *, CASE WHEN len(l) >= 2 THEN l[-2] ELSE '' END AS sld, (family NOT IN ('official', 'benign', 'page'))::INT AS y
  FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM hosts)
), best AS (
  SELECT sld, round(max(1 - levenshtein(translate(sld, 'аео', 'AEO'), core) / greatest(length(sld), length(core))::DOUBLE), 6) AS score
  FROM (SELECT DISTINCT sld FROM slds), brands WHERE length(core) >= 4 GROUP BY sld
), scored AS (
  SELECT id, host, family, brand, s.sld, y, greatest(score, 0.0) AS score FROM slds s JOIN best USING (sld)
)"""


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, device, tab, kind, level, host, registrable, sld, brand, score) from events.

    Kinds: complete (a load is done), loading, block (the block screen was shown), url (the address changed inside a
    page), activated (a tab came to the front).
    """
    e = table(spark, sf_dir, "events")
    b = F.expr(f"cast(event_id % {len(CORES)} as int)")
    return e.select(
        "event_id",
        "ts",
        F.col("user_id").alias("device"),
        F.expr("cast(event_id div 7 % 3 as int)").alias("tab"),
        F.when(F.col("event_type") == "error", "block")
        .when(F.col("event_type") == "click", "loading")
        .when(F.col("event_type") == "signup", "url")
        .when(F.expr("event_id % 5 = 0"), "activated")
        .otherwise("complete")
        .alias("kind"),
        F.when(F.col("value") < 60, "safe").when(F.col("value") < 120, "suspicious").otherwise("dangerous").alias("level"),
        attribute(b, [x.domain for x in CORES]).alias("host"),
        attribute(b, [x.domain for x in CORES]).alias("registrable"),
        attribute(b, [x.core for x in CORES]).alias("sld"),
        F.when(F.expr("event_id % 3 = 0"), attribute(b, [x.name for x in CORES])).alias("brand"),
        (F.col("value") - 20).alias("score"),
    )


NAVIGATION_SQL = f"""
nav AS (
  SELECT event_id, ts, user_id AS device,
    (event_id // 7 % 3)::INT AS tab,
    CASE WHEN event_type = 'error' THEN 'block' WHEN event_type = 'click' THEN 'loading' WHEN event_type = 'signup' THEN 'url'
      WHEN event_id % 5 = 0 THEN 'activated' ELSE 'complete' END AS kind,
    CASE WHEN value < 60 THEN 'safe' WHEN value < 120 THEN 'suspicious' ELSE 'dangerous' END AS level,
    {_list([b.domain for b in CORES])}[event_id % {len(CORES)} + 1] AS host,
    {_list([b.core for b in CORES])}[event_id % {len(CORES)} + 1] AS sld,
    CASE WHEN event_id % 3 = 0 THEN {_list([b.name for b in CORES])}[event_id % {len(CORES)} + 1] END AS brand,
    value - 20 AS score
  FROM events
)"""

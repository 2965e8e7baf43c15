"""Queries of the distances and the rule engine, and the same verdicts as SQL on hosts of ASCII and three Cyrillic letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import distance
from kestrel.operators import evaluate as ev
from kestrel.operators import features as ft
from kestrel.operators import brandtable, match, pages, rules
from kestrel.operators.parse import parse_hosts
from kestrel.sources import readers
from kestrel.plans.inputs import BAD_TLDS_SQL, HOSTS_SQL, LURES_SQL, PARSED_SQL, brands_sql, derived_hosts, table

#: Sites that a user visits, as brands that were learned.
LEARNED = [dims.Brand(s, s, d, dims.LEARNED) for s, d in (("blue-anvil", "blue-anvil.com"), ("example", "example.com"), ("small-widget", "small-widget.org"))]

# ---- SQL -----------------------------------------------------------------------------------------------------------

_PAIR = "substr(x, i + 1, 1) || substr(y, j, 1)"
_VISUAL, _KEYBOARD = ("(" + ", ".join(f"'{p}'" for p, k in dims.substitution_kinds().items() if k == kind) + ")" for kind in ("visual", "keyboard"))
_KIND = f"CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN 'same' WHEN {_PAIR} IN {_VISUAL} THEN 'visual' WHEN {_PAIR} IN {_KEYBOARD} THEN 'keyboard' ELSE 'different' END"
_COST = f"CASE {_KIND} WHEN 'same' THEN 0.0 WHEN 'visual' THEN {dims.VISUAL_COST} WHEN 'keyboard' THEN {dims.KEYBOARD_COST} ELSE {dims.OTHER_COST} END"
_SWAPS = "i > 0 AND j > 1 AND substr(x, i + 1, 1) <> substr(y, j, 1) AND substr(x, i + 1, 1) = substr(y, j - 1, 1) AND substr(x, i, 1) = substr(y, j, 1)"


def distance_sql(name: str, pairs: str, traced: bool = False) -> str:
    """Tables name_rows and name (x, y, d, visual, swapped, and trace): weighted distances of the pairs (x, y), row by row.

    Every cell carries what the cheapest edits to it look like: a swap comes first, then a pair, a deletion, an insertion.
    """
    step = lambda kind, a, b, how: f"{{'type': '{kind}', 'a': {a}, 'b': {b}, 'kind': {how}}}" if kind else ""
    none = "[]::STRUCT(type VARCHAR, a VARCHAR, b VARCHAR, kind VARCHAR)[]"

    def cell(d: str, visual: str, swapped: str, before: str = "", op: str = "") -> str:
        trace = f", 't': list_append({before}.t, {op})" if traced else ""
        return f"{{'d': ({d})::DOUBLE, 'v': {visual}, 's': {swapped}{trace}}}"

    a, b = "substr(x, i + 1, 1)", "substr(y, j, 1)"
    swap = cell("c", "prev[j - 1].v", "true", "prev[j - 1]", step("transpose", "substr(x, i, 2)", "substr(y, j - 1, 2)", "NULL"))
    same = step("x", a, b, _KIND).replace("'x'", f"CASE WHEN {a} = {b} THEN 'match' ELSE 'sub' END", 1)
    pair = cell("c", f"cur[j].v OR {_KIND} = 'visual'", "cur[j].s", "cur[j]", same)
    gone = cell("c", "cur[j + 1].v", "cur[j + 1].s", "cur[j + 1]", step("del", a, "NULL", "NULL"))
    more = cell("c", "acc[-1].v", "acc[-1].s", "acc[-1]", step("ins", "NULL", b, "NULL"))
    least = f"least(acc[-1].d + 1, cur[j + 1].d + 1, cur[j].d + {_COST}, CASE WHEN {_SWAPS} THEN prev[j - 1].d + 1 ELSE 1000.0 END)"
    best = f"CASE WHEN {_SWAPS} AND c = prev[j - 1].d + 1 THEN {swap} WHEN c = cur[j].d + {_COST} THEN {pair} WHEN c = cur[j + 1].d + 1 THEN {gone} ELSE {more} END"
    start = "{'d': j::DOUBLE, 'v': false, 's': false" + (f", 't': list_transform(range(1, j + 1), lambda k: {step('ins', 'NULL', 'substr(y, k::INT, 1)', 'NULL')})" if traced else "") + "}"
    down = "{'d': i + 1.0::DOUBLE, 'v': false, 's': false" + (f", 't': list_transform(range(1, i + 2), lambda k: {step('del', 'substr(x, k::INT, 1)', 'NULL', 'NULL')})" if traced else "") + "}"
    kind = "STRUCT(d DOUBLE, v BOOLEAN, s BOOLEAN" + (", t STRUCT(type VARCHAR, a VARCHAR, b VARCHAR, kind VARCHAR)[]" if traced else "") + ")[]"
    typed = lambda x: f"({x})::{kind}"
    last = f", coalesce(cur[-1].t, {none}) AS trace" if traced else ""
    return f"""{name}_rows AS (
  SELECT x, y, 0 AS i, {typed('[]')} AS prev, {typed(f"list_transform(range(0, length(y) + 1), lambda j: {start})")} AS cur FROM ({pairs})
  UNION ALL
  SELECT x, y, i + 1, cur, {typed(f"list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, list_transform([{least}], lambda c: {best})[1]), {typed(f'[{down}]')})")}
  FROM {name}_rows WHERE i < length(x)
), {name} AS (SELECT x, y, cur[-1].d AS d, cur[-1].v AS visual, cur[-1].s AS swapped{last} FROM {name}_rows WHERE i = length(x))"""


def _sim(d: str, x: str, y: str) -> str:
    return f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0 ELSE greatest(0.0, 1 - {d} / greatest(length({x}), length({y}))::DOUBLE) END"


def _signal(when: str, label: str, detail: str, weight: str) -> str:
    return f"CASE WHEN {when} THEN {{'label': '{label}', 'detail': {detail}, 'weight': ({weight})::DOUBLE}} END"


def _core(place: str, column: str = "core") -> str:
    return f"(SELECT {column} FROM brands b WHERE b.ord = {place})"


def verdict_sql(learned: list[dims.Brand] | None = None) -> str:
    """Tables up to judged: one row for each different host with all places, signals, level, score, brand and distance."""
    brands = dims.brands() + list(learned or [])
    seen = "array_to_string(list_transform(folded, lambda c: c || '=' || translate(c, 'аео', 'aeo')), ' ')"
    signals = ", ".join([
        _signal("hidden", "Homoglyph characters", f"'folds: ' || {seen}", "0.45"),
        _signal("stands AND arm = 'skeleton'", "Skeleton matches a brand", f"sld || ' looks like ' || {_core('skeleton_core')}", "0.4"),
        _signal("stands AND arm = 'exact'", "Brand name on a non-official domain", f"registrable || ' instead of ' || {_core('exact_core', 'domain')}", "CASE WHEN bad THEN 0.5 ELSE 0.32 END"),
        _signal("stands AND arm = 'embedded'", "Brand hidden in a longer name", f"{_core('embedded')} || ' inside ' || sld", "0.4"),
        _signal("stands AND arm = 'token'", "Brand name combined with other words", f"{_core('token')} || ' as a word of ' || sld", "CASE WHEN bad THEN 0.5 ELSE 0.4 END"),
        _signal("stands AND arm = 'nearest'", "Look-alike of a brand", "floor(near_sim * 100 + 0.5)::BIGINT || '% like ' || near_core || CASE WHEN near_visual THEN ' by look-alike characters' WHEN near_swapped THEN ' by swapped letters' ELSE '' END",
                "CASE WHEN near_visual THEN 0.45 ELSE 0.3 END"),
        _signal("in_subdomain IS NOT NULL AND free", "Brand in a sub-domain", f"{_core('in_subdomain', 'name')} || ' before ' || registrable", "0.3"),
        _signal("bad", "Suspicious top-level domain", "'.' || last_label", "0.12"),
        _signal("lured AND imp IS NOT NULL", "Urgency / lure keywords", "array_to_string(lures, ', ')", "0.15"),
    ])
    first = lambda test, order="ord": f"(SELECT ord FROM brands b WHERE {test} ORDER BY {order} LIMIT 1)"
    return f"""WITH RECURSIVE {HOSTS_SQL}, {PARSED_SQL}, {brands_sql(brands)}, {LURES_SQL},
sk AS (
  SELECT *, translate(lower(sld), 'аео', 'aeo') AS skeleton, list_transform(subdomains, lambda s: translate(lower(s), 'аео', 'aeo')) AS subs,
    regexp_matches(sld, '[аео]') AND regexp_matches(sld, '[a-z]') AS mixed, regexp_extract_all(sld, '[аео]') AS folded FROM parsed
), {distance_sql("every", "SELECT DISTINCT skeleton AS x, core AS y FROM sk, brands")},
sims AS (
  SELECT x, ord, core, d, visual, swapped, {_sim('d', 'x', 'y')} AS sim FROM every JOIN brands ON y = core WHERE length(core) >= 4
), near AS (
  SELECT x, ord AS near_ord, core AS near_core, d AS near_d, visual AS near_visual, swapped AS near_swapped, sim AS near_sim
  FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, ord) AS k FROM sims WHERE sim > 0) WHERE k = 1
), placed AS (
  SELECT sk.*, near_ord, near_core, near_d, coalesce(near_sim, 0.0) AS near_sim, coalesce(near_visual, false) AS near_visual,
    coalesce(near_swapped, false) AS near_swapped, last_label IN {BAD_TLDS_SQL} AS bad,
    {first('b.core = sk.sld')} AS exact_core, {first('b.core = sk.skeleton')} AS skeleton_core,
    {first('length(core) >= 4 AND contains(sk.skeleton, core)', '-length(core), ord')} AS embedded,
    {first("length(core) >= 3 AND core <> sk.sld AND list_contains(regexp_split_to_array(sk.skeleton, '[-_]+'), core)")} AS token,
    {first("length(core) >= 4 AND contains(array_to_string(sk.subs, chr(10)), core)")} AS in_subdomain,
    {first(f"EXISTS (SELECT 1 FROM official o WHERE o.ord = b.ord AND o.domain = sk.registrable) OR (owns AND core = sk.sld AND sk.last_label NOT IN {BAD_TLDS_SQL})")} AS official,
    coalesce((SELECT list(word ORDER BY ord) FROM lure_words WHERE contains(sk.skeleton || chr(10) || array_to_string(sk.subs, chr(10)), word)), []) AS lures,
    (length(sk.skeleton) * (SELECT sum(length(core)) FROM brands WHERE length(core) >= 4))::BIGINT AS ops
  FROM sk LEFT JOIN near ON sk.skeleton = near.x
), flagged AS (
  SELECT *, skeleton_core IS NOT NULL OR embedded IS NOT NULL OR near_sim >= 0.85 AS proximate, len(lures) > 0 AS lured, official IS NULL AS free FROM placed
), hid AS (SELECT *, mixed OR (len(folded) > 0 AND proximate) AS hidden FROM flagged
), armed AS (
  SELECT *, CASE WHEN skeleton_core IS NOT NULL AND exact_core IS NULL THEN 'skeleton' WHEN exact_core IS NOT NULL AND free THEN 'exact'
    WHEN embedded IS NOT NULL THEN 'embedded' WHEN token IS NOT NULL AND free AND (lured OR bad) THEN 'token' WHEN near_d > 0 THEN 'nearest' END AS arm FROM hid
), stood AS (
  SELECT *, coalesce(CASE arm WHEN 'exact' THEN {_core('exact_core', 'category')} <> '{dims.LEARNED}' OR bad OR lured OR hidden
    WHEN 'embedded' THEN sld <> {_core('embedded')} AND (lured OR bad OR hidden OR length(skeleton) - length({_core('embedded')}) <= 2)
    WHEN 'nearest' THEN near_sim >= 0.8 OR (length(near_core) <= 5 AND near_d <= 1 AND near_swapped) ELSE arm IS NOT NULL END, false) AS stands FROM armed
), pinned AS (
  SELECT *, CASE WHEN hidden AND near_sim >= 0.7 THEN near_ord END AS close_one,
    coalesce(CASE WHEN stands THEN CASE arm WHEN 'skeleton' THEN skeleton_core WHEN 'exact' THEN exact_core WHEN 'embedded' THEN embedded
      WHEN 'token' THEN token WHEN 'nearest' THEN near_ord END END, CASE WHEN free THEN in_subdomain END) AS pin FROM stood
), branded AS (SELECT *, coalesce(pin, close_one) AS imp FROM pinned
), told AS (SELECT *, list_filter([{signals}], lambda s: s IS NOT NULL) AS found FROM branded
), summed AS (
  SELECT *, floor(least(1.0, list_reduce(list_transform(found, lambda s: s.weight), lambda a, w: a + w, 0.0::DOUBLE)) * 100 + 0.5)::INT AS raw_score,
    NOT free AND NOT hidden AS ours, hidden AND imp IS NOT NULL AS disguised FROM told
), levelled AS (
  SELECT *, CASE WHEN raw_score >= 65 THEN 'dangerous' WHEN raw_score >= 30 THEN 'suspicious' ELSE 'safe' END AS raw FROM summed
), judged AS (
  SELECT l.*, CASE WHEN ours THEN 'safe' WHEN disguised THEN 'dangerous' WHEN (imp IS NOT NULL OR hidden) AND raw = 'safe' THEN 'suspicious' ELSE raw END AS level,
    CASE WHEN ours THEN 2 WHEN disguised THEN greatest(raw_score, 80) ELSE raw_score END AS score,
    CASE WHEN ours THEN official ELSE imp END AS brand_ord, CASE WHEN ours THEN {_core('official')} ELSE {_core('imp')} END AS brand,
    CASE WHEN ours THEN [{{'label': 'Official domain', 'detail': {_core('official', 'domain')}, 'weight': 0.0::DOUBLE}}]
      WHEN len(found) = 0 THEN [{{'label': 'No brand impersonation detected', 'detail': 'nothing resembles a protected brand', 'weight': 0.0::DOUBLE}}]
      ELSE found END AS signals
  FROM levelled l
), verdicts AS (
  SELECT j.*, CASE WHEN ours THEN 1.0 WHEN brand IS NOT NULL THEN {_sim('e.d', 'j.skeleton', 'j.brand')} ELSE near_sim END AS similarity,
    CASE WHEN ours THEN 0.0 WHEN brand IS NOT NULL THEN e.d ELSE near_d END AS distance
  FROM judged j LEFT JOIN every e ON e.x = j.skeleton AND e.y = j.brand
)"""


VERDICT_SQL = verdict_sql()

# ---- queries -------------------------------------------------------------------------------------------------------

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def matched(spark: SparkSession, sf_dir: str, brands: list[dims.Brand] | None = None) -> DataFrame:
    hosts = derived_hosts(spark, sf_dir).select("host").distinct()
    return match.match_brands(match.with_glyphs(parse_hosts(hosts, "host")), brands)


def judged(spark: SparkSession, sf_dir: str, brands: list[dims.Brand] | None = None) -> DataFrame:
    return rules.judge(matched(spark, sf_dir, brands), brands)


def analysed(spark: SparkSession, sf_dir: str, learned: list[dims.Brand] | None = None) -> DataFrame:
    hosts = derived_hosts(spark, sf_dir).select("host").distinct()
    return rules.score_hosts(hosts.select(F.col("host").alias("input")), "input", learned)


CORES = [b.core for b in dims.brands()]


@query("M4_alignment", f"""WITH RECURSIVE {HOSTS_SQL}, {distance_sql("aligned", "SELECT DISTINCT string_split(host, '.')[1] AS x, brand AS y FROM hosts WHERE brand <> ''", True)},
o AS (SELECT x, y, unnest(range(0, len(trace))) AS step, unnest(trace) AS op FROM aligned)
SELECT x AS label, y AS core, step::INT AS step, op.type AS type, op.a AS a, op.b AS b, op.kind AS kind FROM o""")
def m4(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).where("brand <> ''")
    pairs = h.select(F.split("host", r"\.")[0].alias("label"), F.col("brand").alias("core")).distinct()
    return pairs.select("label", "core", F.posexplode(distance.align(F.col("label"), F.col("core"))["trace"]).alias("step", "op")).select("label", "core", "step", "op.*")


@query("M7_nearest_brand", f"{VERDICT_SQL} SELECT host, near_core AS core, near_d AS distance, near_sim AS similarity, near_visual AS visual, near_swapped AS swapped FROM placed")
def m7(spark, sf_dir):
    near = match.nearest_columns()
    core = match.attribute(F.when(near["ord"] >= 0, near["ord"]), CORES)
    return matched(spark, sf_dir).select("host", core.alias("core"), *[near[k].alias(k) for k in match.NEAR[1:]])


@query("R_verdicts", f"{VERDICT_SQL} SELECT id, h.host, family, level, score, brand AS impersonated, round(similarity, 6) AS similarity, "
       "list_transform(signals, lambda s: s.label) AS signals, ops FROM (SELECT id, host, family FROM hosts) h JOIN (SELECT host, level, score, brand, similarity, signals, ops FROM verdicts) v ON h.host = v.host")  # fmt: skip
def r_verdicts(spark, sf_dir):
    out = rules.analyze(derived_hosts(spark, sf_dir), "host")
    v = F.col("verdict")
    return out.select("id", "host", "family", v["level"].alias("level"), v["score"].alias("score"), v["brand"].alias("impersonated"),
                      F.round(v["similarity"], 6).alias("similarity"), F.transform(v["signals"], lambda s: s["label"]).alias("signals"), v["ops"].cast("long").alias("ops"))


@query("R0_official", f"{VERDICT_SQL} SELECT host, brand, level, score, similarity, distance FROM verdicts WHERE ours")
def r0(spark, sf_dir):
    official = F.col("signals")[0]["label"] == "Official domain"
    return analysed(spark, sf_dir).where(official).select("host", "brand", "level", "score", "similarity", "distance")


@query("R1_homoglyph", f"{VERDICT_SQL} SELECT host, proximate, mixed, hidden AS homoglyph FROM hid")
def r1(spark, sf_dir):
    return matched(spark, sf_dir).select("host", "proximate", "mixed", "homoglyph")


_SIGNALS_SQL = f"{VERDICT_SQL}, each AS (SELECT host, unnest(signals) AS s FROM judged)"


def _signal_query(name: str, label: str) -> None:
    @query(name, f"{_SIGNALS_SQL} SELECT host, s.detail AS detail, s.weight AS weight FROM each WHERE s.label = '{label}'")
    def run(spark, sf_dir):
        each = judged(spark, sf_dir).select("host", F.explode("signals").alias("s"))
        return each.where(F.col("s.label") == label).select("host", "s.detail", "s.weight")


for _name, _label in (
    ("R2_homoglyph_signal", "Homoglyph characters"),
    ("R3_skeleton", "Skeleton matches a brand"),
    ("R4_exact_core", "Brand name on a non-official domain"),
    ("R5_embedded", "Brand hidden in a longer name"),
    ("R6_token", "Brand name combined with other words"),
    ("R7_nearest", "Look-alike of a brand"),
    ("R8_subdomain", "Brand in a sub-domain"),
    ("R10_tld", "Suspicious top-level domain"),
    ("R11_lure", "Urgency / lure keywords"),
    ("R13_default", "No brand impersonation detected"),
):
    _signal_query(_name, _label)


@query("R9_attached", f"{VERDICT_SQL} SELECT host, {_core('imp')} AS brand FROM branded WHERE pin IS NULL AND imp IS NOT NULL")
def r9(spark, sf_dir):
    return judged(spark, sf_dir).where("attached").select("host", match.attribute(F.col("impersonated"), CORES).alias("brand"))


@query("R12_aggregate", f"{VERDICT_SQL} SELECT host, level, score FROM judged")
def r12(spark, sf_dir):
    return judged(spark, sf_dir).select("host", "level", "score")


@query("R14_realigned", f"{VERDICT_SQL}, {distance_sql('shown', 'SELECT DISTINCT skeleton AS x, brand AS y FROM judged WHERE brand IS NOT NULL AND NOT ours', True)} "
       "SELECT host, brand, round(similarity, 6) AS similarity, round(distance, 6) AS distance, CASE WHEN ours OR brand IS NULL THEN [] ELSE list_transform(trace, lambda t: t.type || ':' || coalesce(t.a, '') || ':' || coalesce(t.b, '')) END AS edits "
       "FROM verdicts v LEFT JOIN shown s ON s.x = v.skeleton AND s.y = v.brand")  # fmt: skip
def r14(spark, sf_dir):
    edits = F.transform("trace", lambda t: F.concat(t["type"], F.lit(":"), F.coalesce(t["a"], F.lit("")), F.lit(":"), F.coalesce(t["b"], F.lit(""))))
    far = F.when(F.col("distance") < float("inf"), F.round("distance", 6))
    return analysed(spark, sf_dir).select("host", "brand", F.round("similarity", 6).alias("similarity"), far.alias("distance"), edits.alias("edits"))


@query("R15_learned_brands", f"{verdict_sql(LEARNED)} SELECT host, level, score, brand, ops FROM judged")
def r15(spark, sf_dir):
    return analysed(spark, sf_dir, LEARNED).select("host", "level", "score", "brand", F.col("ops").cast("long").alias("ops"))


@query("R15_brand_table", f"{VERDICT_SQL} SELECT host, level, score, brand, array_to_string(list_transform(signals, lambda s: s.label), '|') AS labels FROM judged")
def r15_table(spark, sf_dir):
    """The listed brands as a table that is joined."""
    hosts_ = derived_hosts(spark, sf_dir).select("host").distinct()
    out = brandtable.score_with_table(hosts_, brandtable.brand_table(spark, dims.brands()), "host")
    return out.select("host", "level", "score", "brand", F.array_join(F.transform("signals", lambda s: s["label"]), "|").alias("labels"))


#: A brand for every customer: syllables that spell its number, of which some are a part of others.
_SYLLABLES = "'ba', 'ko', 'mi', 'ne', 'ru', 'sa', 'te', 'vo', 'zi', 'lu'"
_MADE_SQL = f"""made AS (
  SELECT k::INT AS ord, list_reduce(list_transform(string_split(k::VARCHAR, ''), lambda d: [{_SYLLABLES}][d::INT + 1]), lambda a, b: a || b) || 'ly' AS core
  FROM (SELECT DISTINCT c_custkey AS k FROM customer)
)"""
_TOUCH_SQL = f"""WITH {_MADE_SQL}, h AS (
  SELECT ord, core || '.com' AS host, core AS sld, [] AS subs FROM made UNION ALL SELECT ord, core || '-x' || ord || '.net', core || '-x' || ord, [] FROM made WHERE ord % 2 = 0
  UNION ALL SELECT ord, 'my' || core || '.org', 'my' || core, [] FROM made WHERE ord % 3 = 0 UNION ALL SELECT ord, core || 's.x' || ord || '.dev', 'x' || ord, [core || 's'] FROM made WHERE ord % 5 = 0
), t AS (
  SELECT host, 'exact_core' AS kind, m.ord, 0 AS size FROM h JOIN made m ON m.core = h.sld UNION ALL SELECT host, 'skeleton_core', m.ord, 0 FROM h JOIN made m ON m.core = h.sld
  UNION ALL SELECT host, 'official', m.ord, 0 FROM h JOIN made m ON m.core || '.com' = host
  UNION ALL SELECT host, 'token', m.ord, 0 FROM h JOIN made m ON list_contains(string_split(h.sld, '-'), m.core) AND m.core <> h.sld
  UNION ALL SELECT host, 'embedded', m.ord, -length(m.core) FROM h JOIN made m ON contains(h.sld, m.core)
  UNION ALL SELECT host, 'in_subdomain', m.ord, 0 FROM h JOIN made m ON contains(array_to_string(h.subs, ' '), m.core)
)
SELECT host, kind, arg_min(ord, (size, ord)) AS ord FROM t GROUP BY host, kind"""


def made_brands(spark, sf_dir):
    """As many brands as customers, in the columns of brandtable.SCHEMA."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct()
    spelt = F.expr(f"array_join(transform(filter(split(cast(k as string), ''), d -> d <> ''), d -> array({_SYLLABLES})[cast(d as int)]), '')")
    k = k.select(F.col("k").cast("int").alias("ord"), F.concat(spelt, F.lit("ly")).alias("core"))
    domain = F.concat("core", F.lit(".com"))
    return k.select("ord", F.col("core").alias("name"), "core", domain.alias("domain"), F.lit("Shopping").alias("category"), F.lit(False).alias("owns_name"), F.array(domain).alias("official"))


@query("M15_brand_touches", _TOUCH_SQL)
def m15_touches(spark, sf_dir):
    """Hosts made of all customers' brands against all of these brands."""
    brands = made_brands(spark, sf_dir)
    core, k = F.col("core"), F.col("ord").cast("string")
    made = F.array_compact(F.array(
        F.concat(core, F.lit(".com")),
        F.when(F.col("ord") % 2 == 0, F.concat(core, F.lit("-x"), k, F.lit(".net"))),
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("my"), core, F.lit(".org"))),
        F.when(F.col("ord") % 5 == 0, F.concat(core, F.lit("s.x"), k, F.lit(".dev"))),
    ))
    hosts_ = brands.select(F.explode(made).alias("host")).distinct()
    labels = parse_hosts(hosts_, "host").withColumn("skeleton", F.lower("sld")).withColumn("sub_skeletons", F.col("subdomains"))
    return brandtable.touches(labels, brands)


@query("R16_levels", f"{VERDICT_SQL} SELECT family, level, count(*) AS n FROM (SELECT host, family FROM hosts) h JOIN (SELECT host, level FROM judged) j ON h.host = j.host GROUP BY family, level")
def r16(spark, sf_dir):
    out = rules.analyze(derived_hosts(spark, sf_dir), "host")
    return out.groupBy("family", F.col("verdict.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("R16_kept_verdicts", f"{VERDICT_SQL} SELECT id, family, h.host, level, score FROM hosts h JOIN (SELECT host, level, score FROM judged) j ON h.host = j.host WHERE id % 2 = 0")
def r16_kept(spark, sf_dir):
    """Hosts of even numbers, after those divisible by 3 were scored in an earlier run: only the rest of them is scored."""
    path = readers.shared_path(spark, "kept-verdicts")
    h = derived_hosts(spark, sf_dir)
    rules.analyze_new(h.where("id % 3 = 0"), path, "host")
    out = rules.analyze_new(h.where("id % 2 = 0"), path, "host")
    return out.select("id", "family", "host", F.col("verdict.level").alias("level"), F.col("verdict.score").alias("score"))


@query("A10_signal_tally", f"{VERDICT_SQL} SELECT signals[1].label AS label, count(*) AS n, count(brand) AS pinned, count(*) - count(brand) AS unpinned, "
       "list_sort(coalesce(list_distinct(list(h.host || ' [' || level || ']') FILTER (brand IS NULL)), []))[1:25] AS examples FROM (SELECT host FROM hosts WHERE family IN ('benign', 'page')) h JOIN (SELECT host, signals, brand, level FROM judged) j ON h.host = j.host GROUP BY 1")  # fmt: skip
def a10(spark, sf_dir):
    return ev.signal_tally(rules.analyze(derived_hosts(spark, sf_dir).where("family in ('benign', 'page')"), "host").select("verdict.*"))


#: Pages of links to the derived hosts: a page for every 7 customers.
_LINKED_SQL = "linked AS (SELECT (id // 7)::BIGINT AS page_id, host FROM hosts WHERE brand <> '')"


@query("pages_flagged", f"{VERDICT_SQL}, {_LINKED_SQL} SELECT page_id, count(*) AS links, count(*) FILTER (level = 'dangerous') AS danger, count(*) FILTER (level = 'suspicious') AS warn "
       "FROM (SELECT page_id, host FROM linked) l JOIN (SELECT host, level FROM judged) j ON l.host = j.host GROUP BY page_id")  # fmt: skip
def pages_flagged(spark, sf_dir):
    h = derived_hosts(spark, sf_dir).where("brand <> ''")
    anchors = h.withColumn("a", F.concat(F.lit('<p><A class="x" href="https://'), "host", F.lit('/login?a=1">go</a></p>')))
    page = F.expr("cast(id div 7 as long)").alias("page_id")
    made = anchors.groupBy(page).agg(F.array_join(F.collect_list("a"), "\n").alias("html")).withColumn("url", F.lit("https://news.example.org/links"))
    return pages.page_report(pages.flag_links(pages.page_links(made)))


# ---- features and models -------------------------------------------------------------------------------------------

_SYMBOLS = ft.ALPHABET
_FLAGS = {
    "bestSim": "near_sim", "nearestVisual": "near_visual", "nearestTranspose": "near_swapped", "homoglyph": "hidden", "mixedScript": "mixed",
    "homoglyphCount": "len(folded)", "skelExact": "skeleton_core IS NOT NULL AND exact_core IS NULL", "exactCore": "exact_core IS NOT NULL AND free",
    "embedded": "emb", "subBrand": "in_subdomain IS NOT NULL", "tldSuspicious": "bad", "lureCount": "len(lures)", "sldLen": "length(sld)",
    "digitRatio": "CASE WHEN sld = '' THEN 0 ELSE len(regexp_extract_all(sld, '[0-9]')) / length(sld)::DOUBLE END",
    "hyphenCount": "len(regexp_extract_all(sld, '-'))", "official": "NOT free", "simUnofficial": "near_sim * (1 - (NOT free)::INT)",
    "embedLure": "emb AND lured", "subUnofficial": "in_subdomain IS NOT NULL AND free", "ngramImprob": "improbability",
}


def _improbability_sql(label: str) -> str:
    """Mean cost of the pairs of ^label$ under the shipped bigram grid, summed in their order."""
    grid = "[" + ", ".join(repr(dims.bigram_grid()[a + b]) for a in _SYMBOLS for b in _SYMBOLS) + "]::DOUBLE[]"
    text = f"('^' || lower({label}) || '$')"
    a, b = f"instr('{_SYMBOLS}', substr({text}, k::INT, 1))", f"instr('{_SYMBOLS}', substr({text}, k::INT + 1, 1))"
    cost = f"CASE WHEN {a} > 0 AND {b} > 0 THEN -(logp[{len(_SYMBOLS)} * ({a} - 1) + {b}]) ELSE ln({len(_SYMBOLS)}) END"
    return grid, f"list_reduce(list_transform(range(1, length({text})), lambda k: {cost}), lambda a, x: a + x, 0.0::DOUBLE) / (length({text}) - 1)"


_GRID_SQL, _IMPROBABLE = _improbability_sql("skeleton")
FEATURES_SQL = f"""{VERDICT_SQL}, grid AS (SELECT {_GRID_SQL} AS logp), described AS (
  SELECT h.*, {_IMPROBABLE} AS improbability,
    EXISTS (SELECT 1 FROM brands b WHERE length(core) >= 4 AND contains(h.skeleton, core) AND core <> h.sld) AS emb FROM hid h, grid
), features AS (SELECT host, {", ".join(f"({e})::DOUBLE AS {n}" for n, e in _FLAGS.items())} FROM described)"""


def host_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 features of each different derived host."""
    return ft.extract_features(derived_hosts(spark, sf_dir).select("host").distinct(), "host")


_SHOWN = ", ".join(f"round({n}, 9) AS {n}" for n in ft.NAMES)


@query("F1_features", f"{FEATURES_SQL} SELECT host, {_SHOWN} FROM features")
def f1(spark, sf_dir):
    return host_features(spark, sf_dir).select("host", *[F.round(n, 9).alias(n) for n in ft.NAMES])


@query("F1a_embedded", f"{FEATURES_SQL} SELECT host, embedded FROM features")
def f1a(spark, sf_dir):
    return host_features(spark, sf_dir).select("host", "embedded")


@query("F1c_interactions", f"{FEATURES_SQL} SELECT host, round(simUnofficial, 9) AS simUnofficial, embedLure, subUnofficial FROM features")
def f1c(spark, sf_dir):
    return host_features(spark, sf_dir).select("host", F.round("simUnofficial", 9).alias("simUnofficial"), "embedLure", "subUnofficial")


_TERMS = ", ".join(f"{{'k': {k}, 'f': '{n}', 'c': {w!r} * (({n} - {m!r}) / {s!r})}}" for k, (n, m, s, w) in enumerate(dims.model_table()))
MODEL_SQL = f"""{FEATURES_SQL}, termed AS (SELECT host, [{_TERMS}] AS terms FROM features
), predicted AS (
  SELECT host, 1 / (1 + exp(-list_reduce(list_transform(terms, lambda t: t.c), lambda a, c: a + c, ({dims.MODEL_BIAS})::DOUBLE))) AS p, terms FROM termed
), ranked AS (
  SELECT host, p, CASE WHEN p >= {dims.BLOCK_AT} THEN 'dangerous' WHEN p >= {dims.WARN_AT} THEN 'suspicious' ELSE 'safe' END AS level,
    list_transform(list_sort(list_transform(terms, lambda t: {{'o': -abs(t.c), 'k': t.k, 'f': t.f, 'c': t.c}})), lambda t: {{'f': t.f, 'c': t.c}}) AS terms FROM predicted
)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the shipped model."""
    return ft.predict(host_features(spark, sf_dir))


@query("F2_probability", f"{MODEL_SQL} SELECT host, round(p, 9) AS probability, level FROM ranked")
def f2(spark, sf_dir):
    return predicted(spark, sf_dir).select("host", F.round("probability", 9).alias("probability"), "level")


@query("F3_contributions", f"{MODEL_SQL} SELECT host, list_transform(terms, lambda t: t.f) AS features FROM ranked")
def f3(spark, sf_dir):
    return predicted(spark, sf_dir).select("host", F.transform("contributions", lambda t: t["feature"]).alias("features"))


@query("F4_top_contributions", f"{MODEL_SQL}, u AS (SELECT host, unnest(list_filter(terms, lambda t: abs(t.c) > 0.05)[1:4]) AS t, generate_subscripts(list_filter(terms, lambda t: abs(t.c) > 0.05)[1:4], 1) AS place FROM ranked) "
       "SELECT host, place::INT AS place, t.f AS feature, round(t.c, 9) AS contribution FROM u")  # fmt: skip
def f4(spark, sf_dir):
    each = predicted(spark, sf_dir).select("host", F.posexplode(ft.top_contributions(4)).alias("place", "t"))
    return each.select("host", (F.col("place") + 1).alias("place"), "t.feature", F.round("t.contribution", 9).alias("contribution"))


@query("T12_engines", f"{MODEL_SQL} SELECT j.level AS rules_level, r.level AS ml_level, count(*) AS n FROM (SELECT host, level FROM judged) j JOIN (SELECT host, level FROM ranked) r ON j.host = r.host GROUP BY ALL")
def t12(spark, sf_dir):
    ruled = analysed(spark, sf_dir).select("host", F.col("level").alias("rules_level"))
    ml = predicted(spark, sf_dir).select("host", F.col("level").alias("ml_level"))
    return ruled.join(ml, "host").groupBy("rules_level", "ml_level").agg(F.count(F.lit(1)).alias("n"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the different hosts with brand, y and key."""
    y = (~F.col("family").isin("official", "benign", "page")).cast("int")
    marked = derived_hosts(spark, sf_dir).groupBy("host").agg(F.min("brand").alias("brand"), F.max(y).alias("y"))
    return host_features(spark, sf_dir).join(marked, "host")


_LABELLED_SQL = f"""{FEATURES_SQL}, marked AS (
  SELECT host, min(brand) AS brand, max((family NOT IN ('official', 'benign', 'page'))::INT) AS y FROM hosts GROUP BY host
), data AS MATERIALIZED (SELECT m.host, brand, y::DOUBLE AS y, [{", ".join(ft.NAMES)}] AS x FROM features f JOIN marked m ON f.host = m.host)"""


def _fit_sql(models: str, rounds: int, used: list[str] = ft.NAMES) -> str:
    """Tables up to fitted(m, mean, std, w, b): models (m) fitted on rows of `member` (m, x, y) by gradient descent."""
    n = len(ft.NAMES)
    each = lambda f: "[" + ", ".join(f(j) for j in range(1, n + 1)) + "]"
    keep = lambda j: ft.NAMES[j - 1] in used
    return f"""{models}, means AS (
  SELECT m, {each(lambda j: f'avg(x[{j}])')} AS mean, {each(lambda j: f'coalesce(nullif(stddev_pop(x[{j}]), 0), 1)')} AS std, count(*)::DOUBLE AS n, sum(y) AS pos FROM member GROUP BY m
), zs AS MATERIALIZED (
  SELECT a.m, a.y, {each(lambda j: f'(x[{j}] - mean[{j}]) / std[{j}]')} AS z, CASE WHEN a.y = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS cw FROM member a JOIN means s ON a.m = s.m
), steps AS (
  SELECT m, 0 AS r, {each(lambda j: '0.0::DOUBLE')} AS w, 0.0::DOUBLE AS b FROM means
  UNION ALL
  SELECT m, any_value(r) + 1, {each(lambda j: f'any_value(w[{j}]) - 0.5 * (sum(e * z[{j}]) / sum(cw) + 1e-4 * any_value(w[{j}]))' if keep(j) else '0.0::DOUBLE')}, any_value(b) - 0.5 * sum(e) / sum(cw)
  FROM (SELECT s.m, s.r, s.w, s.b, d.z, d.cw, d.cw * (1 / (1 + exp(-(s.b + list_inner_product(s.w, d.z)))) - d.y) AS e FROM steps s JOIN zs d ON s.m = d.m WHERE s.r < {rounds}) GROUP BY m
), fitted AS (SELECT s.m, mean, std, w, b FROM steps s JOIN means t ON s.m = t.m WHERE r = {rounds})"""


def _p_sql(x: str = "x") -> str:
    n = len(ft.NAMES)
    return "1 / (1 + exp(-(b + " + " + ".join(f"w[{j}] * (({x}[{j}] - mean[{j}]) / std[{j}])" for j in range(1, n + 1)) + ")))"


@query("F6_train_logistic", f"{_LABELLED_SQL}, {_fit_sql('member AS (SELECT 0 AS m, x, y FROM data)', 300)} "
       f"SELECT unnest({ft.NAMES + ['bias']}) AS feature, round(unnest(list_append(w, b)), 6) AS weight FROM fitted")  # fmt: skip
def f6(spark, sf_dir):
    weights, bias = ft.train_logistic(labelled(spark, sf_dir), ft.NAMES, rounds=300)
    return spark.createDataFrame([(n, round(w, 6)) for n, _, _, w in weights] + [("bias", round(bias, 6))], "feature string, weight double")


_FOLDS_SQL = "folded_hosts AS (SELECT d.*, ((row_number() OVER (PARTITION BY y ORDER BY md5(host), host) - 1) % 5)::INT AS fold FROM data d)"
_OUT_OF_FOLD_SQL = "member AS (SELECT m::INT AS m, x, y FROM folded_hosts, range(5) t(m) WHERE fold <> m)"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.folds(labelled(spark, sf_dir), "y", "host")


@query("S3_out_of_fold", f"{_LABELLED_SQL}, {_FOLDS_SQL}, {_fit_sql(_OUT_OF_FOLD_SQL, 300)} SELECT host, fold, round({_p_sql()}, 6) AS probability FROM folded_hosts h JOIN fitted f ON h.fold = f.m")
def s3(spark, sf_dir):
    out = ev.out_of_fold(folded(spark, sf_dir), ft.NAMES, 5, rounds=300)
    return out.select("host", "fold", F.round("probability", 6).alias("probability"))


#: Thresholds as the operator steps through them.
_STEPS = ev.threshold_grid(0.05, 0.95)


@query("S4_leave_one_out", f"""{_LABELLED_SQL}, held AS (SELECT DISTINCT brand AS g FROM data WHERE y = 1),
{_fit_sql("member AS (SELECT g AS m, x, y FROM data, held WHERE brand IS DISTINCT FROM g)", 400)}, own AS (
  SELECT f.m, y, {_p_sql()} AS p FROM data d JOIN fitted f ON d.brand IS DISTINCT FROM f.m
), f1 AS (
  SELECT m, t, 2.0 * count(*) FILTER (y = 1 AND p >= t) / (count(*) FILTER (y = 1) + count(*) FILTER (p >= t)) AS f1 FROM own, (SELECT unnest({_STEPS}) AS t) GROUP BY m, t
), warn AS (SELECT m, t AS warn FROM f1 QUALIFY row_number() OVER (PARTITION BY m ORDER BY f1 DESC, t) = 1)
SELECT brand, round(warn, 6) AS warn, count(*) AS n, round(avg(CASE WHEN {_p_sql()} >= warn THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM data d JOIN fitted f ON d.brand = f.m JOIN warn w ON w.m = f.m WHERE y = 1 GROUP BY brand, warn""")
def s4(spark, sf_dir):
    out = ev.leave_one_out(labelled(spark, sf_dir), ft.NAMES, "brand", rounds=400)
    return out.select("brand", F.round("warn", 6).alias("warn"), "n", F.round("recall", 6).alias("recall"))


def _auc_sql(table_: str) -> str:
    return f"""(SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))
      FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM {table_}))"""


#: The features that are neither interactions nor the bigram model.
BASE = ft.NAMES[:16]


@query("A9_ablation", f"{_LABELLED_SQL}, {_FOLDS_SQL}, {_fit_sql(_OUT_OF_FOLD_SQL, 300)}, scored_all AS (SELECT y, round({_p_sql()}, 6) AS p FROM folded_hosts h JOIN fitted f ON h.fold = f.m) "
       f"SELECT 'all' AS features, round({_auc_sql('scored_all')}, 6) AS auc UNION ALL SELECT 'base', (WITH RECURSIVE {_fit_sql(_OUT_OF_FOLD_SQL, 300, BASE)}, scored_base AS (SELECT y, round({_p_sql()}, 6) AS p FROM folded_hosts h JOIN fitted f ON h.fold = f.m) "
       f"SELECT round({_auc_sql('scored_base')}, 6))")  # fmt: skip
def a9(spark, sf_dir):
    return ev.ablation(folded(spark, sf_dir), ft.NAMES, {"all": ft.NAMES, "base": BASE}, 5, rounds=300)


_GRID = [round(0.05 + 0.01 * k, 2) for k in range(91)]


@query("A9_gap", f"""{_LABELLED_SQL}, {_FOLDS_SQL}, {_fit_sql("member AS (SELECT m::INT AS m, x, y FROM folded_hosts, range(6) t(m) WHERE fold <> m)", 300)}, scored_all AS (
  SELECT y, round({_p_sql()}, 9) AS p, m FROM folded_hosts h JOIN fitted f ON h.fold = f.m OR f.m = 5
), f1 AS (
  SELECT t, m, 2.0 * count(*) FILTER (y = 1 AND p >= t) / (count(*) FILTER (y = 1) + count(*) FILTER (p >= t)) AS f1
  FROM (SELECT y, p, CASE WHEN m = 5 THEN 'all' ELSE 'out' END AS m FROM scored_all), (SELECT unnest({_GRID}) AS t) GROUP BY t, m
), best AS (SELECT t FROM f1 WHERE m = 'out' ORDER BY f1 DESC, t LIMIT 1)
SELECT round(t, 6) AS threshold, round(max(f1) FILTER (m = 'all'), 6) AS resubstitution_f1, round(max(f1) FILTER (m = 'out'), 6) AS out_of_fold_f1,
  round(max(f1) FILTER (m = 'all') - max(f1) FILTER (m = 'out'), 6) AS gap FROM f1 WHERE t = (SELECT t FROM best) GROUP BY t""")
def a9_gap(spark, sf_dir):
    out = ev.overfitting(folded(spark, sf_dir), ft.NAMES, 5, rounds=300, grid=_GRID)
    return out.select(*[F.round(c, 6).alias(c) for c in ("threshold", "resubstitution_f1", "out_of_fold_f1", "gap")])


@query("F10_models_compared", f"{MODEL_SQL}, {_LABELLED_SQL[len(FEATURES_SQL) + 2:]}, {_fit_sql('member AS (SELECT 0 AS m, x, y FROM data)', 300)}, fresh AS (SELECT host, brand, y, {_p_sql()} AS q FROM data, fitted) "
       "SELECT brand, count(*) FILTER (p >= 0.94) AS old_hits, count(*) FILTER (q >= 0.5) AS new_hits, count(*) AS n FROM (SELECT host, p FROM ranked) r JOIN (SELECT host AS h2, brand, q, y FROM fresh) f ON r.host = f.h2 WHERE y = 1 GROUP BY brand")  # fmt: skip
def f10(spark, sf_dir):
    df = labelled(spark, sf_dir)
    new = ft.train_logistic(df, ft.NAMES, rounds=300)
    return ft.compared(df.where("y = 1"), {"old_hits": ((dims.model_table(), dims.MODEL_BIAS), dims.WARN_AT), "new_hits": (new, 0.5)}, "brand")

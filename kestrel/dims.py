"""Dimensions of the engine: protected brands, word lists, costs, suffix rules, confusables and the shipped model.

Small dimensions are fixed values below. The large public tables (the Public Suffix List, the UTS #39 confusables and the
bigram model of domain labels) are files in kestrel/data, of about 7,000, 1,600 and 1,500 entries, and are the defaults;
read_suffix_rules and read_confusables load other published versions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEARNED = "Your site"


@dataclass(frozen=True)
class Brand:
    """A protected name: `core` is its registrable label, `domain` its official domain."""

    name: str
    core: str
    domain: str
    category: str
    owns_name: bool = False
    alt_domains: tuple[str, ...] = field(default=())

    @property
    def official(self) -> tuple[str, ...]:
        return (self.domain, *self.alt_domains)


# Brand | core | official domain | category | owns its name on every TLD | other official domains.
_BRANDS = """
State Bank of India | onlinesbi | onlinesbi.sbi | Bank | |
SBI | sbi | sbi.co.in | Bank | |
HDFC Bank | hdfcbank | hdfcbank.com | Bank | |
ICICI Bank | icicibank | icicibank.com | Bank | |
Axis Bank | axisbank | axisbank.com | Bank | |
Kotak | kotak | kotak.com | Bank | |
Bank of Baroda | bankofbaroda | bankofbaroda.in | Bank | |
Punjab National Bank | pnbindia | pnbindia.in | Bank | |
Canara Bank | canarabank | canarabank.com | Bank | |
Paytm | paytm | paytm.com | Payments | yes |
PhonePe | phonepe | phonepe.com | Payments | yes |
Google Pay | gpay | gpay.app | Payments | |
BHIM | bhim | bhimupi.org.in | Payments | |
Razorpay | razorpay | razorpay.com | Payments | yes |
PayPal | paypal | paypal.com | Payments | yes |
Google | google | google.com | Tech | yes | googleapis.com gstatic.com googleusercontent.com googletagmanager.com googlevideo.com googlesyndication.com googleadservices.com google-analytics.com googledomains.com withgoogle.com goo.gl
Microsoft | microsoft | microsoft.com | Tech | yes | microsoftonline.com office.com live.com msftauth.net windows.net azureedge.net sharepoint.com
Apple | apple | apple.com | Tech | yes | apple-dns.net icloud.com mzstatic.com cdn-apple.com
Facebook | facebook | facebook.com | Social | yes | fbcdn.net fb.com facebook.net
Instagram | instagram | instagram.com | Social | yes | cdninstagram.com ig.me
WhatsApp | whatsapp | whatsapp.com | Social | yes | whatsapp.net wa.me
Netflix | netflix | netflix.com | Media | yes | nflxext.com nflximg.net nflxvideo.net
YouTube | youtube | youtube.com | Media | yes | youtu.be ytimg.com youtube-nocookie.com
Amazon | amazon | amazon.in | Shopping | yes | amazonaws.com amazon-adsystem.com ssl-images-amazon.com media-amazon.com images-amazon.com primevideo.com a2z.com
Flipkart | flipkart | flipkart.com | Shopping | yes | flixcart.com fkrt.it
Myntra | myntra | myntra.com | Shopping | yes |
India Post | indiapost | indiapost.gov.in | Logistics | |
IRCTC | irctc | irctc.co.in | Travel | |
EPFO | epfindia | epfindia.gov.in | Government | |
"""

# Top-level domains of throwaway sites.
SUSPICIOUS_TLDS = (
    "xyz top tk ml ga cf gq buzz click link live online site website club icu rest cam support work fit shop store win bid loan"
).split()

# Words of urgency, in the order in which they are reported.
LURE_WORDS = (
    "login verify secure account update kyc support reward refund offer bonus wallet signin confirm alert block unlock "
    "service help care official"
).split()

# Pairs of characters that look alike, the rows of a keyboard, and costs of substitutions.
VISUAL_PAIRS = "0o 1l 1i 5s 3e 4a 7t 8b 9g 6g 2z li oq ce vu mn wv".split()
KEYBOARD_ROWS = "qwertyuiop asdfghjkl zxcvbnm".split()
VISUAL_COST, KEYBOARD_COST, OTHER_COST = 0.25, 0.6, 1.0

# The shipped logistic model, feature | mean | deviation | weight.
_MODEL = """
bestSim | 0.370075 | 0.112233 | 1.045721
nearestVisual | 0.345753 | 0.475613 | -0.304358
nearestTranspose | 0.023963 | 0.152934 | 0.046455
homoglyph | 0.002769 | 0.052553 | 0.56589
mixedScript | 0.001139 | 0.033733 | 0.308795
homoglyphCount | 0.005657 | 0.118289 | 0.080725
skelExact | 0.002278 | 0.047679 | 0.566394
exactCore | 0.000668 | 0.025834 | -0.043974
embedded | 0.007405 | 0.085733 | 0.022801
subBrand | 0.00055 | 0.023445 | 0.278034
tldSuspicious | 0.018836 | 0.135947 | -0.04113
lureCount | 0.011255 | 0.107701 | 0.080327
sldLen | 8.172317 | 3.680786 | -0.251615
digitRatio | 0.023685 | 0.106257 | 0.130556
hyphenCount | 0.084577 | 0.312058 | 0.111118
official | 0.005893 | 0.076536 | -0.090257
simUnofficial | 0.364638 | 0.106479 | 1.164245
embedLure | 0.001179 | 0.034309 | 0.318049
subUnofficial | 0.00055 | 0.023445 | 0.278034
ngramImprob | 2.893633 | 0.365958 | 0.375176
"""
MODEL_BIAS, WARN_AT, BLOCK_AT = -5.19885, 0.940, 0.995

# Common public suffixes in the list's own format (* any label, ! exception); the queries' SQL spells these.
SUFFIX_RULES = """
com net org info biz edu gov mil int io co me app dev page sbi bank
in co.in org.in net.in gov.in ac.in firm.in gen.in ind.in nic.in
uk co.uk org.uk gov.uk ac.uk me.uk ltd.uk plc.uk net.uk
jp co.jp or.jp ne.jp ac.jp go.jp
au com.au net.au org.au gov.au edu.au id.au
br com.br net.br org.br gov.br
cn com.cn net.cn org.cn gov.cn
nz co.nz org.nz net.nz govt.nz
za co.za org.za gov.za
kr co.kr or.kr go.kr
ua com.ua net.ua org.ua gov.ua
tr com.tr org.tr gov.tr
mx com.mx org.mx gob.mx
sg com.sg org.sg gov.sg
de fr es it nl be at ch se no dk fi pl pt cz ru us ca eu gl gg ly be
*.ck !www.ck *.bd *.np *.kh
xyz top tk ml ga cf gq buzz click link live online site website club icu rest cam support work fit shop store win bid loan
""".split()

# Look-alikes of dots; they go before the table of confusables.
_DOTS = "․．。｡·"


def _resource(name: str) -> list[str]:
    return (resources.files("kestrel") / "data" / name).read_text("utf-8").splitlines()


@cache
def public_suffixes() -> tuple[str, ...]:
    """The Public Suffix List, its ICANN section, in its own format."""
    return tuple(line for line in _resource("public_suffixes.txt") if line and not line.startswith("//"))


@cache
def bigram_grid() -> dict[str, float]:
    """The shipped bigram model of domain labels: two symbols -> log probability that the second follows."""
    _, symbols, *rows = _resource("bigrams.txt")
    return {a + b: float(x) for a, row in zip(symbols, rows, strict=True) for b, x in zip(symbols, row.split(), strict=True)}


def brands() -> list[Brand]:
    """The protected brands; their order decides ties."""
    out = []
    for line in _BRANDS.strip().splitlines():
        name, core, domain, category, owns, *alt = (x.strip() for x in line.split("|"))
        out.append(Brand(name, core, domain, category, owns == "yes", tuple(" ".join(alt).split())))
    return out


def model_table() -> list[tuple[str, float, float, float]]:
    rows = [[x.strip() for x in line.split("|")] for line in _MODEL.strip().splitlines()]
    return [(name, *map(float, numbers)) for name, *numbers in rows]


@cache
def confusables() -> dict[str, str]:
    """The folds, character -> what it looks like: the UTS #39 table and look-alikes of dots."""
    rows = (line.split(" ; ") for line in _resource("confusables.txt") if not line.startswith("#"))
    return {chr(int(code, 16)): target for code, target in rows} | dict.fromkeys(_DOTS, ".")


def substitution_kinds() -> dict[str, str]:
    """Two characters -> 'visual' or 'keyboard'; visual wins. Both directions."""
    near = [row[i : i + 2] for row in KEYBOARD_ROWS for i in range(len(row) - 1)]
    kinds = {}
    for kind, pairs in (("keyboard", near), ("visual", VISUAL_PAIRS)):
        for pair in pairs:
            kinds[pair] = kinds[pair[::-1]] = kind
    return kinds


def suffix_rules(spark: SparkSession, rules: list[str] | None = None) -> DataFrame:
    """Rules, by default all of the list, as rows (suffix, exact, wild, except): a suffix may carry several kinds."""
    kinds: dict[str, list[bool]] = {}
    for rule in rules if rules is not None else public_suffixes():
        k = 2 if rule.startswith("!") else 1 if rule.startswith("*.") else 0
        kinds.setdefault(rule.lstrip("!").removeprefix("*."), [False] * 3)[k] = True
    rows = [(s, *k) for s, k in kinds.items()]
    return spark.createDataFrame(rows, "suffix string, is_exact boolean, is_wild boolean, is_exception boolean")


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a published Public Suffix List file, its ICANN section, in the form of suffix_rules."""
    lines = spark.read.text(path, wholetext=True).select(
        F.substring_index(F.substring_index("value", "===END ICANN DOMAINS===", 1), "===BEGIN ICANN DOMAINS===", -1).alias("v")
    )
    rules = lines.select(F.explode(F.split("v", "\n")).alias("rule")).select(F.trim("rule").alias("rule"))
    rules = rules.where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    return classify_rules(rules)


def classify_rules(rules: DataFrame) -> DataFrame:
    """Rows (rule) in the list's format to rows (suffix, is_exact, is_wild, is_exception)."""
    word = F.split(F.trim("rule"), r"\s+")[0]
    kinds = rules.select(word.alias("rule")).select(
        F.regexp_replace("rule", r"^(!|\*\.)", "").alias("suffix"),
        F.col("rule").startswith("!").alias("x"),
        F.col("rule").startswith("*.").alias("w"),
    )
    return kinds.groupBy("suffix").agg(
        F.bool_or(~F.col("x") & ~F.col("w")).alias("is_exact"),
        F.bool_or("w").alias("is_wild"),
        F.bool_or("x").alias("is_exception"),
    )

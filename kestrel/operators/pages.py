"""Links of pages, and scoring each different host once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import hosts, html, urls
from kestrel.operators.rules import analyze


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, url, host, page_host, other): every anchor of pages (page_id, url, html).

    Anchors are those of the markup: none in comments, scripts, styles and templates, attributes read by the rules of HTML. A
    link is resolved against the page's first <base>, or its URL, and is null if it isn't http or https. `other` marks links to
    hosts other than the page's own. A null page has no anchors. Pages without a tag <a don't reach Python, others go through
    the tokenizer once.
    """
    some = pages.where(F.col("html").rlike(html.ANCHOR)).select("page_id", F.col("url").alias("page_url"), "html")
    kind = dict(some.dtypes)["page_id"]
    found = some.mapInArrow(html.anchor_rows, f"page_id {kind}, page_url string, base string, place int, href string")
    out = found.withColumn("__link", urls.link(F.col("href"), F.col("base"), F.col("page_url"))).select("page_id", "place", "href", "__link.*")
    other = F.coalesce(F.col("host") != F.col("page_host"), F.lit(False))
    return out.select("page_id", "place", "href", "url", "host", "page_host", other.alias("other"))


def flag_links(links: DataFrame, **how) -> DataFrame:
    """Links (page_id, host, other) that go elsewhere plus verdict and flag; each different host is scored once."""
    scored = analyze(links.where("other"), "host", **how)
    return scored.withColumn("flag", hosts.flag_of(F.col("verdict.level")))


def page_report(flagged: DataFrame) -> DataFrame:
    """(page_id, links, danger, warn) of flagged links."""
    return flagged.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(F.col("flag") == "danger").alias("danger"),
        F.count_if(F.col("flag") == "warn").alias("warn"),
    )

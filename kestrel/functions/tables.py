"""Table functions for SQL text: links of pages, look-alikes of brands, and signals of verdicts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StructType

from kestrel import dims
from kestrel.functions.html import page_anchors
from kestrel.functions.urls import _web_host, resolved


@udtf(returnType="place int, href string, url string, host string, other boolean")
class PageLinks:
    """page_links(url, html): the anchors of a page as pages.page_links gives them; SELECT ... FROM pages, LATERAL page_links(url, html)."""

    def eval(self, url: str | None, html: str | None) -> Iterator[tuple]:
        if html is None:
            return
        base, hrefs = page_anchors(html)
        base = (resolved(base, url) if base is not None else None) or url
        own = _web_host(url) if url is not None else None
        for place, href in enumerate(hrefs):
            link = resolved(href, base)
            host = _web_host(link) if link else None
            yield place, href, link, host, bool(host and own and host != own)


@udtf(returnType="kind string, label string")
class LookAlikes:
    """look_alikes(core): every label that is one slip, look-alike or digit away from a core, as rows of kind and label.

    Kinds: swap (neighbours exchanged), delete, double, keyboard, visual (another ASCII character), glyph (one beyond ASCII).
    """

    def __init__(self) -> None:
        self.near: dict[str, list[tuple[str, str]]] = {}
        for pair, kind in sorted(dims.substitution_kinds().items()):
            self.near.setdefault(pair[0], []).append((kind, pair[1]))
        for ch, letter in sorted(dims.confusables().items()):
            self.near.setdefault(letter, []).append(("glyph", ch))

    def eval(self, core: str | None) -> Iterator[tuple]:
        if not core:
            return
        seen = {core}
        for k, c in enumerate(core):
            made = [("swap", core[:k] + core[k + 1] + c + core[k + 2 :])] if k + 1 < len(core) else []
            made += [("delete", core[:k] + core[k + 1 :]), ("double", core[:k] + c + core[k:])]
            made += [(kind, core[:k] + x + core[k + 1 :]) for kind, x in self.near.get(c, [])]
            for kind, label in made:
                if label and label not in seen:
                    seen.add(label)
                    yield kind, label


@udtf
class HostRuns:
    """first_visits(TABLE(visits) PARTITION BY device ORDER BY ts): the visits of a device whose host differs from the one before.

    The input table has columns device and host, and may have others; all come back, with run, the number of the visit's run.
    """

    @staticmethod
    def analyze(visits: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType(list(visits.dataType.fields)).add("run", IntegerType())
        return AnalyzeResult(schema=schema)

    def __init__(self) -> None:
        self.last, self.run = None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.run == 0 or row["host"] != self.last:
            self.last, self.run = row["host"], self.run + 1
            yield (*row, self.run)


def register(spark: SparkSession) -> None:
    """page_links, look_alikes, first_visits, and verdict_signals(signals): a row for each signal of a verdict's array."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("look_alikes", LookAlikes)
    spark.udtf.register("first_visits", HostRuns)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION verdict_signals(signals ARRAY<STRUCT<label: STRING, detail: STRING, weight: DOUBLE>>)
      RETURNS TABLE(place INT, label STRING, detail STRING, weight DOUBLE)
      RETURN SELECT pos, col.label, col.detail, col.weight FROM (SELECT posexplode(signals))""")

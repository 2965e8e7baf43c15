"""URLs, links and markup against what browsers make of them."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.functions import html, punycode, unicode, urls
from kestrel.operators.pages import page_links

#: Spelling and the host a browser has; None where it has none.
HOSTS = [
    ("http://Example.COM/", "example.com"),
    ("http:\\\\evil.com\\x", "evil.com"),
    ("http:example.com", "example.com"),
    ("https:/example.com", "example.com"),
    ("https:////example.com//x", "example.com"),
    ("http://0x7f.1/", "127.0.0.1"),
    ("http://2130706433", "127.0.0.1"),
    ("http://017700000001/", "127.0.0.1"),
    ("http://1.2.3", "1.2.0.3"),
    ("http://1.2.3.4.5/", None),
    ("http://256.1.1.1/", None),
    ("http://1.2.3.09/", None),
    ("http://a.1x/", "a.1x"),
    ("http://a.b.0x1/", None),
    ("http://4294967296/", None),
    ("http://1.2.3.4./", "1.2.3.4"),
    ("http://ex%61mple.com/", "example.com"),
    ("http://ex%zzmple.com/", None),
    ("http://a%2fb.com/", None),
    ("http://example.com:99999/", None),
    ("http://example.com:65535/", "example.com"),
    ("http://example.com:8x/", None),
    ("http://example.com:", "example.com"),
    ("http://user:pa@ss@example.com:80/", "example.com"),
    ("http://@/", None),
    ("http://", None),
    ("http:// x.com/", None),
    ("  http://exa\tmple.com\n/ ", "example.com"),
    ("http://a<b.com/", None),
    ("http://a_b.com/", "a_b.com"),
    ("http://Bücher.example/", "xn--bcher-kva.example"),
    ("http://faß.de/", "xn--fa-hia.de"),
    ("http://例え。テスト/", "xn--r8jz45g.xn--zckzah"),
    ("http://ｅｘａｍｐｌｅ．com/", "example.com"),
    ("http://exam­ple.com/", "example.com"),
    ("http://xn--bcher-kva.example/", "xn--bcher-kva.example"),
    ("http://XN--BCHER-KVA.example/", "xn--bcher-kva.example"),
    ("http://xn--a/", None),
    ("http://xn--abc-.com/", None),
    ("http://�.com/", None),
    ("http://%EF%BF%BD.com/", None),
    ("http://̀a.com/", None),
    ("http://[2001:DB8::0:1]:80/", "[2001:db8::1]"),
    ("http://[::1.2.3.4]/", "[::102:304]"),
    ("http://[1:0:0:2:0:0:0:3]/", "[1:0:0:2::3]"),
    ("http://[::1/", None),
    ("http://[::g]/", None),
    ("http://[::1%25eth0]/", None),
    ("ftp://example.com/", None),
    ("mailto:a@b.com", None),
    ("//example.com/", None),
    ("example.com", None),
    ("", None),
    (None, None),
]

#: Link, page and the URL that it leads to.
LINKS = [
    ("/x", "https://a.com/b/c?q#f", "https://a.com/x"),
    ("x", "https://a.com/b/c?q#f", "https://a.com/b/x"),
    ("../../up", "https://a.com/b/c/d", "https://a.com/up"),
    ("../../../..", "https://a.com/b/c/d", "https://a.com/"),
    ("./x/./y/../z/", "https://a.com/b/c", "https://a.com/b/x/z/"),
    ("x/%2e%2E/y", "https://a.com/b/", "https://a.com/b/y"),
    (".", "https://a.com/b/c", "https://a.com/b/"),
    ("..", "https://a.com/b/c/d", "https://a.com/b/"),
    ("?q=1", "https://a.com/b/c?old#f", "https://a.com/b/c?q=1"),
    ("#top", "https://a.com/b/c?old#f", "https://a.com/b/c?old#top"),
    ("", "https://a.com/b/c?old#f", "https://a.com/b/c?old"),
    ("//Other.com", "https://a.com/b", "https://other.com/"),
    ("\\\\other.com\\x", "https://a.com/b", "https://other.com/x"),
    ("/\\other.com", "https://a.com/b", "https://other.com/"),
    ("http://other.com:80", "https://a.com/b", "http://other.com/"),
    ("http://other.com:8080/a/../b?x='", "https://a.com/b", "http://other.com:8080/b?x=%27"),
    ("https:x", "https://a.com/b/c", "https://a.com/b/x"),
    ("https:/x", "https://a.com/b/c", "https://a.com/x"),
    ("http:x", "https://a.com/b/c", "http://x/"),
    ("a bé\"<", "https://a.com/", "https://a.com/a%20b%C3%A9%22%3C"),
    ("/a?b cé#d e`", "https://a.com/", "https://a.com/a?b%20c%C3%A9#d%20e%60"),
    ("https://u s:p@b.com/", "https://a.com/", "https://u%20s:p@b.com/"),
    ("\t/x\n", "https://a.com/", "https://a.com/x"),
    ("javascript:void(0)", "https://a.com/", None),
    ("mailto:x@y.com", "https://a.com/", None),
    ("ftp://b.com/", "https://a.com/", None),
    ("https://b.com:99999/", "https://a.com/", None),
    ("/x", "about:blank", None),
    ("https://b.com/x", None, "https://b.com/x"),
    ("/x", None, None),
    (None, "https://a.com/", None),
]

PAGES = {
    "comments and scripts": ("<!-- <a href=/no> --><script>s='<a href=/no></scr'+'ipt>'</script><a href=/yes>", [None, ["/yes"]]),
    "odd comments": ("<!--><a href=1><!---><a href=2><!-- <a href=no> --!><a href=3><!doctype a href=no><?a href=no><a href=4>", [None, ["1", "2", "3", "4"]]),
    "an end of nothing": ("</><a href=1></ a href=no><a href=2>", [None, ["1", "2"]]),
    "hidden end of a script": ("<script><!-- <script> </script> <a href=no> --></script><a href=1>", [None, ["1"]]),
    "a script with an open comment": ("<script><!-- </script><a href=1>", [None, ["1"]]),
    "raw text": ("<title><a href=no></title><TEXTAREA><a href=no></textareax></textarea ><style><a href=no></style/><noscript><a href=no></noscript><a href=1>", [None, ["1"]]),
    "attributes": ("<a class='x>y' HREF = \"u v\" href=no data-href=no>x</a><a\thref='w'/><a/href=z><area href=no><a name=n><abbr href=no>", [None, ["u v", "w", "z"]]),
    "no space between": ("<a id=\"1\"href=x><a =href=no><a href><a href=>", [None, ["x", "", ""]]),
    "references": ("<a href='?a=1&amp;b&lt;&copy=2&copy;3&copyx&#x26;&#38&#128;&#0;&bogus;&notit;'>", [None, ["?a=1&b<&copy=2©3&copyx&&€�&bogus;&notit;"]]),
    "base": ("<base target=x><BASE href='/b/'><base href=no><a href=x>", ["/b/", ["x"]]),
    "templates": ("<template><a href=no><template></template><a href=no></template><a href=1>", [None, ["1"]]),
    "a tag that never ends": ("<a href=1>x<a href=\"no", [None, ["1"]]),
    "text": ("1 < 2 <3 a href=no> <a href=1>", [None, ["1"]]),
    "plaintext": ("<a href=1><plaintext><a href=no>", [None, ["1"]]),
    "nothing": ("", [None, []]),
}


def test_hosts(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(HOSTS)], "k int, url string")
    got = {r["k"]: r["host"] for r in df.select("k", urls.url_host(F.col("url")).alias("host")).collect()}
    assert [(u, got[k]) for k, (u, _) in enumerate(HOSTS)] == HOSTS


def test_right_to_left_names():
    assert urls.host_of("אב.com") == "xn--" + "אב".encode("punycode").decode() + ".com"
    assert urls.host_of("אבa.com") is None and urls.host_of("1א.com") is None


def test_hostnames_of_any_scheme():
    want = {"ftp://A.com/": "a.com", "foo://Bar.com:1/x": "Bar.com", "mailto:x@y": "", "file:///x": "", "file://Srv/x": "srv", "x": None, "foo://a b/": None}
    assert {u: urls.hostname(u) for u in want} == want


def test_links(spark):
    df = spark.createDataFrame([(k, h, b) for k, (h, b, _) in enumerate(LINKS)], "k int, href string, base string")
    got = {r["k"]: r["url"] for r in df.select("k", urls.resolve(F.col("href"), F.col("base")).alias("url")).collect()}
    assert [(h, b, got[k]) for k, (h, b, _) in enumerate(LINKS)] == LINKS


def test_plain_links_are_what_the_parser_makes_of_them(spark):
    """Whatever Spark's expressions take for plain, the parser leaves as it is."""
    rng = random.Random(3)
    pieces = ["http://", "https://", "a", "B", "-", ".", "..", "/", "//", "\\", "?", "#", "%2e", "%41", ":", "80", "@", "xn--", "é", " ", "com", "_", "'", "0x1"]
    some = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    some += ["https://" + x for x in some[:1500]]
    df = spark.createDataFrame([(h, b) for h in some for b in ("https://www.b.com/c/d?e",)], "href string, base string")
    for r in df.select("href", "base", urls.resolve(F.col("href"), F.col("base")).alias("url"), urls.url_host(F.col("href")).alias("host")).collect():
        assert (r["url"], r["host"]) == (urls.resolved(r["href"], r["base"]), urls._web_host(r["href"])), r["href"]


@pytest.mark.parametrize("name", PAGES)
def test_anchors(name):
    assert list(html.page_anchors(PAGES[name][0])) == PAGES[name][1]


def test_links_of_pages(spark):
    rows = [(1, "https://a.com/x/y", "<base href='//Cdn.com/z/'><a href='p'><a href='http://a.com/'><a href='mailto:q@r'>"), (2, "https://a.com/", None), (3, None, "<a href='/x'>"), (4, "https://a.com/", "none")]
    got = page_links(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted((r["page_id"], r["place"], r["url"], r["host"], r["other"]) for r in got if r["url"]) == [
        (1, 0, "https://cdn.com/z/p", "cdn.com", True), (1, 1, "http://a.com/", "a.com", False)
    ]
    assert len(got) == 4


def test_references_of_any_length():
    assert html.attribute_text("&#0000000065;&#x00000000000041;&#99999999999;&#0;") == "AA\ufffd\ufffd"
    long = "a" * 400_000
    assert html.attribute_text(f"?x&{long}&ampz") == f"?x&{long}&ampz"
    assert html.attribute_text("&notin;&notit;&not") == "\u2209&notit;\u00ac"


def test_links_of_any_id_and_many_anchors(spark):
    rows = [("p", "https://a.com/", "<A HREF=/x>" * 60_000), ("q", "https://a.com/", "<a>"), (None, "https://a.com/", "<a href=y>")]
    got = page_links(spark.createDataFrame(rows, "page_id string, url string, html string")).groupBy("page_id").count()
    assert {r["page_id"]: r["count"] for r in got.collect()} == {"p": 60_000, None: 1}
    assert page_links(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_scripts_of_letters(spark):
    rows = [("pay-1",), ("pаy",), ("αβ",), ("é1",), ("12-",), ("",), (None,)]
    got = spark.createDataFrame(rows, "s string").select("s", unicode.letter_scripts(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == [["Latin"], ["Latin", "Cyrillic"], ["Greek"], ["Latin"], [], [], None]


def test_punycode_against_the_codec():
    rng = random.Random(1)
    for _ in range(3000):
        label = "".join(rng.choice("abz-09éüßñ漢字кирαω😀א") for _ in range(rng.randrange(1, 14)))
        spelt = label.encode("punycode").decode()
        assert punycode.encode(label) == spelt and punycode.decode(spelt) == label
    assert punycode.decode("a-é") is None and punycode.decode("99999999") is None and punycode.decode("b!") is None


def test_links_go_through_python_once(spark):
    """A task has a process for each Python step of its plan: the tokenizer, and one for links that aren't plain."""
    df = spark.createDataFrame([(1, "https://a.com/", "<a href=x>")], "page_id int, url string, html string")
    plan = page_links(df)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1

"""Anchors of HTML pages, by a tokenizer of the markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa

#: Elements whose content is text, up to their own end tag. Scripts of pages run, so noscript is one of them.
RAW_TEXT = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea", "title"))
#: Elements that anchors of a page depend on.
SHOWN = frozenset(("a", "base", "template"))
#: Letters of the longest name of a character reference.
LONGEST_NAME = max(map(len, html5))

BETWEEN = re.compile(r"[\t\n\f\r /]*")
SPACES = re.compile(r"[\t\n\f\r ]*")
NAME = re.compile(r"=?[^\t\n\f\r />=]*")
BARE_VALUE = re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile(r"--!?>")
REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*;?))")
SCRIPT_STEP = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)


def _character(code: int) -> str:
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return "\ufffd" if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


def attribute_text(value: str) -> str:
    """An attribute's value with its character references read.

    A name without a semicolon stays as it is if a letter, a digit or = follows, so queries like a&copy=b keep their text.
    """

    def read(m: re.Match) -> str:
        if m[1] or m[2]:
            digits = (m[1] or m[2]).lstrip("0") or "0"
            return _character(int(digits, 16 if m[1] else 10) if len(digits) < 8 else 0x110000)
        name = m[3]
        if name in html5 and (name.endswith(";") or value[m.end() : m.end() + 1] != "="):
            return html5[name]
        for k in range(min(len(name) - 1, LONGEST_NAME), 1, -1):  # a name known without semicolon that this one begins with
            if name[:k] in html5:
                return m[0] if name[k].isalnum() else html5[name[:k]] + name[k:]
        return m[0]

    return REFERENCE.sub(read, value) if "&" in value else value


def _attributes(html: str, at: int) -> tuple[dict[str, str], int] | None:
    """The attributes of a tag from after its name, the first of each name, and the place behind it; None at the end of the page."""
    out: dict[str, str] = {}
    while True:
        at = BETWEEN.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return out, at + 1
        found = NAME.match(html, at)
        name, at = found[0].lower(), SPACES.match(html, found.end()).end()
        value = ""
        if html[at : at + 1] == "=":
            at = SPACES.match(html, at + 1).end()
            quote = html[at : at + 1]
            if quote and quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                found = BARE_VALUE.match(html, at)
                value, at = found[0], found.end()
        out.setdefault(name, value)


def _after_script(html: str, at: int) -> int:
    """Where a script's end tag begins. In a comment of the script, <script> hides the next </script>."""
    comment = nested = False
    for step in SCRIPT_STEP.finditer(html, at):
        if step[0] == "<!--":
            comment = True
        elif step[0] == "-->":
            comment = nested = False
        elif step[1] and not nested:
            return step.start()
        else:
            nested = comment and not step[1]
    return len(html)


def _after_raw(html: str, at: int, name: str) -> int:
    if name == "script":
        return _after_script(html, at)
    found = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I).search(html, at)
    return found.start() if found else len(html)


NEXT_TAG = re.compile(r"<(?:(!--)|(?=[!?]|/[^A-Za-z])|(/?)([A-Za-z][^\t\n\f\r />]*))")


def tags(html: str, wanted: frozenset[str]) -> Iterator[tuple[str, bool, dict[str, str]]]:
    """(name, whether it is an end tag, attributes as spelt) of the tags of a page that have one of the wanted names, in order.

    What stands in comments, declarations, scripts, styles and other raw text is no tag, nor is a tag that the page ends in.
    """
    at = 0
    while found := NEXT_TAG.search(html, at):
        at = found.end()
        if found[1]:
            if html.startswith(">", at) or html.startswith("->", at):
                at = html.index(">", at) + 1
            else:
                end = COMMENT_END.search(html, at)
                at = end.end() if end else len(html)
            continue
        if found[3] is None:
            at = html.find(">", at) + 1 or len(html)
            continue
        kind, ends, close = found[3].lower(), bool(found[2]), html.find(">", at)
        if close < 0:
            return
        if kind not in wanted and html.find('"', at, close) < 0 and html.find("'", at, close) < 0:
            at = close + 1  # without quotes a tag ends at the next >
        else:
            read = _attributes(html, at)
            if read is None:
                return
            attributes, at = read
            if kind in wanted:
                yield kind, ends, attributes
        if not ends and kind == "plaintext":
            return
        if not ends and kind in RAW_TEXT:
            at = _after_raw(html, at, kind)


def page_anchors(html: str) -> tuple[str | None, list[str]]:
    """The href of a page's first base element that has one, and those of its anchors in order; templates aren't shown."""
    base, out, hidden = None, [], 0
    for name, ends, attributes in tags(html, SHOWN):
        if name == "template":
            hidden = max(0, hidden + (-1 if ends else 1))
        elif not ends and not hidden and "href" in attributes:
            if name == "a":
                out.append(attribute_text(attributes["href"]))
            elif name == "base" and base is None:
                base = attribute_text(attributes["href"])
    return base, out


#: Pages without such a tag have no anchors.
ANCHOR = r"(?i)<a[\t\n\f\r /]"


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, page_url, html) to a row (page_id, page_url, base, place, href) for each anchor."""
    names = ["page_id", "page_url", "base", "place", "href"]
    for batch in batches:
        at, found = [], []

        def rows() -> pa.RecordBatch:
            of = [batch[c].take(pa.array(at, pa.int32())) for c in names[:2]]
            base, place, href = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([*of, pa.array(base, pa.string()), pa.array(place, pa.int32()), pa.array(href, pa.string())], names)

        for k, page in enumerate(batch["html"]):
            base, hrefs = page_anchors(page.as_py())
            at += [k] * len(hrefs)
            found += [(base, place, href) for place, href in enumerate(hrefs)]
            if len(found) > 50_000:
                yield rows()
                at, found = [], []
        yield rows()

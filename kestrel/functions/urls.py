"""URLs as browsers parse them. Plain ones are read by Spark expressions; only odd ones reach Python."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions import punycode

# Fixed values of the URL standard: ports that schemes have by default, and characters that are escaped or forbidden.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
FORBIDDEN_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | frozenset("%\x7f") | frozenset(map(chr, range(32)))
FRAGMENT_ESCAPES = ' "<>`'
QUERY_ESCAPES = " \"#<>'"
PATH_ESCAPES = ' "#<>?^`{}'
USER_ESCAPES = PATH_ESCAPES + "/:;=@[\\]|"
#: Characters that the mapping of domains leaves out, and those that stand for a dot.
IGNORED = re.compile("[­͏᠋-᠍᠏​⁠⁤︀-️﻿\U0001bca0-\U0001bca3\U000e0100-\U000e01ef]")
DOTS = re.compile("[。．｡]")
#: Joiners that need a letter before them, and small letters that folding would change.
JOINERS, KEPT = "‌‍", {"ß": "ß", "ẞ": "ß", "ς": "ς"}
#: Bidirectional classes that labels from right to left, and from left to right, may hold.
RIGHT = frozenset("R AL AN EN ES CS ET ON BN NSM".split())
LEFT = frozenset("L EN ES CS ET ON BN NSM".split())

SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")


class Url(NamedTuple):
    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    def text(self) -> str:
        at = f"{self.user}@" if self.user else ""
        port = "" if self.port is None else f":{self.port}"
        query = "" if self.query is None else f"?{self.query}"
        return f"{self.scheme}://{at}{self.host}{port}{self.path}{query}" + ("" if self.fragment is None else f"#{self.fragment}")


def escaped(text: str, marks: str) -> str:
    """Bytes that a part of a URL can't show as they are, in percent form."""
    if text.isascii() and text.isprintable() and not any(c in marks for c in text):
        return text
    raw = text.encode("utf-8", "replace")
    return "".join(chr(b) if 32 <= b < 127 and chr(b) not in marks else f"%{b:02X}" for b in raw)


def unescaped(text: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))


# ---- hosts -----------------------------------------------------------------------------------------------------------


def ipv4_number(part: str) -> int | None:
    """A part of an IPv4 address: hexadecimal after 0x, octal after 0, else decimal; None if it isn't one."""
    digits, base = part, 10
    if part[:2] in ("0x", "0X"):
        digits, base = part[2:], 16
    elif len(part) > 1 and part[0] == "0":
        digits, base = part[1:], 8
    if not digits:
        return 0 if part else None
    allowed = "0123456789abcdef"[:base]
    return int(digits, base) if all(c in allowed for c in digits.lower()) else None


def ends_in_number(host: str) -> bool:
    parts = host.split(".")
    if parts[-1] == "":
        parts.pop()
    last = parts[-1] if parts else ""
    return last != "" and ((last.isascii() and last.isdigit()) or (last[:2] in ("0x", "0X") and ipv4_number(last) is not None))


def ipv4(host: str) -> str | None:
    """Dotted decimals of an address of up to four numbers, the last of which fills what the others leave."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    numbers = [ipv4_number(p) for p in parts]
    if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def ipv6(text: str) -> str | None:
    """The shortest spelling of an address: no leading zeros, and the first longest run of zero groups left out."""
    if "%" in text:
        return None
    try:
        packed = ipaddress.IPv6Address(text).packed
    except ValueError:
        return None
    groups = [f"{packed[k] << 8 | packed[k + 1]:x}" for k in range(0, 16, 2)]
    runs = [(sum(1 for _ in iter_zeros(groups[k:])), -k) for k in range(8)]
    size, start = max(runs)
    if size < 2:
        return ":".join(groups)
    return ":".join(groups[:-start]) + "::" + ":".join(groups[-start + size :])


def iter_zeros(groups: list[str]):
    for g in groups:
        if g != "0":
            return
        yield g


def mapped(domain: str) -> str:
    """A domain with characters folded as in international domain names: case, width and compatibility forms, dots."""
    spread = IGNORED.sub("", DOTS.sub(".", domain))
    folded = (KEPT.get(c) or unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in spread)
    return unicodedata.normalize("NFC", "".join(folded))


def _bidi_ok(label: str) -> bool:
    kinds = [unicodedata.bidirectional(c) for c in label]
    end = next((k for k in reversed(kinds) if k != "NSM"), "")
    if kinds[0] in ("R", "AL"):
        return set(kinds) <= RIGHT and end in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    return kinds[0] == "L" and set(kinds) <= LEFT and end in ("L", "EN")


def _label_ok(label: str) -> bool:
    """Whether a Unicode label may stand in a domain: composed, no mark first, no controls, spaces or unassigned characters."""
    if unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0]).startswith("M"):
        return False
    for k, c in enumerate(label):
        if c in JOINERS:
            if not k or unicodedata.combining(label[k - 1]) != 9:  # only after a virama
                return False
        elif c == "\ufffd" or (not c.isascii() and unicodedata.category(c) in ("Cc", "Cf", "Cn", "Co", "Cs", "Zs", "Zl", "Zp")):
            return False
    return True


def domain_to_ascii(domain: str) -> str | None:
    """The ASCII form of a domain, labels beyond ASCII in Punycode; None where a label may not stand in a domain."""
    if domain.isascii():
        domain = domain.lower()
        if "xn--" not in domain:
            return domain or None
    labels, shown = mapped(domain).split("."), []
    for k, label in enumerate(labels):
        if label.startswith("xn--"):
            back = punycode.decode(label[4:])
            if not back or back.isascii() or mapped(back) != back or not _label_ok(back):
                return None
            shown.append(back)
        elif label and not label.isascii():
            if not _label_ok(label):
                return None
            shown.append(label)
            labels[k] = "xn--" + punycode.encode(label)
        elif label:
            shown.append(label)
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for label in shown for c in label) and not all(map(_bidi_ok, shown)):
        return None
    return ".".join(labels) if any(labels) else None


def host_of(text: str) -> str | None:
    """The host of an http or https URL as it is compared: a domain in ASCII, or an address; None if it isn't one."""
    if text.startswith("["):
        found = ipv6(text[1:-1]) if text.endswith("]") else None
        return None if found is None else f"[{found}]"
    ascii_ = domain_to_ascii(unescaped(text).decode("utf-8", "replace"))
    if ascii_ is None or any(c in FORBIDDEN_DOMAIN for c in ascii_):
        return None
    return ipv4(ascii_) if ends_in_number(ascii_) else ascii_


def opaque_host(text: str) -> str | None:
    """The host of a URL of a scheme that browsers give no meaning to."""
    if text.startswith("["):
        return host_of(text)
    return None if any(c in FORBIDDEN_HOST for c in text) else escaped(text, "")


# ---- URLs ------------------------------------------------------------------------------------------------------------


def _tail(text: str, folders: list[str]) -> tuple[str, str | None, str | None]:
    """path, query, fragment of what follows a host, the path below some folders, without dot segments."""
    text, mark, fragment = text.partition("#")
    fragment = escaped(fragment, FRAGMENT_ESCAPES) if mark else None
    text, mark, query = text.partition("?")
    query = escaped(query, QUERY_ESCAPES) if mark else None
    stack, steps = list(folders), text.replace("\\", "/").split("/")
    for k, step in enumerate(steps):
        bare = step.lower().replace("%2e", ".")
        if bare == "..":
            del stack[-1:]
        elif bare != ".":
            stack.append(escaped(step, PATH_ESCAPES))
        if bare in (".", "..") and k == len(steps) - 1:
            stack.append("")
    return "/" + "/".join(stack), query, fragment


def _authority(scheme: str, rest: str) -> Url | None:
    end = re.search(r"[/\\?#]", rest)
    authority, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    user, at, place = authority.rpartition("@")
    name, _, word = user.partition(":")
    user = escaped(name, USER_ESCAPES) + (":" + escaped(word, USER_ESCAPES) if word else "")
    cut = re.fullmatch(r"(\[[^\]]*\]|[^:\[]*)(?::([0-9]*))?", place, re.S)
    if not cut or not cut[1]:
        return None
    port = int(cut[2]) if cut[2] else None
    host = host_of(cut[1])
    if host is None or (port or 0) > 65535:
        return None
    return Url(scheme, user, host, None if port == PORTS[scheme] else port, *_tail(rest[1:] if rest[:1] in ("/", "\\") else rest, []))


def _relative(rest: str, base: Url) -> Url | None:
    if rest[:1] in ("/", "\\"):
        if rest[1:2] in ("/", "\\"):
            return _authority(base.scheme, rest.lstrip("/\\"))
        return base._replace(**dict(zip(("path", "query", "fragment"), _tail(rest[1:], []), strict=True)))
    folders = base.path[1:].split("/")
    if not rest or rest[0] in "?#":
        _, query, fragment = _tail(rest, [])
        return base._replace(query=query if rest[:1] == "?" else base.query, fragment=fragment)
    return base._replace(**dict(zip(("path", "query", "fragment"), _tail(rest, folders[:-1]), strict=True)))


def _trimmed(text: str) -> str:
    return re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))


@lru_cache(10_000)
def parse(text: str, base: Url | None = None) -> Url | None:
    """An http, https, ws, wss or ftp URL, against an http(s) base if there is one; None for other schemes and failures."""
    text = _trimmed(text)
    found = SCHEME.match(text)
    if not found:
        return None if base is None else _relative(text, base)
    scheme, rest = found[1].lower(), text[found.end() :]
    if scheme not in PORTS:
        return None
    if base is not None and scheme == base.scheme and not rest.startswith("//"):
        return _relative(rest, base)
    return _authority(scheme, rest.lstrip("/\\"))


def hostname(text: str) -> str | None:
    """The host of a URL of any scheme, empty if it has none; None for what isn't a URL by itself."""
    found = SCHEME.match(bare := _trimmed(text))
    if not found:
        return None
    scheme = found[1].lower()
    if scheme in PORTS:
        url = parse(text)
        return url and url.host
    rest = bare[found.end() :].replace("\\", "/") if scheme == "file" else bare[found.end() :]
    if not rest.startswith("//"):
        return ""
    authority = re.match(r"//([^/?#]*)", rest)[1]
    if scheme == "file":
        host = host_of(authority) if authority else ""
        return "" if host == "localhost" else host
    user, at, place = authority.rpartition("@")
    cut = re.fullmatch(r"(\[[^\]]*\]|[^:\[]*)(?::([0-9]*))?", place, re.S)
    if not cut or (not cut[1] and (at or cut[2] is not None)) or int(cut[2] or 0) > 65535:
        return None
    return opaque_host(cut[1]) if cut[1] else ""


def resolved(href: str, base: str | None) -> str | None:
    """A link as an http or https URL against a page's; None if it isn't one."""
    against = parse(base) if base is not None else None
    url = parse(href, against if against and against.scheme in ("http", "https") else None)
    return url.text() if url and url.scheme in ("http", "https") else None


# ---- columns ---------------------------------------------------------------------------------------------------------

#: Hosts that mean themselves, whatever their case: labels of letters, digits, - and _, the last beginning with a letter.
_HOST = r"(?:[A-Za-z0-9_](?:[A-Za-z0-9_\-]{0,61}[A-Za-z0-9_])?\.){0,20}[A-Za-z](?:[A-Za-z0-9_\-]{0,61}[A-Za-z0-9_])?"
PLAIN = rf"^(?i:https?)://({_HOST})(?::[0-9]{{1,4}})?(?:[/?#]|$)"
#: A path, query and fragment without anything that resolving changes.
_STEP = r"(?:/(?!\.|%2[eE])[A-Za-z0-9_~,;=@$*()!+.:%&\-]{0,2000}+){0,40}+"
_AFTER = r"(?:\?[A-Za-z0-9_~,;=@$*()!+./:%&\-]{0,4000}+)?+(?:#[A-Za-z0-9_~,;=@$*()!+./:%&\-]{0,4000}+)?+"
_LOW_HOST = _HOST.replace("A-Za-z", "a-z")
ABSOLUTE = rf"^https?://{_LOW_HOST}/(?!\.|%2[eE])[A-Za-z0-9_~,;=@$*()!+.:%&\-]{{0,2000}}+{_STEP}{_AFTER}$"
ROOTED = rf"^/(?![/\\]|\.|%2[eE])[A-Za-z0-9_~,;=@$*()!+.:%&\-]{{0,2000}}+{_STEP}{_AFTER}$"
ORIGIN = rf"^(https?://{_LOW_HOST})(?:[/?#]|$)"


def _by_python(function, *columns: Column) -> Column:
    """function over rows whose first column isn't null; equal rows of a batch are worked out once."""

    @F.pandas_udf("string")
    def of_one(first: pd.Series) -> pd.Series:
        known = {x: function(x) for x in first.dropna().unique()}
        return first.map(known.get, na_action="ignore")

    @F.pandas_udf("string")
    def of_two(first: pd.Series, second: pd.Series) -> pd.Series:
        keys = [(a, b if isinstance(b, str) else None) for a, b in zip(first, second, strict=True)]
        known = {k: function(*k) for k in set(keys) if isinstance(k[0], str)}
        return pd.Series([known.get(k) for k in keys], dtype=object)

    return of_one(*columns) if len(columns) == 1 else of_two(*columns)


def _plain(url: Column) -> Column:
    return url.rlike(PLAIN) & ~F.lower(url).contains("xn--")


def _web_host(text: str) -> str | None:
    url = parse(text)
    return url.host if url and url.scheme in ("http", "https") else None


def url_host(url: Column) -> Column:
    """The host of an http or https URL as a browser has it; null for other schemes and for what it rejects.

    Case, userinfo, ports, escapes, backslashes, missing slashes, number forms of addresses and international names are taken
    as the URL standard says. A null URL has no host.
    """
    plain = F.lower(F.regexp_extract(url, PLAIN, 1))
    return F.when(_plain(url), plain).otherwise(_by_python(_web_host, F.when(~_plain(url), url)))


def url_hostname(url: Column) -> Column:
    """The host of a URL of any scheme, empty where it has none, null where it isn't a URL."""
    plain = F.lower(F.regexp_extract(url, PLAIN, 1))
    return F.when(_plain(url), plain).otherwise(_by_python(hostname, F.when(~_plain(url), url)))


def resolve(href: Column, base: Column) -> Column:
    """A link as an absolute http or https URL against the URL of its page; null for other schemes and failures.

    Plain absolute links stay as they are and plain paths follow the origin of a plain page; all else, such as dot segments,
    queries alone, fragments, escapes and international names, is resolved as browsers do.
    """
    whole = href.rlike(ABSOLUTE) & ~href.contains("xn--")
    rooted = href.rlike(ROOTED) & base.rlike(ORIGIN) & ~base.contains("xn--")
    odd = F.when(~F.coalesce(whole | rooted, F.lit(False)), href)
    return F.when(whole, href).when(rooted, F.concat(F.regexp_extract(base, ORIGIN, 1), href)).otherwise(_by_python(resolved, odd, base))


def link(href: Column, base: Column, page: Column) -> Column:
    """struct(url, host, page_host): a link resolved against a page's <base>, which may be null, or its URL, and the hosts of both.

    The same as resolve and url_host, in one Python pass for links that aren't plain and none for the others.
    """
    whole = href.rlike(ABSOLUTE) & ~href.contains("xn--")
    rooted = href.rlike(ROOTED) & page.rlike(ORIGIN) & ~page.contains("xn--")
    url = F.when(whole, href).when(rooted, F.concat(F.regexp_extract(page, ORIGIN, 1), href))
    plain = F.coalesce(base.isNull() & _plain(url) & _plain(page), F.lit(False))
    host = lambda u: F.lower(F.regexp_extract(u, PLAIN, 1))
    known = F.struct(url.alias("url"), host(url).alias("host"), host(page).alias("page_host"))

    @F.pandas_udf("url string, host string, page_host string")
    def read(odd: pd.Series, hrefs: pd.Series, bases: pd.Series, pages: pd.Series) -> pd.DataFrame:
        out = []
        for x, h, b, p in zip(odd, *(s.astype(object).where(s.notna(), None) for s in (hrefs, bases, pages)), strict=True):
            against = (resolved(b, p) if x and b is not None else None) or p
            u = resolved(h, against) if x and h is not None else None
            out.append((u, _web_host(u) if u is not None else None, _web_host(p) if x and p is not None else None))
        return pd.DataFrame(out, columns=["url", "host", "page_host"], dtype=object)

    none = lambda c: F.when(~plain, c)
    return F.when(plain, known).otherwise(read(~plain, none(href), none(base), none(page)))


def to_ascii(domain: Column) -> Column:
    """Domains in ASCII, null for those that can't be; plain ones don't reach Python."""
    plain = domain.rlike(r"^[\x00-\x7F]+$") & ~F.lower(domain).contains("xn--")
    return F.when(plain, F.lower(domain)).otherwise(_by_python(domain_to_ascii, F.when(~plain, domain)))

"""Column functions over host strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_host(text: Column) -> Column:
    """The host of a URL or host string: trimmed, lower case, without scheme, path, query, fragment and port."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*", 0), r":[0-9]+$", "")


def labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def naive_parts(host: Column) -> Column:
    """The split without a suffix list: struct(sld, registrable) of the last two labels."""
    parts = labels(host)
    sld = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    joined = F.when(F.size(parts) >= 2, F.concat_ws(".", sld, last)).otherwise(last)
    return F.struct(sld.alias("sld"), joined.alias("registrable"))


def trainer_label(host: Column) -> Column:
    """The label that bigrams are learned from: second to last, without other characters than a-z, 0-9 and -."""
    return F.regexp_replace(naive_parts(host)["sld"], "[^a-z0-9-]", "")


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def glyphs(text: Column) -> Column:
    """Every character with whether it is non-ASCII and its code, for marking up a host."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(
        chars,
        lambda c: F.struct(
            c.alias("glyph"),
            has_non_ascii(c).alias("bad"),
            F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")).alias("code"),
        ),
    )


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def valid_candidate(host: Column) -> Column:
    """Whether an override host is 1 to 253 characters without spaces, quotes, brackets, & or slashes."""
    return F.coalesce(host.rlike(r"""^[^\s<>"'&/\\]{1,253}$"""), F.lit(False))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def script_of(ch: Column) -> Column:
    """Cyrillic, Greek, Full-width, other non-ASCII ('Unicode') or Latin, by code point."""
    code = F.ascii(ch)
    return (
        F.when(code.between(0x0400, 0x04FF), "Cyrillic")
        .when(code.between(0x0370, 0x03FF), "Greek")
        .when(code.between(0xFF00, 0xFFEF), "Full-width")
        .when(code > 127, "Unicode")
        .otherwise("Latin")
    )


def level_of(score: Column) -> Column:
    return F.when(score >= 65, "dangerous").when(score >= 30, "suspicious").otherwise("safe")


def action_of(level: Column) -> Column:
    """What a page gets: none, a bar or a block screen."""
    return F.when(level == "dangerous", "block").when(level == "suspicious", "warn_bar").otherwise("none")


def flag_of(level: Column) -> Column:
    """What a link gets; null for none."""
    return F.when(level == "dangerous", "danger").when(level == "suspicious", "warn")


def positions(text: Column, pattern: Column) -> Column:
    """All start places, from 0, of a pattern in a text, overlapping ones too; none of an empty pattern."""
    last = F.length(text) - F.length(pattern)
    places = F.when((F.length(pattern) > 0) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda k: F.substring(text, k + 1, F.length(pattern)) == pattern)


def similarity(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / longest))

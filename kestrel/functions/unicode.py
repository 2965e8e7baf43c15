"""Unicode folding as Arrow UDFs: skeletons, scripts and Punycode, over distinct labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.dims import confusables
from kestrel.functions import punycode

GLYPHS = "struct<skeleton:string,mixed:boolean,scripts:array<string>,folds:array<struct<orig:string,canon:string,script:string>>>"


def fold(text: str, table: dict[str, str]) -> str:
    """Decompose (NFKD), lower, drop marks, and put what a character looks like in its place."""
    spread = unicodedata.normalize("NFKD", text).lower()
    return "".join(table.get(c, c) for c in spread if not unicodedata.category(c).startswith("M"))


def script_name(ch: str) -> str:
    code = ord(ch)
    for name, low, high in (("Cyrillic", 0x400, 0x4FF), ("Greek", 0x370, 0x3FF), ("Full-width", 0xFF00, 0xFFEF)):
        if low <= code <= high:
            return name
    return "Unicode" if code > 127 else "Latin"


def describe(label: str, table: dict[str, str]) -> dict:
    letters = (c for c in unicodedata.normalize("NFD", label) if unicodedata.category(c).startswith("L"))
    scripts = list(dict.fromkeys(map(script_name, letters)))
    folds = [
        {"orig": c, "canon": canon, "script": script_name(c)}
        for c in label
        if ord(c) > 127 and (canon := fold(c, table)) != c and canon.isascii()
    ]
    return {"skeleton": fold(label, table), "mixed": len(scripts) > 1, "scripts": scripts, "folds": folds}


def each_once(texts: pd.Series, function) -> pd.Series:
    """function over the different texts of a batch, each worked out once; null stays null."""
    known = {x: function(x) for x in texts.dropna().unique()}
    return pd.Series([known.get(x) for x in texts], texts.index, dtype=object)


def _only_non_ascii(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def skeleton(text: Column, table: dict[str, str] | None = None) -> Column:
    """What a string looks like. ASCII rows are lower-cased by Spark; only others reach Python."""
    folds = table or confusables()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return each_once(s, lambda x: fold(x, folds))

    return F.coalesce(run(_only_non_ascii(text)), F.lower(text))


def label_glyphs(label: Column, table: dict[str, str] | None = None) -> Column:
    """struct(skeleton, mixed, scripts, folds) of non-ASCII labels, null for ASCII ones."""
    folds = table or confusables()

    @F.pandas_udf(GLYPHS)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = each_once(s, lambda x: describe(x, folds))
        empty = dict.fromkeys(("skeleton", "mixed", "scripts", "folds"))
        return pd.DataFrame([r if isinstance(r, dict) else empty for r in rows], columns=list(empty))

    return run(_only_non_ascii(label))


def letter_scripts(label: Column, table: dict[str, str] | None = None) -> Column:
    """The different scripts of a label's letters, in the order in which they come; ASCII labels don't reach Python."""
    plain = F.when(label.rlike("[A-Za-z]"), F.array(F.lit("Latin"))).otherwise(F.array().cast("array<string>"))
    return F.when(label.isNotNull(), F.coalesce(label_glyphs(label, table)["scripts"], plain))


def decode_label(label: str) -> str:
    """A Punycode label as Unicode; the label itself if it isn't valid."""
    return label if label[:4].lower() != "xn--" else punycode.decode(label[4:]) or label


def decode_host(host: Column) -> Column:
    """Each xn-- label decoded. Hosts without one don't reach Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return each_once(s, lambda h: ".".join(map(decode_label, h.split("."))))

    return F.coalesce(run(F.when(host.rlike(r"(?i)xn--"), host)), host)

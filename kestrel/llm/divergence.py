"""Source divergence audit: how far the word use of sources lies apart, over distinct count vectors."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.shared import hand_back, keep, parts, text_or_empty
from kestrel.llm.words import rows_of

#: Bytes of terms, A-Z as a-z, and a space for all others: letters and whatever isn't ASCII make up terms.
SPELT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text whose terms are listed at once, and entries that a task counts before it passes them on.
SLICE, HELD = 1 << 20, 300_000
#: Sources whose divergences a task works out against all others of their language.
BLOCK = 256
SCALE, SMOOTH = 1_000_000_000, 2


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time, in order."""
    spelt, at = text.translate(SPELT), 0
    while at < len(spelt):
        end = spelt.find(b" ", at + SLICE)
        end = len(spelt) if end < 0 else end
        yield spelt[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a task passes on HELD entries at most at a time."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0
    for lang, source, text in rows_of(batches):
        n, docs = held[lang, source]
        before, seen = len(n), set()
        for some in terms_of(text):
            n.update(some)
            seen.update(some)
        docs.update(seen)
        size += len(n) - before + 1
        if size > HELD:
            yield from _counted(held)
            held.clear()
            size = 0
    yield from _counted(held)


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        arrays = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                  pa.array(list(map(n.__getitem__, terms)), pa.int64()), pa.array(list(map(docs.__getitem__, terms)), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])


def count_vectors(docs: DataFrame, least_docs: int, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, n, vector) of the terms in at least least_docs documents of a language, written once.

    vector has (source, n) of the sources that use the term, by source; n is their sum.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # tasks have counted already, so a term comes once from each at most: one shuffle serves both sums
    each = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    )
    return keep(terms.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")


def source_groups(docs: DataFrame, terms: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, place, total, lang_total, v) for every language and source of docs, written once.

    place counts a language's sources from 0, total sums the kept terms' occurrences in the source, lang_total those in the
    language, and v is the number of its kept terms.
    """
    groups = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    totals = terms.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    out = placed.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    return keep(out.na.fill(0, ["total", "lang_total", "v"]), "divergence-groups")


def shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), exact: three digits of the quotient at a time."""
    left, by, out = n + SMOOTH, total + SMOOTH * v, 0
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // by
        left = left % by
    return 1 + out


def _share(n: str, total: str) -> Column:
    # the least decimal that holds the product, as counts of a large corpus times SCALE pass 64 bits
    return F.expr(f"1 + (cast({n} + {SMOOTH} as decimal(27, 0)) * {SCALE}) div cast({total} + {SMOOTH} * v as decimal(27, 0))")


def _divergences(vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over some distinct vectors of a language, for the sources of one block against all sources."""
    sources, place = groups["source"].combine_chunks(), groups["place"].to_numpy()
    total, v = groups["total"].to_numpy(), groups["v"][0].as_py()
    salt, block = groups["salt"][0].as_py(), groups["block"][0].as_py()
    mine = np.flatnonzero(place // BLOCK == block)
    sums = np.zeros((len(mine), len(place)), np.int64)
    if v:
        flat = vectors["vector"].combine_chunks()
        lens = flat.value_lengths().to_numpy(zero_copy_only=False)
        flat = flat.flatten()
        where, n = pc.index_in(flat.field("source"), sources).to_numpy(), flat.field("n").to_numpy()
        times, zero = vectors["times"].to_numpy(), shares(np.zeros(len(place), np.int64), total, v)
        row, each = np.repeat(np.arange(len(lens)), lens), max(1, (1 << 20) // len(place))
        for k in range(0, len(lens), each):
            some = slice(*np.searchsorted(row, [k, k + each]))
            p = np.tile(zero, (len(lens[k : k + each]), 1))
            p[row[some] - k, where[some]] = shares(n[some], total[where[some]], v)
            for i, a in enumerate(mine):
                apart, both = p - p[:, a : a + 1], p + p[:, a : a + 1]
                sums[i] += times[k : k + each] @ (apart * apart // both)
    a, b = np.nonzero((mine[:, None] != np.arange(len(place))) & (bool(len(vectors)) | (salt == 0)))
    lang = pa.array([groups["lang"][0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "source": sources.take(pa.array(mine[a])), "item": sources.take(pa.array(b)), "value": sums[a, b]})


def pair_divergences(terms: DataFrame, groups: DataFrame, *, entries: int = 20_000) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: the sum of their divergences over all its kept terms.

    Terms of one language with the same vector diverge alike, so each different vector is worked out once for every pair
    and counts as often as it has terms. Vectors are dealt by language and salts of about `entries` entries, and
    by blocks of BLOCK sources that a task sets against all others.
    """
    distinct = keep(terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")), "divergence-vectors")
    salts = parts(distinct.agg(F.sum(F.size("vector"))).first()[0] or 0, entries)
    blocks = (groups.agg(F.max("place")).first()[0] or 0) // BLOCK + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.withColumn("salt", F.pmod(F.xxhash64("vector"), F.lit(salts)).cast("int")).withColumn("block", each(blocks))
    right = groups.drop("lang_total").withColumn("salt", each(salts)).withColumn("block", each(blocks))
    keys = ["lang", "salt", "block"]
    some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_divergences, "lang string, source string, item string, value long")
    return some.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergences(terms: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the `top` terms that a source uses most over its language."""
    entries = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.inline("vector"))
    known = hand_back(entries, groups.drop("place"), ["lang", "source"], "item")
    valued = known.withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")}).where("p > q")
    return _ranked(valued.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "item", "value", F.row_number().over(by).alias("rank"))


def audit(
    docs: DataFrame,
    *,
    least_docs: int = 10,
    top: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """How each source's use of terms diverges from other sources of its language, and by which terms from the language.

    Terms are runs of letters a-z and of characters beyond ASCII, with A-Z in lower case. Those in at least least_docs documents of a
    language are kept there. A source gives each kept term the share p = 1 + floor(10**9 (n + 2) / (N + 2V)), n its
    occurrences, N their sum, V the number of kept terms, and so does the language. Two shares diverge by
    floor((p - q)**2 / (p + q)). Returns lang, source, part, item, value, rank: part `pair` has every other source of the
    language as item and the sum over all kept terms as value; part `term` the `top` terms with p over the language's share.
    Ranks are by value, then item.

    Null texts, languages and sources count as empty ones, a source without kept terms has its row, a language without
    them gives values of 0, and one with a single source no pair. A row is a document: rows that repeat count again. An empty table gives no
    rows. Texts of any length are counted slice by slice. Other columns are not read. What a task holds is bounded, but for the
    sources of a language, whose pairs are the result.
    """
    names = {"lang_col": lang_col, "source_col": source_col}
    terms = count_vectors(docs, least_docs, text_col=text_col, **names)
    groups = source_groups(docs, terms, **names)
    pairs = _ranked(pair_divergences(terms, groups)).withColumn("part", F.lit("pair"))
    best = term_divergences(terms, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")

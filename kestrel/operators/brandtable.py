"""Brands as a table of any size: what a host touches is found by joins, not by conditions in the plan."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.dims import KEYBOARD_COST, Brand, substitution_kinds
from kestrel.functions import distance
from kestrel.operators.match import NEAR, lures, settle, suspicious_tld, with_glyphs
from kestrel.operators.parse import parse_hosts
from kestrel.operators.rules import judge, verdicts
from kestrel.sources.readers import stored

SCHEMA = "ord int, name string, core string, domain string, category string, owns_name boolean, official array<string>"
#: Similarities from which a label is near a core, and near one where the label holds look-alike characters.
NEAR_FROM, NEAR_FROM_HIDDEN = 0.8, 0.7
#: Characters at the front that deletions are made in.
FRONT = 10
#: Characters of cores that are sent to every task for labels of look-alike characters; longer tables are refused.
MOST_CHARACTERS = 64 << 20
ATTRIBUTES = ("core", "name", "domain", "category")
KINDS = ("official", "exact_core", "skeleton_core", "embedded", "token", "in_subdomain")


def brand_table(spark: SparkSession, brands: list[Brand]) -> DataFrame:
    rows = [(k, b.name, b.core, b.domain, b.category, b.owns_name, list(b.official)) for k, b in enumerate(brands)]
    return spark.createDataFrame(rows, SCHEMA)


# ---- exact touches ---------------------------------------------------------------------------------------------------

#: Bits of the filter of cores: 64 for each core, but 32 MB at most; with more cores more pieces pass it for nothing.
MOST_BITS = 28
#: An odd number whose powers give the characters of a piece their places, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: sums of characters by place before each character, what moves a piece to the front, and where texts begin and end."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(BASE, len(code))[:-1])])
    return sums, _powers(INVERSE, len(code)), np.concatenate([[0], np.cumsum(list(map(len, texts)))])


def _slots(sums: np.ndarray, back: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    """The bit of the filter that each piece, from start to stop, has: equal pieces have the same."""
    h = (sums[stop] - sums[start]) * back[start]
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _core_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, back, ends = _laid(batch["core"].to_pylist())
        slot = _slots(sums, back, ends[:-1], ends[1:], bits)
        mask = np.uint64(1) << (slot & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])


def _core_filter(cores: DataFrame) -> tuple[np.ndarray, list[int], int]:
    """The filter as 64-bit words, the lengths that cores have, and its bits as a power of two."""
    sizes = cores.groupBy(F.length("core").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length
    bits = min(MOST_BITS, max(12, (64 * sum(r["n"] for r in sizes)).bit_length()))
    words = cores.select("core").mapInArrow(partial(_core_bits, bits=bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    got = words.toArrow()  # 64 MB at most
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return held, sorted(r["size"] for r in sizes), bits


def _pieces(batches: Iterator[pa.RecordBatch], held: np.ndarray, lengths: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """Of rows (host, kind, text): host, kind and the pieces of the text that have a core's length and pass the filter."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            texts = part["text"].to_pylist()
            sums, back, ends = _laid(texts)
            row = np.repeat(np.arange(len(texts)), np.diff(ends))
            rows, pieces = [np.zeros(0, np.int64)], []
            for size in lengths:
                start = np.flatnonzero(np.arange(len(row)) + size <= ends[row + 1])
                slot = _slots(sums, back, start, start + size, bits)
                start = start[(held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                of = row[start]
                rows.append(of)
                pieces += [texts[r][a : a + size] for r, a in zip(of.tolist(), (start - ends[of]).tolist(), strict=True)]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([part["host"].take(at), part["kind"].take(at), pa.array(pieces, pa.string())], ["host", "kind", "piece"])


def held_cores(texts: DataFrame, cores: DataFrame) -> DataFrame:
    """(host, kind, core, ord): the cores (core, ord, a row each) that stand anywhere in texts (host, kind, text), each place once.

    Pieces of the lengths that cores have are joined with them; a filter of bounded size, made by an aggregate, keeps back most pieces that
    are no core before they are shuffled. So work grows with texts and cores, not with their product, and no list of cores goes through the driver.
    A text has a piece for each of its places and lengths: this is for labels and hosts; of long texts, find_patterns takes the places.
    """
    held, lengths, bits = _core_filter(cores)
    shared = texts.sparkSession.sparkContext.broadcast(held)
    kind = dict(texts.dtypes)["host"]
    rows = texts.select("host", "kind", "text").where("text <> ''")
    found = rows.mapInArrow(lambda batches: _pieces(batches, shared.value, lengths, bits), f"host {kind}, kind string, piece string")
    return found.join(cores, F.col("piece") == F.col("core")).select("host", "kind", "core", "ord")


def touches(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """(host, kind, ord): the first brand that each host of labels touches by each kind of test.

    labels: (host, sld, registrable, last_label, skeleton, sub_skeletons), a row per host. Equal labels, tokens and domains are one
    join on what must be equal; cores inside labels are found by joins on pieces of the labels, the longest first.
    """
    key = lambda space, column, rows: rows.select(F.lit(space).alias("space"), F.col(column).alias("key"), "ord")
    domains = brands.select("ord", F.explode("official").alias("d"))
    keys = key("core", "core", brands).unionByName(key("domain", "d", domains)).unionByName(key("owned", "core", brands.where("owns_name")))
    keys = keys.groupBy("space", "key").agg(F.min("ord").alias("ord"))

    probe = lambda space, value, kind: F.struct(F.lit(space).alias("space"), value.alias("key"), F.lit(kind).alias("kind"))
    tokens = F.filter(F.array_distinct(F.split("skeleton", "[-_]+")), lambda t: (F.length(t) >= 3) & (t != F.col("sld")))
    probes = F.concat(
        F.array(
            probe("core", F.col("sld"), "exact_core"),
            probe("core", F.col("skeleton"), "skeleton_core"),
            probe("domain", F.col("registrable"), "official"),
            probe("owned", F.when(~suspicious_tld(F.col("last_label")), F.col("sld")), "official"),
        ),
        F.transform(tokens, lambda t: probe("core", t, "token")),
    )
    equal = labels.select("host", F.inline(probes)).where("key is not null").join(keys, ["space", "key"]).select("host", "kind", "ord", F.lit(0).alias("size"))
    cores = brands.where(F.length("core") >= 4).groupBy("core").agg(F.min("ord").alias("ord"))
    text = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    texts = labels.select("host", F.inline(F.array(text("embedded", F.col("skeleton")), text("in_subdomain", F.concat_ws("\n", "sub_skeletons")))))
    size = F.when(F.col("kind") == "embedded", -F.length("core")).otherwise(0)
    every = equal.unionByName(held_cores(texts, cores).select("host", "kind", "ord", size.alias("size")))
    first = every.groupBy("host", "kind").agg(F.min(F.struct("size", "ord")).alias("first"))
    return first.select("host", "kind", F.col("first.ord").alias("ord"))


# ---- near touches ----------------------------------------------------------------------------------------------------


@cache
def _alike() -> dict[str, str]:
    """Each character of a pair that looks alike, to the first of all that it is linked with."""
    root: dict[str, str] = {}
    for pair, kind in substitution_kinds().items():
        if kind == "visual":
            a, b = (root.get(c, c) for c in pair)
            low = min(a, b)
            root = {c: low if r in (a, b) else r for c, r in (root | {pair[0]: a, pair[1]: b}).items()}
    return root


def unfolded(text: Column) -> Column:
    """Text with characters that look alike made one, so that putting one for another is no edit."""
    alike = sorted(_alike().items())
    return F.translate(text, "".join(c for c, _ in alike), "".join(r for _, r in alike))


def budget(size: int, least: float) -> float:
    """The largest distance of a pair whose longer text has `size` characters: that of `least`, or a swap in short ones."""
    return max((1 - least) * size, 1.0 if size <= 5 else 0.0) + 1e-9


def most_edits(size: int, least: float) -> int:
    """The most edits, look-alikes aside, that a text of this size can have from any text within its budget."""
    longest = size
    while longest + 1 - size <= budget(longest + 1, least):
        longest += 1
    return int(budget(longest, least) / KEYBOARD_COST)


def deletions(text: str, edits: int) -> set[str]:
    """The front of a text with up to `edits` of its characters left out.

    Of two texts within so many edits, a swap being one, some deletions agree.
    """
    front = text[:FRONT]
    least = max(0, len(front) - edits)
    return {"".join(c) for n in range(least, len(front) + 1) for c in itertools.combinations(front, n)}


def _spread(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (text, bare): text, size and all deletions of bare."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            rows = [(t, b, v) for t, b in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True) for v in deletions(b, most_edits(len(b), least))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["text", "variant"])


def deletion_index(texts: DataFrame, least: float) -> DataFrame:
    """(text, variant): different texts (column text) under the hashes of their deletions."""
    rows = texts.select("text", unfolded(F.col("text")).alias("bare")).distinct()
    return rows.mapInArrow(partial(_spread, least=least), "text string, variant string").select("text", F.xxhash64("variant").alias("variant"))


def near_pairs(labels: DataFrame, cores: DataFrame, least: float) -> DataFrame:
    """(text, core) of labels and cores that deletions bring together and that a plain distance doesn't rule out.

    Every pair within the budget is among them: an edit that isn't a look-alike costs at least that of neighbouring keys.
    """
    left = deletion_index(labels, least)
    right = deletion_index(cores, least).withColumnRenamed("text", "core")
    size = F.greatest(F.length("text"), F.length("core"))
    most = F.greatest((1 - least) * size, F.when(size <= 5, 1.0).otherwise(0.0)) + 1e-9
    pairs = left.join(right, "variant").where(F.abs(F.length("text") - F.length("core")) <= most).select("text", "core").distinct()
    # a swap costs 1 and is two plain edits; keys apart cost less than a plain edit, but not less than half
    return pairs.where(F.levenshtein(unfolded(F.col("text")), unfolded(F.col("core"))) <= F.floor(2 * most))


PAIR = "struct<distance:double,similarity:double,visual:boolean,swapped:boolean>"


def pair_distance(a: Column, b: Column) -> Column:
    """struct(distance, similarity, visual, swapped) of two strings, by the same sums as the nearest brand of a list has."""

    @F.arrow_udf(PAIR)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = x.to_pylist(), y.to_pylist()
        out = {"distance": np.zeros(len(left)), "similarity": np.zeros(len(left)), "visual": np.zeros(len(left), bool), "swapped": np.zeros(len(left), bool)}
        for some in distance._by_length(left, 4000):
            pairs = distance.Aligned([left[k] for k in some], [right[k] for k in some])
            sizes = np.array([max(1, len(right[k])) for k in some])
            out["distance"][some] = pairs.distance
            out["similarity"][some] = np.maximum(0.0, 1 - pairs.distance / np.maximum(pairs.n, sizes))
            out["visual"][some], out["swapped"][some] = pairs.marks()
        return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], list(out))

    return run(a, b)


def _hidden_pairs(batches: Iterator[pa.RecordBatch], cores: list[str], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (text): text and the cores that it is near to, against all cores, block by block."""
    laid = [(block, distance.Cores(block), np.array(list(map(len, block)))) for block in (cores[k : k + 4096] for k in range(0, len(cores), 4096))]
    for batch in batches:
        texts, found = batch["text"].to_pylist(), []
        for block, words, sizes in laid:
            for run in distance._by_length(texts, 50):
                some = [texts[k] for k in run]
                if some[0]:
                    apart = words.distances(distance._spell(some, len(some[0]))) / distance.SCALE
                    w, c = np.nonzero(1 - apart / np.maximum(len(some[0]), sizes) >= least - 1e-9)
                    found += [(some[k], block[j]) for k, j in zip(w.tolist(), c.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["text", "core"])


def near_brands(labels: DataFrame, brands: DataFrame, *, least: float = NEAR_FROM, least_hidden: float = NEAR_FROM_HIDDEN) -> DataFrame:
    """(text, near_ord, near_distance, near_similarity, near_visual, near_swapped) of the brand nearest to each label, if one is near.

    labels: different (text, hidden). Near is a similarity of `least`, or a distance of 1 in texts of up to 5
    characters; for hidden labels, a similarity of least_hidden. Of equally similar brands the first counts. Candidates are the pairs with a
    deletion in common (near_pairs); hidden labels, which need a lower similarity than deletions can serve, are set against all cores in
    blocks. Empty labels and cores of fewer than 4 letters have nothing near.
    """
    cores = brands.where(F.length("core") >= 4).groupBy("core").agg(F.min("ord").alias("ord"))
    plain = near_pairs(labels.where("text <> ''").select("text"), cores.select(F.col("core").alias("text")), least)
    size = cores.agg(F.sum(F.length("core"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"brands of {size} characters are too many to send to each task")
    every = [r["core"] for r in cores.select("core").collect()] if size else []
    spark = labels.sparkSession
    shared = spark.sparkContext.broadcast(every)
    run = lambda batches: _hidden_pairs(batches, shared.value, least_hidden)
    deep = labels.where("hidden and text <> ''").select("text").mapInArrow(run, "text string, core string")
    pairs = plain.unionByName(deep).distinct().join(cores, "core").join(labels, "text")
    known = pairs.withColumn("d", pair_distance(F.col("text"), F.col("core")))
    short = (F.greatest(F.length("text"), F.length("core")) <= 5) & (F.col("d.distance") <= 1)
    close = (F.col("d.similarity") >= least) | short | (F.col("hidden") & (F.col("d.similarity") >= least_hidden))
    best = known.where(close & (F.col("d.similarity") > 0)).groupBy("text").agg(F.max(F.struct(F.col("d.similarity").alias("s"), (-F.col("ord")).alias("o"), "d")).alias("best"))
    return best.select("text", (-F.col("best.o")).alias("near_ord"), *[F.col(f"best.d.{k}").alias(f"near_{k}") for k in NEAR[1:]])


# ---- verdicts --------------------------------------------------------------------------------------------------------


def picker(place: str, name: str) -> Column:
    """An attribute of a brand that the row touches, by its ord."""
    return F.try_element_at(F.col("touched"), F.col(place))[name]


def match_table(df: DataFrame, brands: DataFrame) -> DataFrame:
    """Hosts with glyphs plus what match_brands adds, from a table of brands; and touched, the brands that a row touches by ord.

    near_* is null where no brand is near (see near_brands), not that of the nearest at any distance.
    """
    rows = stored(df, "brand-hosts")
    labels = rows.select("host", "sld", "registrable", "last_label", "skeleton", "sub_skeletons", (F.col("mixed") | (F.size("folds") > 0)).alias("hidden")).dropDuplicates(["host"])
    texts = labels.groupBy(F.col("skeleton").alias("text")).agg(F.max("hidden").alias("hidden"))
    near = stored(near_brands(texts, brands), "brand-near")
    exact = touches(labels, brands)
    close = labels.select("host", F.col("skeleton").alias("text")).join(near, "text").select("host", F.lit("near").alias("kind"), F.col("near_ord").alias("ord"))
    known = exact.unionByName(close).join(brands.select("ord", F.struct(*ATTRIBUTES).alias("brand")), "ord")
    places = known.groupBy(F.col("host").alias("__host")).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("ord"))).alias(k) for k in KINDS],
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("ord", "brand")))).alias("touched"),
    )
    letters = brands.where(F.length("core") >= 4).agg(F.sum(F.length("core"))).first()[0] or 0
    joined = rows.join(places, F.col("host") == F.col("__host"), "left").drop("__host")
    joined = joined.join(near.withColumnRenamed("text", "__text"), F.col("skeleton") == F.col("__text"), "left").drop("__text")
    closeness = F.coalesce(F.col("near_similarity"), F.lit(0.0))
    near_or = {"near_similarity": closeness, "near_visual": F.coalesce("near_visual", F.lit(False)), "near_swapped": F.coalesce("near_swapped", F.lit(False)), "near_ord": F.coalesce("near_ord", F.lit(-1))}
    joined = joined.withColumns(near_or).withColumns(
        {"tld_suspicious": suspicious_tld(F.col("last_label")), "lures": lures(F.col("skeleton"), F.col("sub_skeletons")), "ops": F.length("skeleton") * F.lit(letters)}
    )
    near_enough = F.col("skeleton_core").isNotNull() | F.col("embedded").isNotNull() | (F.col("near_similarity") >= 0.85)
    return settle(joined, proximate=near_enough, homoglyph=F.col("mixed") | ((F.size("folds") > 0) & near_enough))


def score_with_table(inputs: DataFrame, brands: DataFrame, column: str = "input") -> DataFrame:
    """Verdicts of inputs against a table of brands (SCHEMA), whose size the plan doesn't depend on.

    Levels, scores, brands and signals are those of score_hosts over the same brands; similarity and distance of hosts that
    resemble no brand tell of a near one only. Brands are taken in the order of ord, which must not repeat. An empty table of brands or of inputs
    is fine; null inputs are empty hosts.
    """
    matched = match_table(with_glyphs(parse_hosts(inputs, column)), brands)
    return verdicts(judge(matched, of=picker), of=picker)

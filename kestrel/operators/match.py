"""Which brands a host touches: exact, folded, embedded, as a token, in a sub-domain, officially, or nearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.dims import LEARNED, LURE_WORDS, SUSPICIOUS_TLDS, Brand
from kestrel.functions import distance, unicode
from kestrel.functions.hosts import has_non_ascii, positions, similarity


#: What is known of the nearest brand, as columns near_ord and so on.
NEAR = ("ord", "distance", "similarity", "visual", "swapped")


def nearest_columns() -> dict[str, Column]:
    return {k: F.col(f"near_{k}") for k in NEAR}


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added or replaced by values computed once.

    A row of one struct is unpacked by a generator, which the optimizer doesn't fold into what reads the columns: long
    chains of conditions would otherwise be copied into every condition that uses them.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def first_of(brands: list[Brand], test) -> Column:
    """The place of the first brand that passes, else null; a chain of built-in conditions."""
    tests = [(k, test(b)) for k, b in enumerate(brands)]
    tests = [F.when(t, F.lit(k)) for k, t in tests if t is not None]
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


def attribute(place: Column, values: list) -> Column:
    """values[place]; null for a null place."""
    return F.get(F.array(*map(F.lit, values)), place)


def picker(brands: list[Brand], learned: str | None = None):
    """A function of a column that holds a brand's place and the name of a field, giving that field of the brand.

    Places from len(brands) on stand for entries of the row's own array `learned` (structs of core and domain).
    """
    own = {"core": "core", "name": "core", "domain": "domain"}

    def of(place: str, name: str) -> Column:
        value = attribute(F.col(place), [getattr(b, name) for b in brands] or [""])
        if learned is None:
            return value
        entry = F.get(F.col(learned), F.col(place) - len(brands))
        return F.when(F.col(place) >= len(brands), F.lit(LEARNED) if name == "category" else entry[own[name]]).otherwise(value)

    return of


def learned_place(brands: list[Brand], learned: str, test) -> Column:
    """The place of the first learned brand of the row that passes, after the places of brands; else null."""
    at = F.array_position(F.transform(F.col(learned), lambda b: F.coalesce(test(b), F.lit(False))), F.lit(True))
    return F.when(at > 0, at - 1 + len(brands)).cast("int")


def suspicious_tld(label: Column) -> Column:
    return label.isin(SUSPICIOUS_TLDS)


def lures(skeleton: Column, sub_skeletons: Column) -> Column:
    """Lure words in the label's or a sub-domain's skeleton, in the order of the list."""
    everywhere = F.concat_ws("\n", skeleton, sub_skeletons)
    return F.array_compact(F.array(*[F.when(everywhere.contains(w), F.lit(w)) for w in LURE_WORDS]))


def official_brand(brands: list[Brand]) -> Column:
    trusted = ~suspicious_tld(F.col("last_label"))

    def test(b: Brand) -> Column:
        listed = F.col("registrable").isin(*b.official)
        owned = (F.col("sld") == b.core) & trusted
        return listed | owned if b.owns_name else listed

    return first_of(brands, test)


def embedded_brand(brands: list[Brand], skeleton: Column) -> Column:
    """The place of the longest core (4 letters or more) inside a skeleton; of equal ones the first."""
    ranked = sorted((-len(b.core), k, b.core) for k, b in enumerate(brands) if len(b.core) >= 4)
    return F.coalesce(*[F.when(skeleton.contains(core), F.lit(k)) for _, k, core in ranked])


def token_brand(brands: list[Brand], skeleton: Column, sld: Column) -> Column:
    tokens = F.split(skeleton, "[-_]+")
    return first_of(
        brands, lambda b: F.array_contains(tokens, b.core) & (sld != b.core) if len(b.core) >= 3 else None
    )


def sub_brand(brands: list[Brand], sub_skeletons: Column) -> Column:
    joined = F.concat_ws("\n", sub_skeletons)
    return first_of(brands, lambda b: joined.contains(b.core) if len(b.core) >= 4 else None)


def compared_cells(brands: list[Brand], skeleton: Column) -> Column:
    """Cells that comparing a skeleton with all cores of 4 letters or more fills."""
    return F.length(skeleton) * F.lit(sum(len(b.core) for b in brands if len(b.core) >= 4))


def with_glyphs(df: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Parsed hosts plus skeleton, mixed, folds of the label, sub_skeletons and host_skeleton."""
    subs = F.concat_ws("\n", "subdomains")
    marked = df.withColumn("__g", unicode.label_glyphs(F.col("sld"), table)).withColumn(
        "__subs", unicode.skeleton(subs, table)
    )
    nothing = F.array().cast("array<struct<orig:string,canon:string,script:string>>")
    return (
        marked.withColumn("skeleton", F.coalesce(F.col("__g.skeleton"), F.lower("sld")))
        .withColumn("mixed", F.coalesce(F.col("__g.mixed"), F.lit(False)))
        .withColumn("folds", F.coalesce(F.col("__g.folds"), nothing))
        .withColumn("sub_skeletons", F.filter(F.split("__subs", "\n"), lambda x: x != ""))
        .withColumn("host_skeleton", unicode.skeleton(F.col("host"), table))
        .drop("__g", "__subs")
    )


def brand_distances(df: DataFrame, label: str, brands: list[Brand] | None = None) -> DataFrame:
    """A row for each label and brand: df plus core, d (plain Levenshtein distance) and similarity by it."""
    brands = brands if brands is not None else dims.brands()
    each = df.withColumn("core", F.explode(F.array(*[F.lit(b.core) for b in brands])))
    d = F.levenshtein(label, "core")
    return each.withColumn("d", d.cast("long")).withColumn("similarity", similarity(F.col("d"), F.col(label), F.col("core")))


def within_distance(label: Column, host: Column, most: int, brands: list[Brand] | None = None) -> Column:
    """The plain baseline: whether a label is within a Levenshtein distance of a core of 4 letters or more, official domains aside."""
    brands = brands if brands is not None else dims.brands()
    d = F.least(*[F.levenshtein(label, F.lit(b.core)) for b in brands if len(b.core) >= 4])
    return (d <= most) & ~host.isin([b.domain for b in brands])


def brand_patterns(df: DataFrame, label: str, brands: list[Brand] | None = None) -> DataFrame:
    """A row for each place of each core of 4 letters or more in a label, overlapping ones too: df plus core, start and stop.

    For a handful of brands; patterns.find_patterns takes any number.
    """
    brands = brands if brands is not None else dims.brands()
    found = [F.when(F.col(label).contains(b.core), F.lit(b.core)) for b in brands if len(b.core) >= 4]
    each = df.withColumn("core", F.explode(F.array_compact(F.array(*found))))
    each = each.withColumn("start", F.explode(positions(F.col(label), F.col("core"))))
    return each.withColumn("start", F.col("start").cast("long")).withColumn("stop", F.col("start") + F.length("core"))


def resembling(label: Column, host: Column, brands: list[Brand] | None = None) -> Column:
    """Whether a host has characters beyond ASCII, or its label and a core (4 letters or more) hold each other or are 2 apart."""
    brands = brands if brands is not None else dims.brands()
    cores = F.array(*[F.lit(b.core) for b in brands if len(b.core) >= 4])
    like = lambda c: F.contains(label, c) | ((label != "") & F.contains(c, label)) | (F.levenshtein(label, c) <= 2)
    return has_non_ascii(host) | F.exists(cores, like)


def with_learned(brands: list[Brand], learned: str) -> dict[str, Column]:
    """What the row's own learned brands add to each test of match_brands: places where no brand of the list came before."""
    skeleton, sld = F.col("skeleton"), F.col("sld")
    tokens, joined = F.split(skeleton, "[-_]+"), F.concat_ws("\n", "sub_skeletons")
    first = lambda column, test: F.coalesce(F.col(column), learned_place(brands, learned, test))
    inside = F.transform(
        F.col(learned),
        lambda b, k: F.when((F.length(b["core"]) >= 4) & skeleton.contains(b["core"]), F.struct(F.length(b["core"]).alias("n"), (-k).alias("k"))),
    )
    longest = F.array_max(F.array_compact(inside))
    held = attribute(F.col("embedded"), [len(b.core) for b in brands])
    nearer = F.coalesce(F.col("__own.similarity") > F.col("near_similarity"), F.lit(False))
    letters = F.aggregate(F.col(learned), F.lit(0), lambda n, b: n + F.when(F.length(b["core"]) >= 4, F.length(b["core"])).otherwise(0))
    near = {k: F.when(nearer, F.col(f"__own.{k}")).otherwise(F.col(f"near_{k}")) for k in NEAR[1:]}
    near["ord"] = F.when(nearer, F.col("__own.ord") + len(brands)).otherwise(F.col("near_ord"))
    return {
        "official": first("official", lambda b: b["domain"] == F.col("registrable")),
        "exact_core": first("exact_core", lambda b: b["core"] == sld),
        "skeleton_core": first("skeleton_core", lambda b: b["core"] == skeleton),
        "embedded": F.when(longest["n"] > F.coalesce(held, F.lit(0)), len(brands) - longest["k"]).otherwise(F.col("embedded")),
        "token": first("token", lambda b: (F.length(b["core"]) >= 3) & F.array_contains(tokens, b["core"]) & (sld != b["core"])),
        "in_subdomain": first("in_subdomain", lambda b: (F.length(b["core"]) >= 4) & joined.contains(b["core"])),
        "ops": F.col("ops") + F.length(skeleton) * F.coalesce(letters, F.lit(0)),
        **{f"near_{k}": v for k, v in near.items()},
    }


def match_brands(df: DataFrame, brands: list[Brand] | None = None, learned: str | None = None) -> DataFrame:
    """Hosts with glyphs plus the places of brands by each test, tld_suspicious, lures, near_* columns and homoglyph flags.

    `learned` names a column array<struct<core,domain>> of brands that the row's device learned; they come after the list.
    """
    brands = brands if brands is not None else dims.brands()
    skeleton, subs = F.col("skeleton"), F.col("sub_skeletons")
    near = df.withColumn("__n", distance.nearest_brand(skeleton, brands))
    near = near.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__n.{k}").alias(f"near_{k}") for k in NEAR])
    out = settle(
        near,
        official=official_brand(brands),
        exact_core=first_of(brands, lambda b: F.col("sld") == b.core),
        skeleton_core=first_of(brands, lambda b: skeleton == b.core),
        embedded=embedded_brand(brands, skeleton),
        token=token_brand(brands, skeleton, F.col("sld")),
        in_subdomain=sub_brand(brands, subs),
        tld_suspicious=suspicious_tld(F.col("last_label")),
        lures=lures(skeleton, subs),
        ops=compared_cells(brands, skeleton),
    )
    if learned is not None:
        own = distance.nearest_learned(skeleton, F.transform(F.col(learned), lambda b: b["core"]))
        out = settle(out.withColumn("__own", own), **with_learned(brands, learned)).drop("__own")
    close = (
        F.col("skeleton_core").isNotNull() | F.col("embedded").isNotNull() | (F.col("near_similarity") >= 0.85)
    )
    return settle(out, proximate=close, homoglyph=F.col("mixed") | ((F.size("folds") > 0) & close))

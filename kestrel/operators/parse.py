"""Hosts to labels, public suffix and registrable domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel import dims
from kestrel.functions import hosts, unicode

#: Labels of the longest suffix rule.
LONGEST = 4
PARSED = ("host", "labels", "suffix", "sld", "subdomains", "last_label", "registrable")


def split_suffix(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """df (with column host) plus labels, suffix, sld, subdomains, last_label, registrable.

    One lookup for each number of labels that a rule can have, broadcast for the published list, so nothing is shuffled and streams work. An
    exception wins and ends before its first label; else the longest exact or wildcard rule wins; else the last
    label is the suffix.
    """
    given = rules is not None
    rules = rules if given else dims.suffix_rules(df.sparkSession)
    out = df.withColumn("labels", hosts.labels(F.col("host")))
    n = F.size("labels")
    for k in range(1, LONGEST + 1):
        tail = F.when(n >= k, F.concat_ws(".", F.slice("labels", F.greatest(n - k + 1, F.lit(1)), F.lit(k))))
        side = rules.select(
            F.col("suffix").alias(f"__s{k}"),
            F.col("is_exact").alias(f"__e{k}"),
            F.col("is_wild").alias(f"__w{k}"),
            F.col("is_exception").alias(f"__x{k}"),
        )
        # the published list has about 7,000 rows; of a list that was given Spark knows the size
        out = out.withColumn("__tail", tail).join(side if given else F.broadcast(side), F.col("__tail") == F.col(f"__s{k}"), "left")
    kinds = range(LONGEST, 0, -1)
    exception = F.coalesce(*[F.when(F.col(f"__x{k}"), F.lit(k - 1)) for k in kinds])
    longest = F.greatest(
        *[F.when(F.col(f"__e{k}"), F.lit(k)).otherwise(F.lit(1)) for k in kinds],
        *[F.when(F.col(f"__w{k}") & (n > k), F.lit(k + 1)).otherwise(F.lit(1)) for k in kinds],
    )
    out = out.withColumn("__len", F.least(F.coalesce(exception, longest), n)).withColumn("__rest", n - F.col("__len"))
    suffix = F.concat_ws(".", F.slice("labels", F.col("__rest") + 1, F.col("__len")))
    sld = F.when(F.col("__rest") > 0, F.get("labels", F.col("__rest") - 1)).otherwise("")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        "labels",
        suffix.alias("suffix"),
        sld.alias("sld"),
        F.slice("labels", F.lit(1), F.greatest(F.col("__rest") - 1, F.lit(0))).alias("subdomains"),
        F.coalesce(F.try_element_at("labels", F.lit(-1)), F.lit("")).alias("last_label"),
        F.concat(F.when(sld != "", F.concat(sld, F.lit("."))).otherwise(""), suffix).alias("registrable"),
    )


def parse_hosts(df: DataFrame, column: str = "input", rules: DataFrame | None = None) -> DataFrame:
    """df plus host (cleaned and Punycode decoded) and what split_suffix adds. A null input is an empty host."""
    text = F.coalesce(F.col(column), F.lit(""))
    return split_suffix(df.withColumn("host", unicode.decode_host(hosts.clean_host(text))), rules)

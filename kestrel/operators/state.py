"""What devices learn and count, as batch operators over events (device, ts, event_id, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.evaluate import in_ranges

MOST_VISITS, MOST_SITES, MOST_RECENT = 999, 300, 8


def visits(events: DataFrame) -> DataFrame:
    """(device, registrable, sld, count, last_seen) of safe completed loads of labels of 4 letters or more; counts stop at 999.

    Loads under way, addresses that change inside a page, activated tabs and blocks are no visits.
    """
    kept = events.where((F.col("kind") == "complete") & (F.col("level") == "safe") & (F.length("sld") >= 4))
    return kept.groupBy("device", "registrable").agg(
        F.max("sld").alias("sld"), F.least(F.count(F.lit(1)), F.lit(MOST_VISITS)).alias("count"), F.max("ts").alias("last_seen")
    )


def remembered(visited: DataFrame, most: int = MOST_SITES) -> DataFrame:
    """The most visited sites that a device keeps; of equal counts the ones seen last."""
    w = Window.partitionBy("device").orderBy(F.desc("count"), F.desc("last_seen"), "registrable")
    return visited.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


class Sites:
    """The sites that a device keeps: registrable -> [sld, count], in the order in which they came."""

    def __init__(self, most: int) -> None:
        self.most, self.kept = most, {}

    def visit(self, registrable: str, sld: str) -> None:
        """One visit more; then, if there are too many sites, the oldest of the least visited goes, be it the new one."""
        site = self.kept.setdefault(registrable, [sld, 0])
        site[0], site[1] = sld, min(MOST_VISITS, site[1] + 1)
        if len(self.kept) > self.most:
            del self.kept[min(self.kept, key=lambda r: self.kept[r][1])]


def _forgetful(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows (device, registrable, sld) in order of device and time: the sites that each device has kept in the end."""
    out, now, sites = [], None, Sites(most)

    def rows() -> pa.RecordBatch:
        names = ["device", "registrable", "sld", "count"]
        kinds = [device, pa.string(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], names)

    device = None
    for batch in batches:
        device = batch.schema.field("device").type
        for who, registrable, sld in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if who != now:
                out += [(now, r, *v) for r, v in sites.kept.items()]
                now, sites = who, Sites(most)
                if len(out) > 50_000:
                    yield rows()
                    out = []
            sites.visit(registrable, sld)
    if device is not None:
        out += [(now, r, *v) for r, v in sites.kept.items()]
        yield rows()


def kept_sites(events: DataFrame, most: int = MOST_SITES) -> DataFrame:
    """(device, registrable, sld, count): the sites that each device keeps of its visits, forgetting as it goes.

    Visits are those of visits(), in the order of time. A device that has never had over `most` sites has forgotten none: its counts
    are sums. The visits of others are gone through one by one in their order, on which it depends what they keep; of a device, one task
    holds `most` sites and reads visits as they come.
    """
    kept = events.where((F.col("kind") == "complete") & (F.col("level") == "safe") & (F.length("sld") >= 4) & F.col("device").isNotNull())
    sums = kept.groupBy("device", "registrable").agg(
        F.max_by("sld", F.struct("ts", "event_id")).alias("sld"), F.least(F.count(F.lit(1)), F.lit(MOST_VISITS)).cast("int").alias("count")
    )
    sizes = sums.groupBy("device").agg(F.count(F.lit(1)).alias("__sites"))
    full = sizes.where(F.col("__sites") > most).select("device")
    few = sums.join(full, "device", "left_anti")
    ordered = kept.join(full, "device", "left_semi").repartition("device").sortWithinPartitions("device", "ts", "event_id")
    kind = dict(events.dtypes)["device"]
    many = ordered.select("device", "registrable", "sld").mapInArrow(partial(_forgetful, most=most), f"device {kind}, registrable string, sld string, count int")
    return few.unionByName(many)


def trusted(visited: DataFrame, least: int = 3) -> DataFrame:
    return visited.where((F.col("count") >= least) & (F.length("sld") >= 4))


def learned(visited: DataFrame) -> DataFrame:
    """(device, learned): the trusted sites of each device as brands, array<struct<core,domain>>, the most visited first.

    A device has at most as many as `remembered` leaves it.
    """
    site = F.struct((-F.col("count")).alias("o"), F.col("registrable").alias("domain"), F.col("sld").alias("core"))
    brand = lambda x: F.struct(x["core"].alias("core"), x["domain"].alias("domain"))
    return trusted(visited).groupBy("device").agg(F.transform(F.sort_array(F.collect_list(site)), brand).alias("learned"))


def trusted_count(visited: DataFrame, least: int = 3) -> DataFrame:
    return visited.groupBy("device").agg(F.count_if(F.col("count") >= least).alias("trusted"))


def counters(events: DataFrame) -> DataFrame:
    """(device, scanned, blocked): completed loads, and blocks shown."""
    return events.groupBy("device").agg(
        F.count_if(F.col("kind") == "complete").alias("scanned"), F.count_if(F.col("kind") == "block").alias("blocked")
    )


def in_spans(events: DataFrame, keys: list[str], value: Column, spans: int | None = None) -> DataFrame:
    """events (ts, event_id, ...) plus part, a span of time, and __before: the last value that is no null in earlier spans of the keys.

    What looks back over a device's events can then run inside spans, whose ends come ahead as one row each, so no task
    orders all events of a busy device. Events without a time come first.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(2**63)))
    rows = in_ranges(events.withColumn("__at", at), "__at", spans).drop("__at").withColumn("__value", value)
    when = F.when(F.col("__value").isNotNull(), F.struct("ts", "event_id"))
    ends = rows.groupBy(*keys, "part").agg(F.max_by("__value", when).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "part", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "part")]
    return rows.alias("e").join(before.alias("b"), same).select("e.*", "b.__before")


def recent_threats(blocks: DataFrame, most: int = MOST_RECENT, spans: int | None = None) -> DataFrame:
    """The newest blocked hosts of a device with their place, runs of one host collapsed to its first block.

    The newest of a device are ranked among what each task leaves as its own newest.
    """
    w = Window.partitionBy("device", "part").orderBy("ts", "event_id")
    seen = in_spans(blocks, ["device"], F.struct("host"), spans)
    last = F.coalesce(F.lag("__value").over(w), F.col("__before"))["host"]
    fresh = seen.withColumn("__last", last).where(~F.col("host").eqNullSafe(F.col("__last")) | F.col("__last").isNull())
    newest = Window.partitionBy("device").orderBy(F.desc("ts"), F.desc("event_id"))
    placed = fresh.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    return placed.select(*blocks.columns, "place")


def clean_message(df: DataFrame) -> DataFrame:
    """Block messages made valid: host and brand cut to 253 and 60 characters, a score of 0 to 100, a default brand.

    Rows without a host are dropped.
    """
    score = F.col("score").cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return (
        df.where(F.length("host") > 0)
        .withColumn("host", F.left("host", F.lit(253)))
        .withColumn("brand", F.when(F.length("brand") > 0, F.left("brand", F.lit(60))).otherwise("a brand"))
        .withColumn("score", F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(F.lit(0.0)))
    )


def block_latch(events: DataFrame, spans: int | None = None) -> DataFrame:
    """events plus latched: whether the last block or load start of the device's tab, this event included, was a block."""
    w = Window.partitionBy("device", "tab", "part").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("kind").isin("block", "loading"), F.col("kind"))
    seen = in_spans(events, ["device", "tab"], turn, spans)
    last = F.coalesce(F.last("__value", ignorenulls=True).over(w), F.col("__before"))
    return seen.withColumn("latched", F.coalesce(last == "block", F.lit(False))).select(*events.columns, "latched")


def badge(latched: Column, level: Column) -> Column:
    return F.when(latched | (level == "dangerous"), "!").when(level == "suspicious", "?").otherwise("")


def rescans(changes: DataFrame, quiet: str = "600 milliseconds", spans: int | None = None) -> DataFrame:
    """(device, started, ended, changes): bursts of page changes, each rescanned once after a quiet time.

    A change begins a burst if the one before is at least `quiet` earlier. Devices are cut into spans of time: each span is told the last
    change and the number of bursts before it, so no task orders all changes of a busy device. Changes without a time are left out.
    """
    wait = F.expr(f"interval {quiet}")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = in_ranges(changes.where(F.col("ts").isNotNull()).withColumn("__at", at), "__at", spans).drop("__at").select("device", "part", "ts")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("device", "part")]
    earlier = Window.partitionBy("device").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    ends = rows.groupBy("device", "part").agg(F.max("ts").alias("__end")).withColumn("__before", F.max("__end").over(earlier))
    told = rows.alias("a").join(ends.alias("b"), same).select("a.*", "b.__before")
    inside = Window.partitionBy("device", "part").orderBy("ts")
    begins = F.coalesce(F.col("ts") >= F.coalesce(F.lag("ts").over(inside), F.col("__before")) + wait, F.lit(True)).cast("long")
    counted = told.withColumn("__new", begins)
    news = counted.groupBy("device", "part").agg(F.sum("__new").alias("__news")).withColumn("__nth", F.coalesce(F.sum("__news").over(earlier), F.lit(0)))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.alias("a").join(news.alias("b"), same).select("a.*", "b.__nth")
    burst = placed.withColumn("__burst", F.col("__nth") + F.sum("__new").over(upto)).groupBy("device", "__burst")
    return burst.agg(F.min("ts").alias("started"), (F.max("ts") + wait).alias("ended"), F.count(F.lit(1)).alias("changes")).drop("__burst")


def enabled_only(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Events of devices that aren't paused; a device without a setting is enabled."""
    return events.join(settings.where(~F.col("enabled")).select("device"), "device", "left_anti")

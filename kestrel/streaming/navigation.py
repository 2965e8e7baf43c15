"""Navigation events as streams: verdicts, learned sites, threats and latches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kestrel.operators.rules import score_hosts
from kestrel.operators.state import MOST_RECENT, MOST_SITES, MOST_VISITS, learned, remembered, visits
from kestrel.sources.readers import read_state, upsert_state

#: Kinds are complete, loading, block, url (the address changed inside a page), activated and settings.
EVENTS = "device long, tab int, event_id long, ts timestamp, kind string, url string"
_OUT = "device long, event_id long, latched boolean, visits int, trusted int, recent array<string>, scanned long, blocked long"
_STATE = "hosts array<string>, slds array<string>, counts array<int>, recent array<string>, latched array<int>, scanned long, blocked long"


def read_events(spark, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def score_events(events: DataFrame, **how) -> DataFrame:
    """Events with verdicts; broadcast lookups only, so no state and no watermark."""
    return score_hosts(events, "url", **how)


def scored_batches(events: DataFrame, out: str, checkpoint: str, sites: str | None = None):
    """Start a query that writes verdicts of each batch under out.

    Sites that a device learned are brands for its own events. They are read from the state table `sites` (device,
    registrable, sld, count, last_seen) as the batch before left it, and safe completed loads are added to it after
    scoring; a device keeps the 300 most visited. A batch that is run again after a failure replaces what it wrote, and
    sites are counted once per batch number.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_state(spark, sites)[0] if sites else None
        target = f"{out}/batch={number}"
        if old is None:
            scored = score_hosts(batch, "url")
        else:
            known = batch.join(learned(old), "device", "left")
            scored = score_hosts(known, "url", learned="learned").drop("learned")
        scored.write.mode("overwrite").parquet(target)
        if sites and (old is None or old.where(F.col("batch") >= number).isEmpty()):
            done = spark.read.parquet(target).withColumn("registrable", F.concat_ws(".", "sld", "suffix"))
            new = visits(done).withColumn("count", F.col("count").cast("long"))
            mine = new if old is None else new.unionByName(old.join(new.select("device").distinct(), "device", "left_semi").drop("batch"))
            total = mine.groupBy("device", "registrable").agg(
                F.max("sld").alias("sld"), F.least(F.sum("count"), F.lit(MOST_VISITS)).alias("count"), F.max("last_seen").alias("last_seen")
            )
            upsert_state(remembered(total, MOST_SITES).withColumn("batch", F.lit(number).cast("long")), sites, ["device"])

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One device's events, in order, through its visits, recent threats, latches of its tabs and counters."""
    if state.exists:
        hosts, slds, counts, recent, tabs, scanned, blocked = state.get
        visited = {h: [s, c] for h, s, c in zip(hosts, slds, counts, strict=True)}
        recent, latched = list(recent), set(tabs)
    else:
        visited, recent, latched, scanned, blocked = {}, [], set(), 0, 0
    out = []
    for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
        if e.kind == "block":
            latched.add(int(e.tab))
            blocked += 1
            if not recent or recent[0] != e.host:
                recent = [e.host, *recent][:MOST_RECENT]
        elif e.kind == "loading":
            latched.discard(int(e.tab))
        elif e.kind == "complete":
            scanned += 1
            if e.level == "safe" and len(e.sld) >= 4:
                seen = visited.setdefault(e.registrable, [e.sld, 0])
                seen[1] = min(MOST_VISITS, seen[1] + 1)
                if len(visited) > MOST_SITES:  # the oldest of the least visited goes
                    del visited[min(visited, key=lambda h: visited[h][1])]
        trusted = sum(c >= 3 for _, c in visited.values())
        out.append((key[0], e.event_id, int(e.tab) in latched, len(visited), trusted, list(recent), scanned, blocked))
    state.update(
        (list(visited), [s for s, _ in visited.values()], [c for _, c in visited.values()], recent, sorted(latched), scanned, blocked)
    )
    yield pd.DataFrame(out, columns=["device", "event_id", "latched", "visits", "trusted", "recent", "scanned", "blocked"])


def device_states(events: DataFrame) -> DataFrame:
    """After every event (device, tab, event_id, ts, kind, level, host, registrable, sld): the tab's latch, the device's
    number of sites and of trusted sites, recent threats and counters. Events of a batch are taken in the order of time."""
    return events.groupBy("device").applyInPandasWithState(
        _advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )


class History:
    """What is known of one device while its events go by in the order of time: sites by the rule of state.Sites, threats, latches, counters."""

    def __init__(self, most_sites: int, sites: dict | None = None, recent: list | None = None, tabs: set | None = None, sums: tuple = (0, 0, 0)) -> None:
        self.most_sites, self.sites, self.recent, self.tabs = most_sites, sites or {}, recent or [], tabs or set()
        self.scanned, self.blocked, self.came = sums
        self.trusted = sum(n >= 3 for _, n, _ in self.sites.values())
        self.touched: set = set()

    def take(self, tab: int, kind: str, level: str, host: str, registrable: str, sld: str | None) -> tuple:
        """One event more; what _COLUMNS say after it, from latched on."""
        if kind == "block":
            self.tabs.add(tab)
            self.blocked += 1
            if not self.recent or self.recent[0] != host:
                self.recent = [host, *self.recent][:MOST_RECENT]
        elif kind == "loading":
            self.tabs.discard(tab)
        elif kind == "complete":
            self.scanned += 1
            if level == "safe" and sld is not None and len(sld) >= 4:
                self.visit(registrable, sld)
        return tab in self.tabs, len(self.sites), self.trusted, self.recent, self.scanned, self.blocked

    def visit(self, registrable: str, sld: str) -> None:
        self.came += 1
        _, n, since = self.sites.get(registrable, (sld, 0, self.came))
        self.sites[registrable] = (sld, min(MOST_VISITS, n + 1), since)
        self.trusted += n == 2
        self.touched.add(registrable)
        if len(self.sites) > self.most_sites:  # the oldest of the least visited goes
            gone = min(self.sites, key=lambda r: self.sites[r][1:])
            self.trusted -= self.sites.pop(gone)[1] >= 3
            self.touched.add(gone)


class Device(StatefulProcessor):
    """One device's sites, threats, latches and counters, each in a state of its own.

    Sites are a map, so a visit rewrites one entry; threats a list of MOST_RECENT at most; latches a map by tab. Sites that no visit has touched
    for the time to live of the state, where one is given, are forgotten.
    """

    def __init__(self, most_sites: int = MOST_SITES, site_days: int | None = None) -> None:
        self.most_sites, self.ttl = most_sites, site_days and site_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sites = handle.getMapState("sites", "registrable string", "sld string, n int, came long", ttlDurationMs=self.ttl)
        self.recent = handle.getListState("recent", "host string")
        self.latched = handle.getMapState("latched", "tab int", "yes boolean")
        self.sums = handle.getValueState("sums", "scanned long, blocked long, came long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - the names are Spark's
        sums = self.sums.get() if self.sums.exists() else (0, 0, 0)
        sites = {r[0]: tuple(v) for r, v in self.sites.iterator()}
        recent = [h for (h,) in self.recent.get()] if self.recent.exists() else []
        known = {t for (t,), _ in self.latched.iterator()}
        now = History(self.most_sites, sites, recent, set(known), sums)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = [(key[0], e.event_id, *now.take(int(e.tab), e.kind, e.level, e.host, e.registrable, e.sld)) for e in events.itertuples()]
        for site in now.touched:
            if site in now.sites:
                self.sites.updateValue((site,), now.sites[site])
            elif self.sites.containsKey((site,)):
                self.sites.removeKey((site,))
        for tab in now.tabs - known:
            self.latched.updateValue((tab,), (True,))
        for tab in known - now.tabs:
            self.latched.removeKey((tab,))
        if now.recent:
            self.recent.put([(h,) for h in now.recent])
        self.sums.update((now.scanned, now.blocked, now.came))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


_COLUMNS = ["device", "event_id", "latched", "visits", "trusted", "recent", "scanned", "blocked"]


_TAKEN = ["tab", "kind", "level", "host", "registrable", "sld"]


def _in_order(batches: Iterator[pa.RecordBatch], most_sites: int) -> Iterator[pa.RecordBatch]:
    """Of events in order of device and time: what is known after each of them. One device is held at a time, and none of its events."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64()]
    who = now = None
    for batch in batches:
        out = []
        for device, event_id, *event in zip(*(batch[c].to_pylist() for c in ("device", "event_id", *_TAKEN)), strict=True):
            if now is None or device != who:
                who, now = device, History(most_sites)
            out.append((device, event_id, *now.take(*event)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], _COLUMNS)


def device_histories(events: DataFrame, most_sites: int = MOST_SITES, site_days: int | None = None) -> DataFrame:
    """device_states with states of their own for sites, threats and latches, so a batch rewrites what it touches only.

    The state store of streams must be RocksDB (spark.sql.streaming.stateStore.providerClass); of one batch, a device's events are held at once to
    be put in order. Tables, after which no state is needed, have their events sorted by device and time and go through the same steps without
    a store; a device's events are one task's, which reads them as they come. A device keeps most_sites sites by the rule of state.Sites.
    Null devices are one device; events without a time come last.
    """
    if not events.isStreaming:
        order = ["device", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")]
        ordered = events.select("device", "ts", "event_id", *_TAKEN).repartition("device").sortWithinPartitions(*order)
        return ordered.drop("ts").mapInArrow(partial(_in_order, most_sites=most_sites), _OUT)
    return events.groupBy("device").transformWithStateInPandas(Device(most_sites, site_days), _OUT, "Append", "ProcessingTime" if site_days else "None")


def rescan_windows(changes: DataFrame, quiet: str = "600 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of page changes by session windows; changes later than the watermark are dropped."""
    return (
        changes.withWatermark("ts", late)
        .groupBy("device", F.session_window("ts", quiet).alias("w"))
        .agg(F.count(F.lit(1)).alias("changes"))
        .select("device", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")
    )


def once_per_link(links: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (device, url) once within the watermark."""
    return links.withWatermark("ts", late).dropDuplicatesWithinWatermark(["device", "url"])

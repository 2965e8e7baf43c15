"""Navigation events as a data source of Spark: format("navigation") reads logs of JSON lines in batches and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "device long, tab int, event_id long, ts timestamp, kind string, url string"
KINDS = ("complete", "loading", "block", "url", "activated", "removed", "settings")
#: Bytes of a log that a task reads, from the first line that begins in them.
SPLIT = 32 << 20
_ARROW = pa.schema([("device", pa.int64()), ("tab", pa.int32()), ("event_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("kind", pa.string()), ("url", pa.string())])


class Piece(InputPartition):
    """Bytes start to stop of a log."""

    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


def _logs(root: str) -> list[tuple[str, int]]:
    """(path, size) of the logs under a folder, or of one log, by name; names that begin with a dot or _ are none."""
    fs, path = pafs.FileSystem.from_uri(root)
    if fs.get_file_info(path).type == pafs.FileType.File:
        return [(root, fs.get_file_info(path).size)]
    found = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and f.base_name[:1] not in "._"]
    scheme = root[: root.index(path)]
    return sorted((scheme + f.path, f.size) for f in found)


def _lines(piece: Piece) -> Iterator[bytes]:
    """The lines that begin in a piece."""
    fs, path = pafs.FileSystem.from_uri(piece.path)
    with fs.open_input_file(path) as f:
        at = max(0, piece.start - 1)
        f.seek(at)
        rest, skip = b"", piece.start > 0  # the line that began before belongs to the piece before
        while at < piece.stop or rest:
            more = f.read(1 << 20)
            block = rest + more
            *whole, rest = block.split(b"\n") if more else (*filter(None, [block]), b"")
            for line in whole:
                if skip:
                    skip = False
                elif at < piece.stop:
                    yield line
                at += len(line) + 1
            if not more or at >= piece.stop:
                return


def _rows(piece: Piece) -> Iterator[pa.RecordBatch]:
    """Events of a piece; lines that aren't events, or of a kind that isn't known, are left out."""
    held: list[dict] = []
    for line in _lines(piece):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and row.get("kind") in KINDS and isinstance(row.get("device"), int):
            held.append(row)
        if len(held) >= 10_000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    whole = lambda r, c: r.get(c) if isinstance(r.get(c), int) else None
    text = lambda r, c: r.get(c) if isinstance(r.get(c), str) else None
    columns = [[whole(r, c) for r in rows] for c in ("device", "tab", "event_id", "ts")] + [[text(r, c) for r in rows] for c in ("kind", "url")]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _cut(path: str, size: int, begin: int = 0) -> list[Piece]:
    return [Piece(path, k, min(k + SPLIT, size)) for k in range(begin, size, SPLIT)]


class _Batch(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Piece]:
        return [p for path, size in _logs(self.root) for p in _cut(path, size)]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _rows(partition)  # None: there is no piece


class _Stream(DataSourceStreamReader):
    """Offsets say how many logs, in the order of their names, have been read: logs are written whole and under rising names."""

    def __init__(self, root: str, logs_at_once: int) -> None:
        self.root, self.logs_at_once, self.last = root, logs_at_once, 0

    def initialOffset(self) -> dict:  # noqa: N802 - the names are Spark's
        return {"logs": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.last = min(len(_logs(self.root)), self.last + self.logs_at_once) if self.logs_at_once else len(_logs(self.root))
        return {"logs": self.last}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.last = max(self.last, end["logs"])
        return [p for path, size in _logs(self.root)[start["logs"] : end["logs"]] for p in _cut(path, size)]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _rows(partition)

    def commit(self, end: dict) -> None:
        self.last = max(self.last, end["logs"])


class NavigationSource(DataSource):
    """Logs of navigation events, JSON lines of device, tab, event_id, ts (microseconds), kind and url.

    Options: path (a folder or a log, as a URI), logs_at_once (logs of a micro-batch; all by default). A batch reads pieces of logs in parallel.
    A stream that is begun again goes on at the log after the last that was committed. An empty folder has no events; missing fields are null.
    """

    @classmethod
    def name(cls) -> str:
        return "navigation"

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        path = self.options["path"]
        return path if "://" in path else "file://" + (path if not path.startswith("file:") else path[5:])

    def reader(self, schema) -> _Batch:
        return _Batch(self._root())

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(self._root(), int(self.options.get("logs_at_once", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NavigationSource)

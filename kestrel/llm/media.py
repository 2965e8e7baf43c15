"""AVI motion-JPEG columns: texts stored as frames, frames read back, shots cut into timed clips."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.jpeg import block_means, encode_samples
from kestrel.llm.shared import text_or_empty

#: Samples of a row, and rows of a full frame.
COLUMNS, ROWS = 64, 64
RATE, SCALE = 25, 1
_CLIP = "struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,mean_luma:double>"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(frames: list[bytes], width: int, height: int, comment: str = "", rate: int = RATE, scale: int = SCALE) -> bytes:
    """An AVI file of JPEG frames: headers, an optional comment, the frames and their index."""
    most = max(map(len, frames), default=0)
    head = struct.pack("<14I", 1_000_000 * scale // rate, 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack(
        "<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, scale, rate, 0, len(frames), most, -1, 0, 0, 0, width, height
    )
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", head), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", form)))
    info = _list(b"INFO", _chunk(b"ICMT", comment.encode())) if comment else b""
    body, index, at = [], [], 4
    for frame in frames:
        body.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    inside = b"AVI " + headers + info + _list(b"movi", *body) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", inside)


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name or list kind, start, end) of chunks, lists opened."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        stop = min(at + 8 + size, end)
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 8, stop
            yield from _walk(data, at + 12, stop)
        else:
            yield name, at + 8, stop
        at += 8 + size + size % 2


def read_avi(data: bytes) -> dict:
    """frames (bytes of each video chunk), rate, scale, width, height, comment of an AVI file.

    Frames come from the index; its offsets count from the list of frames or from the file's start. Without an
    index they come from the list itself. ValueError if it isn't an AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    listed: list[tuple[int, int]] = []
    for name, start, end in _walk(data, 0, len(data)):
        if name[2:] in (b"dc", b"db"):
            listed.append((start, end))
        else:
            found.setdefault(name, (start, end))
    width, height = struct.unpack_from("<II", data, found[b"avih"][0] + 32)
    scale, rate = struct.unpack_from("<II", data, found[b"strh"][0] + 20)
    frames: list[bytes] = []
    if b"idx1" in found and b"movi" in found:
        start, end = found[b"idx1"]
        base = None
        for name, _, offset, size in struct.iter_unpack("<4sIII", data[start : end - (end - start) % 16]):
            if name[2:] not in (b"dc", b"db"):
                continue
            if base is None:
                base = next((b for b in (found[b"movi"][0], 0) if data[b + offset : b + offset + 4] == name), None)
                if base is None:
                    raise ValueError("the index points elsewhere")
            frames.append(data[base + offset + 8 : base + offset + 8 + size])
    else:
        frames = [data[a:b] for a, b in listed]
    comment = data[slice(*found[b"ICMT"])].decode() if b"ICMT" in found else ""
    return {"frames": frames, "rate": rate, "scale": scale, "width": width, "height": height, "comment": comment}


def pack_bytes(raw: bytes) -> bytes:
    """An AVI file that holds bytes, zero-padded to a positive multiple of 64, as 8-bit samples of flat blocks."""
    n = max(COLUMNS, -(-len(raw) // COLUMNS) * COLUMNS)
    rows = min(ROWS, n // COLUMNS)
    count = -(-n // (rows * COLUMNS))
    samples = np.zeros(count * rows * COLUMNS, np.uint8)
    samples[: len(raw)] = np.frombuffer(raw, np.uint8)
    frames = [encode_samples(x) for x in samples.reshape(count, rows, COLUMNS)]
    return write_avi(frames, COLUMNS * 8, rows * 8, f"payload_bytes={n}")


def unpack_bytes(avi: dict, frames: list[np.ndarray]) -> bytes:
    """The padded bytes that pack_bytes stored, from a parsed file and its frames' block means."""
    n = int(avi["comment"].partition("payload_bytes=")[2])
    return b"".join(x.tobytes() for x in frames)[:n]


def cuts(frames: list[np.ndarray], *, bins: int = 16, around: int = 8, factor: float = 3.0, least: float = 0.15) -> list[int]:
    """First frames of shots: where the histogram difference to the frame before stands out.

    The difference is half the sum of absolute differences of two normalised histograms (0 to 1). It is a cut when it
    is above `least` and above mean + factor * deviation of up to `around` differences on either side, and none of its
    neighbours is larger. The first frame begins a shot.
    """
    if not frames:
        return []
    shift = 8 - (bins - 1).bit_length()
    hists = np.stack([np.bincount(x.ravel() >> shift, minlength=bins) / max(1, x.size) for x in frames])
    diff = np.abs(np.diff(hists, axis=0)).sum(1) / 2
    out = [0]
    for k, d in enumerate(diff.tolist()):
        if d <= least:
            continue
        others = np.concatenate([diff[max(0, k - around) : k], diff[k + 1 : k + 1 + around]])
        limit = others.mean() + factor * others.std() if len(others) else least
        if d > limit and d >= max(diff[max(0, k - 1) : k + 2]):
            out.append(k + 1)
    return out


def clips(avi: dict, frames: list[np.ndarray]) -> list[dict]:
    """Timed clips between the cuts of a file."""
    starts = cuts(frames)
    second = avi["scale"] / avi["rate"] if avi["rate"] else 0.0
    return [
        {
            "clip": k,
            "first_frame": a,
            "last_frame": b - 1,
            "start_s": a * second,
            "end_s": b * second,
            "mean_luma": float(np.mean([x.mean() for x in frames[a:b]])),
        }
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True))
    ]


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes as an AVI motion-JPEG file.

    A null or empty text is 64 zero bytes. Equal texts give equal files. Rows may repeat; an empty table gives no
    rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            media = [pack_bytes(raw) for raw in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame) -> DataFrame:
    """stored with rate, scale, n_frames, payload and clips, read from its binary column media.

    payload is null for files that pack_bytes didn't write. For a null or broken file all of them are null. Columns of
    stored that have these names, in whatever case, are replaced. Rows may repeat; an empty table gives no rows.
    """
    made = ("rate", "scale", "n_frames", "payload", "clips")
    kept = [c for c in stored.columns if c.lower() not in made]
    place = [c.lower() for c in kept].index("media")
    # plain names inside: those of stored may repeat each other in Arrow
    stored = stored.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    names = stored.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()),
                                   ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_luma", pa.float64())]))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), clip)
        for part in _slices(batches):
            read = [_read(data) for data in part.column(place).to_pylist()]
            more = [pa.array([r[k] for r in read], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *more], [*names, *made]
            )

    read = stored.mapInArrow(run, f"{kinds}, rate int, scale int, n_frames int, payload binary, clips array<{_CLIP}>")
    return read.toDF(*kept, *made)


def _read(data: bytes | None) -> tuple:
    try:
        avi = read_avi(data or b"")
        frames = [block_means(x) for x in avi["frames"]]
    except (ValueError, KeyError, StopIteration, struct.error, IndexError):
        return None, None, None, None, None
    payload = unpack_bytes(avi, frames) if avi["comment"].startswith("payload_bytes=") else None
    return avi["rate"], avi["scale"], len(frames), payload, clips(avi, frames)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def clip_rows(read: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per timed clip: id_col, clip, first_frame, last_frame, start_s, end_s, mean_luma."""
    return read.select(id_col, F.inline("clips"))

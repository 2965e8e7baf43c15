"""Baseline JPEG frames in numpy: coefficients, block means, pixels, and an exact form for samples."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the JPEG standard: the order in which a block's coefficients are coded.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21,
     28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61,
     54, 47, 55, 62, 63]
)


@dataclass
class Huffman:
    """Code lengths of 1 to 16 bits and the symbols in the order of their codes."""

    counts: list[int]
    symbols: list[int]

    def codes(self) -> dict[tuple[int, int], int]:
        """(length, code) -> symbol."""
        out, code, k = {}, 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                out[length, code] = self.symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def segment(self, kind: int, place: int) -> bytes:
        return bytes([kind << 4 | place, *self.counts, *self.symbols])


#: A category s is followed by s bits, and its code here has 9 - s bits: every difference takes 9 bits.
EVEN_DC = Huffman([1] * 9 + [0] * 7, list(range(8, -1, -1)))
#: One code of one bit: the end of a block.
ONLY_END = Huffman([1] + [0] * 15, [0])


def _even_codes() -> np.ndarray:
    """10-bit codes (difference, end of block) of the differences -255 to 255."""
    code = {s: (c, n) for (n, c), s in EVEN_DC.codes().items()}
    out = []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        bits = d if d >= 0 else d + (1 << s) - 1
        out.append((code[s][0] << s | bits) << 1)
    return np.array(out, np.uint64)


_CODE = _even_codes()
_VALUE = np.zeros(1024, np.int64)
_VALUE[_CODE] = np.arange(-255, 256)


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_TABLES = (
    b"\xff\xd8"
    + _marker(0xDB, bytes([0, 8] + [1] * 63))
    + _marker(0xC4, EVEN_DC.segment(0, 0))
    + _marker(0xC4, ONLY_END.segment(1, 0))
)
_SCAN = _marker(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_samples(samples: np.ndarray) -> bytes:
    """A baseline grey JPEG whose 8x8 blocks are flat, one per sample of a (rows, columns) uint8 array.

    The quantiser of the mean is 8, so any decoder gives each block exactly its sample's value. rows * columns must be
    a multiple of 4.
    """
    rows, columns = samples.shape
    code = _CODE[np.diff(samples.ravel().astype(np.int64), prepend=128) + 255].reshape(-1, 4)
    word = code[:, 0] << 30 | code[:, 1] << 20 | code[:, 2] << 10 | code[:, 3]
    scan = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    size = _marker(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
    return _TABLES + size + _SCAN + scan + b"\xff\xd9"


@dataclass
class Component:
    key: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Frame:
    """A parsed frame: sizes, tables, and the coded scan."""

    width: int = 0
    height: int = 0
    restart: int = 0
    parts: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], Huffman] = field(default_factory=dict)
    scan: bytes = b""


def parse(data: bytes) -> Frame:
    """Read the markers of a baseline JPEG. ValueError for other kinds or broken data."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    f, at = Frame(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        if kind == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                step = 128 if wide else 64
                f.quantisers[key] = np.frombuffer(body[1 : 1 + step], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + step :]
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                total = sum(counts)
                f.huffman[body[0] >> 4, body[0] & 15] = Huffman(counts, list(body[17 : 17 + total]))
                body = body[17 + total :]
        elif kind == 0xC0:
            depth, f.height, f.width, count = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples")
            for k in range(count):
                key, sampling, q = body[6 + 3 * k : 9 + 3 * k]
                f.parts.append(Component(key, sampling >> 4, sampling & 15, q))
        elif kind == 0xDD:
            (f.restart,) = struct.unpack(">H", body[:2])
        elif kind == 0xDA:
            for k in range(body[0]):
                key, tables = body[1 + 2 * k : 3 + 2 * k]
                part = next(p for p in f.parts if p.key == key)
                part.dc, part.ac = tables >> 4, tables & 15
            end = data.rfind(b"\xff\xd9")
            f.scan = data[at + 2 + n : end if end > 0 else len(data)]
            return f
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames")
        at += 2 + n
    raise ValueError("no scan")


def _even(f: Frame) -> bool:
    if len(f.parts) != 1 or f.restart:
        return False
    p = f.parts[0]
    return f.huffman.get((0, p.dc)) == EVEN_DC and f.huffman.get((1, p.ac)) == ONLY_END


def block_means(data: bytes) -> np.ndarray:
    """The mean of each 8x8 block of a frame's first component (its luma), rounded and clipped to 0..255.

    Frames whose blocks all take 10 bits, as encode_samples writes them, are read at once; others bit by bit.
    """
    f = parse(data)
    if _even(f):
        rows, columns = -(-f.height // 8), -(-f.width // 8)
        n = rows * columns
        raw = np.frombuffer(f.scan.replace(b"\xff\x00", b"\xff"), np.uint8)
        if n % 4 == 0 and len(raw) >= n * 10 // 8:
            eight = np.zeros((n // 4, 8), np.uint8)
            eight[:, 3:] = raw[: n * 10 // 8].reshape(-1, 5)
            word = eight.view(">u8").astype(np.uint64)[:, 0]
            code = np.stack([word >> 30, word >> 20, word >> 10, word], 1).astype(np.int64) & 1023
            mean = np.cumsum(_VALUE[code].ravel())
            return _sample(mean * f.quantisers[f.parts[0].quantiser][0]).reshape(rows, columns)
    first = _coefficients(f)[0]
    means = _sample(first.blocks[:, :, 0] * f.quantisers[first.quantiser][0])
    return means[: -(-f.height // 8), : -(-f.width // 8)]


def _sample(mean: np.ndarray) -> np.ndarray:
    return np.clip((mean + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _coefficients(f: Frame) -> list[Component]:
    """Decode a scan bit by bit into quantised coefficients, in zigzag order, of each component's blocks."""
    most_across, most_down = max(p.across for p in f.parts), max(p.down for p in f.parts)
    if len(f.parts) == 1:
        f.parts[0].across = f.parts[0].down = most_across = most_down = 1
    wide, high = -(-f.width // (8 * most_across)), -(-f.height // (8 * most_down))
    for p in f.parts:
        p.blocks = np.zeros((high * p.down, wide * p.across, 64), np.int64)
    tables = {key: table.codes() for key, table in f.huffman.items()}
    pieces = _restarts(f.scan) if f.restart else [f.scan]
    units = iter(range(wide * high))
    for piece in pieces:
        bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
        last = [0] * len(f.parts)
        for _, unit in zip(range(f.restart or wide * high), units, strict=False):
            y, x = divmod(unit, wide)
            for k, p in enumerate(f.parts):
                for dy in range(p.down):
                    for dx in range(p.across):
                        block = p.blocks[y * p.down + dy, x * p.across + dx]
                        last[k] += bits.signed(bits.symbol(tables[0, p.dc]))
                        block[0] = last[k]
                        at = 1
                        while at < 64:
                            run = bits.symbol(tables[1, p.ac])
                            if run == 0:
                                break
                            at += run >> 4
                            if run & 15:
                                block[at] = bits.signed(run & 15)
                            at += 1
            if bits.ended():
                return f.parts
    return f.parts


def _restarts(scan: bytes) -> list[bytes]:
    out, begin, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[begin:at])
            begin = at + 2
        at = scan.find(b"\xff", at + 2)
    return [*out, scan[begin:]]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def ended(self) -> bool:
        return self.at > 8 * len(self.data)

    def take(self, n: int) -> int:
        """The next n bits; ones after the end."""
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last].ljust(last - first, b"\xff"), "big")
        self.at += n
        return word >> (last * 8 - self.at) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        if self.ended():
            return 0
        raise ValueError("a code is unknown")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        bits = self.take(n)
        return bits if bits >> (n - 1) else bits - (1 << n) + 1


def decode_luma(data: bytes) -> np.ndarray:
    """The pixels of a frame's first component."""
    f = parse(data)
    p = _coefficients(f)[0]
    spread = np.zeros(p.blocks.shape, float)
    spread[..., ZIGZAG] = p.blocks * f.quantisers[p.quantiser]
    k = np.arange(8)
    cosine = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    pixels = np.einsum("xu,rcuv,yv->rcxy", cosine, spread.reshape(*p.blocks.shape[:2], 8, 8), cosine)
    rows, columns = p.blocks.shape[:2]
    full = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
    most_across, most_down = max(x.across for x in f.parts), max(x.down for x in f.parts)
    return full[: -(-f.height * p.down // most_down), : -(-f.width * p.across // most_across)]

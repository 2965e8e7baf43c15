import hashlib
import zlib

import numpy as np
import pytest

from kestrel.llm import jpeg, media, queries


def test_samples_survive_and_blocks_are_flat():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 256, (6, 64)), np.zeros((1, 64)), np.full((2, 64), 255), np.tile([0, 255], (3, 32))):
        x = x.astype(np.uint8)
        data = jpeg.encode_samples(x)
        assert (jpeg.block_means(data) == x).all()
        assert (jpeg.decode_luma(data) == np.kron(x, np.ones((8, 8), np.uint8))).all()


def other_encoder(pixels, quantiser, restart=0, colour=False):
    """A plain encoder with 8-bit codes; colour adds two flat components of half the resolution."""
    k = np.arange(8)
    cosine = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    symbols = sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0})
    dc = jpeg.Huffman([0] * 7 + [12] + [0] * 8, list(range(12)))
    ac = jpeg.Huffman([0] * 7 + [len(symbols)] + [0] * 8, symbols)
    bits, scan, unit, last = [], b"", 0, [0, 0, 0]

    def put(value, n):
        bits.extend(value >> (n - 1 - i) & 1 for i in range(n))

    def number(v):
        s = abs(v).bit_length()
        return s, v if v >= 0 else v + (1 << s) - 1

    def flush():
        nonlocal scan, bits
        bits += [1] * (-len(bits) % 8)
        scan += np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") if bits else b""
        bits = []

    def block(q, k):
        s, b = number(int(q[0] - last[k]))
        last[k] = q[0]
        put(s, 8)
        put(b, s)
        run = 0
        for v in q[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(symbols.index(0xF0), 8)
                run -= 16
            s, b = number(int(v))
            put(symbols.index(run << 4 | s), 8)
            put(b, s)
            run = 0
        if run:
            put(symbols.index(0), 8)

    def coded(tile):
        return np.rint((cosine.T @ (tile - 128.0) @ cosine).ravel()[jpeg.ZIGZAG] / quantiser).astype(int)

    step = 16 if colour else 8
    h, w = pixels.shape
    for y in range(0, h, step):
        for x in range(0, w, step):
            if restart and unit and unit % restart == 0:
                flush()
                scan += bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
                last = [0, 0, 0]
            for dy in range(0, step, 8):
                for dx in range(0, step, 8):
                    block(coded(pixels[y + dy : y + dy + 8, x + dx : x + dx + 8]), 0)
            if colour:
                block(coded(np.full((8, 8), 90)), 1)
                block(coded(np.full((8, 8), 160)), 2)
            unit += 1
    flush()
    parts = [(1, 0x22 if colour else 0x11)] + [(2, 0x11), (3, 0x11)] * colour
    out = b"\xff\xd8" + jpeg._marker(0xDB, bytes([0, *quantiser])) + jpeg._marker(0xC4, dc.segment(0, 0)) + jpeg._marker(0xC4, ac.segment(1, 0))
    if restart:
        out += jpeg._marker(0xDD, restart.to_bytes(2, "big"))
    out += jpeg._marker(0xC0, bytes([8, *h.to_bytes(2, "big"), *w.to_bytes(2, "big"), len(parts)]) + b"".join(bytes([k, s, 0]) for k, s in parts))
    return out + jpeg._marker(0xDA, bytes([len(parts)]) + b"".join(bytes([k, 0]) for k, _ in parts) + bytes([0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart,colour", [(0, False), (3, False), (0, True), (2, True)])
def test_frames_of_another_encoder(restart, colour):
    y, x = np.mgrid[0:32, 0:48]
    pixels = (120 + 60 * np.sin(x / 5) + 40 * np.cos(y / 4)).astype(int)
    data = other_encoder(pixels, np.full(64, 2), restart, colour)
    assert np.abs(jpeg.decode_luma(data).astype(int) - pixels).max() <= 4
    means = pixels.reshape(4, 8, 6, 8).mean((1, 3))
    assert np.abs(jpeg.block_means(data) - means).max() <= 1


def test_index_offsets_and_missing_index():
    frames = [jpeg.encode_samples(np.full((1, 64), k, np.uint8)) for k in range(3)]
    data = media.write_avi(frames, 512, 8, rate=30000, scale=1001)
    assert media.read_avi(data)["frames"] == frames
    cut = data.index(b"idx1")
    assert media.read_avi(data[:cut])["frames"] == frames
    movi = data.index(b"movi")
    index = bytearray(data[cut:])
    for k in range(3):
        at = 8 + 16 * k + 8
        index[at : at + 4] = (int.from_bytes(index[at : at + 4], "little") + movi).to_bytes(4, "little")
    assert media.read_avi(data[:cut] + bytes(index))["frames"] == frames
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFxxxxWAVE")


def test_cuts():
    rng = np.random.default_rng(2)
    shots = [rng.integers(low, low + 40, (9, 8, 64)).astype(np.uint8) for low in (0, 100, 200, 30)]
    frames = [f for shot in shots for f in shot]
    assert media.cuts(frames) == [0, 9, 18, 27]
    assert media.cuts(frames[:9]) == [0] and media.cuts([]) == []
    timed = media.clips({"rate": 25, "scale": 1}, frames)
    assert [(c["first_frame"], c["last_frame"], c["start_s"]) for c in timed] == [(0, 8, 0.0), (9, 17, 0.36), (18, 26, 0.72), (27, 35, 1.08)]


def plain_cuts(frames):
    """First frames of shots, by plain loops over lists of samples."""
    hists = []
    for f in frames:
        h = [0.0] * 16
        for x in f:
            h[x >> 4] += 1 / len(f)
        hists.append(h)
    diff = [sum(abs(a - b) for a, b in zip(p, q)) / 2 for p, q in zip(hists, hists[1:])]
    out = [0]
    for k, d in enumerate(diff):
        others = diff[max(0, k - 8) : k] + diff[k + 1 : k + 9]
        limit = 0.15
        if others:
            mean = sum(others) / len(others)
            limit = mean + 3 * (sum((x - mean) ** 2 for x in others) / len(others)) ** 0.5
        if d > 0.15 and d > limit and d >= max(diff[max(0, k - 1) : k + 2]):
            out.append(k + 1)
    return out


def test_clips_of_stored_texts_against_plain_loops(spark):
    parts = ["aaaa bbb " * 2500, "0123 456 " * 3000, "ZZZZ QQQ " * 2000]
    rows = [(0, "".join(parts)), (1, "short"), (2, None), (3, parts[0] + parts[2]), (4, "é漢字 " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = 0
    for r in media.read_media(media.store_texts(docs)).collect():
        payload = bytes(r["payload"])
        size = min(64 * 64, len(payload))
        padded = payload + bytes(-len(payload) % size)
        frames = [padded[k : k + size] for k in range(0, len(padded), size)]
        assert r["n_frames"] == len(frames)
        starts = plain_cuts(frames)
        assert [c["first_frame"] for c in r["clips"]] == starts
        for c, a, b in zip(r["clips"], starts, [*starts[1:], len(frames)]):
            assert c["last_frame"] == b - 1 and (c["start_s"], c["end_s"]) == pytest.approx((a / media.RATE, b / media.RATE))
            assert c["mean_luma"] == pytest.approx(sum(map(sum, frames[a:b])) / (size * (b - a)))
        cut += len(starts) > 1
    assert cut >= 2


def test_round_trip(made, nothing):
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(made)).collect()}
    for row in made.collect():
        raw = (row["text"] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[row["doc_id"]]
        assert bytes(r["payload"]) == padded and r["n_bytes"] == len(raw)
        assert zlib.crc32(bytes(r["payload"])[-64:]) == zlib.crc32(padded[-64:])
        assert r["clips"][-1]["last_frame"] == r["n_frames"] - 1
    assert media.read_media(media.store_texts(nothing)).collect() == []
    assert media.clip_rows(media.read_media(media.store_texts(made))).count() >= len(got)


def test_query_counts_bytes_of_texts_beyond_ascii(spark, tmp_path):
    texts = [None, "", "a" * 64, "a" * 4097, "é" * 40, "ÿ" * 70, "x" * 70 + "😀", "漢字 é " * 5000, "\0" * 65]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[k] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    got = queries.op4_media(spark, str(tmp_path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_broken_files(spark):
    rows = spark.createDataFrame([(1, None), (2, b"abc"), (3, bytearray(b"RIFF\0\0\0\0AVI "))], "k int, media binary")
    assert {r["n_frames"] for r in media.read_media(rows).collect()} == {None}

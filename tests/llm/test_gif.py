import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import gif


def slow_decode(packed: bytes, bits: int) -> bytes:
    """Code by code, with the entries kept as texts."""
    number, have = int.from_bytes(packed, "little"), len(packed) * 8
    clear, at, width, out, made, last = 1 << bits, 0, bits + 1, b"", {}, None
    while at + width <= have:
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            made, width, last = {}, bits + 1, None
            continue
        if code == clear + 1:
            break
        text = bytes([code]) if code < clear else made.get(code, (last or b"") + (last or b"")[:1])
        if last is not None and len(made) + clear + 2 < 4096:
            made[len(made) + clear + 2] = last + text[:1]
            if len(made) + clear + 2 == 1 << width and width < 12:
                width += 1
        out, last = out + text, text
    return out


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text("ab", max_size=9000).map(str.encode), st.integers(0, 20000).map(bytes)))
def test_codes_round_trip(data):
    packed = gif.lzw_encode(data)
    assert gif.lzw_decode(packed, 8, len(data) + 5) == data == slow_decode(packed, 8)


def test_a_stretch_that_never_clears():
    draw = np.random.default_rng(3)
    data = draw.integers(0, 4, 60_000).astype(np.uint8).tobytes()
    # codes of two bits by a plain encoder that stops making entries at 4096
    made, codes, at = {bytes([i]): i for i in range(4)}, [4], b""
    for b in data:
        if at + bytes([b]) in made:
            at += bytes([b])
            continue
        codes.append(made[at])
        if len(made) + 2 < 4096:
            made[at + bytes([b])] = len(made) + 2
        at = bytes([b])
    codes += [made[at], 5]
    number = place = 0
    for j, c in enumerate(codes):
        width = 3 if j == 0 else min(12, max(3, (6 + max(j - 2, 0)).bit_length()))
        number |= c << place
        place += width
    packed = number.to_bytes((place + 7) // 8, "little")
    assert gif.lzw_decode(packed, 2, len(data)) == data


def picture(frames, palette, size):
    """A small GIF by hand: frames of (left, top, rows of indexes, disposal, clear index, interlaced)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, 0, 0) + bytes(palette)
    for left, top, rows, disposal, clear, laced in frames:
        a = np.array(rows, dtype=np.uint8)
        if laced:
            h = len(a)
            a = a[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]]
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, a.shape[1], a.shape[0], 0x40 if laced else 0) + b"\x08" + gif._blocks(gif.lzw_encode(a.tobytes()))
    return out + b"\x3b"


def test_palette_transparency_disposal_and_interlace():
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    whole = [[1] * 4] * 9
    data = picture([(0, 0, whole, 1, None, True), (1, 1, [[2, 0], [0, 2]], 3, 0, False), (0, 0, [[3]], 2, None, False), (3, 8, [[2]], 0, None, False)], palette, (4, 9))
    a, b, c, d = (f["picture"] for f in gif.read_gif(data))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert (a == red).all()
    assert b[1, 1].tolist() == green and b[1, 2].tolist() == red and b[2, 2].tolist() == green
    assert c[0, 0].tolist() == blue and c[1, 1].tolist() == red  # the frame before was taken back
    assert d[0, 0].tolist() == [0, 0, 0, 0] and d[8, 3].tolist() == green  # cleared to the background
    assert sum(gif.histogram(d)) == 35
    laced = gif.read_gif(picture([(0, 0, [[i % 4] for i in range(9)], 0, None, True)], palette, (1, 9)))
    assert laced[0]["samples"].ravel().tolist() == [i % 4 for i in range(9)]
    assert gif.read_gif(b"nothing") is None


def test_damaged_files_give_what_came_before():
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    data = picture([(0, 0, [[1] * 4] * 9, 1, None, True), (1, 1, [[2, 0], [0, 2]], 3, 0, False)], palette, (4, 9))
    whole = gif.read_gif(data)
    for cut in range(len(data)):
        got = gif.read_gif(data[:cut])
        if cut < 25:
            assert got is None
            continue
        assert len(got) <= 2
        for a, b in zip(got[:-1], whole, strict=False):
            assert (a["picture"] == b["picture"]).all()
    draw = np.random.default_rng(4)
    for _ in range(500):
        bad = bytearray(data)
        for at in draw.integers(0, len(data), 3):
            bad[at] = draw.integers(0, 256) if at > 10 else bad[at]
        gif.read_gif(bytes(bad[: draw.integers(0, len(data) + 1)]))


def test_texts_abreast_have_the_codes_of_each_by_itself(monkeypatch):
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, most, n).astype(np.uint8).tobytes() for most in (1, 2, 20, 256) for n in (1, 2, 63, 700, 5000, 9000)]
    texts += [b"", b"a line that comes again\n" * 400, bytes(range(256)) * 30, draw.integers(0, 256, 40_000).astype(np.uint8).tobytes()]
    alone = [gif.lzw_encode(x) for x in texts]
    assert [slow_decode(x, 8) for x in alone] == texts
    single, plain = [], gif.lzw_encode
    monkeypatch.setattr(gif, "lzw_encode", lambda x: single.append(len(x)) or plain(x))
    monkeypatch.setattr(gif, "ABREAST", 1)
    monkeypatch.setattr(gif, "ENTRIES", 1 << 16)
    monkeypatch.setattr(gif, "CELLS", 2_000)
    assert gif.lzw_encode_all(texts) == alone and sorted(single) == [0, 40_000]  # by themselves: the empty and the very long
    assert gif.lzw_encode_all([]) == []


def test_a_batch_is_not_encoded_one_by_one(monkeypatch):
    draw = np.random.default_rng(6)
    payloads = [draw.integers(97, 105, 64 * n).astype(np.uint8).tobytes() for n in draw.integers(1, 9, 900)]
    files = [gif.write_gif(x) for x in payloads[:5]]
    monkeypatch.setattr(gif, "lzw_encode", None)
    got = gif.write_gifs(payloads)
    assert got[:5] == files
    assert all(b"".join(f["samples"].tobytes() for f in gif.read_gif(g)) == x for g, x in zip(got, payloads, strict=True))


def test_counted_samples_are_those_of_the_pictures(monkeypatch):
    draw = np.random.default_rng(7)
    palette = draw.integers(0, 256, 12).tolist()
    for _ in range(60):
        frames = []
        for _ in range(draw.integers(1, 7)):
            whole = draw.random() < 0.5
            left, top, w, h = (0, 0, 5, 6) if whole else (int(x) for x in draw.integers((0, 0, 1, 1), (5, 6, 6, 7)))
            frames.append((left, top, draw.integers(0, 7, (h, w)), int(draw.integers(0, 4)), [None, 0, 2][draw.integers(0, 3)], bool(draw.integers(0, 2))))
        data = picture(frames, palette, (5, 6))
        want = [(f["delay"], f["samples"].tobytes(), gif.histogram(f["picture"])) for f in gif.shots(data)]
        assert [(f["delay"], f["samples"].tobytes(), colours) for f, colours in gif.counted(data)] == want
    monkeypatch.setattr(gif, "histogram", None)  # frames that hide all behind them need no picture
    data = gif.write_gif(bytes(64) + b"a" * 64)
    assert [colours for _, colours in gif.counted(data)] == [[64, *[0] * 20, 64, *[0] * 42]]


def test_long_stretches_in_pieces(monkeypatch):
    monkeypatch.setattr(gif, "PIECE", 100)
    draw = np.random.default_rng(8)
    for data in (bytes(20_000), b"words and words " * 900, draw.integers(0, 3, 12_000).astype(np.uint8).tobytes()):
        packed = gif.lzw_encode(data)
        for most in (1, 99, 5_000, len(data) + 1):
            assert gif.lzw_decode(packed, 8, most) == data[:most]


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gif, "ROWS", 3)
    rows = [(1, None, "x"), (2, "", "y"), (3, "é" * 500, "z"), (3, "é" * 500, "z"), (None, "abc", "m"), (5, "x" * 64, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = gif.op3_gif_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "").encode() for i, t, _ in rows if i == r.doc_id)
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert gif.frames(gif.store(docs.where("doc_id = 2"))).select("at_ms", "delay_ms", "width", "height").first()[:] == (0, 40, 64, 1)
    assert gif.read(gif.store(docs.limit(0))).count() == 0

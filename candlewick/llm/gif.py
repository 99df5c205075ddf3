"""Operator 3, media columns: GIF.

A GIF reader and writer that work on one row's bytes inside a task, and DataFrame operators around them:
``store`` turns payload bytes into GIF files, ``frames`` and ``read`` turn GIF files into timed frames with
colour histograms. The reader knows LZW code streams of all widths, local and global palettes, interlacing,
transparency, and the disposal of earlier frames.

Codes of one stretch between clear codes have widths that follow from their place alone, so numpy unpacks a
stretch at once. The entry that code i makes is the output of step i and one byte more, so every byte of the output
is a copy of an earlier one or stands for itself; doubling those ways finds all bytes at once.

The payload is stored as 8-bit samples: pixels that index a grey palette, SIDE wide, in frames of at most
ROWS rows. Both steps are maps over rows: no shuffle, and memory for one batch.
Texts of like length are encoded abreast, a byte of each at a time; the codes are those of each by itself.

Frames are made one at a time on one canvas, so a film costs the memory of a picture and of its samples.

Defined cases: a null text or payload is empty; an empty one becomes one row of zero samples; repeated
rows give equal files; long payloads become several frames; an empty table gives an empty result; a file
that is no GIF, is cut off in its header or claims more than PIXELS, gives null; one that is cut off or damaged later gives the frames before
the damage, and of a frame whose code stream breaks off the rest as zeros; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import materialize, table

SIDE = 64  # samples in a row, and the payload's padding
ROWS = 4096  # rows in a frame
PIXELS = 1 << 26  # a larger picture or frame counts as damage: its memory isn't set aside
DELAY = 4  # hundredths of a second that a frame stands
BITS = 8
CLEAR, END, FIRST = 1 << BITS, (1 << BITS) + 1, (1 << BITS) + 2
STRETCH = 4096 - FIRST  # codes after which the writer clears
ABREAST = 200  # texts, or the bytes of shorter ones, from which on encoding them abreast is faster than one by one
LONG = 1 << 15  # texts of more bytes are encoded by themselves
ENTRIES = 1 << 23  # places for entries of the texts that are encoded abreast, of four bytes each
CELLS = 1 << 20  # places of their codes that are packed at once
PIECE = 1 << 18  # samples that are unpacked at once
GREY = bytes(b for v in range(256) for b in (v, v, v))


@lru_cache
def _all_widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    free = (1 << bits) + 2 + np.maximum(np.arange(1 << 13) - 1, 0)
    width = np.minimum(np.maximum(np.floor(np.log2(free)).astype(np.int32) + 1, bits + 1), 12)
    return width, np.cumsum(width, dtype=np.int32)


def _packed(codes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Code streams packed from the lowest bit. ``first``: where each stream begins in codes, with a clear code."""
    place = np.arange(len(codes))
    clear = np.maximum.accumulate(np.where(codes == CLEAR, place, 0))
    # the first clear code is BITS + 1 wide, any other as wide as the code in its place would be
    nth = np.zeros(len(codes), dtype=np.int64)
    nth[1:] = place[:-1] - clear[:-1]
    nth[first] = 0
    width = _all_widths(BITS)[0][nth]
    start = np.cumsum(width, dtype=np.int64) - width
    count = np.diff(first, append=len(codes))
    last = first + count - 1
    size = (start[last] + width[last] - start[first] + 7) >> 3
    end = np.cumsum(size)
    start += np.repeat(8 * (end - size) - start[first], count)
    value, byte = codes.astype(np.int32) << (start & 7).astype(np.int32), start >> 3
    out = np.zeros(int(end[-1]) + 3, dtype=np.uint8)
    for k in range(3):  # codes share bytes but no bits, and no two begin in one byte
        out[byte + k] |= (value >> 8 * k).astype(np.uint8)
    whole = out.tobytes()
    return [whole[z - n : z] for n, z in zip(size.tolist(), end.tolist(), strict=True)]


def lzw_encode(data: bytes) -> bytes:
    """LZW codes of 8-bit samples, packed from the lowest bit; starts with a clear code, ends with the end code."""
    codes: list[int] = [CLEAR]
    put = codes.append
    made: dict[int, int] = {}
    get, free, at = made.get, FIRST, 0
    if data:
        at = data[0]
        for b in memoryview(data)[1:]:
            key = at << 8 | b
            at = get(key)
            if at is None:
                put(key >> 8)
                made[key] = free
                free += 1
                at = b
                if free == 4096:
                    put(CLEAR)
                    made.clear()
                    free = FIRST
        put(at)
    put(END)
    return _packed(np.array(codes), np.zeros(1, dtype=np.int64))[0]


def _abreast(texts: list[bytes]) -> list[bytes]:
    """The streams of lzw_encode for texts that aren't empty, the longest first, a byte of each at a time. The entries of
    each text are in a hash table of its own: key (code and byte) and entry in one number, the next place where one is taken."""
    lanes, most = len(texts), len(texts[0])
    slots = _slots(most)
    grid = np.zeros((lanes, most), dtype=np.uint8)
    for row, x in zip(grid, texts, strict=True):
        row[: len(x)] = np.frombuffer(x, dtype=np.uint8)
    grid = np.ascontiguousarray(grid.T)
    lengths = np.array([len(x) for x in texts])
    going = (lanes - np.searchsorted(lengths[::-1], np.arange(most), side="right")).tolist()  # texts that have a byte there
    none = np.uint32(0xFFFFFFFF)
    entries, home = np.full(lanes * slots, none), np.arange(lanes) * slots
    shift = np.uint32(32 - slots.bit_length() + 1)
    at, free = grid[0].astype(np.uint32), np.full(lanes, FIRST, dtype=np.uint32)
    put = np.full((most + 2, lanes), -1, dtype=np.int16)
    put[0] = CLEAR
    for i in range(1, most):
        n = going[i]
        b = grid[i, :n].astype(np.uint32)
        key = at[:n] << 8 | b
        slot = home[:n] + (key * np.uint32(2654435761) >> shift)
        entry = entries[slot]
        miss = np.flatnonzero(entry >> 12 != key)
        goes = slot[miss]  # where the new entry goes, unless another is there
        taken = np.flatnonzero(entry[miss] != none)
        if len(taken):
            which = miss[taken]
            look, low, wanted = goes[taken], home[which], key[which]
            while True:
                look = low + (look + 1 & slots - 1)
                found = entries[look]
                same = found >> 12 == wanted
                stop = same | (found == none)
                if stop.all():
                    break
                look -= stop  # those stay where they are
            entry[which], goes[taken] = found, look
            new = np.ones(len(miss), dtype=bool)
            new[taken] = ~same
            miss, goes = miss[new], goes[new]
        put[i, miss] = at[miss]
        made = free[miss]
        entries[goes] = key[miss] << 12 | made
        free[miss] = made + 1
        at[:n] = entry & 4095
        at[miss] = b[miss]
        for j in miss[made == 4095].tolist() if i >= STRETCH else ():
            entries[j * slots : (j + 1) * slots] = none
            free[j] = FIRST
            put[i, j] |= 4096  # a clear code follows
    put[most], put[most + 1] = at, END
    streams: list[bytes] = []
    some = max(1, CELLS // most)
    for j in range(0, lanes, some):
        streams += _streams(put[:, j : j + some].T)
    return streams


def _streams(rows: np.ndarray) -> list[bytes]:
    """The streams of rows with a code or -1 at each place; 4096 and more stands for a code with a clear code behind it."""
    codes = rows[rows >= 0]
    twice = (codes >= 4096).astype(np.int64)
    end = np.cumsum(1 + twice)
    count = np.cumsum((rows >= 0).sum(axis=1))
    codes = np.repeat(codes & 4095, 1 + twice)
    codes[end[twice > 0] - 1] = CLEAR
    return _packed(codes, np.concatenate([[0], end[count[:-1] - 1]]))


def _slots(most: int) -> int:
    """Places for the entries of texts of so many bytes: a quarter of them is taken at most."""
    return 1 << (4 * min(most, STRETCH)).bit_length()


def lzw_encode_all(texts: list[bytes]) -> list[bytes]:
    """lzw_encode of each text. Texts of like length go abreast where that pays, others by themselves."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    total = [0, *accumulate(len(texts[i]) for i in order)]
    out: dict[int, bytes] = {}
    at = 0
    while at < len(order):
        most = len(texts[order[at]])
        end = min(len(order), at + ENTRIES // _slots(most))
        if 0 < most <= LONG and total[end] - total[at] >= ABREAST * most:
            some = [i for i in order[at:end] if texts[i]]
            out |= zip(some, _abreast([texts[i] for i in some]), strict=True)
            at += len(some)
        else:
            out[order[at]] = lzw_encode(texts[order[at]])
            at += 1
    return [out[i] for i in range(len(texts))]


def _unpack(raw: np.ndarray, start: int, width: np.ndarray) -> np.ndarray:
    at = np.cumsum(width) - width + start
    byte = at >> 3
    return raw[byte] >> (at & 7).astype(np.int32) & ((1 << width) - 1)


def _texts(codes: np.ndarray, clear: int, most: int) -> bytes:
    """The samples of a stretch whose codes all have entries; it stops once it has ``most``."""
    literal = codes < clear
    parent = np.where(literal, np.arange(len(codes)), codes - (clear + 2))  # an entry is the text of its code and one sample more
    size, at = (~literal).astype(np.int64), parent
    while (more := size[at]).any():
        size, at = size + more, at[at]
    size += 1
    end = np.cumsum(size)
    begin = end - size
    back = begin - begin[parent]  # how far before a text the one is that it repeats
    out = np.zeros(0, dtype=np.uint8)
    done = 0
    while done < len(codes) and len(out) < most:
        base = len(out)
        stop = min(len(codes), int(np.searchsorted(end, min(base + PIECE, most))) + 1)
        here, first = slice(done, stop), literal[done:stop]
        place = np.arange(int(end[stop - 1]) - base)
        way = place - np.repeat(back[here], size[here])  # each sample's like, at last one that points to itself
        part = np.zeros(len(way), dtype=np.uint8)
        part[begin[here][first] - base] = codes[here][first]
        old = np.flatnonzero(way < 0)
        part[old], way[old] = out[way[old] + base], old
        while not np.array_equal(far := way[way], way):
            way = far
        out = np.concatenate([out, part[way]])
        done = stop
    return out.tobytes()


def lzw_decode(packed: bytes, bits: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; what a damaged stream lacks is left out."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    raw = np.ndarray(len(packed) + 1, dtype="<i4", buffer=packed + bytes(4), strides=(1,))  # four bytes from each byte on
    left, start, out = len(packed) * 8, 0, bytearray()
    while len(out) < most:
        width, ends = _all_widths(bits)
        if start + ends[0] <= left and _unpack(raw, start, width[:1])[0] == clear:
            start += int(ends[0])
            continue
        while True:  # a longer look where a stretch goes on at full width
            n = int(np.searchsorted(ends, left - start, side="right"))
            codes = _unpack(raw, start, width[:n])
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or n < len(width):
                break
            width = np.concatenate([width, np.full(len(width), 12, dtype=np.int32)])
            ends = np.cumsum(width)
        n = int(stop[0]) if len(stop) else n
        lost = np.flatnonzero(codes[:n] - first >= np.arange(n))  # codes of entries that aren't made yet
        out += _texts(codes[: int(lost[0]) if len(lost) else n], clear, most - len(out))
        if len(lost):
            break
        if not len(stop) or codes[n] == end:
            break
        start += int(ends[n])
    return bytes(out[:most])


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gif(payload: bytes) -> bytes:
    """A GIF with the payload's bytes as samples; the payload is a positive multiple of SIDE long."""
    return write_gifs([payload])[0]


def write_gifs(payloads: list[bytes]) -> list[bytes]:
    """write_gif of each payload."""
    parts = [[x[i : i + ROWS * SIDE] for i in range(0, len(x), ROWS * SIDE)] for x in payloads]
    streams = iter(lzw_encode_all([part for x in parts for part in x]))
    files = []
    for x in parts:
        out = [b"GIF89a", struct.pack("<HHBBB", SIDE, len(x[0]) // SIDE, 0xF7, 0, 0), GREY]
        for part in x:
            out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 0, DELAY, 0) + b"\0")
            out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, len(part) // SIDE, 0) + bytes([BITS]) + _blocks(next(streams)))
        files.append(b"".join(out) + b"\x3b")
    return files


def _interlaced(rows: np.ndarray) -> np.ndarray:
    h, out = len(rows), np.empty_like(rows)
    out[np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])] = rows
    return out


def header(data: bytes) -> tuple[int, int, np.ndarray, int] | None:
    """(width, height, palette, where the blocks begin); None for what is no GIF or too short for one."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return None
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    if wide * high > PIXELS:
        return None
    if not flags & 0x80:
        return wide, high, np.frombuffer(GREY, dtype=np.uint8).reshape(-1, 3), 13
    palette = _palette(data, 13, flags)
    return (wide, high, palette, 13 + palette.size) if palette is not None else None


def _palette(data: bytes, at: int, flags: int) -> np.ndarray | None:
    n = 2 << (flags & 7)
    return np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3) if at + 3 * n <= len(data) else None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The blocks' bytes from ``at`` on, and where they end; what a cut-off file lacks is left out."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(parts), at + 1


def _placed(data: bytes) -> Iterator[dict]:
    """The frames of a GIF one by one, not yet painted: delay, place, samples, colours, clear index and disposal. Damage ends them."""
    _, _, palette, at = header(data)
    delay, clear_index, disposal = 0, None, 0
    while at + 1 < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            more, end = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(more) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", more)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            at = end
            continue
        if data[at] != 0x2C or at + 10 > len(data):
            return
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if flags & 0x80:
            colours = _palette(data, at, flags)
            if colours is None:
                return
            at += colours.size
        if at >= len(data) or not 1 <= data[at] <= 8 or w * h > PIXELS:
            return
        codes, end = _sub_blocks(data, at + 1)
        samples = lzw_decode(codes, data[at], w * h)
        at = end
        pixels = np.frombuffer(samples + bytes(w * h - len(samples)), dtype=np.uint8).reshape(h, w)
        if flags & 0x40:
            pixels = _interlaced(pixels)
        yield {"delay": delay * 10, "left": left, "top": top, "samples": pixels, "colours": colours, "clear": clear_index, "disposal": disposal}
        delay, clear_index, disposal = 0, None, 0


def _inside(canvas: np.ndarray, frame: dict) -> np.ndarray:
    h, w = frame["samples"].shape
    return canvas[frame["top"] : frame["top"] + h, frame["left"] : frame["left"] + w]


def _paint(canvas: np.ndarray, frame: dict) -> np.ndarray:
    inside, colours = _inside(canvas, frame), frame["colours"]
    shown = frame["samples"][: inside.shape[0], : inside.shape[1]]
    rgba = np.full((*shown.shape, 4), 255, dtype=np.uint8)
    rgba[..., :3] = colours[np.minimum(shown, len(colours) - 1)]
    if frame["clear"] is None:
        inside[:] = rgba
    else:
        inside[shown != frame["clear"]] = rgba[shown != frame["clear"]]
    return canvas


def _shown(canvas: np.ndarray, frame: dict) -> Iterator[np.ndarray]:
    """The canvas while the frame stands; behind that, what its disposal leaves is on it."""
    inside = _inside(canvas, frame)
    before = inside.copy() if frame["disposal"] == 3 else None
    yield _paint(canvas, frame)
    if frame["disposal"] == 2:
        inside[:] = 0
    elif frame["disposal"] == 3:
        inside[:] = before


def _blank(data: bytes) -> np.ndarray:
    wide, high, _, _ = header(data)
    return np.zeros((high, wide, 4), dtype=np.uint8)


def shots(data: bytes) -> Iterator[dict]:
    """The frames of a GIF one by one: delay, place and samples of each, and the whole picture (height x width x RGBA)
    that shows while it stands, which the next frame changes. Damage ends them."""
    canvas = _blank(data)
    for f in _placed(data):
        for picture in _shown(canvas, f):
            yield f | {"picture": picture}


def counted(data: bytes) -> Iterator[tuple[dict, list[int]]]:
    """The frames one by one with the histograms of their pictures. A frame that hides all behind it is counted by its
    samples and painted only where a later frame leaves some of it to be seen."""
    wide, high, _, _ = header(data)
    canvas, behind = None, None  # behind: a frame to be painted on an empty canvas, in place of canvas
    for f in _placed(data):
        h, w = f["samples"].shape
        if f["left"] == f["top"] == 0 and w >= wide and h >= high and f["clear"] is None:
            yield f, _of_samples(f["samples"][:high, :wide], f["colours"])
            if f["disposal"] != 3:
                canvas, behind = None, f if f["disposal"] != 2 else None
            continue
        if canvas is None:
            canvas = _blank(data) if behind is None else _paint(_blank(data), behind)
        for picture in _shown(canvas, f):
            yield f, histogram(picture)


def read_gif(data: bytes) -> list[dict] | None:
    """All frames with pictures of their own. None for what is no GIF."""
    return None if header(data) is None else [f | {"picture": f["picture"].copy()} for f in shots(data)]


def histogram(picture: np.ndarray) -> list[int]:
    """Pixels of a picture by colour, four steps for each of red, green and blue; clear pixels don't count."""
    steps = picture >> 6
    bins = steps[..., 0] * 16 + steps[..., 1] * 4 + steps[..., 2]
    return np.bincount(bins[picture[..., 3] > 0], minlength=64).tolist()


def _of_samples(samples: np.ndarray, colours: np.ndarray) -> list[int]:
    """The histogram of a picture whose pixels all have one of the colours."""
    shade = colours[np.minimum(np.arange(256), len(colours) - 1)] >> 6
    found = np.zeros(64, dtype=np.int64)
    np.add.at(found, shade[:, 0] * 16 + shade[:, 1] * 4 + shade[:, 2], np.bincount(samples.ravel(), minlength=256))
    return found.tolist()


FRAME = pa.struct([("at_ms", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int32()))])
SHOT = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("at_ms", "delay_ms", "width", "height")), T.StructField("histogram", T.ArrayType(T.IntegerType()))])
MEDIA = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("frames", T.ArrayType(SHOT))])


@F.arrow_udf(T.BinaryType())
def encode(payloads: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Payload bytes (padded with zeros to whole rows) as GIF files."""
    for batch in payloads:
        texts = [x or b"" for x in batch.to_pylist()]
        yield pa.array(write_gifs([x + bytes(-len(x) % SIDE if x else SIDE) for x in texts]), type=pa.binary())


@F.arrow_udf(MEDIA)
def decode(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """GIF files as all frames' samples in order, and the frames with their times and histograms."""
    for batch in files:
        payloads, frames = [], []
        for x in batch.to_pylist():
            if not x or header(x) is None:
                payloads.append(None)
                frames.append(None)
                continue
            clock, rows, samples = 0, [], []
            for f, colours in counted(x):
                rows.append({"at_ms": clock, "delay_ms": f["delay"], "width": f["samples"].shape[1], "height": f["samples"].shape[0], "histogram": colours})
                clock += f["delay"]
                samples.append(f["samples"].tobytes())
            payloads.append(b"".join(samples))
            frames.append(rows)
        yield pa.StructArray.from_arrays([pa.array(payloads, type=pa.binary()), pa.array(frames, type=pa.list_(FRAME))], names=["payload", "frames"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a GIF, written to the shared folder and read again."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return materialize(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), encode(text).alias("media")), "gif")


def read(stored: DataFrame) -> DataFrame:
    """stored with the struct ``read`` of payload and frames, from the column media."""
    return stored.withColumn("read", decode("media"))


def frames(stored: DataFrame) -> DataFrame:
    """One row for each timed frame: doc_id, frame, at_ms, delay_ms, width, height, histogram."""
    return read(stored).select("doc_id", F.posexplode("read.frames").alias("frame", "f")).select("doc_id", "frame", "f.*")


def _feature(shots: Column) -> Column:
    """Frames, milliseconds and the histogram summed over the frames, as text."""
    total = F.aggregate(shots, F.array_repeat(F.lit(0), 64), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    time = F.aggregate(shots, F.lit(0), lambda acc, f: acc + f["delay_ms"])
    return F.concat_ws(";", F.size(shots).cast("string"), time.cast("string"), F.array_join(F.transform(total, lambda x: x.cast("string")), ","))


def op3_gif_media(spark, sf_dir):
    got = read(store(table(spark, sf_dir, "documents")))
    payload = F.col("read.payload")
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -SIDE, SIDE)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        _feature(F.col("read.frames")).alias("feature"),
    )

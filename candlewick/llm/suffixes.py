"""Operator 9, suffix-array dedup: bytes under a string of LENGTH bytes that an earlier document holds too.

A suffix array of all bytes would be shuffled many times the input's size, so the array is sparse: it holds
only suffixes that start at anchors. Of the GRAM-byte grams of each LENGTH-byte window the one with the least
hash is an anchor; equal windows have equal anchors at equal places, so every repeated window is seen by an
anchor's suffix, with up to LEFT bytes before it.

1. Documents are dealt into chunks. A chunk finds its anchors; their hashes, 32 bits each, go to buckets.
2. A bucket says which hashes more than one document has; only those anchors go on.
3. A chunk sends the distinct surroundings of these anchors (LEFT bytes before, LENGTH from it on), each with
   the smallest doc_id that has it there, to the hash's bucket.
4. A bucket sorts the suffixes of the anchors, and the reversed texts before them: multikey quicksort, eight bytes a
   character, to SHALLOW bytes, and blind tries for the groups that still share a prefix then. In sorted order, windows
   at one offset are equal exactly where both common prefixes are long enough, so each run gives its smallest doc_id.
5. A chunk marks its windows whose smallest doc_id is below their own and cuts the bytes they cover.

All steps are one job; the texts are shuffled once and that shuffle is read four times. Chunks hold about DEAL bytes
each and buckets are as many, so a task's memory stays as the data grow, whatever the session's partitions; rows are
dealt by their place, so repeated ones part. A hash that
very many chunks have with unlike surroundings is hot: these would all meet in one bucket, as where a short line stands
in very many documents. (Copies of a document are alike, one row a chunk, however many.) A chunk tells eight bits of the
least of a hash's surroundings, by their hashes; a hash with more than HOT of the 256 signs is hot. Of hot hashes the windows are looked at one by one: their hashes go to buckets
of their own, as those of anchors in steps 1 and 2, and only windows that several have are sent then, each distinct one
of a chunk once. Equal windows have equal anchors and so are all sent that way. A window that very many documents share
is one row for each chunk. Hashes only bring candidates together: bytes are compared.

Defined cases: a null text is empty; a null doc_id is above all others, so its bytes go if any numbered document
has them, and never vice versa; rows with one doc_id are one document and don't touch each other; an empty table
gives an empty result; other columns are ignored. UTF-8 has no byte 0xFF, which parts the documents of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import deals, numbered, table

LENGTH = 50
GRAM = 20
LEFT = LENGTH - GRAM  # an anchor's window starts at most so far before it
AROUND = LEFT + LENGTH
SHALLOW = 24
DEAL = 6 << 20  # bytes of text in a chunk
HOT = 128  # of 256 signs
LAST = int(np.iinfo(np.int64).max)  # stands for a null doc_id
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


# ---- anchors


def _sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        a = least(a[:-have], a[have:])
        have *= 2
    return least(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in sorted({*range(0, GRAM - 7, 8), GRAM - 8}):
        h = (h ^ np.ndarray(n, dtype="<u8", buffer=data, offset=k, strides=(1,))) * MIX[k // 8 % 4]
        h ^= h >> np.uint64(29)
    return np.maximum(h * MIX[3] ^ h >> np.uint64(32), np.uint64(1))  # 0 marks what is no window


def anchors(data: np.ndarray, valid: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows whose start is marked in valid; data: uint8, contiguous."""
    grams = LENGTH - GRAM + 1
    places, hashes = [], []
    for a in range(0, max(len(data) - LENGTH + 1, 0), block):
        # windows that start in [a, z) and their grams
        z = min(a + block, len(data) - LENGTH + 1)
        h = _gram_hashes(data[a : z + LENGTH - 1])
        least = _sliding(h, grams, np.minimum)
        least[~valid[a:z]] = 0
        edge = np.zeros(grams - 1, dtype=np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), grams, np.maximum)
        at = np.flatnonzero(most == h)
        at = at[h[at] > 0]
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    place, h = np.concatenate(places), np.concatenate(hashes)
    place, one = np.unique(place, return_index=True)  # neighbouring blocks find an anchor twice
    return place, h[one]


class Chunk:
    """The texts of a chunk in one array, parted by 0xFF, in a fixed order of rows."""

    def __init__(self, frame: pd.DataFrame) -> None:
        texts = [x.encode() if isinstance(x, str) else b"" for x in frame["text"]]
        ids = frame["doc_id"].to_numpy(dtype=np.int64)
        nameless = frame["nameless"].to_numpy(dtype=bool) if "nameless" in frame else np.zeros(len(ids), dtype=bool)
        order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
        self.texts, self.ids, self.nameless = [texts[k] for k in order], ids[order], nameless[order]
        part = b"\xff" * AROUND
        if sum(map(len, self.texts)) + AROUND * (len(texts) + 1) >= 1 << 32:
            raise OverflowError("a chunk's places are numbers of 32 bits: deal smaller chunks")
        self.data = np.frombuffer(part + part.join(self.texts) + part, dtype=np.uint8)
        size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.ends = AROUND + np.cumsum(size) + AROUND * np.arange(len(size))
        self.starts = self.ends - size
        self.valid = np.zeros(len(self.data), dtype=bool)
        for a, z in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            self.valid[a : max(a, z - LENGTH + 1)] = True

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


class Anchors:
    """A chunk's anchors by hash; distinct hashes are grouped by bucket, each bucket's in order."""

    def __init__(self, chunk: Chunk, buckets: int) -> None:
        place, hashes = anchors(chunk.data, chunk.valid)
        row = chunk.row_of(place)
        bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((hashes, bucket))  # stable: places, and so rows, stay in order
        self.place, self.row, h = place[order], row[order], hashes[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        self.first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # for each anchor its distinct hash
        self.tail = h[self.first].astype(np.uint32)
        self.bucket = bucket[order][self.first].astype(np.int64)
        around = string_hashes(chunk.data, self.place - LEFT, AROUND)
        self.signs = (np.minimum.reduceat(around, self.first) >> np.uint64(56)).astype(np.uint8) if len(h) else np.zeros(0, dtype=np.uint8)
        last = np.append(self.first[1:], len(h)) - 1
        self.several = self.row[self.first] != self.row[last] if len(h) else np.zeros(0, dtype=bool)


class Windows:
    """The windows of a chunk's hot anchors by hash; distinct hashes are grouped by bucket, each bucket's in order."""

    def __init__(self, chunk: Chunk, anchors_: Anchors, hot: np.ndarray, buckets: int) -> None:
        starts = np.zeros(len(chunk.data), dtype=bool)
        for o in range(LEFT + 1):
            starts[anchors_.place[hot[anchors_.of]] - o] = True
        place = np.flatnonzero(starts & chunk.valid)
        h = string_hashes(chunk.data, place, LENGTH)
        bucket = (h >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((h, bucket))
        self.place, h = place[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.tail = h[first].astype(np.uint32)
        self.bucket = bucket[order][first].astype(np.int64)
        self.several = np.diff(np.append(first, len(h))) > 1


def _marks(masks: pd.DataFrame, kind: int, name: str, by_bucket: np.ndarray) -> np.ndarray:
    """The bits of one kind that came back for the distinct hashes whose buckets are given."""
    own = masks[masks["kind"] == kind]
    mask_of = dict(zip(own["bucket"].tolist(), own[name], strict=True))
    marks = np.zeros(len(by_bucket), dtype=bool)
    for b, i, j in _runs(by_bucket):
        marks[i:j] = np.unpackbits(np.frombuffer(mask_of[b], dtype=np.uint8), count=j - i)
    return marks


def _runs(label: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(label, start, end) of each run."""
    if len(label):
        cut = np.flatnonzero(label[1:] != label[:-1]) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(label)], strict=True):
            yield int(label[a]), a, z


# ---- sorting


def _blind_trie(texts: list[bytes]) -> list[int]:
    """Order of distinct texts of one length: each goes down a trie that knows only branching bytes, is compared
    with the one leaf it meets, and is put in where the two part."""
    number, width = [int.from_bytes(t) for t in texts], len(texts[0])
    root: int | list = 0  # a leaf is a text's place; a node is [depth, {byte: child}]
    for i in range(1, len(texts)):
        t, node, path = texts[i], root, []
        while not isinstance(node, int):
            path.append(node)
            kids = node[1]
            node = kids.get(t[node[0]])
            if node is None:
                node = next(iter(kids.values()))
        depth = width - ((number[i] ^ number[node]).bit_length() + 7 >> 3)
        k = next((k for k, p in enumerate(path) if p[0] >= depth), len(path))
        if k < len(path) and path[k][0] == depth:
            path[k][1][t[depth]] = i
            continue
        below = path[k] if k < len(path) else node
        made = [depth, {texts[node][depth]: below, t[depth]: i}]
        if k:
            path[k - 1][1][t[path[k - 1][0]]] = made
        else:
            root = made
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of rows of keys: the sorted order, and for each place in it the first place of the rows equal to it.

    Multikey quicksort: a group is parted by a pivot at its depth into smaller, equal and larger; the equal part goes one
    key deeper, the others stay. All groups take each step at once, by counting.
    """
    n, deep = keys.shape
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    live = np.arange(n)  # places whose group has more than one row and is not sorted yet
    depth = np.zeros(n, dtype=np.int64)  # by place
    while len(live):
        of, at = order[live], depth[live]
        key = keys[of, at]
        new = np.ones(len(live), dtype=bool)
        new[1:] = group[live[1:]] != group[live[:-1]]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(live)))
        which = np.cumsum(new) - 1
        # pivot: the median of a group's first, middle and last key
        a, b, c = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[which]
        below, above = key < pivot, key > pivot
        counts = np.stack([np.add.reduceat(below.astype(np.int64), start), size, np.add.reduceat(above.astype(np.int64), start)])
        counts[1] -= counts[0] + counts[2]
        ends = np.cumsum(counts, axis=0)
        to = np.empty(len(live), dtype=np.int64)  # where each row goes, counted from its group's start
        for side, before in ((below, None), (~(below | above), ends[0]), (above, ends[1])):
            seen = np.cumsum(side)
            rank = seen - (seen[start] - side[start])[which] - 1
            to[side] = (rank if before is None else rank + before[which])[side]
        moved = start[which] + to
        order[live[moved]] = of
        # the parts of each group become groups, named by their first places
        place = np.arange(len(live)) - start[which]
        low, high = ends[0][which], ends[1][which]
        part = np.where(place < low, 0, np.where(place < high, low, high))
        equal = (place >= low) & (place < high)
        group[live] = live[start[which] + part]
        at = depth[live] + equal
        depth[live] = at
        width = np.where(place < low, low, np.where(equal, high - low, size[which] - high))
        live = live[(width > 1) & (at < deep)]
    return order, group


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct rows of bytes, and the common prefix of each with the one before it (0 for the first).

    Shallow: multikey quicksort of the first SHALLOW bytes, eight a character. Deep: groups that share them are ordered
    by blind tries.
    """
    n, width = rows.shape
    shallow = min(SHALLOW, -(-width // 8) * 8)
    head = np.zeros((n, shallow), dtype=np.uint8)
    head[:, : min(width, shallow)] = rows[:, :shallow]
    order, group = multikey_quicksort(head.view(">u8").astype(np.uint64))
    for _, a, z in _runs(group):
        if z - a > 1:
            texts = [rows[k, shallow:].tobytes() for k in order[a:z]]
            order[a:z] = order[a:z][_blind_trie(texts)]
    lcp = np.zeros(n, dtype=np.int64)
    for a in range(1, n, 1 << 16):
        z = min(a + (1 << 16), n)
        same = rows[order[a:z]] == rows[order[a - 1 : z - 1]]
        lcp[a:z] = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return order, lcp


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the places of distinct rows, and for each row which of them it equals."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    wide[:, :width] = rows
    h = np.zeros(n, dtype=np.uint64)
    for k, column in enumerate(wide.view("<u8").T):
        h = (h ^ column) * MIX[k % 4]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    of = np.empty(n, dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    if new.sum() > 1 and (np.diff(h[first]) == 0).any():  # unlike rows of one hash may alternate: compare them all
        _, first, of = np.unique(rows.view(f"V{width}").ravel() if rows.flags.c_contiguous else np.ascontiguousarray(rows).view(f"V{width}").ravel(), return_index=True, return_inverse=True)
    return first, of


def earlier(around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of surroundings the offsets at which a row of a smaller id has an equal window, as bits.

    Bit o is for the window that starts o bytes before the anchor.
    """
    one, of = distinct(around)
    least = np.full(len(one), LAST)
    np.minimum.at(least, of, ids)
    sides = []
    for side in (around[one, LEFT:], around[one, LEFT - 1 :: -1] if LEFT else around[one, :0]):
        side = np.ascontiguousarray(side)
        first, which = distinct(side)
        order, lcp = deep_shallow(side[first])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        sides.append((rank[which], lcp))
    (right, right_lcp), (left, left_lcp) = sides
    bits = np.zeros(len(ids), dtype=np.uint64)
    for o in range(LEFT + 1):
        run = np.cumsum(right_lcp < LENGTH - o)[right] * (len(left_lcp) + 1) + np.cumsum(left_lcp < o)[left]
        order = np.argsort(run, kind="stable")
        new = np.ones(len(run), dtype=bool)
        new[1:] = run[order[1:]] != run[order[:-1]]
        best = np.empty(len(one), dtype=np.int64)
        best[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        bits |= (best[of] < ids).astype(np.uint64) << np.uint64(o)
    return bits


def string_hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings of ``width`` bytes that start there."""
    n = len(data) - width + 1
    h = np.zeros(len(starts), dtype=np.uint64)
    for i, k in enumerate([*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]):
        h = (h ^ np.ndarray(n, dtype="<u8", buffer=data, offset=k, strides=(1,))[starts]) * MIX[i % 4]
        h ^= h >> np.uint64(29)
    return h * MIX[3] ^ h >> np.uint64(32)


# ---- the steps

ANCHOR, WINDOW = 0, 1  # whose hashes an answer is about
HASHES = "chunk long, bucket long, tails binary, several binary, signs binary"
SHARED = "chunk long, bucket long, shared binary, hot binary"
PLACES = "chunk long, bucket long, wide int, around binary, ids binary, counts binary, places binary, later binary"
FOUND = "chunk long, bucket long, places binary, offsets binary"
KEPT = "doc_id long, nameless boolean, text string, kept binary, n_bytes long, spans array<struct<start:long,end:long>>"


def _send_hashes(buckets: int):
    def send(frame: pd.DataFrame) -> pd.DataFrame:
        a = Anchors(Chunk(frame), buckets)
        rows = [(int(frame["chunk"].iat[0]), b, a.tail[i:j].tobytes(), np.packbits(a.several[i:j]).tobytes(), a.signs[i:j].tobytes()) for b, i, j in _runs(a.bucket)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "tails", "several", "signs"])

    return send


def _send_windows(buckets: int):
    def send(docs: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and len(masks):
            chunk = Chunk(docs)
            a = Anchors(chunk, buckets)
            hot = _marks(masks, ANCHOR, "hot", a.bucket)
            if hot.any():
                w = Windows(chunk, a, hot, buckets)
                rows = [(int(docs["chunk"].iat[0]), b, w.tail[i:j].tobytes(), np.packbits(w.several[i:j]).tobytes(), bytes(j - i)) for b, i, j in _runs(w.bucket)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "tails", "several", "signs"])

    return send


def _find_shared(frame: pd.DataFrame) -> pd.DataFrame:
    tails = [np.frombuffer(x, dtype=np.uint32) for x in frame["tails"]]
    several = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(t)).astype(bool) for x, t in zip(frame["several"], tails, strict=True)]
    every = np.concatenate(tails)
    values, of, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[of[np.concatenate(several)]] = True
    signs = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in frame["signs"]])
    unlike = np.bincount(np.unique(of.astype(np.int64) * 256 + signs) // 256, minlength=len(values))
    shared, hot = shared[of], (unlike > HOT)[of]
    out, at = [], 0
    for t in tails:
        out.append([np.packbits(x[at : at + len(t)]).tobytes() for x in (shared, hot)])
        at += len(t)
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "shared": [x for x, _ in out], "hot": [x for _, x in out]})


def _send_places(buckets: int):
    def send(docs: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list[tuple]] = {}

        def add(bucket: int, strings: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
            first, of = distinct(strings)
            least = np.full(len(first), LAST)
            np.minimum.at(least, of, ids)
            order = np.argsort(of, kind="stable")
            held.setdefault(bucket, []).append((strings[first], least, np.bincount(of, minlength=len(first)).astype(np.uint32), at[order].astype(np.uint32), ids[order] > least[of[order]]))

        if len(docs) and len(masks):
            chunk = Chunk(docs)
            a = Anchors(chunk, buckets)
            shared, hot = _marks(masks, ANCHOR, "shared", a.bucket), _marks(masks, ANCHOR, "hot", a.bucket)
            on = (shared & ~hot)[a.of]
            place, row, bucket = a.place[on], a.row[on], a.bucket[a.of[on]]
            windows = np.lib.stride_tricks.sliding_window_view(chunk.data, AROUND)
            for b, i, j in _runs(bucket):
                add(b, windows[place[i:j] - LEFT], place[i:j], chunk.ids[row[i:j]])
            if hot.any():  # their windows go by themselves, those that several have
                w = Windows(chunk, a, hot, buckets)
                on = _marks(masks, WINDOW, "shared", w.bucket)[w.of]
                place, bucket = w.place[on], w.bucket[w.of[on]]
                windows = np.lib.stride_tricks.sliding_window_view(chunk.data, LENGTH)
                for b, i, j in _runs(bucket):
                    add(b, windows[place[i:j]], place[i:j], chunk.ids[chunk.row_of(place[i:j])])
        rows = []  # one for each bucket: its ``wide`` surroundings, then its windows
        for b, both in held.items():
            strings, ids, counts, at, later = zip(*both, strict=True)
            wide = sum(len(x) for x in strings if x.shape[1] == AROUND)
            rows.append((int(docs["chunk"].iat[0]), b, wide, b"".join(x.tobytes() for x in strings), *(np.concatenate(x).tobytes() for x in (ids, counts, at)), np.packbits(np.concatenate(later)).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "wide", "around", "ids", "counts", "places", "later"])

    return send


def _find_earlier(frame: pd.DataFrame) -> pd.DataFrame:
    wide = frame["wide"].tolist()
    bytes_of = [np.frombuffer(x, dtype=np.uint8) for x in frame["around"]]
    ids_of = [np.frombuffer(x, dtype=np.int64) for x in frame["ids"]]
    around = np.concatenate([x[: k * AROUND] for k, x in zip(wide, bytes_of, strict=True)]).reshape(-1, AROUND)
    ids = np.concatenate([x[:k] for k, x in zip(wide, ids_of, strict=True)])
    bits = earlier(around, ids) if len(ids) else np.zeros(0, dtype=np.uint64)
    windows = np.concatenate([x[k * AROUND :] for k, x in zip(wide, bytes_of, strict=True)]).reshape(-1, LENGTH)
    ids = np.concatenate([x[k:] for k, x in zip(wide, ids_of, strict=True)])
    first, of = distinct(windows) if len(ids) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    least = np.full(len(first), LAST)
    np.minimum.at(least, of, ids)
    alone = (least[of] < ids).astype(np.uint64)  # a window for itself: offset 0
    found, at, at_alone = [], 0, 0
    for k, c, p, late in zip(wide, frame["counts"], frame["places"], frame["later"], strict=True):
        counts = np.frombuffer(c, dtype=np.uint32)
        more = len(counts) - k
        each = np.repeat(np.concatenate([bits[at : at + k], alone[at_alone : at_alone + more]]), counts)
        every = np.repeat(np.array([(1 << LEFT + 1) - 1, 1], dtype=np.uint64), [int(counts[:k].sum()), int(counts[k:].sum())])
        at, at_alone = at + k, at_alone + more
        # a later document of the chunk has all of it from the chunk's first
        each = np.where(np.unpackbits(np.frombuffer(late, dtype=np.uint8), count=len(each)).astype(bool), every, each)
        on = each > 0
        found.append((np.frombuffer(p, dtype=np.uint32)[on].tobytes(), each[on].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (LEFT + 8) // 8].tobytes()))
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "places": [p for p, _ in found], "offsets": [b for _, b in found]})


def _cut(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(docs):
        chunk = Chunk(docs)
        starts = np.zeros(len(chunk.data), dtype=bool)
        for p, b in zip(found["places"], found["offsets"], strict=True):
            place = np.frombuffer(p, dtype=np.uint32).astype(np.int64)
            small = np.frombuffer(b, dtype=np.uint8).reshape(-1, (LEFT + 8) // 8)
            for o in range(LEFT + 1):
                starts[place[small[:, o // 8] >> o % 8 & 1 > 0] - o] = True
        # windows in order: a span goes on while the next one starts inside or at the end of the one before
        at = np.flatnonzero(starts & chunk.valid)
        new = np.append(True, np.diff(at) > LENGTH)[: len(at)]
        first = np.flatnonzero(new)
        begin, end = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + LENGTH
        of = np.searchsorted(begin, chunk.starts), np.searchsorted(begin, chunk.ends)
        for t, i, none, a, j, k in zip(chunk.texts, chunk.ids.tolist(), chunk.nameless.tolist(), chunk.starts.tolist(), *(x.tolist() for x in of), strict=True):
            spans = [(s - a, e - a) for s, e in zip(begin[j:k].tolist(), end[j:k].tolist(), strict=True)]
            edges = [0, *(x for s in spans for x in s), len(t)]
            kept = b"".join(t[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2))
            rows.append((i, none, t.decode(), kept, len(t), [{"start": s, "end": e} for s, e in spans]))
    return pd.DataFrame(rows, columns=["doc_id", "nameless", "text", "kept", "n_bytes", "spans"])


def repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept[, text]): removed spans of each text's bytes, and the bytes that stay."""
    docs = docs.select("doc_id", "text")
    n = deals(docs, "text", DEAL)
    # ids go through pandas as numbers that are never null, so all their digits stay
    own = F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(LAST).cast("long")).alias("doc_id"), F.isnull("doc.doc_id").alias("nameless")
    texts = numbered(docs).select(*own, "doc.text", F.pmod(F.xxhash64("rid"), F.lit(n)).alias("chunk"))
    hashes = texts.groupBy("chunk").applyInPandas(_send_hashes(n), HASHES)
    shared = hashes.groupBy("bucket").applyInPandas(_find_shared, SHARED).withColumn("kind", F.lit(ANCHOR))
    windows = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(_send_windows(n), HASHES)
    both = shared.unionByName(windows.groupBy("bucket").applyInPandas(_find_shared, SHARED).withColumn("kind", F.lit(WINDOW)))
    places = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(_send_places(n), PLACES)
    found = places.groupBy("bucket").applyInPandas(_find_earlier, FOUND)
    cut = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(_cut, KEPT)
    cut = cut.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
    return cut if keep_text else cut.drop("text")


def op9_suffix_dedup(spark, sf_dir):
    cut = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: A table of all strings of 50 bytes; bytes are two hexadecimal digits, and texts blocks of 256 bytes and the 49 behind them.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, doc_id, 256 * k AS o, substr(h, 512 * k + 1, 610) AS p FROM (SELECT *, unnest(range(0, length(h) // 512 + 1)) AS k FROM d)),
w AS (SELECT rid, doc_id, o + j AS i, substr(p, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(256, length(p) // 2 - 49))) AS j FROM b)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT rid, i FROM w JOIN m USING (s) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
n AS (SELECT *, (i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 50)::INT AS new FROM g),
sp AS (SELECT rid, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY rid ORDER BY i) AS k FROM n) GROUP BY rid, k),
k AS (SELECT rid, sum(z - a)::BIGINT AS removed, count(*) AS spans, [0::BIGINT] || list(z ORDER BY a) AS lz, list(a ORDER BY a) AS la FROM sp GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN la IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(lz) + 1), lambda j: substr(h, 2 * lz[j] + 1, 2 * (coalesce(la[j], length(h) // 2) - lz[j]))), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import suffixes


def brute(rows):
    """(doc_id, removed spans) of each row, by a table of all strings of 50 bytes."""
    texts = [(suffixes.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = end + 1
        out.append((d, t, spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=40).map(lambda b: bytes(x % 3 for x in b[:26]) + bytes(x % 2 for x in b[26:])), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_deep_shallow_sorts_and_counts_prefixes(texts, same):
    texts = [bytes([7] * 8 * same) + t for t in texts]
    rows = np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(len(texts), -1)
    order, lcp = suffixes.deep_shallow(rows)
    assert [texts[k] for k in order] == sorted(texts)
    for a, b, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
        assert n == next(i for i in range(len(texts[a])) if texts[a][i] != texts[b][i])


def test_anchors_of_equal_windows_are_equal():
    draw = random.Random(1)
    data = np.frombuffer(bytes(draw.choice(b"abcd") for _ in range(3000)) * 2 + bytes(500), dtype=np.uint8)
    valid = np.ones(len(data), dtype=bool)
    place, h = suffixes.anchors(data, valid)
    small = suffixes.anchors(data, valid, block=700)
    assert place.tolist() == small[0].tolist() and h.tolist() == small[1].tolist()
    seen = dict(zip(place.tolist(), h.tolist(), strict=True))
    for p in range(0, len(data) - 49):
        inside = {q - p: seen[q] for q in range(p, p + suffixes.LEFT + 1) if q in seen}
        assert inside
        if p < 2950:  # the same window again
            assert all(seen.get(p + 3000 + o) == v for o, v in inside.items() if v == min(inside.values()))


def made_rows():
    draw = random.Random(4)
    some = lambda n: "".join(draw.choice("abcdeé fgh\n") for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 80, 200, 700)]
    rows = []
    for i in range(120):
        text = some(draw.randint(0, 200))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            a = draw.randint(0, 20)
            text += p[a : len(p) - draw.randint(0, 20)] + some(draw.randint(0, 90))
        rows.append((draw.randint(0, 90), text))
    hot = some(300)
    rows += [(200 + i, hot) for i in range(60)] + [(300 + i, hot[:150] + "X" + hot[151:]) for i in range(30)]
    rows += [(5, rows[3][1]), (5, rows[3][1]), (None, hot), (None, hot), (None, some(300)), (2**62 + 1, some(200)), (400, None), (401, ""), (402, "short"), (403, "z" * 400), (404, "z" * 120), (-3, hot[10:90])]
    return rows


@pytest.mark.parametrize("each", [1 << 30, 4000])
def test_whole_operator_against_brute_force(spark, monkeypatch, each):
    monkeypatch.setattr(suffixes, "DEAL", each)
    rows = made_rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, chunk int, spans string")
    got = [(suffixes.LAST if r.doc_id is None else r.doc_id, r.text.encode(), [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.repeats(docs, keep_text=True).collect()]
    assert sorted(got) == sorted(brute(rows))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 3), st.sampled_from([2, 5, 1 << 62]), st.integers(0, 1 << 30))
def test_multikey_quicksort(n, deep, most, seed):
    keys = np.random.default_rng(seed).integers(0, most, (n, deep)).astype(np.uint64)
    order, group = suffixes.multikey_quicksort(keys)
    rows = [tuple(keys[k]) for k in order]
    assert rows == sorted(map(tuple, keys)) and sorted(order) == list(range(n))
    assert group.tolist() == [rows.index(r) for r in rows]


def test_empty_table(spark):
    assert suffixes.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(suffixes._cut(pd.DataFrame({"doc_id": [], "text": []}), pd.DataFrame({"places": [], "offsets": []}))) == 0


def line_rows():
    """A line of 53 bytes in many documents, with other bytes around it in each."""
    draw = random.Random(6)
    some = lambda n: "".join(draw.choice("abcdefghij klm") for _ in range(n))
    line = some(53)
    return [(i, some(draw.randint(60, 150)) + line + some(draw.randint(60, 150))) for i in range(400)]


@pytest.mark.parametrize("hot", [1, 2])
def test_hot_anchors_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "DEAL", 12_000)
    rows = made_rows() + line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(suffixes.LAST if r.doc_id is None else r.doc_id, r.text.encode(), [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.repeats(docs, keep_text=True).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_a_common_line_does_not_fill_one_bucket(monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 4, raising=False)
    rows, buckets = line_rows(), 16
    chunks = [pd.DataFrame([(k, *r) for r in rows[k::20]], columns=["chunk", "doc_id", "text"]) for k in range(20)]
    hashes = pd.concat([suffixes._send_hashes(buckets)(c) for c in chunks])
    shared = pd.concat([suffixes._find_shared(g) for _, g in hashes.groupby("bucket")]).assign(kind=suffixes.ANCHOR)
    look = suffixes._send_windows(buckets)
    hashes = pd.concat([look(c, shared[shared["chunk"] == k]) for k, c in enumerate(chunks)])
    shared = pd.concat([shared, *(suffixes._find_shared(g).assign(kind=suffixes.WINDOW) for _, g in hashes.groupby("bucket"))])
    send = suffixes._send_places(buckets)
    places = pd.concat([send(c, shared[shared["chunk"] == k]) for k, c in enumerate(chunks)])
    strings = places["ids"].map(len).groupby(places["bucket"]).sum() // 8
    assert len(strings) == buckets and strings.max() < 2 * strings.median()


def test_a_chunk_sends_a_bucket_one_row(monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 4)
    draw = random.Random(7)
    rows, buckets = line_rows(), 4
    rows += [(1000 + i, "".join(draw.choice("nopqrstuvw") for _ in range(300))) for i in range(4)] * 2  # in two chunks: shared, not hot
    chunks = [pd.DataFrame([(k, *r) for r in rows[k::20]], columns=["chunk", "doc_id", "text"]) for k in range(20)]
    hashes = pd.concat([suffixes._send_hashes(buckets)(c) for c in chunks])
    shared = pd.concat([suffixes._find_shared(g) for _, g in hashes.groupby("bucket")]).assign(kind=suffixes.ANCHOR)
    look = suffixes._send_windows(buckets)
    hashes = pd.concat([look(c, shared[shared["chunk"] == k]) for k, c in enumerate(chunks)])
    shared = pd.concat([shared, *(suffixes._find_shared(g).assign(kind=suffixes.WINDOW) for _, g in hashes.groupby("bucket"))])
    send = suffixes._send_places(buckets)
    places = pd.concat([send(c, shared[shared["chunk"] == k]) for k, c in enumerate(chunks)])
    assert len(places) == len(places.drop_duplicates(["chunk", "bucket"])) and places["wide"].sum() > 0

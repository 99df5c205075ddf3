import hashlib
import math

import numpy as np
import pytest

from candlewick.llm import vector_codes as V
from tests.conftest import SF

SHAPE = "vec_id long, embedding array<double>, label int, _key string, n int"


def brute(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    """The contract in plain Python integers; rows: (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max([len(r[1]) for r in rows], default=0)
    width = -(-width // V.PARTS) * V.PARTS
    step = width // V.PARTS
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [(i, [*v, *[0.0] * (width - len(v))], g) for i, v, g in rows]
    whole = [[int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v] for _, v, _ in rows]
    part = lambda v, k: v[k * step : (k + 1) * step]
    books = [[part(v, k) for v in whole[:entries]] for k in range(V.PARTS)]

    def best(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for k, book in enumerate(books):
            held = [[] for _ in book]
            for v in whole:
                held[best(part(v, k), book)[0]].append(part(v, k))
            books[k] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for e, h in zip(book, held, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[best(part(v, k), books[k]) for k in range(V.PARTS)] for v in whole]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for (_, _, g), e in zip(rows, errors, strict=True):
        by_label.setdefault(g, []).append(e)
    fits = lambda e: e if e <= V.MOST else None
    of_label = {g: None if max(e) > V.MOST else fits(sum(e)) for g, e in by_label.items()}
    return [(r[0], "".join(f"{i:02x}" for i, _ in f), fits(e), of_label[r[2]], sha) for r, f, e in zip(rows, found, errors, strict=True)]


def compared(spark, rows):
    got = V.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, V.op13_vector_codes(spark, SF).collect())) == sorted(brute(rows))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), draw.integers(-3, 3, 32).astype(float).tolist(), None if i % 3 == 0 else int(i) % 2) for i in draw.permutation(150)]  # many ties
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 31, 1), (1002, [float("nan")] * 32, 1), (1003, [float("-inf")] * 32, 1)]
    rows += [rows[0], rows[0], (None, [0.5] * 32, None), (5, [0.25] * 32, 9), (2**62 + 1, [-0.001] * 32, 9), (1, [], 9), (2, [1.0] * 7, 9)]
    compared(spark, rows)


def test_very_large_components_are_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(16).tolist(), 1) for i in range(80)]
    rows += [(100, [1e300] * 16, 2), (101, [3e9] + [0.1] * 15, 3), (102, [-3.4e38] * 16, None), (-1, [2.0**31] * 16, 4), (103, [2.0**31] * 16, 4)]
    compared(spark, rows)


def test_few_vectors_and_none(spark):
    compared(spark, [(3, [0.1] * 48, 1), (2, [0.2] * 48, 1)])
    compared(spark, [(3, [], None)])
    compared(spark, [])


def test_one_label_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr("candlewick.llm.common.HOT_KEYS", 16)
    draw = np.random.default_rng(5)
    compared(spark, [(i, draw.standard_normal(16).round(1).tolist(), None if i % 3 == 0 else i) for i in range(300)])


@pytest.mark.parametrize("width", [1, 4, 64, V.WIDE])
@pytest.mark.parametrize("size", [3, 300, V.SAFE])
def test_screening_finds_the_exact_nearest(width, size):
    draw = np.random.default_rng(width + size)
    book = draw.integers(-size, size + 1, (64, width))
    book[40:] = book[:24]  # copies: the least index counts
    x = np.concatenate([draw.integers(-size, size + 1, (300, width)), book + draw.integers(-1, 2, book.shape), (book[:30] + book[1:31]) // 2])
    x = np.clip(x, -size, size)
    index, distance = V.nearest(x, book)
    want = V._nearest_exact(x.astype(object), book.astype(object))
    assert (index == want[0]).all() and (distance.astype(object) == want[1]).all() and distance.dtype == np.int64


def test_decode_gives_the_named_entries(spark):
    docs = V.kept(spark.read.parquet(f"{SF}/embeddings.parquet"))
    width = V.width_of(docs)
    books = V.train(docs, width)
    coded = V.decode(V.encode(docs, books, width), books).join(docs.select("vec_id", "embedding"), "vec_id").collect()
    for r in coded:
        assert sum((math.floor(256 * a) - b * 256) ** 2 for a, b in zip(r.embedding, r.vector, strict=True)) == r.error

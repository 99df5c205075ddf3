import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlewick.llm import simhash
from candlewick.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(doc_id, fp) rows: the smallest id that links of three bits or fewer reach."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                root[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(find(i), []).append(d)
    return [min((d for d in group[find(i)] if d is not None), default=None) for i in range(len(rows))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\x0bé\x85 ÄZ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=2, max_size=40, unique=True), st.booleans())
def test_forest_spans_all_links(values, across):
    a = np.array(values, dtype=np.int64)
    left, right = (a[: len(a) // 2], a[len(a) // 2 :]) if across else (a, None)
    got = simhash.forest(left, right, 1)
    pairs = [(x, y) for x in left.tolist() for y in (right if across else a).tolist() if x != y and bin(x ^ y).count("1") <= 1]
    root = {v: v for v in values}

    def join(edges):
        root.update({v: v for v in values})
        for _ in values:
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        return dict(root)

    assert join(got) == join(pairs) and len(got) < len(a)


def test_whole_operator_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    draw = random.Random(5)
    rows, ids = [], iter(draw.sample(range(10_000), 500))
    for g in range(12):
        base = [draw.choice("abcdefghijklmnop") * draw.randint(1, 4) for _ in range(60)]
        for _ in range(14):
            text = list(base)
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(60)] = draw.choice("xyz")
            rows.append((next(ids), " ".join(text), g))
    rows += [(None, rows[0][1], 0), (rows[5][0], rows[5][1], 0), (20_000, None, 0), (20_001, "", 0), (20_002, " \n", 0), (20_003, "one", 0), (20_004, "One two", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    marked = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    want = sorted((d is None, d, f, c) for (d, f), c in zip(marked, brute_components(marked), strict=True))
    assert got == want
    kept = simhash.stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for *_, c in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1100)] + [(-5, 1050)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[k] == -5 for k in [*range(1000, 1100), -5])


def test_stage_on_rows_that_come_from_no_file_place_of_their_own(spark, tmp_path):
    """Exploded, doubled and joined rows: of exact copies one row stays."""
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice("abcdefghijklmnop") * draw.randint(1, 4) for _ in range(60)), i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for df in (docs.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))), docs.union(docs), docs.join(docs.select("doc_id"), "doc_id"), spark.read.parquet(f"{tmp_path}/d", f"{tmp_path}/d")):
        got = simhash.stage(spark, df, "")
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])))


def test_one_fingerprint_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr("candlewick.llm.common.HOT_KEYS", 8)
    rows = [(k, "" if k % 3 == 0 else f"word{k} other{k % 50} more{k * 7 % 90} and so on {k % 11}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert sorted(found) == list(range(300))
    fps = {k: simhash.fingerprint(t.encode()) for k, t in rows}
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(300):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= simhash.DISTANCE:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(found[k].component_id == find(k) for k in fps)

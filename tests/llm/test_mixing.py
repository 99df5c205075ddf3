import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlewick.llm import mixing
from candlewick.llm.common import numbered


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), max_size=60), st.integers(0, 9))
def test_flight_keeps_words_and_documents(units, seed):
    pi, size = [p for p, _ in units], [float(s) for _, s in units]
    before = sum(pi), sum(p * s for p, s in zip(pi, size, strict=True))
    mixing.flight(pi, size, random.Random(seed))
    after = sum(pi), sum(p * s for p, s in zip(pi, size, strict=True))
    assert before == pytest.approx(after, abs=1e-5)
    assert sum(0 < p < 1 for p in pi) <= 2
    mixing.landing(pi, size)
    assert set(pi) <= {0.0, 1.0}


def filled(totals, weights):
    """Targets by brute force: cap whoever is above and share the rest anew, until none is above."""
    fixed, total = {}, sum(totals)
    while True:
        free = [i for i in range(len(totals)) if i not in fixed]
        rest = total - sum(fixed.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        above = [i for i in free if share[i] > 3 * totals[i]]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(totals))]
        fixed |= {i: 3.0 * totals[i] for i in above}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, `key` int").select("doc_id", "text", "source", "size", "key")


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 32)
    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.randint(1, 200)), draw.choice(["a"] * 8 + ["b", "b", "c", "Ä", None]), "x", 1) for i in range(900)]
    rows += [(None, "a b", "b", "x", 1), (7, None, "a", "x", 1), (5, "q q", "a", "x", 1), (5, "q q", "a", "x", 1), (8, "", "empty", "x", 1), (2**62 + 1, "a b c", "a", "x", 1)]
    docs = docs_of(spark, rows)
    kept = numbered(docs)
    take = lambda: mixing.sample(kept.select("doc.doc_id", "doc.source", mixing._size("doc.text"), "rid")).toPandas()
    got = take()
    assert len(got) == len(rows) and (got.copies <= 3).all() and (got.copies >= 0).all()
    assert 2**62 + 1 in {r.doc_id for r in mixing.sample(kept.select("doc.doc_id", "doc.source", mixing._size("doc.text"), "rid")).collect()}
    names = sorted({r[2] for r in rows} - {None}) + [None]
    totals = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in names]
    goal = filled(totals, [1 + i % 3 for i in range(len(names))])
    for s, total, want in zip(names, totals, goal, strict=True):
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert own.source_size.iat[0] == total and own.target.iat[0] == pytest.approx(want)
        assert abs((own["size"] * own.copies).sum() - want) <= own["size"].max() / 2 + 1e-6
    cols = ["doc_id", "size", "copies"]
    assert got[cols].fillna(-1).sort_values(cols).values.tolist() == take()[cols].fillna(-1).sort_values(cols).values.tolist()


def test_landing_finds_the_nearest_words():
    draw = random.Random(4)
    for _ in range(20):
        size = [float(draw.randint(1, 400)) for _ in range(12)]
        pi = [0.37] * 12
        words, docs = 0.37 * sum(size), 0.37 * 12
        ways = [[k for k in range(12) if w >> k & 1] for w in range(1 << 12)]
        best = min(abs(sum(size[k] for k in way) - words) for way in ways if abs(len(way) - docs) < 1)
        mixing.landing(pi, size, 1e9)
        on = [k for k in range(12) if pi[k]]
        assert abs(sum(size[k] for k in on) - words) == pytest.approx(best) and abs(len(on) - docs) < 1


def test_sources_come_within_a_hundredth(spark):
    draw = random.Random(7)
    rows = [(i, " ".join("w" * draw.randint(20, 400)), f"s{i % 20}", "x", 1) for i in range(1000)]
    got = mixing.sample(numbered(docs_of(spark, rows)).select("doc.doc_id", "doc.source", mixing._size("doc.text"), "rid")).toPandas()
    for _, own in got.groupby("source"):
        assert abs((own["size"] * own.copies).sum() - own.target.iat[0]) <= 0.01 * own.target.iat[0]


def test_very_many_equal_rows_are_parted(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    rows = [(3, "a b c", "a", "x", 1)] * 600 + [(None, "a b", "a", "x", 1)] * 500 + [(i, "w " * (i % 30), "b", "x", 1) for i in range(300)]
    largest = []
    fly = mixing._flown

    def watched(last, ids):
        inner = fly(last, ids)

        def run(frame):
            assert len(frame) <= 200, len(frame)
            return inner(frame)

        largest.append(last)
        return run

    monkeypatch.setattr(mixing, "_flown", watched)
    got = mixing.sample(numbered(docs_of(spark, rows)).select("doc.doc_id", "doc.source", mixing._size("doc.text"), "rid")).toPandas()
    assert len(got) == len(rows) and largest
    for _, own in got.groupby("source"):
        assert abs((own["size"] * own.copies).sum() - own.target.iat[0]) <= 0.01 * own.target.iat[0]


def test_stage_on_rows_that_come_from_no_file_place_of_their_own(spark, tmp_path):
    spark.createDataFrame([(i, "one two three", "ab"[i % 2], "x", i) for i in range(40)], "doc_id long, text string, source string, lang string, n int").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    doubled = docs.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    for df, n in ((doubled, 80), (docs.union(docs), 80), (spark.read.parquet(f"{tmp_path}/d", f"{tmp_path}/d"), 80), (docs.join(docs.select("doc_id"), "doc_id"), 40)):
        out = mixing.stage(spark, df, "")
        assert out.columns == df.columns and out.count() == n
        words = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
        assert abs(words["a"] - n / 3) <= 1


def test_stage_repeats_rows_and_empty_tables_stay_empty(spark):
    docs = docs_of(spark, [(i, "one two three", "ab"[i % 2], "x", i) for i in range(40)])
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    # a has weight 1, b weight 2: 120 words as 40 and 80
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert sum(n.values()) == 40 and abs(n["a"] - 40 / 3) <= 1
    assert mixing.stage(spark, docs.limit(0), "").count() == 0

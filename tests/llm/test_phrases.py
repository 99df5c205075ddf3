import random
import re
from collections import Counter

import numpy as np
import pytest

from candlewick.llm import phrases as P
from tests.conftest import SF

SHAPE = "text string, lang string, words int, times string, chunk int"


def brute(docs, least=P.LEAST, top=P.TOP):
    """The contract by counters; docs: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= 80 * f[lang, w[i : i + size]]:
                    dropped.add((lang, w[i : i + size]))
    rows = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def compared(spark, docs, **how):
    got = P.collocations(spark.createDataFrame([(*d, 5, "x", 1) for d in docs], SHAPE), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, **how)


def some_docs(seed=1, rows=300):
    draw = random.Random(seed)
    words = ["the", "of", "New", "YORK", "city", "é", "É", "\xa0", "漢字", "a.b", "x", "y", "z", "\x85", "ß", "<", "1"]
    text = lambda: "".join(draw.choice(words[: draw.randint(2, 17)]) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\x0b", " \r"]) for _ in range(draw.randint(0, 60)))
    docs = [(text(), draw.choice(["en", "de", None, "und", ""])) for _ in range(rows)]
    return docs + [(None, "en"), ("", None), (" \t.,;", "fr"), ("one", "it")] + [docs[0]] * 40 + [("New York city of light. " * 3000, "en")]


def test_whole_table_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    want = brute(docs)
    assert sorted(map(tuple, P.op12_phrases(spark, SF).collect())) == want and want


@pytest.mark.parametrize("deal,held", [(P.DEAL, P.HELD), (3000, 2000)])
def test_odd_rows(spark, monkeypatch, deal, held):
    monkeypatch.setattr(P, "DEAL", deal)
    monkeypatch.setattr(P, "HELD", held)
    compared(spark, some_docs())
    compared(spark, some_docs(2, 60), least=2, top=7)


def test_more_asking_than_one_deal(spark, monkeypatch):
    monkeypatch.setattr(P, "ASKING", 5)
    compared(spark, some_docs(3, 100), least=3)


def test_ties_stand_in_the_order_of_bytes(spark):
    compared(spark, [("b a. a b. a \U0001f642. a ￿. é a.", "en")] * 30)


def test_nothing_to_find(spark):
    compared(spark, [])
    compared(spark, [(None, None), ("", "en"), ("a b c", "en")])


def test_one_piece_in_a_third_of_all_rows(spark):
    compared(spark, [("The same line of words", "en")] * 200 + some_docs(4, 40))


def test_sums_of_groups_are_exact():
    draw = np.random.default_rng(1)
    codes, weights = draw.integers(0, 50, 1000), draw.integers(2**52, 2**53, 1000)
    distinct, sums, of = P.grouped(codes, weights)
    assert (distinct[of] == codes).all() and sums.tolist() == [sum(w for c, w in zip(codes.tolist(), weights.tolist(), strict=True) if c == d) for d in distinct.tolist()]
    assert [len(x) for x in P.grouped(codes[:0], weights[:0])] == [0, 0, 0]


def test_a_bucket_goes_to_disk(monkeypatch):
    monkeypatch.setattr(P, "MEMORY", "40MB")
    monkeypatch.setattr(P, "BATCH", 50_000)
    import pyarrow as pa

    n = 2_000_000
    batches = (pa.record_batch({"chunk": np.zeros(10_000, dtype=np.int64), "pair": np.arange(i, i + 10_000) % (n // 2), "times": np.full(10_000, 15)}) for i in range(0, n, 10_000))
    found = P._in_duckdb("chunk BIGINT, pair BIGINT, times BIGINT", P.FREQUENT.format(least=30))(batches)
    assert sum(b.num_rows for b in found) == n

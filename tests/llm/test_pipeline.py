import random
from collections import Counter

import pytest

import corpus_pipeline

from tests.llm.test_simhash import brute_components, brute_fingerprint


def made(spark, path):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7)))
    rows = []
    for i in range(40):
        text = [word() for _ in range(draw.randint(60, 200))]
        rows.append((i, " ".join(text), "en", draw.choice(["s1", "s2", None]), None))
        if i % 5 == 0:
            rows.append((100 + i, " ".join([*text[:-1], "changed"]), "en", "s1", 5))
    rows += [(200, "too short", "en", "s1", 9), (201, None, None, None, None), (202, " ".join("ab" for _ in range(90)), "en", "s2", 1)]
    rows.append((203, rows[1][1].split(" ", 3)[0] + " password = hunter2222 " + " ".join(word() for _ in range(70)), "en", "s1", 1))
    rows.append(rows[0])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages_by_brute_force(spark, tmp_path):
    rows = made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    out = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns or name == "bpe"
        out.append(docs.collect())
    good = [r for r in rows if r[0] not in (200, 201, 202)]
    assert sorted(r.doc_id for r in out[0]) == sorted(r[0] for r in good)
    marked = [(r[0], brute_fingerprint(r[1])) for r in good]
    assert sorted(r.doc_id for r in out[1]) == sorted(set(brute_components(marked)))
    assert len(out[2]) == len(out[1])
    text = {r.doc_id: r.text for r in out[2]}
    assert "[assign]" in text[203] and "hunter2222" not in text[203]
    assert all(text[r.doc_id] == r.text for r in out[1] if r.doc_id != 203)
    taken = Counter(r.doc_id for r in out[3])
    assert set(taken) <= set(text) and max(taken.values()) <= 3
    words = {s: sum(len(r.text.split()) for r in out[2] if r.source == s) for s in ("s1", "s2", None)}
    total = sum(words.values())
    for s, w in (("s1", 1), ("s2", 2), (None, 3)):  # no source is above three times its size here
        assert total * w / 6 < 3 * words[s]
        got = sum(len(r.text.split()) for r in out[3] if r.source == s)
        assert got == pytest.approx(total * w / 6, abs=110)
    assert Counter(r.doc_id for r in out[4]) == taken
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out[4]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0



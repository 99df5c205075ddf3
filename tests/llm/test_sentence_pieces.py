import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import sentence_pieces as S
from tests.conftest import SF

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
PATH = public.path(S.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = S.Pieces(open(PATH, "rb").read())
PARTS = ["a", "B", "é", "ß", "1", " ", "  ", "   ", " " * 17, "\n", "\t", "\r\n", "▁", "▁▁", "\x00", "\x85", "\xa0", "　", "漢字", "🙂", "́", "<s>", "</s>", "<unk>", "<0x41>", " the", "ing", ",", ").", "://", "аб", "한", "ｆ", "�", "\U0010ffff", "aa", "==", "----"]


def check(text):
    want = LIBRARY.encode(text)
    assert OWN.text_ids(text) == want
    decoded = LIBRARY.decode(want)
    assert OWN.decode(want) == decoded
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert OWN.digests(text) == (len(want), sha(",".join(map(str, want))), sha(decoded))


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_ids_of_parts(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_of_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdehinorst", max_size=60))
def test_ids_of_letters(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 400), st.integers(0, len(OWN.pieces) - 1)), max_size=12))
def test_text_of_any_ids(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_compatible_pairs_are_those_that_encode_to_themselves():
    draw = random.Random(2)
    names = sorted(OWN.ids)
    for _ in range(3000):
        a, b = draw.choice(names), draw.choice(names)
        ids = [OWN.ids[a], OWN.ids[b]]
        # behind a line end, which merges with nothing
        assert OWN.compatible(a, b) == (LIBRARY.encode("\n" + (a + b).replace(S.SPACE, " "))[2:] == ids)


def test_no_piece_crosses_a_cut():
    for p in OWN.ids:
        assert OWN.cut.findall(p) == [p], p


def test_very_long_words_and_texts(monkeypatch):
    draw = random.Random(1)
    for letters in ("a", "ab", "etaoinshrdlu", " ", "漢ａ", "\n "):
        check("".join(draw.choice(letters) for _ in range(20_000)))
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "REMEMBERED", 5)
    check("a few words of a text, and then\nsome more of them " * 50)
    began = time.perf_counter()
    OWN.encode("".join(draw.choice("etaoinshrdlu") for _ in range(1_000_000)))
    assert time.perf_counter() - began < 60


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        ids = LIBRARY.encode(r.text or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, S.op11_sentence_pieces(spark, SF).collect())) == sorted(want)


def test_rows(spark):
    rows = [(1, "It's  the end,\n\nisn't it? "), (2, None), (3, ""), (3, ""), (None, "x " * 400), (5, "<s>▁"), (1, "same id"), (2**62 + 1, "a large id")]
    docs = spark.createDataFrame([(d, t, 7, "n") for d, t in rows], "doc_id long, text string, found int, n_tokens string")
    got = S.digests(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == sorted((d is None, d, len(LIBRARY.encode(t or ""))) for d, t in rows)
    back = S.decode(S.encode(docs)).collect()
    assert sorted(r.decoded for r in back) == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert S.digests(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [264, None, -5, 99999, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in S.decode(odd).collect()} == {1: None, 2: "", 3: "a"}


def test_other_models_are_refused(spark, tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="not a BPE model"):
        S.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)

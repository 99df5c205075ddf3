import hashlib
import json
import random
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
OWN = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
SPLITTER = bpe.Splitter(list(OWN.special))
PIECES = ["a", "B", "é", "ß", "1", "²", "Ⅷ", " ", "  ", "\n", "\t", "\x85", " ", "　", "'", "'s", "'re", "'ll", "'S", ".", "-", "漢", "🙂", "́", "\x1c", "\x00", "<|endoftext|>", "<|", "​", "٣", " the", "'", "'d"]


def check(text):
    words = SPLITTER.words(text)
    ids = [i for w in words for i in OWN.encode(w)]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert "".join(words) == text and ids == want
    assert OWN.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_ids_of_pieces(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=40))
def test_ids_of_any_text(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, bpe.PART]), max_size=6).map("".join), max_size=6))
def test_texts_split_together(texts):
    words = bpe.Words(texts, SPLITTER, 3)
    name = dict(zip(words.place, words.names, strict=True))
    assert [[name[k] for k in own.tolist()] for own in words.codes] == [SPLITTER.words(t) for t in texts]


def test_classes_of_all_assigned_code_points():
    chars = [chr(c) for c in range(0x3400) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    check("".join("a" + c + "a1" + c + "1." + c + ". " + c for c in chars))


def test_very_long_words():
    draw = random.Random(1)
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000, 30_000):
        for letters in ("a", "ab", "etaoinshrdlu", "éü漢a"):
            check("".join(draw.choice(letters) for _ in range(n)))
    began = time.perf_counter()
    OWN.encode("".join(draw.choice("etaoinshrdlu") for _ in range(1_000_000)))
    assert time.perf_counter() - began < 60


def test_vocabularies_that_begin_alike_are_told_apart(spark, tmp_path):
    source = open(PATH, encoding="utf-8").read()
    other = json.loads(source)
    other["model"]["merges"][-1], other["model"]["merges"][0] = other["model"]["merges"][0], other["model"]["merges"][-1]
    texts = []
    for k, model in enumerate((json.loads(source), other)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(model), encoding="utf-8")
        texts.append([r.ids for r in bpe.encode(spark.createDataFrame([(1, "the then there into the thing")], "doc_id long, text string"), path).collect()])
    assert texts[0] != texts[1]


def rows_of(spark):
    rows = [(1, "It's the <|endoftext|> of\n\n all, isn't it?  "), (2, None), (3, ""), (3, ""), (None, "x " * 400), (5, "<|endoftext|><|endoftext|>"), (6, "été " * 3000 + "🙂"), (1, "other row, same id"), (2**62 + 1, "a large id")]
    return rows, spark.createDataFrame([(d, t, 7, "n") for d, t in rows], "doc_id long, text string, chunk int, n_tokens string")


@pytest.mark.parametrize("each", [bpe.DEAL, 40])
def test_digests_and_ids(spark, monkeypatch, each):
    monkeypatch.setattr(bpe, "DEAL", each)
    rows, docs = rows_of(spark)
    want = []
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, bpe.digests(docs).collect()), key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t in rows)
    assert bpe.digests(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [464, -5, 99999]), (4, [0xE9])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd).collect()} == {1: None, 2: "", 3: "The", 4: OWN.pieces[0xE9].decode("utf-8", "replace")}

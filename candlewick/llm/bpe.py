"""Operator 2, BPE encoding and decoding by a table of distinct words.

Byte pair encoding never crosses the borders of pre-tokens ("words"), so a word's ids depend on the word alone.

1. Documents are dealt into chunks. A chunk splits its texts and sends each distinct word once, to a bucket
   by the word's hash.
2. A bucket gathers the distinct words of all chunks, encodes each once, and returns to each chunk the ids of
   its words, in the order in which they came.
3. A chunk splits its texts again and puts the words' ids in their places.

Decoding joins ids with the table of pieces (``decode``), one row for each token. The digests of a whole corpus don't
need that many rows: there each distinct word of a chunk is decoded once, by a dictionary of the same pieces.

The texts are shuffled once, compressed, and that shuffle is read twice. Chunks hold about DEAL bytes each and buckets
are as many, so memory in a task stays as the data grow, whatever the session's partitions; rows are dealt by their
place, so repeated ones part; a very frequent word is one row of each chunk. The vocabulary file has a fixed size
and is broadcast.

Splitting works on code points in numpy: each has a class (letter, number, white space, other) from
``unicodedata``, and borders follow from neighbouring classes.

Defined cases: a null text is empty and has no ids; repeated rows return as often as they come; special
tokens inside a text become their own ids; texts are encoded whole, and a word of any length costs n log n;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import deals, numbered, table

DEAL = 12 << 20  # bytes of text in a chunk
LONG = 256  # bytes of a word from which merges are found by a heap
VOCABULARY = "byte_bpe_50k.json"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White_Space beyond what the categories Zs, Zl and Zp hold.
MORE_SPACE = [*range(0x09, 0x0E), 0x85]
SUFFIXES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]  # Fixed values: they are words wherever a word may start


# ---- splitting


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    out[MORE_SPACE] = SPACE
    return out


def _borders(text: str) -> np.ndarray:
    """Where the words of a text start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    kind = _classes()[codes]
    part = codes == ord(PART)
    at = np.ones(n, dtype=bool)  # starts of runs of one class, and of what stands between texts
    at[1:] = (kind[1:] != kind[:-1]) | part[1:] | part[:-1]
    space = kind == SPACE
    # the last of a run of white space before a word: a blank joins the word, anything else stands alone
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~part[1:]
    at |= last
    blank = last & (codes == 32)
    after = np.flatnonzero(blank) + 1
    at[after] = False
    # suffixes after an apostrophe at which a word starts
    for i in np.flatnonzero((codes == 39) & at).tolist():
        for s in SUFFIXES:
            if text.startswith(s, i):
                end = i + len(s)
                at[i + 1] = False
                if end < n:
                    at[end] = True
                    if kind[end] == SPACE and codes[end] == 32 and end + 1 < n and not space[end + 1] and not part[end + 1]:
                        at[end + 1] = False
                break
    return np.flatnonzero(at)


def split(text: str) -> list[str]:
    """The words of a text without special tokens; joined, they are the text."""
    if not text:
        return []
    at = _borders(text).tolist()
    return [text[a:z] for a, z in zip(at, [*at[1:], len(text)], strict=True)]


PART = "\U0010ffff"  # stands between texts that are split together


def split_all(texts: list[str]) -> list[str]:
    """The words of all texts, with a PART between two texts; no text may hold one, or a special token."""
    return split(PART.join(texts))


class Splitter:
    """Words of a text, special tokens being words of their own."""

    def __init__(self, special: list[str]) -> None:
        self.special = sorted(special, key=len, reverse=True)

    def words(self, text: str) -> list[str]:
        found = [(i, s) for s in self.special if (i := text.find(s)) >= 0]
        if not found:
            return split(text)
        i, s = min(found, key=lambda x: (x[0], -len(x[1])))
        out = split(text[:i])
        while True:
            out.append(s)
            start = i + len(s)
            found = [(j, t) for t in self.special if (j := text.find(t, start)) >= 0]
            if not found:
                return out + split(text[start:])
            i, s = min(found, key=lambda x: (x[0], -len(x[1])))
            out += split(text[start:i])


# ---- words and ids


class Vocabulary:
    """Ranks of pairs, ids of pieces, and pieces of ids of a byte-level BPE file."""

    def __init__(self, source: str) -> None:
        got = json.loads(source)
        model = got["model"]
        letter = _byte_letters()
        back = {c: b for b, c in enumerate(letter)}
        self.letters = letter
        self.ids = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in got["added_tokens"]}
        self.pieces = {i: bytes(back[c] for c in p) for p, i in self.ids.items() if all(c in back for c in p)}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the pair of the lowest rank is merged, the leftmost first, until none is known."""
        if word in self.special:
            return [self.special[word]]
        rank, never = self.rank.get, len(self.rank)
        p = [self.letters[b] for b in word.encode()]
        if len(p) > LONG:
            return self._encode_long(p)
        ranks = [rank(x, never) for x in zip(p, p[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            p[i] += p.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((p[i - 1], p[i]), never)
            if i < len(ranks):
                ranks[i] = rank((p[i], p[i + 1]), never)
        return [self.ids[x] for x in p]

    def _encode_long(self, p: list[str]) -> list[int]:
        """The same by a heap of (rank, place) over a linked list of pieces: n log n for a word of n bytes."""
        rank, n = self.rank.get, len(p)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank((p[i], p[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not p[i] or j < 0 or rank((p[i], p[j])) != r:
                continue  # one of the two has been merged since
            p[i] += p[j]
            p[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank((p[a], p[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.ids[x] for x in p if x]

    def decode(self, ids) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(0x100 + hidden.index(b)) for b in range(256)]


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(sent) -> Vocabulary:
    """One vocabulary for each file and worker; sent: a broadcast of the file's digest and text."""
    key, source = sent.value
    if key not in _loaded:
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


class Words:
    """The distinct words of a chunk by bucket, in an order that a second look gives again.

    codes: for each text its words as places among ``found``, the words in the order of their first sight.
    """

    def __init__(self, texts: list[str], splitter: Splitter, buckets: int) -> None:
        index: dict[str, int] = defaultdict(count().__next__)
        place = index.__getitem__
        self.codes: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and PART not in t and not any(s in t for s in splitter.special)]
        for some in _together(plain, texts):  # split together: a step over a long array costs little for each text
            codes = np.array(list(map(place, split_all([texts[k] for k in some]))), dtype=np.uint32)
            cuts = np.flatnonzero(codes == index[PART]) if len(some) > 1 else np.zeros(0, dtype=np.int64)
            for k, a, z in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(codes)], strict=True):
                self.codes[k] = codes[a:z]
        for k in set(range(len(texts))) - set(plain):
            self.codes[k] = np.array(list(map(place, splitter.words(texts[k]))), dtype=np.uint32)
        self.places = len(index)
        if not any(PART in t for t in texts):
            index.pop(PART, None)
        names = sorted(index)
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in names], dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[order]
        self.names = [names[k] for k in order.tolist()]
        self.place = [index[w] for w in self.names]

    def runs(self) -> Iterator[tuple[int, int, int]]:
        if len(self.bucket):
            cut = np.flatnonzero(self.bucket[1:] != self.bucket[:-1]) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(self.bucket)], strict=True):
                yield int(self.bucket[a]), a, z


def _together(which: list[int], texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    """Runs of texts of about ``most`` characters."""
    held, size = [], 0
    for k in which:
        held.append(k)
        size += len(texts[k])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pack(numbers: list[int]) -> bytes:
    """Numbers in the fewest bytes each that hold them all; the first byte says how many."""
    a = np.array(numbers, dtype=np.uint32)
    wide = 1 if not len(a) or a.max() < 256 else 2 if a.max() < 65536 else 4
    return bytes([wide]) + a.astype(f"<u{wide}").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int64)


@F.arrow_udf(T.BinaryType())
def _squeezed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts as they go through the shuffle: their length and Zstandard's form of them."""
    codec = pa.Codec("zstd", 3)
    for batch in texts:
        yield pa.array([None if x is None else len(x).to_bytes(5, "little") + codec.compress(x, asbytes=True) for x in batch.cast(pa.binary()).to_pylist()], type=pa.binary())


SENT = "chunk long, bucket long, sizes binary, words binary"
CODED = "chunk long, bucket long, counts binary, ids binary"


def _texts(frame: pd.DataFrame) -> list[str]:
    codec = pa.Codec("zstd")
    return ["" if x is None else codec.decompress(x[5:], int.from_bytes(x[:5], "little"), asbytes=True).decode() for x in frame["text"]]


def _send_words(sent, buckets: int):
    def send(frame: pd.DataFrame) -> pd.DataFrame:
        words = Words(_texts(frame), Splitter(list(_vocabulary(sent).special)), buckets)
        rows = []
        for b, i, j in words.runs():
            raw = [w.encode() for w in words.names[i:j]]
            rows.append((int(frame["chunk"].iat[0]), b, _pack([len(w) for w in raw]), b"".join(raw)))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "sizes", "words"])

    return send


def _encode_words(sent):
    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        vocabulary, known = _vocabulary(sent), {}
        counts, ids = [], []
        for sizes, words in zip(frame["sizes"], frame["words"], strict=True):
            ends = np.cumsum(_unpack(sizes)).tolist()
            here = []
            for a, z in zip([0, *ends], ends, strict=False):
                w = words[a:z]
                if w not in known:
                    known[w] = vocabulary.encode(w.decode())
                here.append(known[w])
            counts.append(_pack([len(x) for x in here]))
            ids.append(_pack(list(chain.from_iterable(here))))
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "counts": counts, "ids": ids})

    return encode


def _named(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """rows, whose first column is a doc_id or None: all its digits stay."""
    frame = pd.DataFrame(rows, columns=columns)
    return frame.assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))


def _put_back(sent, buckets: int, whole: bool):
    def put(docs: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        vocabulary = _vocabulary(sent)
        words = Words(_texts(docs), Splitter(list(vocabulary.special)), buckets)
        ids_of: list[list[int]] = [[]] * words.places
        by_bucket = {b: (c, i) for b, c, i in zip(coded["bucket"].tolist(), coded["counts"], coded["ids"], strict=True)}
        for b, i, j in words.runs():
            counts, ids = by_bucket[b]
            ends = np.cumsum(_unpack(counts)).tolist()
            ids = _unpack(ids).tolist()
            for k, a, z in zip(words.place[i:j], [0, *ends], ends, strict=False):
                ids_of[k] = ids[a:z]
        out = []
        names = [None if none else d for d, none in zip(docs["doc_id"].tolist(), docs["nameless"].tolist(), strict=True)]
        if whole:
            for d, own in zip(names, words.codes, strict=True):
                out.append((d, list(chain.from_iterable(map(ids_of.__getitem__, own.tolist())))))
            return _named(out, ["doc_id", "ids"])
        # digests straight from the words: the ids as digits, the pieces as bytes
        digits = [",".join(map(str, i)) for i in ids_of].__getitem__
        pieces = [vocabulary.decode(i) for i in ids_of].__getitem__
        number = np.array([len(i) for i in ids_of], dtype=np.int64)
        for d, own in zip(names, words.codes, strict=True):
            at = own.tolist()
            decoded = b"".join(map(pieces, at)).decode("utf-8", "replace")
            out.append((d, int(number[own].sum()), hashlib.sha256(",".join(map(digits, at)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return _named(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return put


def _vocabulary_text(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(os.fspath(path), encoding="utf-8") as f:
        return f.read()


def _sent(spark: SparkSession, path: str | None):
    text = _vocabulary_text(path)
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def _coded(docs: DataFrame, path: str | None, whole: bool, schema: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = deals(docs, "text", DEAL)
    sent = _sent(spark, path)
    # ids go through pandas as numbers that are never null, so all their digits stay
    own = F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.isnull("doc.doc_id").alias("nameless")
    texts = numbered(docs).select(*own, _squeezed("doc.text").alias("text"), F.pmod(F.xxhash64("rid"), F.lit(n)).alias("chunk"))
    words = texts.groupBy("chunk").applyInPandas(_send_words(sent, n), SENT)
    coded = words.groupBy("bucket").applyInPandas(_encode_words(sent), CODED)
    return texts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInPandas(_put_back(sent, n, whole), schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs; path: a byte-level BPE file, by default the public one."""
    return _coded(docs, path, True, "doc_id long, ids array<int>")


@F.arrow_udf(T.StringType())
def _as_text(raw: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in raw:
        yield pa.array([None if x is None else x.decode("utf-8", "replace") for x in batch.to_pylist()], type=pa.string())


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece) of a vocabulary: its bytes by id."""
    return spark.createDataFrame(sorted(Vocabulary(_vocabulary_text(path)).pieces.items()), "id int, piece binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with ids) with the column ``decoded``: ids with their places are joined with the pieces, and the pieces of
    a row put together in order; null ids give null, an unknown id gives nothing."""
    kept = numbered(encoded)
    tokens = kept.select("rid", F.posexplode("doc.ids").alias("place", "id")).join(F.broadcast(pieces(encoded.sparkSession, path)), "id")  # as large as the vocabulary
    ordered = F.sort_array(F.collect_list(F.struct("place", F.hex("piece").alias("piece"))))
    raw = tokens.groupBy("rid").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: t["piece"]), "")).alias("raw"))
    found = kept.join(raw, "rid", "left").withColumn("raw", F.when(F.col("doc.ids").isNotNull(), F.coalesce("raw", F.lit(b""))))
    return found.select("doc.*", _as_text("raw").alias("decoded"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs."""
    return _coded(docs, path, False, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline stage, the last: every row's ids as counts and digests, in the cases defined above; the copies that the
    mix has made are rows like others."""
    return digests(docs)

"""Operator 11, SentencePiece encoding and decoding by a table of prefixes.

In merge-type (BPE) encoding the last token of a text's encoding is unique for each of its prefixes, and what stands before
it is the encoding of a shorter prefix. So a table with the last token of every prefix holds the encoding of them all:

1. An automaton of all pieces gives, for each place of a text, the pieces that end there.
2. One of them is the prefix's last token: the one whose pair with the last token of the prefix before it is compatible,
   that is, merging the characters of both would give these two tokens again. The test replays the merges of both tokens in
   their order, and looks whether a merge across their border would have come first. Pairs tested are remembered.
3. From the end of the text the ids are recovered backwards, each token naming the prefix before it.

A text is cut where no merge can cross: before a space that follows something else, between letters and marks, and around
line ends, each only if no piece has the two characters side by side. Each distinct stretch is encoded once in a task, as long as a table of bounded size remembers
it; a text is digested stretch by stretch, so a task holds one batch of texts. Nothing is shuffled, and lost tasks run again
by themselves. The file of pieces has a fixed size and is broadcast.

Characters that are no piece become the ids of their bytes. ``decode`` puts the pieces of ids together: a piece's ``▁`` is a
space, the space that encoding adds to the front goes, runs of bytes are read as UTF-8 with U+FFFD for what is none, and
control ids are nothing.

Defined cases: a null text is empty and has no ids; null ids give null, ids that no piece has give nothing; the names of
control pieces inside a text are plain characters; texts are encoded whole, and a word of any length costs time linear in
its length; repeated rows return as often as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # Fixed values: kinds of pieces in the file
REMEMBERED = 1 << 18  # stretches, and as many pairs, that a task remembers
BLOCK = 1 << 20  # characters of a text that are split together
NEVER = float("inf")
_BEFORE_SPACE = re.compile(f"[^{SPACE}](?={SPACE})")


# ---- the file


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size, form = (4, "<f") if key & 7 == 5 else (8, "<d")
            yield key >> 3, struct.unpack(form, data[at : at + size])[0]
            at += size


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id. Only what this operator encodes is taken: BPE with byte fallback, text as it is, a
    space before the first word."""
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("not a BPE model with byte fallback, plain normalisation and a leading space")
    if odd := {kind for *_, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"pieces of kinds {sorted(odd)}")
    return pieces


# ---- encoding


def _cuts(long: list[str]) -> str:
    """A pattern of stretches that no merge crosses: between two of them stand characters that no piece has side by side.

    White space that no piece holds stands apart; spaces belong to what follows; ASCII's marks part from all characters but
    those that some piece has beside a mark, which go with both.
    """
    beside = {pair for p in long for pair in zip(p, p[1:], strict=False)}
    if any(b == SPACE != a for a, b in beside):
        raise ValueError("a piece goes on past a space")
    inside = {c for pair in beside for c in pair}
    apart = re.escape("".join(c for c in "\n\r\t\x0b\x0c" if c not in inside))
    marks = {chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()}
    both = {c for pair in beside if marks & set(pair) for c in pair} - marks - {SPACE}
    mark, shared = f"[{re.escape(''.join(sorted(marks)))}]+", f"[{re.escape(''.join(sorted(both)))}]+" if both else "(?!)"
    other = f"[^{SPACE}{mark[1:-2]}{re.escape(''.join(sorted(both)))}{apart}]+"
    run = f"(?:{other}|{mark})"
    return f"{SPACE}*(?:{run}|{shared}{run}?)(?:{shared}{run}?)*|{SPACE}+" + (f"|[{apart}]+" if apart else "")


class Known(dict):
    """What has been found of stretches. When it is full it starts anew, but takes over what is asked for again until it is
    full again. Long ones aren't kept."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, stretch: str):
        found = self.old.get(stretch) or self.find(stretch)
        if len(stretch) < 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[stretch] = found
        return found


class Pieces:
    """Automaton, merges and ids of a model."""

    def __init__(self, data: bytes) -> None:
        self.pieces = read_model(data)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.rank = {p: -self.pieces[i][1] for p, i in self.ids.items()}  # merges of lower rank come first
        self.merges: dict[str, tuple[list, list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known = Known(self.of_stretch)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cut = re.compile(_cuts([p for p in self.ids if len(p) > 1]))

    def _merged(self, piece: str) -> tuple[list, list, list] | None:
        """The ranks of a piece's merges in their order, and the symbols at its front and its back before each of them and
        after the last; None if its characters don't merge to the piece."""
        if piece not in self.merges:
            symbols, ranks, fronts, backs = list(piece), [], [piece[0]], [piece[-1]]
            while len(symbols) > 1:
                found = [(self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
                rank, k = min(found)
                if rank == NEVER:
                    break
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                ranks.append(rank)
                fronts.append(symbols[0])
                backs.append(symbols[-1])
            self.merges[piece] = ([*ranks, NEVER], fronts, backs) if len(symbols) == 1 else None
        return self.merges[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Would merging the characters of both give left and right? The merges on both sides run by rank, of equal ranks
        the left one first; one across the border needs a lower rank than the left side's next."""
        a, b = self._merged(left), self._merged(right)
        if a is None or b is None:
            return False
        (left_ranks, _, backs), (right_ranks, fronts, _) = a, b
        i = j = 0
        while True:
            x, y = left_ranks[i], right_ranks[j]
            across = self.rank.get(backs[i] + fronts[j], NEVER)
            if across < x and across <= y:
                return False
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def prefixes(self, text: str) -> array:
        """By place: the last token of the prefix that ends there; -1 behind a character that is no piece. Such a character
        merges with nothing, so what follows it starts anew."""
        last = array("i", [-1]) * len(text)
        known, done = self.pairs.get, -1
        for end, (token, size) in self.automaton.iter(text):
            if end == done:
                continue  # this prefix has its token
            left = last[end - size] if size <= end else -1
            fits = known(left << 32 | token)
            if fits is None:
                fits = self._fits(left, token)
            if fits:
                last[end] = token
                done = end
        return last

    def _fits(self, left: int, token: int) -> bool:
        """Is the pair compatible, or the token one by itself? Remembered."""
        right = self.pieces[token][0]
        fits = self._merged(right) is not None if left < 0 else self.compatible(self.pieces[left][0], right)
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[left << 32 | token] = fits
        return fits

    def encode(self, stretch: str) -> list[int]:
        """Ids of a stretch, recovered from its end."""
        last, out, end = self.prefixes(stretch), [], len(stretch)
        while end:
            token = last[end - 1]
            if token >= 0:
                out.append(token)
                end -= len(self.pieces[token][0])
            else:
                out += [self.byte_ids[b] for b in reversed(stretch[end - 1].encode())]
                end -= 1
        out.reverse()
        return out

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Parts of a text with its leading space that no merge crosses, those of about BLOCK characters together; joined,
        they are the text with ``▁`` for spaces."""
        whole, at = (SPACE + text.replace(" ", SPACE)) if text else "", 0
        while at < len(whole):
            end = _BEFORE_SPACE.search(whole, at + BLOCK) if len(whole) > at + BLOCK else None
            upto = end.start() + 1 if end else len(whole)
            yield self.cut.findall(whole, at, upto)
            at = upto

    def text_ids(self, text: str) -> list[int]:
        return [i for some in self.stretches(text) for stretch in some for i in self.encode(stretch)]

    # ---- decoding

    def raw(self, ids: list[int]) -> bytes:
        """The bytes of ids, with ``▁`` for spaces. Bytes by themselves may be no UTF-8."""
        out = []
        for i in ids:
            if 0 <= i < len(self.pieces):
                piece, _, kind = self.pieces[i]
                out.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.encode())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids. Bytes that are no UTF-8 become a U+FFFD each; the first space of the first piece goes."""
        out, run, front = [], bytearray(), True
        for i in [*ids, None]:
            piece, _, kind = self.pieces[i] if i is not None and 0 <= i < len(self.pieces) else ("", 0, CONTROL)
            if i is not None and kind == BYTE:
                run.append(int(piece[3:5], 16))
                continue
            if run:
                out.append(bytes_as_text(bytes(run)))
                front = False
                run.clear()
            if i is None or kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            else:
                out.append((piece[1:] if front and piece[0] == SPACE else piece).replace(SPACE, " "))
            front = False
        return "".join(out)

    # ---- whole texts

    def of_stretch(self, stretch: str) -> tuple[str, bytes]:
        """The ids of a stretch as digits, and the text that they stand for. Whole characters go into a stretch, so that its
        bytes are UTF-8 whatever stands beside it."""
        ids = self.encode(stretch)
        return ",".join(map(str, ids)), self.raw(ids).decode().replace(SPACE, " ").encode()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them."""
        n, ids, decoded, comma = 0, hashlib.sha256(), hashlib.sha256(), b""
        for some in self.stretches(text):
            digits, texts = zip(*map(self.known.__getitem__, some), strict=True)
            joined, out = ",".join(digits).encode(), b"".join(texts)
            n += joined.count(b",") + 1
            ids.update(comma + joined)
            decoded.update(out if comma else out[1:])  # the first is the space that was added
            comma = b","
        return n, ids.hexdigest(), decoded.hexdigest()


def bytes_as_text(run: bytes) -> str:
    """UTF-8 with a U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        size = next((n for n, least in ((4, 0xF0), (3, 0xE0), (2, 0xC0)) if run[at] >= least), 1)
        try:
            out.append(run[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


# ---- jobs

_loaded: dict[str, Pieces] = {}


def _pieces(sent) -> Pieces:
    """One table for each file and worker; sent: a broadcast of the file's digest and bytes."""
    key, data = sent.value
    if key not in _loaded:
        _loaded[key] = Pieces(data)
    return _loaded[key]


def _sent(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(os.fspath(path), "rb") as f:
        data = f.read()
    read_model(data)  # a file that can't be used fails here
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with the column ``ids``; path: a model file, by default the public one."""
    sent = _sent(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_pieces(sent).text_ids(x.as_py() or "") for x in batch], type=pa.list_(pa.int32()))

    return docs.withColumn("ids", of("text"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with ids) with the column ``decoded``."""
    sent = _sent(encoded.sparkSession, path)

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (ids := x.as_py()) is None else _pieces(sent).decode([i for i in ids if i is not None]) for x in batch], type=pa.string())

    return encoded.withColumn("decoded", of("ids"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs."""
    sent = _sent(docs.sparkSession, path)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, ids, decoded = zip(*(_pieces(sent).digests(x.as_py() or "") for x in batch), strict=True) if len(batch) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", of("text").alias("found")).select("doc_id", "found.*")


def op11_sentence_pieces(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))

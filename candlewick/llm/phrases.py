"""Operator 12, phrase collocation mining: weighted n-grams of distinct pieces, counted in buckets.

1. Texts are cut into pieces, and equal pieces of a language become one row with a multiplicity: first in each task, then
   in chunks, to which pieces are dealt by their hash.
2. A chunk numbers its words and counts each distinct pair of neighbouring words by its multiplicities, in numpy. Hashes of
   the pairs go to buckets. A bucket adds them up out of core in DuckDB and tells each chunk which of its pairs reach LEAST.
   Nothing else can be part of a candidate, as a phrase is no more frequent than any pair in it; equal hashes of unlike pairs
   only let some through that the next step drops.
3. Chunks count the phrases of LONGEST words or fewer that are made of such pairs, and all single words. They go to buckets by
   their own hash, are added up out of core in DuckDB again, and those that reach LEAST are written. The counts are exact.
4. Candidates ask for the counts of their parts. Each deal of candidates asks for a part once, however many of its candidates
   share it; requests are shuffled to where the counts are, and the answers return to the deals.
5. The lowest score of a candidate's cuts counts. A candidate is dropped for a longer one that holds it with at least COVERED
   hundredths of its count; longer ones tell this to all phrases inside them. Each language's first TOP are found in
   splits and then among the splits' firsts.

No hot key: a frequent piece, pair or phrase is one row of each task or chunk. Chunks hold about DEAL bytes of text, buckets
are as many, so a task's share stays as the data grow. DuckDB works in a folder of the task's own, removed with the task, and
spills there beyond MEMORY; a lost executor loses only that.

Defined cases: null texts are empty; a null lang is ``und``, and so is one of that name; pieces without a word count nothing;
texts of any length are read whole; repeated rows count as often as they come; scores are exact in 38 digits; phrases of equal
score and count stand in the order of their UTF-8 bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import LOWER, UPPER, materialize, table

LEAST, LONGEST, COVERED, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
DEAL = 4 << 20  # bytes of text of a chunk
HELD = 32 << 20  # bytes of distinct pieces that a task holds before it sends them
MEMORY = "256MB"  # of a task's DuckDB
BATCH = 1 << 18  # rows that go to DuckDB together
SPLITS = 64  # parts of a language whose firsts are found by themselves
ASKING = 1 << 16  # candidates that ask together
END = "\n"  # no word: it stands between pieces

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans((UPPER + "\t").encode() + _ENDS, (LOWER + " ").encode() + b"\n" * len(_ENDS))


# ---- pieces


def pieces(text: bytes) -> Iterator[bytes]:
    """The pieces of a UTF-8 text that have a word, with one space between words."""
    for piece in text.translate(_PLAIN).split(b"\n"):
        if words := piece.split():
            yield b" ".join(words)


PIECES = "chunk long, lang string, size long, pieces binary, times binary"


def _send_pieces(chunks: int):
    """Distinct pieces of a task and how often they come, packed by the chunk that their hash names."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = defaultdict(int)
        size, codec = 0, pa.Codec("zstd", 3)

        def rows() -> pa.RecordBatch:
            dealt: dict[tuple[int, str], list[tuple[bytes, int]]] = defaultdict(list)
            for (lang, p), n in held.items():
                dealt[xxhash.xxh64_intdigest(p) % chunks, lang].append((p, n))
            held.clear()
            raw = [b"\n".join([p for p, _ in own]) for own in dealt.values()]
            times = [np.array([n for _, n in own], dtype="<i8").tobytes() for own in dealt.values()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c, _ in dealt], type=pa.int64()), pa.array([lang for _, lang in dealt], type=pa.string()), pa.array(map(len, raw), type=pa.int64()),
                    pa.array([codec.compress(x, asbytes=True) for x in raw], type=pa.binary()), pa.array([codec.compress(x, asbytes=True) for x in times], type=pa.binary()),
                ],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for p in pieces(text.as_py() or b""):
                    if not held[lang, p]:
                        size += len(p) + 100
                    held[lang, p] += 1
                if size >= HELD:
                    yield rows()
                    size = 0
        yield rows()

    return of


def _received(chunk: pa.Table, lang: str) -> tuple[pa.Array, np.ndarray]:
    """The distinct pieces of a language in a chunk, and their multiplicities."""
    codec, texts, times = pa.Codec("zstd"), [], []
    own = chunk.filter(pc.equal(chunk["lang"], lang))
    for size, packed, counted in zip(own["size"].to_pylist(), own["pieces"], own["times"], strict=True):
        some = codec.decompress(packed.as_py(), size, asbytes=True).decode().split("\n")
        texts.append(pa.array(some, type=pa.string()))
        times.append(np.frombuffer(codec.decompress(counted.as_py(), 8 * len(some), asbytes=True), dtype="<i8"))
    table = pa.table({"piece": pa.chunked_array(texts), "times": np.concatenate(times)})
    distinct = table.group_by("piece", use_threads=False).aggregate([("times", "sum")])
    return distinct["piece"].combine_chunks(), distinct["times_sum"].to_numpy()


# ---- n-grams of a chunk


def grouped(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, the sum of each one's weights, and the place of each code among them."""
    if not len(codes):
        return codes, weights, np.zeros(0, dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    of = np.empty(len(codes), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], np.add.reduceat(weights[order], np.flatnonzero(new)), of


class Counted:
    """The words of one language's pieces of a chunk in a row, by number, and the distinct pairs of neighbours."""

    def __init__(self, lang: str, texts: pa.Array, times: np.ndarray) -> None:
        index: dict[str, int] = defaultdict(count().__next__)
        place, self.end = index.__getitem__, index[END]
        parts, sizes = [np.zeros(0, dtype=np.int32)], []
        for start in range(0, len(texts), 4096):
            some = texts.slice(start, 4096)
            sizes.append(pc.count_substring(some, " ").to_numpy(zero_copy_only=False) + 2)  # words, and an end
            parts.append(np.fromiter(map(place, f" {END} ".join(some.to_pylist()).split(" ")), dtype=np.int32))
            parts.append(np.array([self.end], dtype=np.int32))
        self.words = np.concatenate(parts).astype(np.int64)
        self.weight = np.repeat(times, np.concatenate([*sizes, np.zeros(0, dtype=np.int64)]).astype(np.int64))
        self.names = list(index)
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in self.names], dtype=np.uint64)
        inside = (self.words[:-1] != self.end) & (self.words[1:] != self.end)
        self.at = np.flatnonzero(inside)  # where a pair starts
        codes = self.words[self.at] * len(self.names) + self.words[self.at + 1]
        self.pairs, self.times, self.pair_of = grouped(codes, self.weight[self.at])

    def pair_hashes(self) -> np.ndarray:
        a, b = self.hashes[self.pairs // len(self.names)], self.hashes[self.pairs % len(self.names)]
        mixed = a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(29) | b >> np.uint64(35))
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed ^ mixed >> np.uint64(32)).view(np.int64)

    def phrases(self, frequent: np.ndarray) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        """(phrases, their number of words, counts) of all single words and of phrases made of frequent pairs."""
        names, size = pa.array(self.names, type=pa.string()), len(self.names)
        real = self.words != self.end
        one, times, _ = grouped(self.words[real], self.weight[real])
        yield names.take(pa.array(one)), 1, times
        good = np.zeros(len(self.words) + LONGEST, dtype=bool)
        good[self.at[frequent[self.pair_of]]] = True
        chosen = np.flatnonzero(frequent)
        text = pc.binary_join_element_wise(names.take(pa.array(self.pairs[chosen] // size)), names.take(pa.array(self.pairs[chosen] % size)), " ")
        yield text, 2, self.times[chosen]
        number = np.full(len(self.pairs), -1)
        number[chosen] = np.arange(len(chosen))
        of = np.full(len(self.words), -1)
        of[self.at] = number[self.pair_of]  # by place, the phrase that starts there
        at = np.flatnonzero(good)
        for k in range(3, LONGEST + 1):
            at = at[good[at + k - 2]]
            last = self.words[at + k - 1]
            found, times, place = grouped(of[at] * size + last, self.weight[at])
            text = pc.binary_join_element_wise(text.take(pa.array(found // size)), names.take(pa.array(found % size)), " ")
            yield text, k, times
            of[at] = place

    def total(self) -> int:
        return int(self.weight[self.words != self.end].sum())


def _by_lang(chunk: pa.Table) -> Iterator[Counted]:
    for lang in sorted(set(chunk["lang"].to_pylist())):
        counted = Counted(lang, *_received(chunk, lang))
        counted.lang = lang
        yield counted


PAIRS = "chunk long, pair long, times long"


def _send_pairs(chunk: pa.Table) -> pa.Table:
    name, out = chunk["chunk"][0].as_py(), []
    for c in _by_lang(chunk):
        out.append(pa.table({"chunk": pa.array(np.full(len(c.pairs), name)), "pair": pa.array(c.pair_hashes()), "times": pa.array(c.times)}))
    return pa.concat_tables(out)


PHRASES = "lang string, phrase string, words int, times long"


def _send_phrases(chunk: pa.Table, told: pa.Table) -> pa.Table:
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("times", pa.int64())])
    if not chunk.num_rows:
        return schema.empty_table()
    frequent, out = told["pair"].to_numpy(), []
    for c in _by_lang(chunk):
        # all words of a language together have no phrase
        parts = [(pa.array([""]), 0, np.array([c.total()], dtype=np.int64)), *c.phrases(np.isin(c.pair_hashes(), frequent))]
        out += [pa.table([pa.array([c.lang] * len(t)), t, pa.array(np.full(len(t), k, dtype=np.int32)), pa.array(n.astype(np.int64))], schema=schema) for t, k, n in parts]
    return pa.concat_tables(out)


# ---- buckets


def _in_duckdb(shape: str, query: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows as table ``t`` of the given shape, on its own disk beyond MEMORY; the query's rows go on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="phrases-") as folder:
            con = duckdb.connect(f"{folder}/t.db", config={"memory_limit": MEMORY, "threads": "1", "temp_directory": f"{folder}/spill", "preserve_insertion_order": "false"})
            try:
                con.execute(f"CREATE TABLE t ({shape})")
                held, n = [], 0

                def put() -> None:
                    con.register("arrived", pa.Table.from_batches(held))
                    con.execute("INSERT INTO t SELECT * FROM arrived")
                    con.unregister("arrived")
                    held.clear()

                for batch in batches:
                    held.append(batch)
                    n += batch.num_rows
                    if n >= BATCH:
                        put()
                        n = 0
                if held:
                    put()
                yield from con.sql(query).to_arrow_reader(10_000)
            finally:
                con.close()

    return of


FREQUENT = "SELECT chunk, pair FROM t SEMI JOIN (SELECT pair FROM t GROUP BY pair HAVING sum(times) >= {least}) USING (pair)"
COUNTED = "SELECT lang, phrase, words, sum(times)::BIGINT AS times FROM t GROUP BY lang, phrase, words HAVING words = 0 OR sum(times) >= {least}"


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, times) of all words and phrases that occur ``least`` times; a language's number of words stands
    at the empty phrase."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bytes_of = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-bytes_of // DEAL))
    dealt = texts.mapInArrow(_send_pieces(n), PIECES)
    pairs = dealt.groupBy("chunk").applyInArrow(_send_pairs, PAIRS)
    told = pairs.repartition(n, "pair").mapInArrow(_in_duckdb("chunk BIGINT, pair BIGINT, times BIGINT", FREQUENT.format(least=least)), "chunk long, pair long")
    phrases = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_send_phrases, PHRASES)
    shape = "lang VARCHAR, phrase VARCHAR, words INT, times BIGINT"
    return phrases.repartition(n, "lang", "phrase").mapInArrow(_in_duckdb(shape, COUNTED.format(least=least)), PHRASES)


# ---- candidates


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of all candidates by their lowest cut; found: of :func:`counts`."""
    candidates = found.where("words >= 2").select("lang", "phrase", F.col("times").alias("a"), F.split("phrase", " ").alias("w"))
    deals = 1 + candidates.count() // ASKING
    cuts = (
        candidates.withColumn("deal", F.pmod(F.xxhash64("lang", "phrase"), F.lit(deals)))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
        .select("deal", "lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    )
    requests = cuts.select("deal", "lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    counted = found.where("words >= 1").select("lang", F.col("phrase").alias("part"), "times")
    answers = materialize(requests.join(counted, ["lang", "part"]), "answers")
    whole = cuts
    for side, name in (("first", "l"), ("rest", "r")):
        whole = whole.join(answers.withColumnsRenamed({"part": side, "times": name}), ["deal", "lang", side])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide("a"), wide("l") + wide("r"))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return whole.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(found: DataFrame) -> DataFrame:
    """(lang, phrase, over): phrases of two words or more inside longer candidates, with the largest count of those."""
    longer = found.where("words >= 3").select("lang", "times", "words", F.split("phrase", " ").alias("w"))
    sizes = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    places = sizes.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    return places.select("lang", _part(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "times").groupBy("lang", "phrase").agg(F.max("times").alias("over"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first ``top`` phrases. docs: with lang and text."""
    found = materialize(counts(docs, least), "counts")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    inside = F.coalesce(100 * wide("over") >= COVERED * wide("a"), F.lit(False))
    left = scored(found).join(covered(found), ["lang", "phrase"], "left").where(~inside).drop("over")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    split = left.withColumn("split", F.pmod(F.xxhash64("phrase"), F.lit(SPLITS)))
    firsts = split.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "split").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("words = 0").select("lang", F.col("times").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w, count(*) AS m FROM p GROUP BY ALL),
f AS (SELECT lang, len(g) AS k, array_to_string(g, ' ') AS phrase, sum(m)::HUGEINT AS a FROM
      (SELECT lang, m, w[i : i + k - 1] AS g FROM w, range(1, {LONGEST + 1}) t(k), range(1, len(w) - k + 2) s(i)) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= {LEAST}),
cut AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, {SCALE} * c.a // (x.a + y.a) AS score FROM c, range(1, k) t(j)
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT lang, phrase, a, unnest(arg_min({{'l': l, 'r': r, 'score': score}}, {{'s': score, 'j': j}})) FROM cut GROUP BY lang, phrase, a),
over AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, k) t(s), range(1, k - s + 2) u(i) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b LEFT JOIN over o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""

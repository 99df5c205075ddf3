"""Operator 8 in the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

At that similarity the fingerprints of two texts differ in about 10 of 64 bits, and in up to 19 in one pair of a
thousand, which no choice of pigeonhole blocks reaches with keys that are long enough. So candidates come from two sides:

1. SimHash: fingerprints over the sets' hashes that differ in at most DISTANCE bits, by operator 8's blocks.
2. Shared shingles, which leave no alike pair out. A text's sketch is the least of its shingle hashes, so many that
   two alike texts share at least ``enough`` of them (prefix filter with a margin: of a set's n hashes an alike one lacks at
   most a fifth, so their first ``enough`` common ones lie in both sketches). Texts with fewer hashes that
   another text has too are done. The others drop their ``enough - 1`` most frequent shared hashes, which leaves
   each alike pair one in common, so what a common line brings together is let go. The margin is a fifth of a text's shingles, so
that a line or two which many texts share are among those dropped, and don't chain unlike texts into blocks.

Candidates are linked to the least of those that they meet; components of these links are blocks, and inside a block
whole sets are compared. Copies are one set from the start. How often a hash occurs is counted as in operator 9: chunks
of sets send packed hashes to buckets, which answer with a byte for each.

A block is compared in splits of at most HOT sets and LOAD hashes. Only links that connect are sought, so sets that are
connected already are not compared. A block of several splits is first held against a few hubs, sets that stand for
many; after that only those sets that are not with the most are compared with the other splits, never all with all.

Defined cases: upper-case A-Z and white space make no difference, as in operator 8; fewer than five words are one
shingle; texts are read whole, however long; texts without a word are copies of each other; of alike rows the one with the smallest doc_id stays (null last),
then the one with the least row name; other columns are carried; an empty table stays empty; shingles are compared by
64-bit hashes, sets of them likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candlewick.llm import simhash
from candlewick.llm.common import deals, materialize, numbered, parts
from candlewick.llm.components import components

SHINGLE = 5
MARGIN = 5  # a sketch has one hash more for each so many shingles
DEAL = 32 << 20  # bytes of text whose sketches are a chunk
HOT = 512  # sets of one block that a task compares with each other, and
LOAD = 1 << 21  # the hashes that they have
HUBS = 16  # sets of a block that all its splits are held against


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingle hashes in order, as signed longs."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    return hashes[: n - (4 * n + 4) // 5 + 1 + n // MARGIN]


def enough(n: np.ndarray) -> np.ndarray:
    """Hashes of the sketch of a set of n that one of any alike set has at least."""
    return 1 + (4 * n + 4) // 5 // MARGIN


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int64)])))


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield _arrays([shingle_set(x or b"") for x in batch.cast(pa.binary()).to_pylist()])


SKETCHED = T.StructType([T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType())])


@F.arrow_udf(SKETCHED)
def sketches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The name of a text's set, its size, its fingerprint and its packed sketch."""
    for batch in texts:
        sid, n, fp, packed = [], [], [], []
        for x in batch.cast(pa.binary()):
            own = shingle_set(x.as_py() or b"")
            sid.append(xxhash.xxh64_intdigest(own.tobytes()))
            n.append(len(own))
            fp.append(simhash.majority(own.view(np.uint64)))
            packed.append(sketch(own).tobytes())
        signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
        yield pa.StructArray.from_arrays([signed(sid), pa.array(n, type=pa.int32()), signed(fp), pa.array(packed, type=pa.binary())], names=["sid", "n", "fp", "sketch"])


# ---- candidates by shared hashes


class Sketches:
    """The sketches of a chunk: hashes by bucket, then by hash; ``of`` tells whose each is."""

    def __init__(self, frame: pd.DataFrame, buckets: int) -> None:
        frame = frame.sort_values("sid", kind="stable")
        self.sid, self.n = frame["sid"].to_numpy(dtype=np.int64), frame["n"].to_numpy(dtype=np.int64)
        held = [np.frombuffer(x, dtype=np.int64) for x in frame["sketch"]]
        hashes = np.concatenate([*held, np.zeros(0, dtype=np.int64)])
        of = np.repeat(np.arange(len(held)), [len(x) for x in held])
        # the least hashes of a set lie close together at the low end, so buckets go by their low bits
        bucket = (hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.lexsort((hashes, bucket))
        self.hashes, self.of, bucket = hashes[order], of[order], bucket[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.hashes[1:] != self.hashes[:-1]
        self.first = np.flatnonzero(new)
        self.which = np.cumsum(new) - 1
        self.bucket = bucket[self.first].astype(np.int64)
        self.times = np.diff(np.append(self.first, len(order)))

    def runs(self) -> Iterator[tuple[int, int, int]]:
        if len(self.bucket):
            cut = np.flatnonzero(self.bucket[1:] != self.bucket[:-1]) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(self.bucket)], strict=True):
                yield int(self.bucket[a]), a, z


SENT = "chunk long, bucket long, hashes binary, times binary"
TOLD = "chunk long, bucket long, times binary"


def _send(buckets: int):
    def send(frame: pd.DataFrame) -> pd.DataFrame:
        s = Sketches(frame, buckets)
        rows = [(int(frame["chunk"].iat[0]), b, s.hashes[s.first[a:z]].tobytes(), np.minimum(s.times[a:z], 255).astype(np.uint8).tobytes()) for b, a, z in s.runs()]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "hashes", "times"])

    return send


def _tell(frame: pd.DataFrame) -> pd.DataFrame:
    """How many sets of all chunks have each hash, up to 255."""
    hashes = [np.frombuffer(x, dtype=np.int64) for x in frame["hashes"]]
    times = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in frame["times"]]).astype(np.int64)
    _, of = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.minimum(np.bincount(of, weights=times), 255).astype(np.uint8)[of]
    cuts = np.cumsum([0, *map(len, hashes)])
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "times": [total[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]})


def _keys(buckets: int):
    def keys(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(told):
            return pd.DataFrame({"sid": [], "token": []}, dtype="int64")
        s = Sketches(frame, buckets)
        of_bucket = dict(zip(told["bucket"].tolist(), told["times"], strict=True))
        df = np.concatenate([np.frombuffer(of_bucket[b], dtype=np.uint8) for b, _, _ in s.runs()])[s.which].astype(np.int64)
        shared = df > 1
        of, token, df = s.of[shared], s.hashes[shared], df[shared]
        least = enough(s.n)
        many = np.bincount(of, minlength=len(s.n)) >= least
        on = many[of]
        of, token, df = of[on], token[on], df[on]
        # the most frequent ``enough - 1`` of each set go: one order for all sets
        order = np.lexsort((token, df, of))
        of, token = of[order], token[order]
        size = np.bincount(of, minlength=len(s.n))
        place = np.arange(len(of)) - (np.cumsum(size) - size)[of]
        stay = place <= (size - least)[of]
        return pd.DataFrame({"sid": s.sid[of[stay]], "token": token[stay]})

    return keys


def shared_links(sets: DataFrame, chunks: int) -> DataFrame:
    """(a, b): sets that share one of the hashes left, linked to the least of them; sets: sid, n, sketch."""
    dealt = sets.select("sid", "n", "sketch", F.pmod(F.xxhash64("sid"), F.lit(chunks)).alias("chunk"))
    told = dealt.groupBy("chunk").applyInPandas(_send(chunks), SENT).groupBy("bucket").applyInPandas(_tell, TOLD)
    keys = materialize(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_keys(chunks), "sid long, token long"), "keys")
    least = keys.groupBy("token").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a < z").select("token", "a")
    return keys.join(least, "token").select("a", F.col("sid").alias("b")).where("a <> b").distinct()


def fingerprint_links(sets: DataFrame) -> DataFrame:
    """(a, b): sets with equal fingerprints, or with fingerprints that operator 8 links; sets: sid, fp."""
    firsts = materialize(sets.groupBy("fp").agg(F.min("sid").alias("first")), "fingerprints")
    same = sets.join(firsts, "fp").select(F.col("first").alias("a"), F.col("sid").alias("b")).where("a <> b")
    near = simhash.links(firsts)
    named = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(named.select(F.col("x").alias("a"), F.col("y").alias("b")))


# ---- comparison inside blocks


def alike(sets: list[np.ndarray], one: np.ndarray, other: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Places (a, b) of alike sets, one with other, that connect what all such pairs connect; root: what is connected
    already, by numbers that equal places share. It is changed."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    has = np.zeros(len(values), dtype=np.int64)
    found = []
    for i in one.tolist():
        # 0.8 at least: neither set is a fifth smaller than the other
        against = other[(root[other] != root[i]) & (5 * size[other] >= 4 * size[i]) & (4 * size[other] <= 5 * size[i])]
        if not len(against):
            continue
        has[of[ends[i] : ends[i + 1]]] = 1
        if size[i]:
            at = np.concatenate([of[ends[j] : ends[j + 1]] for j in against.tolist()])
            both = np.add.reduceat(has[at], np.cumsum(size[against]) - size[against])
        else:
            both = np.zeros(len(against), dtype=np.int64)
        has[of[ends[i] : ends[i + 1]]] = 0
        for j in against[9 * both >= 4 * (size[i] + size[against])].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found.append((i, j))
    return found


def _compared(frame: pd.DataFrame) -> pd.DataFrame:
    """All groups that a deal holds, each compared by itself: side 0 with side 1, or without a side 1 with itself."""
    found: list[tuple[int, int]] = []
    for _, group in frame.groupby(["root", "first", "second"], sort=False):
        if len(group) > 1:
            group = group.sort_values(["side", "sid"])
            sid, side = group["sid"].to_numpy(), group["side"].to_numpy()
            one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            root = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
            found += [(int(sid[a]), int(sid[b])) for a, b in alike(list(group["hashes"]), one, other if len(other) else one, root)]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


GROUP = ["sid", "root", "label", "hashes", "first", "second", "side"]


def _compare(dealt: DataFrame, deals: int) -> DataFrame:
    deal = F.pmod(F.xxhash64("root", "first", "second"), F.lit(deals))
    return dealt.select(*GROUP, deal.alias("deal")).groupBy("deal").applyInPandas(_compared, "a long, b long")


def _splits(n: Column, hashes: Column) -> Column:
    return F.greatest(F.ceil(n / HOT), F.ceil(hashes / LOAD), F.lit(1)).cast("int")


def _side(first: Column | str, second: Column | str, side: int) -> list[Column]:
    """A group's columns, as columns named by strings or as columns."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return ["sid", "root", "label", "hashes", as_column(first).cast("int").alias("first"), as_column(second).cast("int").alias("second"), F.lit(side).alias("side")]


def links(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the alike sets of each block connect; members: sid, root, hashes."""
    sizes = members.groupBy("root").agg(_splits(F.count("*"), F.sum(F.size("hashes"))).alias("splits"))
    # many small groups share a task's frame, of about LOAD hashes, however many there are
    deals = max(8 * parts(members.sparkSession), (members.agg(F.sum(F.size("hashes"))).first()[0] or 0) // LOAD)
    members = members.join(materialize(sizes, "sizes"), "root").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("splits")))
    # within splits: for nearly all blocks that is all there is
    alone = members.withColumn("label", F.col("sid"))
    found = materialize(_compare(alone.select(*_side("mine", "mine", 0)), deals), "links")
    large = members.where("splits > 1")
    if not large.limit(1).count():
        return found
    large = materialize(large, "large")

    def labelled(so_far: DataFrame) -> DataFrame:
        known = components(so_far).select(F.col("node").alias("sid"), F.col("root").alias("label"))
        return materialize(large.drop("label").join(known, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "labelled")

    def ranked(rows: DataFrame) -> DataFrame:
        """(root, label, place): labels by the number of their sets, the most first."""
        counts = materialize(rows.groupBy("root", "label").agg(F.count("*").alias("n")), "counts")
        return counts.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.col("n").desc(), "label"))).where(F.col("place") <= HUBS)

    # all splits against the hubs: the sets that name the largest labels
    rows = labelled(found)
    hubs = rows.join(ranked(rows).select(F.col("root").alias("r"), F.col("label").alias("l")), (F.col("root") == F.col("r")) & (F.col("sid") == F.col("l")), "left_semi")
    everywhere = hubs.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    held = everywhere.select(*_side("split", F.lit(-1), 0)).unionByName(rows.select(*_side("mine", F.lit(-1), 1)))
    found = materialize(found.unionByName(_compare(held, 2 * deals)), "links")
    # then all sets that are not with the most against all others
    rows = labelled(found)
    most = materialize(ranked(rows).where("place = 1").select("root", F.col("label").alias("most")), "most")
    rows = rows.join(most, "root")
    rest = rows.where("label <> most")
    few = materialize(rest.groupBy("root").agg(_splits(F.count("*"), F.sum(F.size("hashes"))).alias("few")), "few")
    rest = rest.join(few, "root").withColumn("part", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("few"))).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    against = rows.join(few, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    held = rest.select(*_side("part", "split", 0)).unionByName(against.select(*_side("part", "mine", 1)))
    return found.unionByName(_compare(held, 4 * deals))


def stage(spark, docs, sf_dir):
    """Pipeline stage: of each component of alike texts the document with the smallest id stays, once."""
    kept = numbered(docs)
    chunks = deals(kept, "doc.text", DEAL)
    marked = kept.select("rid", F.col("doc.doc_id").alias("id"), sketches("doc.text").alias("s")).select("rid", "id", "s.*")
    # of copies the row with the smallest doc_id, then the smallest row name
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best")
    sets = materialize(marked.groupBy("sid").agg(best, *(F.first(c).alias(c) for c in ("n", "fp", "sketch"))), "sets")
    blocks = components(shared_links(sets, chunks).unionByName(fingerprint_links(sets)).distinct())
    found = sets.join(blocks, F.col("node") == F.col("sid")).select("sid", "root", F.col("best.rid").alias("rid"))
    texts = kept.select("rid", F.col("doc.text").alias("text")).join(found.hint("merge"), "rid")
    members = materialize(texts.select("sid", "root", shingle_sets("text").alias("hashes")), "members")
    named = sets.select("sid", "best").join(components(links(members)), F.col("sid") == F.col("node"), "left")
    first = named.groupBy(F.coalesce("root", "sid").alias("component")).agg(F.min("best").alias("best"))
    return kept.join(first.select(F.col("best.rid").alias("rid")).hint("merge"), "rid", "left_semi").select("doc.*")

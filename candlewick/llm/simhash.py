"""Operator 8, SimHash near-duplicates: pigeonhole blocks over fingerprints.

A fingerprint is cut into BLOCKS blocks. Two that differ in at most DISTANCE bits agree on at least
BLOCKS - DISTANCE whole blocks, so for some choice of that many blocks they have the same key; all choices
are written out and keys with more than one fingerprint are compared. With six blocks a key has about 32
bits, so unlike fingerprints rarely meet even among billions.

Copies are one fingerprint from the start. Fingerprints of one key are compared inside a task in blocks and
only the links of a spanning forest come out, never all pairs; a key with more than HOT of them is split, and
each pair of its splits becomes a group of its own. Links become components by joins, and the components are
joined back to the documents.

Defined cases: texts without a word (null, empty or white space) have fingerprint zero and link like others;
fewer than three words are one shingle; texts are read whole, and a very long one costs memory in proportion to its words; a null doc_id never names a component unless all its ids are null;
repeated rows return as often as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import joined_by_key, materialize, numbered, parts, table
from candlewick.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
HOT = 4096  # fingerprints of one key that a task compares with each other


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's shingles of ``width`` words; ``text`` is UTF-8."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - width, 0)
    shingles = [line[a:z] for a, z in zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)]
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(s, SEED) for s in shingles], dtype="<u8")


def fingerprint(text: bytes) -> int:
    """64 majority bits over the hashes of a text's shingles, as an unsigned number; ``text`` is UTF-8."""
    return majority(shingle_hashes(text, SHINGLE))


def majority(hashes: np.ndarray) -> int:
    """Of 64 bits those that over half the hashes have, as an unsigned number."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprints of a text column as signed longs with the same bits."""
    for batch in texts:
        bits = np.array([fingerprint(x) if x else 0 for x in batch.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.array(bits.view(np.int64))


def _masks() -> list[int]:
    """For each choice of BLOCKS - DISTANCE blocks the bits they cover, as signed longs."""
    edges = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(BLOCKS)]
    masks = [sum(block[k] for k in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(left: np.ndarray, right: np.ndarray | None, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Pairs (smallest, other) that connect what all links of at most ``distance`` bits connect: within left, or across both."""
    every = left if right is None else np.concatenate([left, right])
    root = np.arange(len(every))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(left)):
        against = every[i + 1 :] if right is None else right
        near = np.flatnonzero(np.bitwise_count(against ^ left[i]) <= distance) + (i + 1 if right is None else len(left))
        if len(near):
            a = find(i)
            for j in near[root[near] != a].tolist():
                b = find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    a = min(a, b)
    top = [find(i) for i in range(len(every))]
    least: dict[int, int] = {}
    for i, t in enumerate(top):
        least[t] = min(least.get(t, int(every[i])), int(every[i]))
    return [(least[t], int(v)) for t, v in zip(top, every.tolist(), strict=True) if least[t] != v]


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """All keys that a group holds: runs of equal (mask, key, first, second), each compared by itself."""
    frame = frame.sort_values(["mask", "key", "first", "second", "side", "fp"], kind="stable")
    fp, side = frame["fp"].to_numpy(), frame["side"].to_numpy()
    label = frame[["mask", "key", "first", "second"]].to_numpy()
    cuts = np.flatnonzero((label[1:] != label[:-1]).any(axis=1)) + 1
    found: list[tuple[int, int]] = []
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frame)], strict=True):
        if z - a < 2:
            continue
        if label[a, 2] == label[a, 3]:
            found += forest(fp[a:z], None)
        else:
            middle = a + int(np.searchsorted(side[a:z], 1))
            found += forest(fp[a:middle], fp[middle:z])
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp``."""
    spark = distinct.sparkSession
    masks = _masks()
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "key"))
    # counted by partial sums, so a hot key is one row of each task; the keys that several have are few
    several = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(several, ["mask", "key"])
    # groups of about HOT rows, as many as the fingerprints ask for
    deals = max(8 * parts(spark), distinct.count() * len(masks) // HOT)
    # a hot key's fingerprints fall into splits by hash; every pair of splits is a group
    split = F.ceil(F.col("n") / HOT).cast("int")
    mine = F.pmod(F.xxhash64("fp"), split).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("splits") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("first"), F.greatest(o, F.col("mine")).alias("second")))
    dealt = (
        shared.withColumn("splits", split)
        .withColumn("mine", F.when(F.col("splits") == 1, F.lit(0)).otherwise(mine))
        .withColumn("pair", F.explode(pairs))
        .select("fp", "mask", "key", "pair.*", F.when(F.col("mine") == F.col("pair.first"), 0).otherwise(1).alias("side"))
        .withColumn("deal", F.pmod(F.xxhash64("mask", "key", "first", "second"), F.lit(deals)))
    )
    return dealt.groupBy("deal").applyInPandas(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    marked = materialize(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = materialize(grouped.join(smallest, "root").select("fp", "n", "component_id"), "components")
    return joined_by_key(marked, named, "fp", "n")  # texts without a word, or one that is much copied, are one fingerprint


def op8_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs, sf_dir):
    """Of each component of fingerprints the document with the smallest id stays, once; the pipeline has near_copies."""
    kept = numbered(docs)
    found = near_duplicates(kept.select(F.col("rid").alias("doc_id"), F.col("doc.text").alias("text")))
    # components by row: the row with the smallest doc_id, then the smallest row number
    ids = found.join(kept.select(F.col("rid").alias("doc_id"), F.col("doc.doc_id").alias("id")), "doc_id")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("best"))
    return kept.join(first.select(F.col("best.doc_id").alias("rid")), "rid", "left_semi").select("doc.*")

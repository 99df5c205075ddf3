"""Operator 1, mixing sources to target weights: balanced sampling by the cube method.

Each document of a source should come target / size times, for example 1.4 times: once for sure, and
with probability 0.4 once more. The cube method draws these fractions so that words and documents in
all stay what the fractions promise. The flight phase takes three undecided documents, moves their
probabilities along the direction that changes neither sum until one of them is 0 or 1, and goes on with
the next; at most two are left. Flights run in parallel over chunks of a source's documents; what the
chunks leave is flown again, until one small group per source remains. Its last flight leaves HELD documents
out; they and what it could not decide are the landing problem: of all ways to decide them, among those with
the right number of documents, the one nearest to the promised words is taken.

Only keys and sizes move, never texts. A hot source is many chunks, and so are very many rows of one id and
size. Draws depend on the source, the chunk and the documents' order by id and place, so reruns agree.

Defined cases: a null text has size 0; a null source is a source, the last; a null doc_id is a document
like others; repeated rows are documents of their own; sources without words have target 0; an empty
table gives an empty result; other columns are ignored, and the stage carries them.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candlewick.llm.common import WORD, materialize, numbered, parts, table

CHUNK = 4096  # documents in one flight
HELD = 14  # documents that the last flight leaves to the landing
NEAR = 0.005  # share of a source's target by which the landing may miss it before the number of documents gives way
MOST = 3.0  # times its size that a source or document may be taken
WEIGHTS = (1.0, 2.0, 3.0)
EPS = 1e-9


def flight(pi: list[float], size: list[float], draw: random.Random) -> None:
    """Move pi in place, keeping its sum and that of pi * size, until at most two entries are undecided."""
    live: list[int] = []
    for k in range(len(pi)):
        if not EPS < pi[k] < 1 - EPS:
            pi[k] = float(round(pi[k]))
            continue
        live.append(k)
        if len(live) == 3:
            a, b, c = live
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(live, u, strict=True) if x)
            down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(live, u, strict=True) if x)
            step = up if draw.random() * (up + down) < down else -down
            for i, x in zip(live, u, strict=True):
                pi[i] += step * x
                if not EPS < pi[i] < 1 - EPS:
                    pi[i] = float(round(pi[i]))
            live = [i for i in live if EPS < pi[i] < 1 - EPS]


def landing(pi: list[float], size: list[float], target: float = 0.0) -> None:
    """Decide the entries that the flight left, all ways tried: the nearest sum of words among the ways with as many
    documents as pi sums to (rounded up or down); if that misses the target by more than NEAR, among all ways."""
    live = [k for k in range(len(pi)) if EPS < pi[k] < 1 - EPS]
    words, docs = sum(pi[k] * size[k] for k in live), sum(pi[k] for k in live)
    sums, counts = np.zeros(1), np.zeros(1, dtype=np.int64)
    for k in live:  # way w takes entry j of live where bit j of w is set
        sums, counts = np.concatenate([sums, sums + size[k]]), np.concatenate([counts, counts + 1])
    off = np.round(np.abs(sums - words), 6)
    right = np.abs(counts - docs) < 1 - EPS if docs % 1 > EPS else counts == round(docs)
    best = int(np.argmin(np.where(right, off, np.inf)))
    if not right[best] or off[best] > NEAR * target:
        best = int(np.lexsort((np.abs(counts - docs), off))[0])
    for j, k in enumerate(live):
        pi[k] = float(best >> j & 1)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(key, n, source_size, target) by source: shares by weight, capped at ``most`` times the size, the rest reshared.

    sized: key (null-free, ordered like the sources), size.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # ranks over all sources: by range partition, then the partitions' offsets
    ranged = materialize(sums.repartitionByRange(parts(spark), "key").withColumn("part", F.spark_partition_id()), "sources")
    offsets, before = [], 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    if not offsets:
        return ranged.drop("part").withColumn("target", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.create_map(*offsets)[F.col("part")]
    ranked = ranged.withColumn("weight", F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / weight
    while True:  # a few scalars each time: who is above at this level, and the level of the others then
        above = F.col("weight") * level > F.col("cap")
        capped, free = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (capped or 0)) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.select("key", "n", "source_size", F.least("cap", F.col("weight") * level).cast("double").alias("target"))


def _flown(last: bool, ids: str):
    schema = T.StructType.fromDDL(ids)

    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["nameless", "doc_id", "size", "rid"], kind="stable").reset_index(drop=True)
        draw = random.Random(zlib.crc32(f"{frame['key'].iat[0]}|{frame['chunk'].iat[0]}|{len(frame)}".encode()))
        order = list(range(len(frame)))
        draw.shuffle(order)
        pi, size = [frame["pi"].iat[k] for k in order], [float(frame["size"].iat[k]) for k in order]
        held = [k for k in range(len(pi)) if EPS < pi[k] < 1 - EPS][:HELD] if last else []
        kept = [pi[k] for k in held]
        for k in held:
            pi[k] = 0.0
        flight(pi, size, draw)
        for k, p in zip(held, kept, strict=True):
            pi[k] = p
        if last:
            landing(pi, size, float(frame["target"].iat[0]))
        back = [0.0] * len(pi)
        for k, p in zip(order, pi, strict=True):
            back[k] = p
        return frame.assign(pi=back)[[f.name for f in schema]]

    return fly


def sample(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sized (doc_id, source, size, and rid, a name for each row) with source_size, target and copies."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    # ids go through pandas as values that are never null, so all their digits stay
    kind = sized.schema["doc_id"].dataType
    sized = sized.withColumn("nameless", F.isnull("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast(kind)))
    sized = materialize(sized.withColumn("key", key), "sized")
    goals = targets(sized, weights, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # rows of one id and size share a chunk; where they are more than it should hold, their places part them
    same = sized.groupBy("key", "nameless", "doc_id", "size").agg(F.count("*").alias("same")).where(F.col("same") > CHUNK)
    same = materialize(same.select(F.col("key").alias("_key"), F.col("nameless").alias("_none"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "same"), "repeated")
    part = F.when(F.col("same").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("rid"), F.ceil(F.col("same") / CHUNK)))
    units = (
        sized.join(goals, "key")
        .join(same, (F.col("_id") == F.col("doc_id")) & (F.col("_none") == F.col("nameless")) & (F.col("_key") == F.col("key")) & (F.col("_size") == F.col("size")), "left")
        .withColumn("times", times)
        .withColumn("whole", F.floor("times"))
        .withColumn("pi", F.col("times") - F.col("whole"))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", part), F.ceil(F.col("n") / CHUNK)))
        .drop("times", "same", "_id", "_none", "_key", "_size")
    )
    most_left = goals.agg(F.max("n")).first()[0] or 0
    decided = []
    while True:
        last = most_left <= CHUNK
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
        flown = units.groupBy("key", "chunk").applyInPandas(_flown(last, fields), fields)
        if last:
            decided.append(flown)
            break
        flown = materialize(flown, "flown")
        undecided = F.col("pi").between(EPS, 1 - EPS)
        decided.append(flown.where(~undecided))
        most_left = 2 * -(-most_left // CHUNK)
        units = flown.where(undecided).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "rid"), F.lit(-(-most_left // CHUNK)).cast("long")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("whole") + F.round("pi").cast("long")).withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def _size(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def op1_mixing(spark, sf_dir):
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    mixed = sample(docs.select("doc.doc_id", "doc.source", _size("doc.text"), F.xxhash64("rid").alias("rid")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def stage(spark, docs, sf_dir):
    """Pipeline stage: each row comes as often as the mix takes it, 0 to 3 times, with all its columns, in the cases
    defined above."""
    kept = numbered(docs)
    mixed = sample(kept.select("doc.doc_id", "doc.source", _size("doc.text"), "rid"))
    copies = mixed.where("copies > 0").select("rid", "copies").hint("merge")  # as many rows as documents: never broadcast
    return kept.join(copies, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")

"""Operator 6, quality classifier: ordinal regression on graded ratings.

A cumulative-link model: a document's score is the sum of the weights of its hashed words, shared by all
grades, and ordered thresholds turn it into the chance of each grade or better. Weights are fitted by stochastic
steps with a lasso penalty, so words that say nothing keep weight zero. It gives the expected grade and the tail
probability, by which documents are selected.

Ratings come from labels: grade 0 for toxic documents, 1 for clean ones of low quality, 2 for the rest. The fit takes
a sample of at most TRAIN ratings (those with the smallest hashes of their ids), in one task; every
document is then scored where it is read, with the weights that are not zero, at most 2^BITS, sent along with the
function. No text is shuffled, only the features of the rated documents, one row for each rating.

Defined cases: texts are read whole, however long; a null or empty text has only the features of its length; documents without a rating are scored like
others; ratings that are null, or of no document, don't count; the same rating of a document counts once, unlike ones
count each; of rows with one rated id the least features count, so that row order and repeated rows change nothing;
without any rating all tail probabilities are 1; repeated rows are scored alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.common import materialize, table

TRAIN = 12_000  # rated documents in the fit, at most
BITS = 16
EPOCHS = 12
RATE, LASSO, RIDGE = 2.0, 8.0, 1.0
GRADES = 3
TAIL = 2  # the tail is this grade or better
LEAST_TAIL = 0.5
_JUNK = re.compile(r"[^\w\s.,;:!?'\"()-]")


def text_features(text: str) -> list[int]:
    """Buckets of a text's distinct lower-case words and of a few coarse measures."""
    words = text.split()
    names = {w.strip(".,;:!?\"'()[]").lower() for w in words}
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    names.add(f"\x00words {int(math.log2(n + 1))}")
    names.add(f"\x00mean {round(len(text) / (n + 1))}")
    names.add(f"\x00same lines {round(4 * (1 - len(set(lines)) / len(lines)) if lines else 0)}")
    names.add(f"\x00same words {round(8 * len(names) / (n + 1))}")
    names.add(f"\x00junk {min(8, round(100 * len(_JUNK.findall(text)) / (len(text) + 1)))}")
    mask = (1 << BITS) - 1
    return sorted({zlib.crc32(w.encode()) & mask for w in names})


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([text_features(x or "") for x in batch.to_pylist()], type=pa.list_(pa.int32()))


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[np.ndarray], grades: list[int], seed: int = 1) -> tuple[np.ndarray, list[float]]:
    """Weights, and thresholds by grade: P(grade >= k) = logistic(score - thresholds[k - 1])."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)  # sums of gradients and of their squares, for lazy lasso steps
    share = [max(0.5, sum(g >= k for g in grades)) / (len(grades) + 1) for k in range(1, GRADES)]
    cuts = [-math.log(s / (1 - s)) for s in share]
    # rare grades count more, by the square root of their share
    weight = [math.sqrt(len(grades) / (GRADES * max(1, grades.count(k)))) for k in range(GRADES)]
    order, draw = list(range(len(rows))), random.Random(seed)
    for epoch in range(EPOCHS):
        draw.shuffle(order)
        for i in order:
            at, grade = rows[i], grades[i]
            w = -np.where(np.abs(z[at]) > LASSO, z[at] - np.sign(z[at]) * LASSO, 0) / ((1 + np.sqrt(n[at])) / RATE + RIDGE)
            score = float(w.sum())
            # likelihood of the grade: the difference of two cumulative chances
            above = [1.0, *(_logistic(score - c) for c in cuts), 0.0]
            p = max(above[grade] - above[grade + 1], 1e-6)
            slope = [a * (1 - a) for a in above]
            g = -(slope[grade] - slope[grade + 1]) / p * weight[grade]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE
            z[at] += g - sigma * w
            n[at] += g * g
            step = weight[grade] / (4 * (1 + epoch) * math.sqrt(len(rows)))
            if grade >= 1:
                cuts[grade - 1] -= step * slope[grade] / p
            if grade < GRADES - 1:
                cuts[grade] += step * slope[grade + 1] / p
            cuts.sort()
    w = -np.where(np.abs(z) > LASSO, z - np.sign(z) * LASSO, 0) / ((1 + np.sqrt(n)) / RATE + RIDGE)
    return w, cuts


def chances(score: float, cuts: list[float]) -> list[float]:
    """P(grade >= k) for k from 1."""
    return [_logistic(score - c) for c in cuts]


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(quality.isNull(), None).when(F.coalesce(toxic, F.lit(0)) == 1, 0).when(quality == 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> tuple[np.ndarray, list[float]] | None:
    """The fit on at most ``most`` rated documents; None without any."""
    rated = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null and doc_id is not null").distinct()
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)  # its size is bounded: it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(materialize(sample, "ratings")), "doc_id")

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "grade"], kind="stable")
        w, cuts = fit([np.array(x, dtype=np.int64) for x in frame["at"]], frame["grade"].tolist())
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "cuts": [cuts]})

    # one row for each rating, by partial minima: however often an id is repeated, the fit gets at most ``most`` rows
    once = texts.groupBy("doc_id", "grade").agg(F.min(hashed("text")).alias("at"))
    got = once.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fitted, "w binary, cuts array<double>").collect()
    return (np.frombuffer(got[0].w, dtype="<f4"), list(got[0].cuts)) if got else None


def scorer(model: tuple[np.ndarray, list[float]] | None):
    """A function of a text column: struct of expected grade and tail probability."""
    weights, cuts = (np.zeros(1 << BITS, dtype="<f4"), [-math.inf] * (GRADES - 1)) if model is None else model
    known = {int(k): float(weights[k]) for k in np.flatnonzero(weights)}
    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

    @F.arrow_udf(kind)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for x in batch.to_pylist():
                s = sum(known[k] for k in text_features(x or "") if k in known)
                rows.append([1.0] * (GRADES - 1) if model is None else chances(s, cuts))
            yield pa.StructArray.from_arrays([pa.array([sum(r) for r in rows], type=pa.float64()), pa.array([r[TAIL - 1] for r in rows], type=pa.float64())], names=["expected_grade", "tail"])

    return score


def judge(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) for every row of docs."""
    score = scorer(train(docs, labels, most))
    return docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.*").withColumn("kept", F.col("tail") >= LEAST_TAIL)


def op6_ordinal_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

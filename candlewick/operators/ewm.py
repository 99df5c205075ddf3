"""Exponentially weighted means, a recurrence that no window frame expresses.

y starts at the first value that is not null; then y = (1 - a) y + a x; a null repeats y and ages its weight.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.windows import KEY, TIME

Source = str | Callable[[pd.DataFrame], pd.Series]


def scan(x: pd.Series, alpha: float) -> pd.Series:
    return x.astype(float).ewm(alpha=alpha, adjust=False).mean().where(x.notna().cummax())


def ewm(df: DataFrame, *means: tuple[Source, float, str]) -> DataFrame:
    """df with one column for each (source, alpha, name): one pass over each instrument, in time order.

    A source is a column, an earlier mean of the same call, or a function of the instrument's frame.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
        for source, alpha, name in means:
            x = frame[source] if isinstance(source, str) else source(frame)
            frame[name] = scan(x, alpha)
        return frame

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for *_, name in means)])
    return df.groupBy(KEY).applyInPandas(run, schema)


# ---- series too long for one task


def _local(means: list[tuple[str, float]]):
    """A chunk by itself. Behind its first value y1 each mean is P y1 + L, whatever came before the chunk: P is what the chunk's
    rows leave of the first value, L what they add to it, and T counts the nulls since the last value."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
        for j, (x, alpha) in enumerate(means):
            value = frame[x].astype(float)
            known = value.notna()
            first = known & (known.cumsum() == 1)
            frame[f"_P{j}"] = scan(first.astype(float).where(known), alpha)
            frame[f"_L{j}"] = scan(value.mask(first, 0.0), alpha)
            place = pd.Series(np.arange(len(frame)), dtype="float64")
            frame[f"_T{j}"] = (place - place.where(known).ffill().fillna(-1.0)).astype("int64")
        return frame

    return run


def _chained(means: list[tuple[str, float]], kinds: list[str]):
    """Of an instrument's chunks, one row each in time order: what each of them inherits (_in) and its first mean (_y)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_chunk", kind="stable").reset_index(drop=True)
        out = {KEY: frame[KEY], "_chunk": frame["_chunk"]}
        for j, (_, alpha) in enumerate(means):
            y, gap, before, firsts = np.nan, 0, [], []
            for p, left, trail, lead, x1, n in zip(*(frame[f"_{c}{j}"] for c in ("P", "L", "T", "lead", "first")), frame["_n"], strict=True):
                before.append(y)
                if np.isnan(x1):  # no value at all
                    firsts.append(np.nan)
                    gap += n
                    continue
                weight = (1 - alpha) ** (gap + lead + 1)  # of what was before, aged by the nulls since
                y1 = x1 if np.isnan(y) else (weight * y + alpha * x1) / (weight + alpha)
                firsts.append(y1)
                y, gap = p * y1 + left, trail
            out |= {f"_in{j}": before, f"_y{j}": firsts}
        return pd.DataFrame(out)[kinds]

    return run


def affine_scan(df: DataFrame, means: list[tuple[str, float, str]], chunk: Column) -> DataFrame:
    """df with a column for each (source column, alpha, name), as :func:`ewm` gives them, with series cut into chunks of time.

    A step of the recurrence is an affine map of the mean before it, and so is a whole chunk: P y + L. Chunks find theirs in
    parallel; an instrument's maps, one small row a chunk, are composed in order; then each row applies the mean that its chunk
    starts with. Nulls in between age a mean's weight, also over the ends of chunks. Means of means are taken by a second call:
    its chunks lie where they are, so only the composed maps are shuffled again.
    """
    pairs = [(x, alpha) for x, alpha, _ in means]
    js = range(len(means))
    own = df.withColumn("_chunk", chunk)
    number = lambda c, t: T.StructField(c, t)
    extra = [f for j in js for f in (number(f"_P{j}", T.DoubleType()), number(f"_L{j}", T.DoubleType()), number(f"_T{j}", T.LongType()))]
    done = own.groupBy(KEY, "_chunk").applyInPandas(_local(pairs), T.StructType([*own.schema.fields, *extra]))
    maps = done.groupBy(KEY, "_chunk").agg(
        F.count("*").alias("_n"),
        *(F.max_by(f"_{c}{j}", TIME).alias(f"_{c}{j}") for j in js for c in "PLT"),
        *(F.count(F.when(F.col(f"_P{j}").isNull(), 1)).alias(f"_lead{j}") for j in js),
        *(F.min_by(F.col(x).cast("double"), F.when(F.col(x).isNotNull(), F.col(TIME))).alias(f"_first{j}") for j, (x, _) in enumerate(pairs)),
    )
    kinds = T.StructType([own.schema[KEY], own.schema["_chunk"], *(number(f"_{c}{j}", T.DoubleType()) for j in js for c in ("in", "y"))])
    starts = maps.groupBy(KEY).applyInPandas(_chained(pairs, kinds.names), kinds)
    got = done.join(starts, [KEY, "_chunk"])
    named = {name: F.when(F.col(f"_P{j}").isNotNull(), F.col(f"_P{j}") * F.col(f"_y{j}") + F.col(f"_L{j}")).otherwise(F.col(f"_in{j}")) for j, (_, _, name) in enumerate(means)}
    return got.withColumns({n: F.when(~F.isnan(c), c) for n, c in named.items()}).drop("_chunk", *(f"_{c}{j}" for j in js for c in ("P", "L", "T", "in", "y")))


def ewm_chunked(df: DataFrame, x: str, alpha: float, name: str, chunk: Column) -> DataFrame:
    return affine_scan(df, [(x, alpha, name)], chunk)

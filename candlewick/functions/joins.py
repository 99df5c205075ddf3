"""Joins of rows with one row for each of their keys, where a key may have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 4096  # at most so many keys can have more than one row of so many


def joined_by_keys(rows: DataFrame, of_keys: DataFrame, keys: list[str], n: str, most: int = HOT_KEYS) -> DataFrame:
    """rows with the columns of of_keys, which has each key of rows once (nulls among them) and in ``n`` how many rows have it.

    Keys with more than one of ``most`` rows are ``most`` at most, so those are broadcast and their rows stay where they are;
    the others meet in a shuffle, with few rows each.
    """
    total = of_keys.agg(F.sum(n)).first()[0] or 0
    named = of_keys.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    own = [f"_key_{k}" for k in keys]
    few, rest = named.where(F.col(n) > total // most), named.where(F.col(n) <= total // most)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`"))
    hot = rows.join(F.broadcast(few), same).drop(*own, n)
    cold = rows.join(F.broadcast(few.select(*own)), same, "left_anti").join(rest, same).drop(*own, n)
    return hot.unionByName(cold)

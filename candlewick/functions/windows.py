"""Window helpers. Every window is partitioned by instrument and ordered by time; frames count rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEY, TIME = "instrument_id", "ts"


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,))).orderBy(TIME)


def last(p: int, *keys: str) -> WindowSpec:
    """The row and the p - 1 before it."""
    return ordered(*keys).rowsBetween(-(p - 1), 0)


def sofar(*keys: str) -> WindowSpec:
    """All rows up to this one."""
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def roll(f: Callable[[Column], Column], x: str | Column, p: int, *keys: str) -> Column:
    """A rolling aggregate over p rows, null until the frame holds p values that are not null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(last(p, *keys)) == p, f(x).over(last(p, *keys)))


def prev(x: str | Column, k: int = 1, *keys: str) -> Column:
    return F.lag(x, k).over(ordered(*keys))


def with_leads(df: DataFrame, chunk: Column, back: int) -> DataFrame:
    """df cut into chunks of time, each led by copies of the ``back`` rows before it.

    Each chunk (a month, say) is a series of its own, under a name of its own in place of the instrument, which is ``_own``;
    ``_lead`` tells the copies, ``_place`` is a row's number in the whole series, from 0. Rows are numbered within chunks, and
    only the chunks' counts meet by instrument. The copies are few where chunks are long against ``back``.
    """
    own = df.withColumn("_chunk", chunk).withColumn("_own", F.col(KEY))
    by = Window.partitionBy("_own").orderBy("_chunk")
    counts = own.groupBy("_own", "_chunk").agg(F.count("*").alias("_count"))
    # a chunk's first row has the place _from in the series
    spans = counts.withColumn("_from", F.coalesce(F.sum("_count").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = own.join(spans, ["_own", "_chunk"])
    placed = placed.withColumn("_place", F.col("_from") + F.row_number().over(Window.partitionBy("_own", "_chunk").orderBy(TIME)) - 1)
    # the last rows of each chunk lead those chunks that begin within ``back`` rows of them
    tails = placed.where(F.col("_place") >= F.col("_from") + F.col("_count") - back).drop("_chunk", "_from", "_count")
    next_ones = spans.select(F.col("_own").alias("_of"), "_chunk", "_from")
    led = tails.join(next_ones, (F.col("_own") == F.col("_of")) & (F.col("_from") > F.col("_place")) & (F.col("_from") <= F.col("_place") + back)).drop("_of", "_from")
    rows = placed.drop("_from", "_count").withColumn("_lead", F.lit(False)).unionByName(led.withColumn("_lead", F.lit(True)))
    return rows.withColumn(KEY, F.concat_ws("#", F.col("_own").cast("string"), F.col("_chunk").cast("string")))


def chunked(df: DataFrame, op: Callable[[DataFrame], DataFrame], chunk: Column, back: int) -> DataFrame:
    """op(df) for an op whose windows look back ``back`` rows at most, with long series cut into chunks of time.

    Windows by instrument alone put a whole series into one task; here each chunk is a series of its own, and the rows that
    lead it are dropped afterwards.
    """
    done = op(with_leads(df, chunk, back).drop("_place")).where("not _lead").withColumn(KEY, F.col("_own"))
    return done.drop("_own", "_chunk", "_lead")


def running(df: DataFrame, chunk: Column, **totals: tuple[str, Column]) -> DataFrame:
    """df with running totals from each series' start, name=(``sum`` or ``max``, column), by chunks of time.

    Each chunk runs by itself; only the chunks' totals meet by instrument, and what stands before a chunk is joined to it.
    """
    by, whole = Window.partitionBy(KEY, "_chunk").orderBy(TIME), Window.partitionBy(KEY).orderBy("_chunk")
    own = df.withColumns({"_chunk": chunk} | {f"_{n}": c for n, (_, c) in totals.items()})
    agg = {"sum": F.sum, "max": F.max}
    ends = own.groupBy(KEY, "_chunk").agg(*(agg[kind](f"_{n}").alias(f"_{n}") for n, (kind, _) in totals.items()))
    before = ends.select(KEY, "_chunk", *(agg[kind](f"_{n}").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}") for n, (kind, _) in totals.items()))
    local = own.withColumns({f"_{n}": agg[kind](f"_{n}").over(by.rowsBetween(Window.unboundedPreceding, 0)) for n, (kind, _) in totals.items()})
    zero = F.lit(0.0)
    both = {
        "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero)),
        "max": F.greatest,  # of those that are not null
    }
    got = local.join(before, [KEY, "_chunk"]).withColumns({n: both[kind](F.col(f"_{n}"), F.col(f"_before_{n}")) for n, (kind, _) in totals.items()})
    return got.drop("_chunk", *(f"_{n}" for n in totals), *(f"_before_{n}" for n in totals))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def clip(x: Column) -> Column:
    """x held within 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns, for data that come from outside."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def corr(a: str | Column, b: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows that have both; null where either does not vary.

    The built-in one divides by the deviations and so fails, for all groups, where one of them is zero.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    of = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return ratio(of(F.covar_pop(x, y)), of(F.stddev_pop(x)) * of(F.stddev_pop(y)))

"""Exact percentiles of groups of any size, by distributed selection.

The built-in ``percentile`` keeps all distinct values of a group in one task. Here each asked rank has an interval that holds it,
from the group's least to its greatest value at first. A round counts the interval's values in BINS bins, by partial sums, and
goes on with the bin that holds the rank, from that bin's least to its greatest value. When at most ``held`` values are left,
or all of them are equal, they are looked at themselves. Intervals are one small row a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.functions.joins import joined_by_keys
from candlewick.functions.windows import KEY
from candlewick.sources.shared import kept

BINS, HELD = 1024, 100_000


def percentiles(df: DataFrame, x: str, qs: list[float], keys: tuple[str, ...] = (KEY,), held: int = HELD, bins: int = BINS) -> DataFrame:
    """(keys, n, percentiles): the linear percentiles qs (0 to 1) of the values of x that are not null, in an array; groups without
    a value give no row."""
    ks = list(keys)
    values = df.where(F.col(x).isNotNull()).select(*ks, F.col(x).cast("double").alias("_v"))
    sizes = kept(values.groupBy(*ks).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "sizes")
    at = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*(F.least(F.floor(a) + k, F.col("_n") - 1) for a in at for k in (0, 1))))
    start = sizes.withColumn("rank", F.explode(ranks)).select(*ks, "_n", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("_n").alias("inside"))
    wanted, by = kept(start, "ranks"), [*ks, "rank"]

    def inside(asked: DataFrame) -> DataFrame:
        """The values of the groups that have asked, with each rank in whose interval they lie."""
        packed = asked.groupBy(*ks).agg(F.first("_n").alias("_n"), F.collect_list(F.struct("rank", "lo", "hi", "below", F.col("_n").alias("size"))).alias("_asked"))
        met = joined_by_keys(values, packed, ks, "_n")
        return met.select(*ks, "_v", F.inline(F.filter("_asked", lambda a: F.col("_v").between(a["lo"], a["hi"]))))

    rounds = 0
    while True:
        wide = (F.col("hi") > F.col("lo")) & (F.col("inside") > held)
        if not wanted.where(wide).limit(1).count():
            break
        # halves, so that no difference passes the range of a double
        at_ = (lambda c: F.signum(c) * F.when(F.col(c) == 0, 0.0).otherwise(F.ln(F.abs(c)) + 800)) if rounds % 2 == 0 else (lambda c: F.col(c) / 2)
        rounds += 1
        place = F.try_divide(at_("_v") - at_("lo"), at_("hi") - at_("lo"))
        bin_ = F.coalesce(F.least(F.floor(place * bins), F.lit(bins - 1).cast("long")), F.when(F.col("_v") < F.col("hi"), 0).otherwise(1).cast("long"))
        counted = inside(wanted.where(wide)).groupBy(*by, "below", "size", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        first = counted.withColumn("below", F.col("below") + upto - F.col("inside")).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside")))
        wanted = kept(wanted.where(~wide).unionByName(first.withColumnRenamed("size", "_n").select(*wanted.columns)), "ranks")

    met = inside(wanted.where("hi > lo")).groupBy(*by, "below", "size").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    looked = met.select(*by, F.col("size").alias("_n"), F.get("_all", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    known = looked.unionByName(wanted.where("hi = lo").select(*by, "_n", F.col("lo").alias("value")))
    one = known.groupBy(*ks).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_of"))

    def linear(a):
        low = F.floor(a)
        under, over = F.element_at("_of", low), F.element_at("_of", F.least(low + 1, F.col("_n") - 1))
        return under + (over - under) * (a - low)

    return one.select(*ks, F.col("_n").alias("n"), F.array(*map(linear, at)).alias("percentiles"))


def tails(returns: DataFrame, x: str = "ret", keys: tuple[str, ...] = (KEY,), held: int = HELD) -> DataFrame:
    """(keys, var_95, var_99, cvar_95, tail_ratio) of returns, as the tearsheet has them, for groups of any size."""
    ks = list(keys)
    got = percentiles(returns, x, [0.05, 0.01, 0.95], keys, held).select(*ks, "n", *(F.get("percentiles", F.lit(k)).alias(c) for k, c in enumerate(("var_95", "var_99", "p95"))))
    got = kept(got, "tails")
    known = returns.where(F.col(x).isNotNull()).select(*ks, F.col(x).alias("_v"))
    met = joined_by_keys(known, got, ks, "n").groupBy(*ks, "var_95", "var_99", "p95")
    worst = met.agg(F.avg(F.when(F.col("_v") <= F.col("var_95"), F.col("_v"))).alias("cvar_95"))
    return worst.select(*ks, "var_95", "var_99", "cvar_95", F.try_divide(F.col("p95"), F.abs("var_95")).alias("tail_ratio"))

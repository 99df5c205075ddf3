"""Things the corpus operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.sources.shared import clean, delete, fresh  # noqa: F401

#: The ASCII white space that separates words, for ``translate``: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, for Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None, compression: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    It cuts the lineage: a lost executor costs its running tasks, not the work behind this table. instead_of: a
    table of this function that nothing reads any more; it is removed. The others go with :func:`clean`.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path, compression=compression)
    if instead_of is not None:
        for old in {x.rpartition("/")[0] for x in instead_of.inputFiles()}:
            delete(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def _of_files(docs: DataFrame) -> bool:
    """Is docs one read of distinct files, filtered or projected at most? Then a row's file and place are its own."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Filter", "Project", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.length()))
    return all(not b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def numbered(docs: DataFrame) -> DataFrame:
    """docs as struct ``doc`` with ``rid``, a name for each row that a second read gives again.

    It is the row's file and place. Rows that don't come straight from files, each read once, are written to the
    shared folder first: behind a join, union or explode one place of a file is several rows.
    """
    rid = F.concat_ws(":", "_metadata.row_index", "_metadata.file_path").alias("rid")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    if "_metadata" not in docs.columns and _of_files(docs):
        try:
            return docs.select(own, rid)
        except AnalysisException:  # files of a format without places
            pass
    return materialize(docs.select(own), "rows").select("doc", rid)


def deals(docs: DataFrame, text: str, each: int) -> int:
    """Groups of about ``each`` bytes of text that docs make: they follow the data, and are one for each shuffle
    partition of the session at least."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-total // each))


HOT_KEYS = 4096  # at most so many keys can have more than one row of so many


def joined_by_key(rows: DataFrame, of_keys: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the columns of of_keys, which has each key of rows once (null among them) and in ``n`` how many rows
    have it. Keys with more than one of HOT_KEYS rows are at most HOT_KEYS, so those are broadcast and their rows stay
    where they are; the others meet in a shuffle."""
    total = of_keys.agg(F.sum(n)).first()[0] or 0
    named = of_keys.withColumnRenamed(key, "_key")
    few, rest = named.where(F.col(n) > total // HOT_KEYS), named.where(F.col(n) <= total // HOT_KEYS)
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key"))
    hot = rows.join(F.broadcast(few), same).drop("_key", n)
    cold = rows.join(F.broadcast(few.select("_key")), same, "left_anti").join(rest, same).drop("_key", n)
    return hot.unionByName(cold)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session; work that is dealt out by hand grows with it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words(text: Column) -> Column:
    """Words of a text as an array: maximal runs without ASCII white space; null gives none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " "), lambda w: w != "")

"""Tables of date partitions whose readers see a write as a whole or not at all.

A write puts its rows into a folder of its own, then gives out the table's next version: a small file that names, for
each date, the folders that hold it. The version's file appears under its name by one rename that fails where the name is
taken, so of two writers of one version one wins, and the other does its merge again on what the first has left.
Readers take the newest version, and keep it: files that a version names never change. A job that dies before the
rename leaves a folder that no version names, which :func:`vacuum` removes.

What passes through the driver is a version, one line for a date and folder, never rows. The rename must be
atomic, as it is on HDFS and on a local disk.

Defined cases: a table without a version can't be read, and is empty to a write; rows without a ``ts`` are of no known date, so a
rewrite keeps those that are there and adds its own; an empty batch gives a version that equals the last; columns of a batch
that the table has not are left out, and so is its ``date``, which is that of ``ts``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.operators.writes import insert_ignore, upsert

NO_DATE = "date=__HIVE_DEFAULT_PARTITION__"
TRIES = 5
Version = dict  # schema: of the rows, as JSON; folders: {date folder: [names of write folders]}


class Taken(Exception):
    """Another writer gave out this version first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _version_file(path: str, n: int) -> str:
    return f"{path}/_versions/{n:010d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that there are, the oldest first."""
    return sorted(int(x[:-5]) for x in _names(spark, f"{path}/_versions") if re.fullmatch(r"\d+\.json", x))


def _version(spark: SparkSession, path: str, n: int) -> Version:
    return json.loads(spark.read.text(_version_file(path, n), wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, n: int, version: Version) -> None:
    """The swap: a finished file gets the version's name, which nobody may have yet."""
    draft, fs = _fs(spark, f"{path}/_versions/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(version), "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(draft, fs.makeQualified(hadoop.Path(_version_file(path, n))), plain)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise Taken(f"version {n} of {path}") from e
        raise


def _rows(spark: SparkSession, path: str, version: Version, dates: set[str] | None = None) -> DataFrame:
    """Rows of a version with their ``date``, of all its dates or of some."""
    kind = T.StructType.fromJson(version["schema"])
    dated = T.StructType([*kind.fields, T.StructField("date", T.DateType())])
    folders = [f"{path}/{w}/{d}" for d, ws in version["folders"].items() if dates is None or d in dates for w in ws]
    if not folders:
        return spark.createDataFrame([], dated)
    return spark.read.schema(dated).option("basePath", path).parquet(*folders).select(*dated.names)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is in its newest version, or as it was in another."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        raise ValueError(f"{path} has no version{'' if version is None else f' {version}'}")
    return _rows(spark, path, _version(spark, path, have[-1] if version is None else version))


def _written(spark: SparkSession, path: str, rows: DataFrame) -> tuple[str, list[str]]:
    """Rows in a new folder of the table: its name, and the dates that it has."""
    folder = f"write={uuid.uuid4().hex}"
    rows.withColumn("date", F.to_date("ts")).repartition("date").write.partitionBy("date").parquet(f"{path}/{folder}")
    return folder, [x for x in _names(spark, f"{path}/{folder}") if x.startswith("date=")]


def _commit(spark: SparkSession, path: str, batch: DataFrame, merge: Callable[[DataFrame], DataFrame], replace: bool) -> int:
    """merge(the target's rows on the batch's dates) as the next version: in place of these dates' folders, or beside them."""
    days = {f"date={r[0]}" for r in batch.select(F.to_date("ts").alias("d")).where("d is not null").distinct().toLocalIterator()}
    for _ in range(TRIES):
        have = versions(spark, path)
        base = _version(spark, path, have[-1]) if have else {"schema": batch.drop("date").schema.jsonValue(), "folders": {}}
        target = _rows(spark, path, base, days).drop("date")
        folder, dates = _written(spark, path, merge(target))
        folders = {d: list(ws) for d, ws in base["folders"].items()}
        for d in dates:
            folders[d] = ([] if replace and d != NO_DATE else folders.get(d, [])) + [folder]
        n = have[-1] + 1 if have else 0
        try:
            _publish(spark, path, n, {"schema": base["schema"], "folders": folders})
            return n
        except Taken:
            continue
    raise Taken(f"{path}: {TRIES} times another writer was first")


def rewrite(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], columns: list[str], order: list | None = None) -> int:
    """Upsert into the table (see :func:`candlewick.operators.writes.upsert`), all dates of the batch at once; the new version's number."""
    return _commit(spark, path, batch, lambda target: upsert(target, batch, keys, columns, order), True)


def append_new(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list) -> int:
    """Insert-ignore into the table: known keys stay as they are; the new version's number."""

    def new(target: DataFrame) -> DataFrame:
        return insert_ignore(target, batch, keys, order).select(*target.columns)

    return _commit(spark, path, batch, new, False)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` versions, and the write folders that none of those names; how many folders went.
    No write may be under way, since its folder has no version yet."""
    have = versions(spark, path)
    live = {w for n in have[-keep:] for ws in _version(spark, path, n)["folders"].values() for w in ws}
    gone = [x for x in _names(spark, path) if x.startswith("write=") and x not in live]
    for x in [*(_version_file(path, n) for n in have[:-keep]), *(f"{path}/{x}" for x in gone)]:
        at, fs = _fs(spark, x)
        fs.delete(at, True)
    return len(gone)

"""Minute candles from CSV files, plain or zipped, with their checksums."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "unused"]
RAW = T.StructType([T.StructField(n, T.StringType()) for n in FIELDS])
BAR = "instrument_id int, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades int"
NAME = r"([A-Za-z0-9]+)-1m-(\d{4}-\d{2}(?:-\d{2})?)\.(?:zip|csv)$"


def epoch(t: Column) -> Column:
    """UTC time of an epoch in microseconds (above 10^15) or milliseconds, in whole seconds."""
    return F.date_trunc("second", F.when(t > 10**15, F.timestamp_micros(t)).otherwise(F.timestamp_millis(t))).cast("timestamp_ntz")


def parsed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of raw candle lines with symbol; headers, blank and short lines are neither."""
    t = F.expr("try_cast(trim(open_time) as bigint)")
    whole = raw.where("trades is not null")
    header = ~F.coalesce(F.col("open_time").rlike(r"^\s*-?\d+\s*$"), F.lit(False))
    numbers = {c: F.expr(f"try_cast(trim({c}) as {'int' if c == 'trades' else 'double'})") for c in ("open", "high", "low", "close", "volume", "quote_volume", "trades")}
    got = whole.where(~header).withColumns(numbers).withColumn("ts", epoch(t))
    good = F.expr(" and ".join(f"{c} is not null" for c in numbers))
    cols = ["symbol", "period", "ts", *numbers]
    return got.where(good).select(*cols), got.where(~good).select("symbol", "period", "open_time")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of CSV files named {symbol}-1m-{period}.csv, or in folders symbol={symbol}/period={period}."""
    raw = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path)
    name = F.input_file_name()
    told = lambda k, folder: F.coalesce(F.nullif(F.regexp_extract(name, NAME, k), F.lit("")), F.regexp_extract(name, f"/{folder}=([^/]+)/", 1))
    return parsed(raw.withColumn("symbol", told(1, "symbol")).withColumn("period", told(2, "period")))


def read_packed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of CSV files in folders period={period} that hold many symbols: a line's first cell is its symbol, the
    others are those of a candle line. Their number follows from their size, not from how many symbols there are."""
    text = T.StringType()
    packed = T.StructType([T.StructField("symbol", text), *RAW.fields, T.StructField("period", text)])
    return parsed(spark.read.schema(packed).option("mode", "PERMISSIVE").csv(path))


def files(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(symbol, period, name, content) of candle files."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return got.select(F.regexp_extract("path", NAME, 1).alias("symbol"), F.regexp_extract("path", NAME, 2).alias("period"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def verified(zips: DataFrame, checksums: DataFrame) -> DataFrame:
    """zips with ``checksum_ok``: SHA-256 against the first word of {name}.CHECKSUM; a missing one counts as right."""
    told = checksums.select(F.regexp_replace("name", r"\.CHECKSUM$", "").alias("name"), F.lower(F.split(F.trim("content_text"), r"\s+")[0]).alias("_sum"))
    return zips.join(told, "name", "left").withColumn("checksum_ok", F.coalesce(F.sha2("content", 256) == F.col("_sum"), F.lit(True))).drop("_sum")


def _unzipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for symbol, period, content in zip(frame["symbol"], frame["period"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                lines = z.read(name).decode("utf-8", "replace").splitlines() if name else []
            yield pd.DataFrame({"symbol": symbol, "period": period, "line": [x for x in lines if x.strip()]}, columns=["symbol", "period", "line"])


def read_zips(zips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of the first CSV in each file; Python only unzips, Spark parses."""
    lines = zips.select("symbol", "period", "content").mapInPandas(_unzipped, "symbol string, period string, line string")
    cells = F.split("line", ",")
    return parsed(lines.select("symbol", "period", *(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(FIELDS))))


def to_bars(parsed_bars: DataFrame, instrument: DataFrame) -> DataFrame:
    """In the shape of bar_1m, with the instrument of each symbol."""
    got = parsed_bars.join(instrument.select("symbol", "instrument_id"), "symbol")
    kinds = [x.split(" ") for x in BAR.split(", ")]
    return got.select(*(F.col(n).cast(t).alias(n) for n, t in kinds))

import datetime as dt
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from candlewick.jobs import frames, loads
from candlewick.operators import bars
from candlewick.sources import candles, equity, macro, shared, tables, versions
from candlewick.streaming import candles as stream

T0 = 1502928000000
HEAD = "open_time,open,high,low,close,volume,close_time,quote_volume,count,a,b,c"


def line(t, o=1.0):
    return f"{t},{o},2,0.5,1.5,10,0,15,3,0,0,0"


def test_zipped_candles(spark, tmp_path):
    whole = "\n".join([HEAD, line(T0), "", "1,2,3", line((T0 + 60_000) * 1000), "bad,1,2,3,4,5,6,7,8,9,0,0", line(T0 + 120_000, "x")])
    with zipfile.ZipFile(tmp_path / "BTCUSDT-1m-2017-08.zip", "w") as z:
        z.writestr("a.csv", whole)
    with zipfile.ZipFile(tmp_path / "BTCUSDT-1m-2017-09-01.zip", "w") as z:
        z.writestr("b.csv", line(T0 + 180_999))
    zips = candles.files(spark, str(tmp_path))
    good, rejects = candles.read_zips(zips)
    instrument = spark.createDataFrame([("BTCUSDT", 1)], "symbol string, instrument_id int")
    got = candles.to_bars(good, instrument).orderBy("ts").collect()
    start = dt.datetime(2017, 8, 17)
    assert [r.ts for r in got] == [start, start + dt.timedelta(minutes=1), start + dt.timedelta(minutes=3)]
    assert got[0].trades == 3 and got[0].quote_volume == 15 and rejects.count() == 1
    right = hashlib.sha256((tmp_path / "BTCUSDT-1m-2017-08.zip").read_bytes()).hexdigest().upper()
    sums = spark.createDataFrame([("BTCUSDT-1m-2017-08.zip.CHECKSUM", f"{right}  x.zip")], "name string, content_text string")
    assert all(r.checksum_ok for r in candles.verified(zips, sums).collect())
    wrong = sums.withColumn("content_text", F.lit("abc x"))
    assert {r.name: r.checksum_ok for r in candles.verified(zips, wrong).collect()} == {"BTCUSDT-1m-2017-08.zip": False, "BTCUSDT-1m-2017-09-01.zip": True}


def test_plain_candles(spark, tmp_path):
    (tmp_path / "ETH-1m-2020-01.csv").write_text("\n".join([HEAD, line(T0), "", "1,2,3"]))
    good, rejects = candles.read_csv(spark, str(tmp_path))
    assert [(r.symbol, r.period) for r in good.collect()] == [("ETH", "2020-01")] and rejects.count() == 0


def test_packed_candles(spark, tmp_path):
    """Symbols share a file, with headers, blank and short lines and both units; the folder tells the period."""
    for period, lines in (("2017-08", ["symbol," + HEAD, "ETH," + line(T0), "", "BTC," + line((T0 + 60_999) * 1000, 7.5), "ETH,1,2,3", "BTC,bad," + line(T0), "BTC," + line(T0, "x")]), ("2017-09", ["symbol," + HEAD, "ETH," + line(T0 + 120_000)])):
        (tmp_path / f"period={period}").mkdir()
        (tmp_path / f"period={period}/part-0.csv").write_text("\n".join(lines))
    good, rejects = candles.read_packed(spark, str(tmp_path))
    start = dt.datetime(2017, 8, 17)
    rows = sorted((r.symbol, r.period, r.ts, r.open, r.quote_volume, r.trades) for r in good.collect())
    assert rows == [("BTC", "2017-08", start + dt.timedelta(minutes=1), 7.5, 15.0, 3), ("ETH", "2017-08", start, 1.0, 15.0, 3), ("ETH", "2017-09", start + dt.timedelta(minutes=2), 1.0, 15.0, 3)]
    assert [(r.symbol, r.period, r.open_time) for r in rejects.collect()] == [("BTC", "2017-08", str(T0))]


@pytest.mark.parametrize("users", [0, 300])
def test_candle_files_are_as_many_as_their_size_asks_for(spark, tmp_path, monkeypatch, users):
    """Three hundred instruments in two months: two folders of few files, and every minute comes back."""
    t = dt.datetime(2024, 1, 31, 23, 59, 30)
    rows = [(3 * u + i, t + dt.timedelta(seconds=20 * i), u, 1 / (1 + u + i)) for u in range(users) for i in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(loads, "fresh", lambda spark, name: f"{tmp_path}/{name}")
    got = loads.candle_csv(spark, str(tmp_path))
    want = frames.minutes(spark, str(tmp_path))
    assert len(list((tmp_path / "csv").rglob("part-*.csv"))) <= 8
    assert sorted(x.name for x in (tmp_path / "csv").glob("*=*")) == ["period=2024-01", "period=2024-02"][: users and 2]
    assert got.count() == 2 * users and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_macro(spark, tmp_path):
    (tmp_path / "DGS10.csv").write_text("date,value\n2024-12-31, 4.5 \n2025-01-02,.\n2025-01-03,\n,3\n2025-01-06\n2025-01-07,4.7\n")
    (tmp_path / "CPI.csv").write_text("date,value\n2020-01-01,1\n")
    got = macro.read(spark, str(tmp_path))
    series = spark.createDataFrame([("DGS10", "D"), ("CPI", "M")], "series_id string, frequency string")
    rows = sorted((r.series_id, str(r.ts), r.value) for r in macro.capped(got, series).collect() if r.value is not None)
    assert rows == [("CPI", "2020-01-01", 1.0), ("DGS10", "2025-01-07", 4.7)]
    assert {str(r.ts) for r in got.where("value is null").collect()} <= {"2025-01-02", "2025-01-03"}


def test_equity(spark, tmp_path):
    v = {"datetime": "2024-01-03", "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "10"}
    (tmp_path / "SPY.json").write_text(json.dumps({"values": [v, v | {"datetime": "2024-01-02", "adjusted_close": "1.4"}]}))
    (tmp_path / "BAD.json").write_text(json.dumps({"status": "error", "message": "no"}))
    got, errors = equity.read(spark, str(tmp_path))
    day = equity.to_bars(got, spark.createDataFrame([("SPY", 2)], "symbol string, instrument_id int")).orderBy("ts").collect()
    assert [r.adj_close for r in day] == [1.4, 1.5] and day[0].quote_volume is None
    assert [(r.symbol, r.message) for r in errors.collect()] == [("BAD", "no")]


def minute_rows(n, start=0):
    t = dt.datetime(2020, 1, 1)
    return [(1 + i % 2, t + dt.timedelta(minutes=start + i), 1.0 + i, 3.0 + i, 0.5, 2.0 + i, 1.0, 2.0, 1) for i in range(n)]


def test_tables_insert_and_rewrite(spark, tmp_path):
    kind = tables.SHAPES["bar_1m"]
    path, keys = f"{tmp_path}/bars", ["instrument_id", "ts"]
    tables.write(tables.shaped(spark.createDataFrame(minute_rows(2000), kind), "bar_1m"), path)
    tables.append_new(spark, path, spark.createDataFrame(minute_rows(2010), kind), keys, [F.col("open")])
    tables.append_new(spark, path, spark.createDataFrame(minute_rows(2010), kind), keys, [F.col("open")])
    assert tables.read(spark, path).count() == 2010
    batch = spark.createDataFrame(minute_rows(2020)[1990:], kind).withColumn("close", F.lit(-1.0))
    tables.rewrite(spark, path, batch, keys, ["close"], f"{tmp_path}/staging")
    after = tables.read(spark, path)
    assert after.count() == 2020 and after.where("close = -1").count() == 30 and after.where("open is null").count() == 0


def test_streams_equal_the_batch(spark, tmp_path):
    kind = stream.SCHEMA
    df = spark.createDataFrame(minute_rows(600) + minute_rows(50), kind)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(minute_rows(1, 5000), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = stream.deduplicated(stream.read(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 601
    clean = spark.createDataFrame(minute_rows(600), kind)
    clean.coalesce(1).write.parquet(f"{tmp_path}/clean")
    for n in (5000, 9000):  # later rows move the watermark past all windows
        spark.createDataFrame(minute_rows(1, n), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/clean")
    q = stream.rollup(stream.read(spark, f"{tmp_path}/clean", 1), "1h").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    want = bars.rollup(clean, "1h")
    got = spark.table("hours").where("ts < '2020-01-02'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_a_stream_loads_a_new_table_and_goes_on(spark, tmp_path):
    """First batch into nothing, repeated files, a restart from the checkpoint, and a replay from none."""
    kind, path = stream.SCHEMA, f"{tmp_path}/table"

    def run(checkpoint):
        q = stream.load_table(stream.read(spark, f"{tmp_path}/in"), path, f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.instrument_id, r.ts, r.close) for r in tables.read(spark, path).collect())

    def drop(*rows):
        spark.createDataFrame([r for part in rows for r in part], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    drop(minute_rows(300), minute_rows(40))
    first = run("c")
    assert len(first) == 300
    drop(minute_rows(300))  # all known
    drop(minute_rows(20, 300))
    second = run("c")
    assert len(second) == 320 and set(first) <= set(second)
    assert run("another") == second  # everything comes again


def test_feeds_are_checked(spark):
    good = lambda s: s.createDataFrame(minute_rows(3), tables.SHAPES["bar_1m"]).withColumn("more", F.lit(1))
    got = tables.load(spark, good, "bar_1m")
    assert got.columns == [x.split(" ")[0] for x in tables.SHAPES["bar_1m"].split(", ")] and got.count() == 3
    with pytest.raises(ValueError, match="lacks close"):
        tables.load(spark, lambda s: good(s).drop("close"), "bar_1m")


def test_folders_name_what_files_do_not(spark, tmp_path):
    (tmp_path / "c/symbol=ETH/period=2020-01").mkdir(parents=True)
    (tmp_path / "c/symbol=ETH/period=2020-01/part-0.csv").write_text("\n".join([HEAD, line(T0)]))
    good, _ = candles.read_csv(spark, f"{tmp_path}/c")
    assert [(r.symbol, r.period) for r in good.collect()] == [("ETH", "2020-01")]
    (tmp_path / "m/series_id=A%20B").mkdir(parents=True)
    (tmp_path / "m/series_id=A%20B/part-0.csv").write_text("date,value\n2020-01-01,1\n")
    assert macro.read(spark, f"{tmp_path}/m").first()[:1] in (("A B",), ("A%20B",))


def test_the_shared_folder_must_be_named_off_one_machine():
    class Session:
        def __init__(self, master, found=None):
            self.sparkContext = self
            self.conf = self
            self.master, self.found = master, found

        def get(self, key, default):
            return self.found

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.found = path

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://x"):
        with pytest.raises(ValueError, match="shared folder"):
            shared.shared_dir(Session(master))
        assert shared.shared_dir(Session(master, "hdfs://x/y")) == "hdfs://x/y"
    for master in ("local", "local[8]", "local[*]"):
        one = Session(master)
        assert shared.shared_dir(one) == one.found


def test_late_rows_are_counted(spark, tmp_path):
    """Five rows of a bar in time, three late; a bar whose rows are all late; one in time."""
    kind = stream.SCHEMA
    waves = [minute_rows(5) + minute_rows(200, 120), minute_rows(1, 330), minute_rows(3, 30) + minute_rows(4, 60) + minute_rows(2, 300), minute_rows(1, 9000), minute_rows(1, 12000)]
    for wave in waves:
        spark.createDataFrame([(1, *r[1:]) for r in wave], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        bars_out = stream.rollup(stream.read(spark, f"{tmp_path}/in"), "1h", counted=True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start(f"{tmp_path}/bars")
        bars_out.awaitTermination()
        counts = stream.arrivals(stream.read(spark, f"{tmp_path}/in"), "1h", f"{tmp_path}/came", f"{tmp_path}/c2").trigger(availableNow=True).start()
        counts.awaitTermination()
    got = stream.late_rows(spark.read.parquet(f"{tmp_path}/came"), spark.read.parquet(f"{tmp_path}/bars"), F.lit("2020-01-03").cast("timestamp")).orderBy("ts").collect()
    assert [(r.ts.hour, r.arrived, r.in_bar, r.late) for r in got] == [(0, 8, 5, 3), (1, 4, 0, 4), (2, 60, 60, 0), (3, 60, 60, 0), (4, 60, 60, 0), (5, 23, 23, 0)]


def day_rows(spark, days, close, n=3):
    t = dt.datetime(2020, 1, 1)
    rows = [(i, t + dt.timedelta(days=d) if d is not None else None, 1.0, close) for d in days for i in range(n)]
    return spark.createDataFrame(rows, "instrument_id int, ts timestamp_ntz, open double, close double")


def test_a_rewrite_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, keys = f"{tmp_path}/v", ["instrument_id", "ts"]
    with pytest.raises(ValueError):
        versions.read(spark, path)
    assert versions.append_new(spark, path, day_rows(spark, range(10), 1.0), keys, [F.col("open")]) == 0
    assert versions.append_new(spark, path, day_rows(spark, range(12), 2.0), keys, [F.col("open")]) == 1
    closes = lambda df: sorted((r.close, r["count"]) for r in df.groupBy("close").count().collect())
    old = versions.read(spark, path)
    assert closes(old) == [(1.0, 30), (2.0, 6)]
    # a crash after the rows, before the swap
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.rewrite(spark, path, day_rows(spark, range(5, 15), 3.0), keys, ["close"])
    assert closes(versions.read(spark, path)) == [(1.0, 30), (2.0, 6)]
    # another writer is first: the merge is done again on what it has left
    publish, raced = versions._publish, []

    def slow(*a):
        if not raced:
            raced.append(True)
            versions.rewrite(spark, path, day_rows(spark, [0, 14], 9.0), keys, ["close"])
        publish(*a)

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", slow)
        assert versions.rewrite(spark, path, day_rows(spark, range(5, 15), 3.0), keys, ["close"]) == 3
    assert closes(versions.read(spark, path)) == [(1.0, 12), (3.0, 30), (9.0, 3)]
    assert closes(old) == closes(versions.read(spark, path, 1)) == [(1.0, 30), (2.0, 6)]  # who has an old version keeps it
    # rows without a time stay; an empty batch and another column change nothing
    versions.rewrite(spark, path, day_rows(spark, [None], 5.0), keys, ["close"])
    versions.rewrite(spark, path, day_rows(spark, [None], 6.0).withColumn("write", F.lit(1)), keys, ["close"])
    versions.rewrite(spark, path, day_rows(spark, [1], 6.0).limit(0), keys, ["close"])
    last = versions.read(spark, path)
    assert closes(last) == [(1.0, 12), (3.0, 30), (5.0, 3), (6.0, 3), (9.0, 3)] and last.columns == ["instrument_id", "ts", "open", "close", "date"]
    assert versions.vacuum(spark, path, 1) >= 2 and versions.versions(spark, path) == [6]
    assert closes(versions.read(spark, path)) == closes(last)
    assert versions.append_new(spark, f"{tmp_path}/none", day_rows(spark, [], 1.0), keys, [F.col("open")]) == 0
    assert versions.read(spark, f"{tmp_path}/none").count() == 0
    # what was read may be written to a new table, or again to its own
    assert versions.append_new(spark, f"{tmp_path}/copy", last, keys, [F.col("open")]) == 0
    versions.rewrite(spark, path, last.withColumn("close", F.lit(7.0)).where("ts is not null"), keys, ["close"])
    assert closes(versions.read(spark, f"{tmp_path}/copy").where("ts is not null")) == [(1.0, 12), (3.0, 30), (9.0, 3)]
    assert closes(versions.read(spark, path)) == [(5.0, 3), (6.0, 3), (7.0, 45)]
    with pytest.raises(versions.Taken):
        versions._publish(spark, path, 6, {})

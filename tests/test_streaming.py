import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import rates

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(k, i, START + dt.timedelta(milliseconds=ms)) for i, (k, ms) in enumerate(rows)], "k string, i int, ts timestamp")


def ids(df):
    return sorted(r.i for r in df.collect())


def test_batch_folds(spark):
    e = events(spark, [("a", 0), ("a", 249), ("a", 250), ("a", 499), ("a", 501), ("b", 100), ("b", 100)])
    assert ids(rates.throttle(e, "k", "ts", "i")) == [0, 2, 4, 5]
    e = events(spark, [("a", 0), ("a", 1500), ("a", 2000), ("a", 2001), ("a", 4002)])
    assert ids(rates.dedup_window(e, "k", "ts", "i")) == [0, 3, 4]
    e = events(spark, [("a", 0), ("a", 100), ("a", 450), ("a", 700)])
    assert ids(rates.debounce(e, "k", "ts", "i")) == [1, 3]
    assert ids(rates.throttle(e.limit(0), "k", "ts", "i")) == []


def test_batch_dedup_keeps_repeats_within_a_batch(spark):
    seen = events(spark, [("a", 0)])
    batch = events(spark, [("a", 1), ("b", 2), ("b", 3)])
    assert ids(rates.batch_dedup(batch, seen, "k")) == [1, 2]
    assert ids(rates.scan_mode(batch, seen, "SINGLE", "k", "i")) == [0]
    assert ids(rates.scan_mode(batch, seen, "CONTINUOUS", "k", "i")) == [0, 1, 2]
    assert rates.scan_mode(batch, seen, "BATCH", "k", "i").count() == 3


@pytest.mark.parametrize("strict", [False, True])
def test_stream_fold(spark, tmp_path, strict):
    source = tmp_path / "in"
    rows = [[("a", 0), ("a", 100), ("b", 50)], [("a", 250), ("a", 260), ("b", 301)], [("a", 510), ("b", 300_000)]]
    for n, part in enumerate(rows):
        events(spark, part).coalesce(1).write.mode("append").parquet(str(source / f"n={n}"))
    stream = spark.readStream.schema("k string, i int, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = rates.stream_fold(stream.withWatermark("ts", "10 seconds"), "k", "ts", 250_000, strict)
    done = out.writeStream.format("memory").queryName(f"fold_{strict}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = sorted(((r.ts - START) / dt.timedelta(milliseconds=1), r.k) for r in spark.table(f"fold_{strict}").collect())
    assert got == ([(0, "a"), (50, "b"), (260, "a"), (301, "b"), (300_000, "b")] if strict else [(0, "a"), (50, "b"), (250, "a"), (301, "b"), (510, "a"), (300_000, "b")])


def test_accumulate(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate([[("a", 0), ("a", 1)], [("a", 2), ("b", 3)]]):
        events(spark, part).coalesce(1).write.parquet(str(source / f"n={n}"))
    stream = spark.readStream.schema("k string, i int, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(str(source))
    rates.accumulate(stream, table, "k", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == ["a", "a", "b"]


def test_busy_gate(spark):
    e = events(spark, [("a", 0), ("a", 99), ("a", 100), ("a", 150), ("a", 400), ("b", 5)])
    assert ids(rates.busy_gate(e, "k", "ts", "i", (F.col("i") + 1) * 100_000)) == [0, 2, 4, 5]
    assert ids(rates.busy_gate(e, "k", "ts", "i", F.lit(0), F.col("k") == "a")) == [5]
    assert ids(rates.busy_gate(e, "k", "ts", "i", F.lit(None))) == [0, 1, 2, 3, 4, 5]


def test_stream_debounce(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", 0), ("a", 100), ("a", 449), ("b", 50), ("a", 799), ("a", 1148), ("b", 399), ("a", 300_000), ("c", 300_000)]
    for n, part in enumerate([rows[:4], rows[4:7], rows[7:]]):
        events(spark, part).coalesce(1).write.parquet(str(source / f"n={n}"))
    stream = spark.readStream.schema("k string, i int, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = rates.stream_debounce(stream.withWatermark("ts", "10 seconds"), "k", "ts", 350_000)
    done = out.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {(r.k, round((r.ts - START) / dt.timedelta(milliseconds=1))) for r in spark.table("bursts").collect()}
    whole = {(r.k, round((r.ts - START) / dt.timedelta(milliseconds=1))) for r in rates.debounce(events(spark, rows), "k", "ts", "i", 350_000).collect()}
    # The bursts at the end are still open.
    assert got == {x for x in whole if x[1] < 300_000} == {("a", 449), ("a", 1148), ("b", 399)}

"""Months that close on the stream, and subscriptions that end while it runs."""

import datetime as dt

from marketloom.sources.ticks import QUOTE_SCHEMA, stream_quotes
from marketloom.streaming import quotes as live
from marketloom.streaming import stateful


def tick(seq, day, price, symbol="a", qty=10, exchange="X", bid=9.0, ask=11.0):
    return (exchange, symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), seq, price, bid, ask, qty)


def landed(spark, path, batches, schema=QUOTE_SCHEMA):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, changes, tmp_path, keys):
    q = live.run_to_table(changes, f"{tmp_path}/table", f"{tmp_path}/mark", keys=keys)
    q.awaitTermination()
    assert q.exception() is None
    return live.snapshot(spark, f"{tmp_path}/table", keys).collect(), live.late_rows(q)


def test_months_close_by_timer_and_late_ticks_are_counted(spark, tmp_path):
    batches = [
        [tick(1, 0, 10.0), tick(2, 30, 12.0), tick(3, 5, 8.0, "b")],
        [tick(5, 31, 20.0), tick(4, 30.5, 7.0), tick(6, 65, 21.0), tick(7, 3, None, "b", None)],  # February and March; January still open
        [tick(8, 66, 22.0)],
        [tick(9, 29, 99.0), tick(10, 70, 23.0), tick(11, 64.5, 5.0)],  # January is closed: its tick is late
    ]
    feed = stream_quotes(spark, landed(spark, f"{tmp_path}/feed", batches), max_files=1)
    rows, late = run(spark, stateful.month_bars(feed, "2 days"), tmp_path, ["dt", "symbol"])
    got = {(r.symbol, r.dt.month): (r.O, r.H, r.L, r.C, r.V, r.closed) for r in rows}
    assert late == 1
    assert got == {
        ("a", 1): (10.0, 12.0, 7.0, 7.0, 30, True),
        ("b", 1): (8.0, 8.0, 8.0, 8.0, 10, True),
        ("a", 2): (20.0, 20.0, 20.0, 20.0, 10, True),
        ("a", 3): (21.0, 23.0, 5.0, 5.0, 40, False),
    }


def test_without_a_watermark_nothing_is_late(spark, tmp_path):
    batches = [[tick(9, 400, 1.0)], [tick(1, 0, 2.0), tick(2, 0, 3.0)], [tick(5, 399, 9.0)]]
    feed = stream_quotes(spark, landed(spark, f"{tmp_path}/feed", batches), max_files=1)
    rows, late = run(spark, stateful.month_bars(feed, None), tmp_path, ["dt", "symbol"])
    assert late == 0 and not any(r.closed for r in rows)
    assert sorted((str(r.dt), r.O, r.C, r.V) for r in rows) == [("2024-01-01", 2.0, 3.0, 20), ("2025-02-01", 9.0, 1.0, 20)]


def test_subscription_ends_and_begins_again(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    ticks = [
        [tick(1, 0, 11.0), tick(2, 2, 9.0), tick(3, 2, 12.0, "b")],
        [tick(4, 4, 10.0), tick(5, 6, 8.0)],
        [tick(6, 8, 13.0, qty=None), tick(7, 3, 10.5), tick(8, 20, 1.0, "c")],
    ]
    controls = [("X", "a", day(2), True), ("X", "a", day(4), False), ("X", "a", day(7), True), ("X", "b", day(3), True), ("X", None, day(0), True)]
    schema = "exchange string, symbol string, ts timestamp, active boolean"
    feed = stream_quotes(spark, landed(spark, f"{tmp_path}/feed", ticks), max_files=1)
    asked = spark.readStream.schema(schema).parquet(landed(spark, f"{tmp_path}/controls", [controls], schema))
    rows, _ = run(spark, stateful.subscribed_totals(feed, asked), tmp_path, ["exchange", "symbol"])
    got = {r.symbol: (r.totalVolume, r.outsideVolume, r.insideVolume, r.lastPrice, r.ticks, r.ignored) for r in rows}
    assert got == {"a": (20, 0, 10, 10.5, 3, 3), "b": (0, 0, 0, None, 0, 1), "c": (0, 0, 0, None, 0, 1)}

import datetime as dt

import pytest

from marketloom.catalog import ORACLES, QUERIES
from marketloom.catalog.check import compare, connect, oracle_result
from marketloom.operators.panel import bars
from marketloom.sources.ticks import QUOTE_SCHEMA, stream_quotes, subscribed
from marketloom.streaming import quotes as live

T0 = dt.datetime(2024, 1, 1, 9)


def quote(i, hours, price, symbol="a", bid=9.0, ask=11.0, exchange="X"):
    return (exchange, symbol, T0 + dt.timedelta(hours=hours), i, price, bid, ask, 10)


FILES = [
    [quote(1, 0, 11.0), quote(2, 0, 9.0), quote(3, 0, 10.0), quote(4, 1, 12.0, "b", exchange="Y")],
    [quote(5, 20, 8.0), quote(6, 30, 11.5), quote(7, 30, 10.5)],
    [quote(8, 29, 50.0), quote(9, 200, 10.0)],
]


@pytest.fixture
def feed(spark, tmp_path):
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, QUOTE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return str(tmp_path / "feed")


def run(spark, changes, tmp_path, keys, name):
    q = live.run_to_table(changes, str(tmp_path / name), str(tmp_path / f"{name}-mark"))
    q.awaitTermination()
    assert q.exception() is None
    return live.snapshot(spark, str(tmp_path / name), keys)


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_totals_over_several_batches_equal_the_batch_result(spark, feed, tmp_path):
    stream = live.quote_totals(stream_quotes(spark, feed, max_files=1))
    got = run(spark, stream, tmp_path, ["symbol"], "totals")
    assert rows_of(got) == rows_of(live.quote_totals(spark.read.parquet(feed)).select(*got.columns))
    a = got.where("symbol = 'a'").first()
    assert (a.totalVolume, a.outsideVolume, a.insideVolume, a.lastPrice) == (80, 30, 20, 10.0)


def test_day_and_month_bars(spark, feed, tmp_path):
    stream = live.stream_bars(stream_quotes(spark, feed, max_files=1), "day", "100 days")
    got = run(spark, stream, tmp_path, ["dt", "symbol"], "bars")
    plain = live.sided(spark.read.parquet(feed)).selectExpr("*", "price * qty AS val")
    exact = bars(plain, "day").select("dt", "symbol", "O", "H", "L", "C", "V")
    assert rows_of(got) == rows_of(exact.withColumn("V", exact.V.cast("bigint")))
    months = live.months_from_days(got).where("symbol = 'a'").collect()
    assert [(r.O, r.H, r.C, r.V) for r in months] == [(11.0, 50.0, 10.0, 80)]


def test_closed_bars_only_in_append_mode(spark, feed):
    q = (
        live.stream_bars(stream_quotes(spark, feed), "week")
        .writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.table("closed").where("symbol = 'a'").collect()
    assert [r.dt for r in got] == [dt.date(2024, 1, 1)]


def test_subscription(spark, feed):
    chosen = spark.createDataFrame([("Y", "b"), ("Y", "b"), ("X", "none")], "exchange string, symbol string")
    assert [r.symbol for r in subscribed(spark.read.parquet(feed), chosen).collect()] == ["b"]


SMOKE = [
    "a14_bars_week", "w2_momentum_5", "w6_ema_3", "q3_features", "s4_quoted_split", "p3_rightmost_text_cell",
    "q1_institutional_flow", "q2_metadata", "m2_ridge_two_features", "u2_greedy_dedup", "r9_policy_evaluation",
    "t3_stream_bars_week", "k3_matrix_sheet", "a7_bracketed_quantiles",
]


@pytest.mark.parametrize("name", SMOKE)
def test_query_matches_its_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols, expected = oracle_result(connect(sf), ORACLES[name])
    assert compare(df.collect(), df.columns, expected, cols) == ""


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)

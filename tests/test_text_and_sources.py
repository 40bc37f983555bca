import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as sc
from marketloom.operators.flow import flow_table, metadata_table, run_counters, universe
from marketloom.sinks.tables import write_metadata
from marketloom.sources import csv as src
from marketloom.sources import json_feeds as feeds


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", expr(F.col("s")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    texts = ["2024-01-02", "113/1/2", "2024/1/2", "20240102", "bad", None]
    ymd = values(spark, texts, sc.yyyymmdd)
    assert ymd == ["20240102"] * 4 + ["bad", None]
    assert values(spark, texts, sc.to_date) == [dt.date(2024, 1, 2)] * 4 + [None, None]


def test_numbers(spark):
    texts = ["1,234", "-5,000", "-", "", "5-3", "--5", "1.5", "9" * 20, None]
    assert values(spark, texts, sc.whole_number) == [1234, -5000, 0, 0, 5, 0, 15, 0, 0]


def test_trim_takes_carriage_returns(spark):
    assert values(spark, [" a b\t\r\n", "\r", "x"], sc.trim_all) == ["a b", "", "x"]


def test_split_toggles_quotes(spark):
    lines = ['a,"b,c",d', 'x"1,2"y,z', 'p,"open,to the end', '"a""b",c', "", ",,", '""']
    expected = [
        ["a", "b,c", "d"], ["x1,2y", "z"], ["p", "open,to the end"], ["ab", "c"], [""], ["", "", ""], [""],
    ]
    assert values(spark, lines, src.split_csv_line) == expected


def test_etf_rule(spark):
    rows = [("0050", "", ""), ("2330", "", ""), ("9", "Main ETF", ""), ("9", "", "受益證券"), ("9", None, None)]
    df = spark.createDataFrame(rows, "c string, m string, t string")
    got = df.select(sc.lot_size(sc.is_etf(F.col("c"), F.col("m"), F.col("t"))).alias("lot")).collect()
    assert [r.lot for r in got] == [100, 1000, 100, 100, 1000]


@pytest.mark.parametrize("toggle", [False, True])
def test_daily_csv(spark, tmp_path, toggle):
    (tmp_path / "d.csv").write_text(
        "date, Code ,O,H,L,C,V,VAL,symbol\r\n"
        '2024-01-02, 2330 ,1,2,1,2,"1,234",10,zz\r\n'
        "\r\n"
        "113/1/3,2331,,2,1,2,5,10,zz\r\n"
        "2024-01-04\r\n"
        "2024-01-05, ,1,2,1,2,5,10,zz\r\n"
    )
    got = src.read_daily(spark, str(tmp_path / "d.csv"), toggle).orderBy("dt").collect()
    assert [(r.symbol, r.dt.day, r.O, r.V, r.adj_close) for r in got] == [
        ("2330", 2, 1.0, 1234.0, None),
        ("2331", 3, None, 5.0, None),
    ]


def test_missing_column(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,symbol\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        src.read_daily(spark, str(tmp_path / "d.csv"))


BODY = '{"stat":"OK","data":[["2330","n","1,000","-7"],["2331","n","5",9],["1","n",3],["2330","n","0","12"],[5,"n","1"],"x",["7"]]}'


def test_trade_rows(spark):
    bodies = [
        ("20240102", BODY),
        ("20240103", BODY.replace("OK", "NO")),
        ("20240104", '{"data":[]}'),
        ("20240105", '{"stat":"OK"}'),
        ("20240106", "{broken"),
        ("20240107", '{"stat":5,"data":[["1","n","5"]]}'),
    ]
    df = spark.createDataFrame(bodies, "date string, body string")
    rows = feeds.trading_day_rows(df, "date")
    got = feeds.last_per_code(rows.where("code IS NOT NULL"), "date", value=feeds.rightmost_amount(F.col("cells")))
    assert {(r.date, r.code): r.value for r in got.collect()} == {
        ("20240102", "2330"): 12, ("20240102", "2331"): 5, ("20240102", "1"): 0,
    }
    assert rows.where("code IS NULL").count() == 1


def test_flow_table_keeps_spelling_and_universe(spark):
    daily = spark.createDataFrame(
        [(dt.date(2024, 1, 2), "113/1/2", "2330"), (dt.date(2024, 1, 3), "2024-01-03", "9")],
        "dt date, date_text string, symbol string",
    )
    responses = spark.createDataFrame([("20240102", BODY), ("20240104", BODY)], "date string, body string")
    got = flow_table(daily, responses).collect()
    assert [(r.date, r.symbol, r.netbuy) for r in got] == [("113/1/2", "2330", 12)]
    assert flow_table(daily, responses, n_dates=1).count() == 0


def test_companies_and_metadata(spark, tmp_path):
    items = [
        {"公司代號": "", "有價證券代號": "2330", "產業別": 24, "上市別": "上市", "有價證券別": "股票"},
        {"公司代號": "2331", "產業別": "old"},
        {"公司代號": "2331", "產業別": "a, b", "市場別": "ETF"},
        {"產業別": "no code"},
        7,
    ]
    df = spark.createDataFrame([(json.dumps(items, ensure_ascii=False),)], "body string")
    symbols = universe(spark.createDataFrame([("2330",), ("2331",), ("0050",), ("2330",)], "symbol string"))
    meta = metadata_table(symbols, feeds.read_companies(df))
    got = {r.symbol: (r.lot, r.industry, r.group, r.found) for r in meta.collect()}
    assert got == {
        "2330": (1000, "-1", "上市", True),
        "2331": (100, "a, b", "ETF", True),
        "0050": (100, "-1", "-1", False),
    }
    seen = write_metadata(meta, str(tmp_path / "m"), "csv")
    assert seen.get == {"rows_written": 3, "etf_count": 2, "missing_meta": 1} == run_counters(meta).first().asDict()
    back = src.read_metadata(spark, str(tmp_path / "m"))
    assert {r.symbol: r.industry for r in back.collect()}["2331"] == "a, b"


def test_garman_klass_and_safe_division(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (0.0, 2.0, 0.0, 1.0)], "o double, h double, l double, c double")
    a, b = [r.v for r in df.select(sc.garman_klass(*map(F.col, "ohlc")).alias("v")).collect()]
    assert a == pytest.approx(0.9473, abs=1e-4) and b is None
    row = df.select(
        sc.safe_div(F.lit(1.0), F.lit(1e-13)).alias("zero"), sc.safe_div(F.lit(1.0), F.lit(None)).alias("none")
    ).first()
    assert row.zero == 0.0 and row.none is None


def test_chords_bound_the_power_from_above(spark):
    points = (0.0, 0.01, 0.04)
    df = spark.range(0, 41).select((F.col("id") / 1000).alias("u"))
    got = df.select(sc.impact_power(F.col("u")).alias("e"), sc.impact_power(F.col("u"), points).alias("c")).collect()
    assert all(r.c >= r.e - 1e-15 for r in got)
    assert got[10].c == pytest.approx(got[10].e)

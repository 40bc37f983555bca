"""Queries: scans, text cleaning, institutional flow, metadata, file sinks.

Files and responses are written from the supplied tables first and then read by the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import roles
from marketloom.catalog.base import query, rounded, sql
from marketloom.catalog.q_panel import weekly
from marketloom.functions import scalars as sc
from marketloom.operators import flow as fl
from marketloom.session import scratch_path, stage
from marketloom.sinks import tables as sinks
from marketloom.sources import csv as csv_source
from marketloom.sources import json_feeds as feeds

PAGE = 1000  # rows per landed response


def spelled(dt, kind):
    """A date in one of the three spellings."""
    roc = F.concat_ws("/", F.year(dt) - 1911, F.month(dt), F.dayofmonth(dt))
    return (
        F.when(kind == 0, F.date_format(dt, "yyyy-MM-dd"))
        .when(kind == 1, roc)
        .otherwise(F.date_format(dt, "yyyyMMdd"))
    )


def spelled_sql(dt, kind):
    return (
        f"CASE {kind} WHEN 0 THEN strftime({dt}, '%Y-%m-%d') WHEN 1 THEN CAST(year({dt}) - 1911 AS VARCHAR) || '/' || "
        f"CAST(month({dt}) AS VARCHAR) || '/' || CAST(day({dt}) AS VARCHAR) ELSE strftime({dt}, '%Y%m%d') END"
    )


_PRICES = ", ".join(f"round({c}, 8) AS {c}" for c in ("O", "H", "L", "C", "VAL"))


@query("s1_daily_csv_scan", sql(
    f"SELECT dt, symbol, {_PRICES}, V, inside_vol, outside_vol, CAST(NULL AS DOUBLE) AS adj_close FROM bars", "bars"))
def s1(spark, sf):
    path = scratch_path(spark, "daily-csv")
    b = weekly(spark, sf)
    b.select(
        spelled(F.col("dt"), F.col("symbol").cast("int") % 3).alias(" Date "),
        F.col("symbol").alias("Code"),
        "O", "H", "L", "C",
        F.format_number("V", 0).alias("V"),
        F.col("VAL").alias("VAL "),
        "inside_vol", "outside_vol",
    ).write.option("header", True).csv(path)
    return rounded(csv_source.read_daily(spark, path).drop("date_text"), 8, "O", "H", "L", "C", "VAL")


@query("s2_flow_csv_scan", sql("SELECT dt, symbol, netbuy FROM flow", "flow"))
def s2(spark, sf):
    path = scratch_path(spark, "flow-csv")
    net = F.col("netbuy")
    given = F.col("symbol").cast("int") % 2 == 0
    roles.flow(spark, sf).select(
        F.col("dt").cast("string").alias("date"),
        "symbol",
        F.when(given, net).alias("broker_netbuy_topk"),
        F.when(~given, F.greatest(net, F.lit(0))).alias("broker_buy_topk"),
        F.when(~given, F.greatest(-net, F.lit(0))).alias("broker_sell_topk"),
    ).write.option("header", True).csv(path)
    return csv_source.read_flow(spark, path)


@query("s3_metadata_csv_scan", sql(
    """SELECT symbol, CAST(CASE WHEN CAST(symbol AS INTEGER) % 6 = 0 THEN 1 ELSE lot END AS INTEGER) AS lot, 1 AS odd_lot_unit,
    CASE WHEN CAST(symbol AS INTEGER) % 5 = 0 THEN '-1' ELSE industry || ', Ltd' END AS industry, "group",
    CAST(meta_flag AS INTEGER) AS tradable_flag FROM meta""", "meta"))  # fmt: skip
def s3(spark, sf):
    path = scratch_path(spark, "meta-csv")
    n = F.col("symbol").cast("int")
    roles.metadata(spark, sf).select(
        "symbol",
        F.when(n % 6 != 0, F.col("lot")).alias("lot_size"),
        F.when(n % 5 != 0, F.concat("industry", F.lit(", Ltd"))).alias("industry"),
        F.col("group").alias("Group"),
        "tradable_flag",
    ).write.option("header", True).csv(path)
    return csv_source.read_metadata(spark, path)


@query("s4_quoted_split", sql(
    """SELECT p_partkey, p_name || ',' || p_brand AS a, p_type AS b, 'a' || p_size || ',b' AS c,
    CASE WHEN p_partkey % 3 = 0 THEN 'open,' || p_size || ',end' ELSE 'tail' END AS d,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 5 END AS INTEGER) AS n FROM part"""))  # fmt: skip
def s4(spark, sf):
    size = F.col("p_size").cast("string")
    line = F.concat(
        F.lit('"'), "p_name", F.lit(","), "p_brand", F.lit('",'), "p_type", F.lit(',a"'), size, F.lit(',"b,'),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('open",'), size, F.lit(",end"))).otherwise("tail,"),
    )
    f = F.col("f")
    return (
        roles.table(spark, sf, "part")
        .select("p_partkey", csv_source.split_csv_line(line).alias("f"))
        .select("p_partkey", f[0].alias("a"), f[1].alias("b"), f[2].alias("c"), f[3].alias("d"), F.size("f").alias("n"))
    )


def responses(spark, sf):
    """Trade responses, paged: (date, page, body). Some days are closed, some codes come twice."""
    net, code = F.col("netbuy"), F.col("symbol")
    n = code.cast("int")
    amount = F.format_number(F.abs(net) + 1000, 0)
    cell = F.when(net % 4 == 0, net.cast("string")).otherwise(
        F.concat(F.lit('"'), F.format_number(net, 0), F.lit('"'))
    )
    last = F.concat(F.lit('["'), code, F.lit('","n","'), amount, F.lit('",'), cell, F.lit("]"))
    first = F.concat(F.lit('["'), code, F.lit('","n","7","9"]'))
    rows = F.array_sort(F.collect_list(F.struct(n, "row")))
    twice = F.when(n % 5 == 0, F.concat(first, F.lit(","), last)).otherwise(last)
    closed = F.dayofmonth("dt") % 7 == 0
    body = F.concat(
        F.lit('{"stat":"'), F.when(closed, "NO DATA").otherwise("OK"), F.lit('","data":['),
        F.array_join(F.transform("rows", lambda x: x.row), ","), F.lit("]}"),
    )
    return (
        roles.flow(spark, sf)
        .withColumn("row", twice)
        .groupBy("dt", F.floor(n / PAGE).alias("page"))
        .agg(rows.alias("rows"))
        .select(F.date_format("dt", "yyyyMMdd").alias("date"), "page", body.alias("body"))
    )


_NET = "CASE WHEN netbuy % 4 = 0 THEN abs(netbuy) + 1000 ELSE netbuy END"


@query("s5_trade_json_scan", sql(
    f"SELECT dt, symbol AS code, CAST({_NET} AS BIGINT) AS netbuy FROM flow WHERE day(dt) % 7 <> 0", "flow"))
def s5(spark, sf):
    path = scratch_path(spark, "responses")
    responses(spark, sf).repartition("date").write.partitionBy("date", "page").text(path)
    rows = feeds.trading_day_rows(feeds.read_responses(spark, path), "date")
    value = feeds.rightmost_amount(F.col("cells"))
    return feeds.last_per_code(rows, "date", value=value).select(
        sc.to_date(F.col("date").cast("string")).alias("dt"), "code", F.col("value").alias("netbuy")
    )


@query("p3_rightmost_text_cell", sql(
    f"""SELECT dt, symbol AS code, CAST({_NET} AS BIGINT) AS amount, CAST(CAST(symbol AS INTEGER) % 5 = 0 AS BOOLEAN) AS twice
    FROM flow WHERE day(dt) % 7 <> 0 UNION ALL SELECT dt, symbol, 9, true FROM flow WHERE day(dt) % 7 <> 0 AND CAST(symbol AS INTEGER) % 5 = 0""", "flow"))  # fmt: skip
def p3(spark, sf):
    rows = feeds.trading_day_rows(responses(spark, sf), "date")
    return rows.select(
        sc.to_date(F.col("date")).alias("dt"),
        "code",
        feeds.rightmost_amount(F.col("cells")).alias("amount"),
        (F.col("code").cast("int") % 5 == 0).alias("twice"),
    )


@query("p11_trading_days", sql(
    "SELECT dt, count(*) + count(CASE WHEN CAST(symbol AS INTEGER) % 5 = 0 THEN 1 END) AS cells FROM flow WHERE day(dt) % 7 <> 0 GROUP BY dt", "flow"))
def p11(spark, sf):
    rows = feeds.trading_day_rows(responses(spark, sf), "date")
    return rows.groupBy(sc.to_date(F.col("date")).alias("dt")).agg(F.count("*").alias("cells"))


@query("a2_last_wins", sql(
    f"""SELECT dt, symbol AS code, CAST({_NET} AS BIGINT) AS value FROM flow WHERE day(dt) % 7 <> 0""", "flow"))
def a2(spark, sf):
    rows = feeds.trading_day_rows(responses(spark, sf), "date")
    out = feeds.last_per_code(rows, "date", value=feeds.rightmost_amount(F.col("cells")))
    return out.select(sc.to_date(F.col("date")).alias("dt"), "code", "value")


@query("q1_skipped_input", sql(
    f"""SELECT dt, count(DISTINCT CAST(symbol AS INTEGER) // {PAGE}) AS responses, 0 AS broken,
      CASE WHEN day(dt) % 7 = 0 THEN count(DISTINCT CAST(symbol AS INTEGER) // {PAGE}) ELSE 0 END AS not_ok, 0 AS no_data,
      CASE WHEN day(dt) % 7 = 0 THEN 0 ELSE count(*) + count(CASE WHEN CAST(symbol AS INTEGER) % 5 = 0 THEN 1 END) END AS rows,
      0 AS short_rows, 0 AS codeless_rows FROM flow GROUP BY dt""", "flow"))  # fmt: skip
def q1_skipped(spark, sf):
    """What the trade scan takes and sets aside, by day."""
    counts = feeds.response_counts(responses(spark, sf), "date")
    return counts.withColumn("dt", sc.to_date(F.col("date"))).drop("date")


def companies_bodies(spark, sf, whole=False):
    """The company list, paged; unless ``whole``, every fourth supplier is missing from it."""
    n = F.col("s_suppkey")
    code = F.when(n % 2 == 0, F.concat(F.lit('"公司代號":"'), n, F.lit('"'))).otherwise(
        F.concat(F.lit('"公司代號":"","有價證券代號":"'), n, F.lit('"'))
    )
    industry = F.when(n % 9 == 0, F.lit("17")).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"')))
    market_key = F.when(n % 3 == 0, "上市別").otherwise("市場別")
    market = F.when(n % 10 == 0, "Main ETF board").otherwise(F.col("r_name"))
    kind = F.when(n % 7 == 0, "受益證券").otherwise("股票")
    item = F.concat(
        F.lit("{"), code, F.lit(',"產業別":'), industry, F.lit(',"'), market_key, F.lit('":"'), market,
        F.lit('","有價證券別":"'), kind, F.lit('"}'),
    )
    nation, region = roles.table(spark, sf, "nation"), roles.table(spark, sf, "region")
    return (
        roles.table(spark, sf, "supplier")
        .where(F.lit(whole) | (n % 4 != 0))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.floor(n / PAGE).alias("page"))
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("body"))
    )


_ALL_COMPANIES = """SELECT CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE n_name END AS industry,
    CASE WHEN s_suppkey % 10 = 0 THEN 'Main ETF board' ELSE r_name END AS market,
    CASE WHEN s_suppkey % 7 = 0 THEN '受益證券' ELSE '股票' END AS sec_type
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_COMPANY = f"{_ALL_COMPANIES} WHERE s_suppkey % 4 <> 0"


def companies(spark, sf):
    path = scratch_path(spark, "companies")
    companies_bodies(spark, sf, whole=True).write.partitionBy("page").text(path)
    return feeds.read_companies(feeds.read_responses(spark, path))


@query("s6_company_json_scan", _ALL_COMPANIES)
def s6(spark, sf):
    return companies(spark, sf).drop("pos")


@query("p9_alternative_keys", f"SELECT code, market FROM ({_ALL_COMPANIES})")
def p9(spark, sf):
    return feeds.read_companies(companies_bodies(spark, sf, whole=True)).select("code", "market")


_Q2 = f"""SELECT s.symbol, CAST(CASE WHEN etf THEN 100 ELSE 1000 END AS INTEGER) AS lot, 1 AS odd_lot_unit, industry, "group", 1 AS tradable_flag, etf, found
  FROM (SELECT symbol, coalesce(nullif(industry, ''), '-1') AS industry, coalesce(nullif(market, ''), '-1') AS "group", code IS NOT NULL AS found,
     symbol LIKE '00%' OR lower(coalesce(market, '')) LIKE '%etf%' OR lower(coalesce(sec_type, '')) LIKE '%etf%' OR coalesce(sec_type, '') LIKE '%受益%' AS etf
     FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem) u LEFT JOIN ({_COMPANY}) c ON c.code = u.symbol) s"""


def q2_table(spark, sf):
    symbols = fl.universe(roles.ticks(spark, sf))
    return fl.metadata_table(symbols, feeds.read_companies(companies_bodies(spark, sf), "page"))


@query("q2_metadata", _Q2)
def q2(spark, sf):
    return q2_table(spark, sf)


@query("j3_left_metadata_join", f"SELECT symbol, industry, found FROM ({_Q2})")
def j3(spark, sf):
    return q2_table(spark, sf).select("symbol", "industry", "found")


@query("j4_missing_metadata", f"SELECT symbol FROM ({_Q2}) WHERE NOT found")
def j4(spark, sf):
    symbols = fl.universe(roles.ticks(spark, sf))
    index = fl.company_index(feeds.read_companies(companies_bodies(spark, sf), "page"))
    return symbols.join(index, "symbol", "left_anti")


@query("k2_metadata_sink", f'SELECT symbol, lot, odd_lot_unit, industry, "group", tradable_flag FROM ({_Q2})')
def k2(spark, sf):
    path = scratch_path(spark, "meta-out")
    sinks.write_metadata(q2_table(spark, sf), path, "csv")
    return csv_source.read_metadata(spark, path)


_COUNTERS = f"""SELECT count(*) AS rows_written, count(CASE WHEN etf THEN 1 END) AS etf_count,
    count(CASE WHEN NOT found THEN 1 END) AS missing_meta, (SELECT count(*) FROM ({_COMPANY})) AS meta_rows FROM ({_Q2})"""


@query("k6_run_counters", _COUNTERS)
def k6(spark, sf):
    """The counters of the write, by observation, and the rows of the company list."""
    seen = sinks.write_metadata(q2_table(spark, sf), scratch_path(spark, "meta-counted")).get
    listed = feeds.read_companies(companies_bodies(spark, sf)).agg(F.count("*").alias("meta_rows"))
    return listed.select(*[F.lit(v).cast("bigint").alias(k) for k, v in seen.items()], "meta_rows")


@query("a3_conditional_counts", sql(
    """SELECT dt, count(*) AS n, count(CASE WHEN netbuy > 0 THEN 1 END) AS buyers,
    count(CASE WHEN netbuy < 0 THEN 1 END) AS sellers FROM flow GROUP BY dt""", "flow"))  # fmt: skip
def a3(spark, sf):
    return roles.flow(spark, sf).groupBy("dt").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("netbuy") > 0).alias("buyers"),
        F.count_if(F.col("netbuy") < 0).alias("sellers"),
    )


def daily_rows(spark, sf):
    """Symbols and spelled dates of the daily file; a third of the suppliers is not in it."""
    t = roles.ticks(spark, sf).where(F.col("symbol").cast("int") % 3 != 0)
    dt = F.trunc(F.col("ts").cast("date"), "week")
    return t.select("symbol", dt.alias("dt")).withColumn(
        "date_text", spelled(F.col("dt"), F.dayofmonth("dt") % 3)
    )


_Q1 = f"""SELECT f.dt, {spelled_sql('f.dt', 'day(f.dt) % 3')} AS date, f.symbol, CAST({_NET} AS BIGINT) AS netbuy FROM flow f
    WHERE f.dt IN (SELECT dt FROM cal ORDER BY dt DESC LIMIT 60) AND CAST(f.symbol AS INTEGER) % 3 <> 0 AND day(f.dt) % 7 <> 0
    AND f.symbol IN (SELECT symbol FROM bars)"""


def q1_table(spark, sf):
    return fl.flow_table(stage(daily_rows(spark, sf), "daily"), responses(spark, sf))


@query("q1_institutional_flow", sql(_Q1, "flow", "cal", "bars"))
def q1(spark, sf):
    return q1_table(spark, sf)


@query("k1_flow_sink", sql(f"SELECT dt, symbol, netbuy FROM ({_Q1})", "flow", "cal", "bars"))
def k1(spark, sf):
    path = scratch_path(spark, "flow-out")
    sinks.write_flow(q1_table(spark, sf), path, "csv")
    return csv_source.read_flow(spark, path)


@query("j1_universe_semi_join", sql(
    "SELECT dt, symbol, netbuy FROM flow WHERE CAST(symbol AS INTEGER) % 3 <> 0 AND symbol IN (SELECT symbol FROM bars)", "flow", "bars"))
def j1(spark, sf):
    return roles.flow(spark, sf).join(fl.universe(daily_rows(spark, sf)), "symbol", "left_semi").select("dt", "symbol", "netbuy")


@query("j2_flow_on_covered_dates", sql(
    """SELECT dt, symbol, netbuy FROM flow WHERE dt IN (SELECT dt FROM cal ORDER BY dt DESC LIMIT 60)
    AND CAST(symbol AS INTEGER) % 3 <> 0 AND symbol IN (SELECT symbol FROM bars)""", "flow", "cal", "bars"))  # fmt: skip
def j2(spark, sf):
    daily = stage(daily_rows(spark, sf), "daily")
    kept = roles.flow(spark, sf).join(fl.last_dates(daily), "dt", "left_semi")
    return kept.join(fl.universe(daily), "symbol", "left_semi").select("dt", "symbol", "netbuy")


@query("p1_date_spellings", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'bad' || o_orderkey ELSE strftime(o_orderdate, '%Y%m%d') END AS ymd,
    CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS dt FROM orders""")  # fmt: skip
def p1(spark, sf):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    western = F.concat_ws("/", F.year(d), F.month(d), F.dayofmonth(d))
    text = (
        F.when(k < 3, spelled(d, k))
        .when(k == 3, western)
        .otherwise(F.concat(F.lit("bad"), F.col("o_orderkey")))
    )
    return roles.table(spark, sf, "orders").select(
        "o_orderkey", sc.yyyymmdd(text).alias("ymd"), sc.to_date(text).alias("dt")
    )


@query("p2_number_cleaner", """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT)
    WHEN 1 THEN -CAST(floor(l_extendedprice) AS BIGINT) WHEN 2 THEN 0 WHEN 3 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS amount FROM lineitem""")  # fmt: skip
def p2(spark, sf):
    x, k = F.col("l_extendedprice"), F.col("l_orderkey") % 6
    qty = F.col("l_quantity").cast("bigint").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("NT$ "), F.format_number(x, 2)))
        .when(k == 1, F.concat(F.lit("-"), F.format_number(F.floor(x), 0)))
        .when(k == 2, "-")
        .when(k == 3, F.concat(qty, F.lit("-7")))
        .when(k == 4, F.concat(F.lit("--"), qty))
        .otherwise(F.repeat(F.lit("9"), 20))
    )
    return roles.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", sc.whole_number(text).alias("amount")
    )


@query("p4_trim", "SELECT c_custkey, c_name AS name FROM customer")
def p4(spark, sf):
    padded = F.concat(F.lit(" \t"), "c_name", F.when(F.col("c_custkey") % 2 == 0, "\r\n").otherwise(" "))
    return roles.table(spark, sf, "customer").select("c_custkey", sc.trim_all(padded).alias("name"))


@query("p5_header_names", "SELECT p_partkey AS symbol, p_name AS date, p_size AS val FROM part")
def p5(spark, sf):
    """Trimmed, case-insensitive headers; ``code`` is ``symbol``; the first of two wins."""
    path = scratch_path(spark, "headers")
    roles.table(spark, sf, "part").select(
        F.col("p_partkey").alias(" Code "), F.col("p_name").alias("DATE"), F.col("p_size").alias(" Val"),
        F.col("p_brand").alias("symbol"),
    ).write.option("header", True).csv(path)
    out = csv_source.read_named_csv(spark, path)
    return out.select(F.col("symbol").cast("bigint").alias("symbol"), "date", F.col("val").cast("int").alias("val"))


_ETF = """(printf('%06d', p_partkey * 37) LIKE '00%' OR lower(p_brand) LIKE '%etf%' OR p_type LIKE '%受益%')"""


@query("p6_p7_etf_lots", f"""SELECT p_partkey, {_ETF} AS etf, CAST(CASE WHEN {_ETF} THEN 100 ELSE 1000 END AS INTEGER) AS lot
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Etf' ELSE p_brand END AS p_brand,
      CASE WHEN p_partkey % 13 = 0 THEN '受益證券' ELSE p_type END AS p_type FROM part)""")  # fmt: skip
def p6(spark, sf):
    k = F.col("p_partkey")
    etf = sc.is_etf(
        F.format_string("%06d", k * 37),
        F.when(k % 11 == 0, "Etf").otherwise(F.col("p_brand")),
        F.when(k % 13 == 0, "受益證券").otherwise(F.col("p_type")),
    )
    return roles.table(spark, sf, "part").select("p_partkey", etf.alias("etf"), sc.lot_size(etf).alias("lot"))


@query("p8_unknown_marker", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '-1' ELSE c_mktsegment END AS industry FROM customer")
def p8(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 3 != 0, F.col("c_mktsegment")).when(k % 2 == 0, F.lit(""))
    return roles.table(spark, sf, "customer").select("c_custkey", sc.or_unknown(text).alias("industry"))


@query("p10_row_hygiene", """SELECT CAST(o_orderdate AS DATE) AS dt, CAST(o_custkey AS VARCHAR) AS symbol, o_totalprice AS "C" FROM orders WHERE o_orderkey % 4 = 0""")
def p10(spark, sf):
    """Blank lines, short rows and rows without a code are skipped."""
    path = scratch_path(spark, "lines")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.col("o_totalprice").cast("string")
    full = F.concat_ws(",", day, F.col("o_custkey").cast("string"), price, price, price, price, F.lit("1"), F.lit("1"))
    line = (
        F.when(k % 4 == 0, full)
        .when(k % 4 == 1, F.lit("  "))
        .when(k % 4 == 2, day)
        .otherwise(F.concat_ws(",", day, F.lit(" "), price, price, price, price, F.lit("1"), F.lit("1")))
    )
    lines = roles.table(spark, sf, "orders").select(line.alias("date,code,O,H,L,C,V,VAL"))
    plain = lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0002")
    plain.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv_source.read_daily(spark, path, toggle_quotes=True).select("dt", "symbol", "C")


@query("k3_matrix_sheet", """SELECT dt, """ + ", ".join(
    f"coalesce(sum(CASE WHEN n_nationkey = {i} THEN v END), 0.0) AS \"N{i}\"" for i in range(25))
    + """ FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, s_nationkey AS n_nationkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) GROUP BY dt""")  # fmt: skip
def k3(spark, sf):
    li, su = roles.table(spark, sf, "lineitem"), roles.table(spark, sf, "supplier")
    cells = (
        li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.trunc(F.col("l_shipdate").cast("date"), "week").alias("dt"),
            F.concat(F.lit("N"), "s_nationkey").alias("name"),
        )
        .agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("v"))
    )
    return sinks.matrix_sheet(cells, "dt", "name", "v", sinks.default_labels("N", 25))


@query("k4_vector_sheet", """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "index", CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS value FROM customer""")
def k4(spark, sf):
    v = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    df = roles.table(spark, sf, "customer").select("c_custkey", v.alias("v"))
    return sinks.vector_sheet(df, "v", "c_custkey")


@query("k5_default_labels", """SELECT 'R' || CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS VARCHAR) AS label, s_name FROM supplier""")
def k5(spark, sf):
    from marketloom.functions.indexing import with_row_index

    out = with_row_index(roles.table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return out.select(sinks.default_label("R", F.col("index")).alias("label"), "s_name")


@query("k7_kline_json", sql(
    """SELECT symbol, count(*) AS bars, CAST(min(dt) AS VARCHAR) AS first_dt, CAST(max(dt) AS VARCHAR) AS last_dt,
    round(arg_max(C, dt), 8) AS last_close, CAST(sum(V) AS DOUBLE) AS volume FROM bars GROUP BY symbol""", "bars"))  # fmt: skip
def k7(spark, sf):
    """The JSON text, read back: number of bars, ends, last close, volume."""
    schema = "array<struct<dt string, O double, H double, L double, C double, V double>>"
    k = F.from_json("kline", schema)
    read = sinks.kline_json(weekly(spark, sf)).select("symbol", k.alias("k"))
    return read.select(
        "symbol",
        F.size("k").cast("bigint").alias("bars"),
        F.col("k")[0].dt.alias("first_dt"),
        F.element_at("k", -1).dt.alias("last_dt"),
        F.round(F.element_at("k", -1).C, 8).alias("last_close"),
        F.aggregate("k", F.lit(0.0), lambda a, b: a + b.V).alias("volume"),
    )

"""Institutional flow (Q1) and security metadata (Q2) from landed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import is_etf, lot_size, or_unknown, to_date
from marketloom.session import by_date
from marketloom.sources.json_feeds import last_per_code, rightmost_amount, trading_day_rows

# Fixed value: how many trading dates the flow table covers.
FLOW_DATES = 60


def universe(daily: DataFrame) -> DataFrame:
    """Distinct symbols."""
    return daily.select("symbol").distinct()


def trading_dates(daily: DataFrame) -> DataFrame:
    """Distinct dates; order them with ``orderBy('dt')`` (real dates, not text)."""
    return daily.select("dt").distinct()


def last_dates(daily: DataFrame, n: int = FLOW_DATES) -> DataFrame:
    """L2: the newest ``n`` distinct dates."""
    return trading_dates(daily).orderBy(F.desc("dt")).limit(n)


def flow_table(daily: DataFrame, responses: DataFrame, n_dates: int = FLOW_DATES) -> DataFrame:
    """Q1: (dt, date, symbol, netbuy) for the newest dates and the symbols of the daily file.

    J2: a symbol is emitted for any covered date, whether or not it traded that day. The date
    keeps the spelling of the daily file. ``responses`` has (date, body), one per date.
    """
    days = last_dates(daily, n_dates)
    spelling = daily.groupBy("dt").agg(F.min("date_text").alias("date_text"))
    spelled = by_date(spelling.join(by_date(days), "dt"))
    rows = trading_day_rows(
        responses.withColumn("dt", to_date(F.col("date").cast("string"))).join(spelled, "dt"),
        "dt",
        "date_text",
    ).where("code IS NOT NULL")
    kept = rows.withColumnRenamed("code", "symbol").join(universe(daily), "symbol", "left_semi")
    latest = last_per_code(
        kept.withColumnRenamed("symbol", "code"),
        "dt",
        "date_text",
        value=rightmost_amount(F.col("cells")),
    )
    return latest.select(
        "dt",
        F.col("date_text").alias("date"),
        F.col("code").alias("symbol"),
        F.col("value").alias("netbuy"),
    )


def company_index(companies: DataFrame) -> DataFrame:
    """A2 on the company list: one row per code, the last one; a column ``page`` orders pages."""
    record = F.struct("industry", "market", "sec_type")
    pages = ("page",) if "page" in companies.columns else ()
    return last_per_code(companies, value=record, pages=pages).select(
        F.col("code").alias("symbol"), "value.industry", "value.market", "value.sec_type"
    )


def metadata_table(symbols: DataFrame, companies: DataFrame) -> DataFrame:
    """Every symbol with lot, industry and group; ``found`` tells a listed company."""
    index = company_index(companies).withColumn("found", F.lit(True))
    group = or_unknown(F.col("market"))
    etf = is_etf(F.col("symbol"), group, F.col("sec_type"))
    return symbols.join(index, "symbol", "left").select(
        "symbol",
        lot_size(etf).alias("lot"),
        F.lit(1).alias("odd_lot_unit"),
        or_unknown(F.col("industry")).alias("industry"),
        group.alias("group"),
        F.lit(1).alias("tradable_flag"),
        etf.alias("etf"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def run_counters(metadata: DataFrame) -> DataFrame:
    """Symbols, rows written, ETFs and symbols without metadata."""
    return metadata.agg(
        F.count("*").alias("rows_written"),
        F.count_if(F.col("etf")).alias("etf_count"),
        F.count_if(~F.col("found")).alias("missing_meta"),
    )

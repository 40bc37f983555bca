"""The supplied tables in the roles of the engine: ticks, flow, metadata, quotes, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import trade_side
from marketloom.operators.panel import calendar

N_NAMES = 64
# Customers per supplier in the supplied tables; maps order customers to symbols.
CUSTOMERS_PER_SYMBOL = 15


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_supplier() -> Column:
    return F.col("l_suppkey").cast("string")


def by_name() -> Column:
    """64 names, matching the 64 entries of an embedding."""
    return (F.col("l_partkey") % N_NAMES).cast("string")


def customer_supplier() -> Column:
    return F.floor(F.col("o_custkey") / CUSTOMERS_PER_SYMBOL).cast("string")


def customer_name() -> Column:
    return (F.col("o_custkey") % N_NAMES).cast("string")


def ticks(spark: SparkSession, sf: str, symbol: Column | None = None) -> DataFrame:
    """Line items as ticks. The order within a day is by value, then quantity: both fix the price."""
    li = table(spark, sf, "lineitem")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    qty = F.col("l_quantity").cast("bigint")
    return li.select(
        (by_supplier() if symbol is None else symbol).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (day * F.lit(1 << 40) + cents * 64 + qty).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        qty.alias("qty"),
        F.col("l_extendedprice").alias("val"),
        F.when(F.col("l_returnflag") == "R", "OUT")
        .when(F.col("l_returnflag") == "A", "IN")
        .alias("side"),
    )


def weeks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return calendar(li.select(F.trunc(F.col("l_shipdate").cast("date"), "week").alias("dt")))


def flow(spark: SparkSession, sf: str, symbol: Column | None = None) -> DataFrame:
    """Orders as institutional trades: F buys, O sells, P neither."""
    whole = F.floor("o_totalprice").cast("bigint")
    signed = F.when(F.col("o_orderstatus") == "F", whole).when(
        F.col("o_orderstatus") == "O", -whole
    )
    return (
        table(spark, sf, "orders")
        .select(
            (customer_supplier() if symbol is None else symbol).alias("symbol"),
            F.trunc(F.col("o_orderdate").cast("date"), "week").alias("dt"),
            F.coalesce(signed, F.lit(0)).alias("net"),
        )
        .groupBy("symbol", "dt")
        .agg(F.sum("net").alias("netbuy"))
    )


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("symbol"),
            F.when(F.col("s_suppkey") % 10 == 0, 100).otherwise(1000).alias("lot"),
            F.lit(1).alias("odd_lot_unit"),
            F.col("n_name").alias("industry"),
            F.col("r_name").alias("group"),
            F.when(F.col("s_suppkey") % 25 == 7, 0).otherwise(1).alias("tradable_flag"),
        )
    )


def quote_columns() -> list[Column]:
    """Events as quotes; the spread comes from the event's counter."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return [
        F.concat(F.lit("X"), F.col("user_id") % 3).alias("exchange"),
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (k * 0.5).alias("bid"),
        (k * 0.5 + 20).alias("ask"),
        k.alias("qty"),
    ]


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(*quote_columns())


def with_side(quotes: DataFrame) -> DataFrame:
    """Quotes as ticks."""
    side = trade_side(F.col("price"), F.col("bid"), F.col("ask"))
    return quotes.withColumns(
        {"side": side, "val": F.col("price").cast("decimal(18,2)") * F.col("qty")}
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as long-only portfolios: absolute entries over their sum, one row per name."""
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("cand_id"), e.alias("e"))
        .select("cand_id", total.alias("total"), F.posexplode("e").alias("i", "x"))
        .select("cand_id", F.col("i").cast("string").alias("symbol"), (F.col("x") / F.col("total")).alias("w"))
    )


def policy_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("state"),
        (F.col("user_id") % 8).cast("string").alias("action"),
        F.col("event_id").alias("ell"),
        (F.col("value") / 1000 - 0.05).alias("ret"),
    )


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """P[j | i, a] from the events: the counter of an event points at its next state."""
    k = F.get_json_object("props", "$.k").cast("int")
    states = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    counted = (
        table(spark, sf, "events")
        .select(
            F.col("event_type").alias("i"),
            (F.col("user_id") % 8).cast("string").alias("a"),
            F.get(states, k % 5).alias("j"),
        )
        .groupBy("i", "a", "j")
        .agg(F.count("*").alias("n"))
    )
    total = counted.groupBy("i", "a").agg(F.sum("n").alias("total"))
    return counted.join(total, ["i", "a"]).select("i", "a", "j", (F.col("n") / F.col("total")).alias("p"))


def occupation(spark: SparkSession, sf: str) -> DataFrame:
    """Occupation measure from the events; one state is left without any."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("state"), (F.col("user_id") % 8).cast("string").alias("action"))
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
        .select("state", "action", F.when(F.col("state") == "error", 0.0).otherwise(F.col("v")).alias("x"))
    )

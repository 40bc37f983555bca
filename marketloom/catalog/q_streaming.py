"""Queries: live quotes and bars, run as streams over the landed events until all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import roles
from marketloom.catalog.base import query, sql, view
from marketloom.operators.panel import bars
from marketloom.session import scratch_path
from marketloom.sources.ticks import QUOTE_SCHEMA, stream_quotes, subscribed
from marketloom.streaming import quotes as live
from marketloom.streaming import stateful


def quote_stream(spark, sf):
    """All quotes, landed as files of three spans of time, the newest first, read in three batches
    or so; ticks come far out of order."""
    path = scratch_path(spark, "landed")
    quotes = roles.quotes(spark, sf)
    first, second = quotes.agg(F.percentile_approx(F.unix_micros("ts"), [0.33, 0.67])).first()[0] or (0, 0)
    micros = F.unix_micros("ts")
    for part in (micros > second, (micros > first) & (micros <= second), micros <= first):
        quotes.where(part).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return stream_quotes(spark, path, QUOTE_SCHEMA, max_files=max(1, files // 3))


def finished(spark, changes, keys):
    """Run the stream to its end and read the keyed table; no row may have been late."""
    path, mark = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    q = live.run_to_table(changes, path, mark, keys=keys, compact_every=2)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if late := live.late_rows(q):
        raise ValueError(f"{late} rows came behind the watermark")
    return live.snapshot(spark, path, keys)


def subscriptions(spark, sf):
    """Two of the three exchanges, even symbols."""
    q = roles.quotes(spark, sf).where("exchange <> 'X2' AND CAST(symbol AS INT) % 2 = 0")
    return q.select("exchange", "symbol").distinct()


def totals_sql(source):
    return f"""SELECT symbol, CAST(sum(qty) AS BIGINT) AS "totalVolume",
      CAST(sum(CASE WHEN side = 'OUT' THEN qty ELSE 0 END) AS BIGINT) AS "outsideVolume",
      CAST(sum(CASE WHEN side = 'IN' THEN qty ELSE 0 END) AS BIGINT) AS "insideVolume",
      arg_max(price, seq) AS "lastPrice", arg_max(ts, seq) AS "lastTime", arg_max(bid, seq) AS "bestBid", arg_max(ask, seq) AS "bestAsk"
      FROM {source} GROUP BY symbol"""


_CHOSEN = "(SELECT * FROM sided WHERE exchange <> 'X2' AND CAST(symbol AS INTEGER) % 2 = 0)"



def _plain_time(df):
    return df.withColumn("lastTime", F.col("lastTime").cast("timestamp_ntz"))


@query("a15_quote_totals", sql(totals_sql("sided"), "sided"))
def a15(spark, sf):
    return _plain_time(live.quote_totals(roles.quotes(spark, sf)))


@query("t1_k8_stream_quote_totals", sql(totals_sql("sided"), "sided"))
def t1(spark, sf):
    return _plain_time(finished(spark, live.quote_totals(quote_stream(spark, sf)), ["symbol"]))


@query("t2_p19_stream_sides", sql(
    """SELECT symbol, coalesce(side, 'NONE') AS side, count(*) AS ticks, CAST(sum(qty) AS BIGINT) AS qty FROM sided GROUP BY 1, 2""", "sided"))  # fmt: skip
def t2(spark, sf):
    out = (
        live.sided(quote_stream(spark, sf))
        .groupBy("symbol", F.coalesce("side", F.lit("NONE")).alias("side"))
        .agg(F.count("*").alias("ticks"), F.sum("qty").alias("qty"))
    )
    return finished(spark, out, ["symbol", "side"])


@query("t4_j12_subscribed_totals", sql(totals_sql(_CHOSEN), "sided"))
def t4(spark, sf):
    chosen = subscribed(quote_stream(spark, sf), subscriptions(spark, sf))
    return _plain_time(finished(spark, live.quote_totals(chosen), ["symbol"]))


@query("s7_subscribed_stream", sql(
    f"SELECT exchange, symbol, count(*) AS ticks FROM {_CHOSEN} GROUP BY 1, 2", "sided"))
def s7(spark, sf):
    chosen = subscribed(quote_stream(spark, sf), subscriptions(spark, sf))
    counted = chosen.groupBy("exchange", "symbol").agg(F.count("*").alias("ticks"))
    return finished(spark, counted, ["exchange", "symbol"])


def bars_sql(unit):
    return f"""SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS dt, symbol, arg_min(price, seq) AS "O", max(price) AS "H", min(price) AS "L",
      arg_max(price, seq) AS "C", CAST(sum(qty) AS BIGINT) AS "V" FROM quotes GROUP BY 1, 2"""


for _unit in ("day", "week"):

    def _register(unit):
        @query(f"t3_stream_bars_{unit}", sql(bars_sql(unit), "quotes"))
        def run(spark, sf):
            return finished(spark, live.stream_bars(quote_stream(spark, sf), unit, None), ["dt", "symbol"])

    _register(_unit)


@query("t3_stream_bars_month", sql(bars_sql("month"), "quotes"))
def t3_month(spark, sf):
    """From the ticks; months stay open, as the newest ticks come first."""
    return finished(spark, stateful.month_bars(quote_stream(spark, sf), None), ["dt", "symbol"]).drop("closed")


# A moment of the feed's time.
_THIRD = "(SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * {k} // 3 FROM quotes)"
# Spans of the feed in order: thirds of the time, then the ticks of a few symbols that were held back.
_HELD = "CAST(symbol AS INTEGER) % 9 = 4"
_LATENESS_DAYS = 2
view(
    "feed",
    # A batch is judged by the watermark that its predecessor ran with: that of the first two spans for the last.
    f"""SELECT *, {_HELD} AND ts < (SELECT max(ts) FROM quotes WHERE NOT ({_HELD}) AND epoch_us(ts) <= {_THIRD.format(k=2)})
      - INTERVAL {_LATENESS_DAYS} DAY AS late FROM quotes""",
    "quotes",
)


def ordered_feed(spark, sf):
    """Quotes landed in order of time, in three batches, and a fourth with what was held back."""
    path = scratch_path(spark, "ordered")
    quotes = roles.quotes(spark, sf)
    micros, held = F.unix_micros("ts"), F.expr(_HELD.replace("INTEGER", "INT"))
    low, high = (x or 0 for x in quotes.agg(F.min(micros), F.max(micros)).first())
    first, second = low + (high - low) // 3, low + 2 * (high - low) // 3
    spans = ((micros <= first) & ~held, (micros > first) & (micros <= second) & ~held, (micros > second) & ~held, held)
    counts = []
    for span in spans:
        quotes.where(span).repartition(2).write.mode("append").parquet(path)
        counts.append(len(spark.read.parquet(path).inputFiles()) - sum(counts))
    if len(set(counts)) != 1:
        raise ValueError(f"batches of unequal numbers of files: {counts}")
    return stream_quotes(spark, path, QUOTE_SCHEMA, max_files=counts[0])


def month_stream(spark, sf):
    """The keyed table of month bars, and how many ticks came late."""
    path, mark = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    changes = stateful.month_bars(ordered_feed(spark, sf), f"{_LATENESS_DAYS} days")
    q = live.run_to_table(changes, path, mark, keys=["dt", "symbol"], compact_every=2)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return live.snapshot(spark, path, ["dt", "symbol"]), live.late_rows(q)


@query("t3_watermarked_months", sql(
    f"""SELECT *, dt + INTERVAL 1 MONTH <= (SELECT max(ts) FROM quotes) - INTERVAL {_LATENESS_DAYS} DAY AS closed
      FROM ({bars_sql("month").replace("FROM quotes", "FROM feed WHERE NOT late")})""", "feed", "quotes"))  # fmt: skip
def t3_watermarked(spark, sf):
    """Months close when the watermark passes their end; ticks behind it do not count."""
    return month_stream(spark, sf)[0]


@query("t3_late_ticks", sql("SELECT count(*) AS late FROM feed WHERE late", "feed"))
def t3_late(spark, sf):
    _, late = month_stream(spark, sf)
    return spark.range(1).select(F.lit(late).cast("long").alias("late"))


# Every symbol is subscribed at the first third of the time; odd ones are dropped at the second.


def control_stream(spark, sf):
    path = scratch_path(spark, "controls")
    quotes = roles.quotes(spark, sf)
    micros = F.unix_micros("ts")
    low, high = (x or 0 for x in quotes.agg(F.min(micros), F.max(micros)).first())
    names = quotes.select("exchange", "symbol").distinct()
    at = lambda k: F.timestamp_micros(F.lit(low + (high - low) * k // 3))
    on = names.select("*", at(1).alias("ts"), F.lit(True).alias("active"))
    off = names.where("CAST(symbol AS INT) % 2 = 1").select("*", at(2).alias("ts"), F.lit(False).alias("active"))
    on.unionByName(off).repartition(2).write.parquet(path)
    return spark.readStream.schema("exchange string, symbol string, ts timestamp, active boolean").parquet(path)


_SPAN = f"""epoch_us(ts) >= {_THIRD.format(k=1)} AND (CAST(symbol AS INTEGER) % 2 = 0 OR epoch_us(ts) < {_THIRD.format(k=2)})"""
view("spanned", f"SELECT *, {_SPAN} AS counted FROM sided", "sided", "quotes")


@query("t4_unsubscribed_midway", sql(
    """SELECT exchange, symbol, CAST(coalesce(sum(qty) FILTER (counted), 0) AS BIGINT) AS "totalVolume",
      CAST(coalesce(sum(qty) FILTER (counted AND side = 'OUT'), 0) AS BIGINT) AS "outsideVolume",
      CAST(coalesce(sum(qty) FILTER (counted AND side = 'IN'), 0) AS BIGINT) AS "insideVolume",
      arg_max(price, seq) FILTER (counted) AS "lastPrice", arg_max(ts, seq) FILTER (counted) AS "lastTime",
      arg_max(bid, seq) FILTER (counted) AS "bestBid", arg_max(ask, seq) FILTER (counted) AS "bestAsk",
      count(*) FILTER (counted) AS ticks, count(*) FILTER (NOT counted) AS ignored FROM spanned GROUP BY 1, 2""", "spanned"))  # fmt: skip
def t4_midway(spark, sf):
    """Subscriptions begin and end while the stream runs."""
    out = stateful.subscribed_totals(quote_stream(spark, sf), control_stream(spark, sf))
    return _plain_time(finished(spark, out, ["exchange", "symbol"]))


@query("p19_trade_side", sql("SELECT seq, symbol, side FROM sided", "sided"))
def p19(spark, sf):
    return live.sided(roles.quotes(spark, sf)).select("seq", "symbol", "side")


@query("a14_quote_bars", sql(
    """SELECT symbol, dt, "O", "H", "L", "C", CAST("V" AS DOUBLE) AS "V", inside_vol, outside_vol FROM (
      SELECT symbol, CAST(ts AS DATE) AS dt, arg_min(price, seq) AS "O", max(price) AS "H", min(price) AS "L", arg_max(price, seq) AS "C", sum(qty) AS "V",
        CAST(sum(CASE WHEN side = 'IN' THEN qty ELSE 0 END) AS DOUBLE) AS inside_vol, CAST(sum(CASE WHEN side = 'OUT' THEN qty ELSE 0 END) AS DOUBLE) AS outside_vol
      FROM sided GROUP BY 1, 2)""", "sided"))  # fmt: skip
def a14_quotes(spark, sf):
    return bars(roles.with_side(roles.quotes(spark, sf)), "day").drop("VAL")

"""Tick contract: symbol, ts, seq, price, qty, val, and optionally side, bid, ask.

``seq`` (BIGINT) orders the ticks of a symbol; two ticks may share it only at equal prices.
A single number as the order lets open and close be hash-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUOTE_SCHEMA = T.StructType(
    [
        T.StructField("exchange", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("qty", T.LongType()),
    ]
)


def stream_quotes(
    spark: SparkSession, path: str, schema: T.StructType = QUOTE_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """Landed quote files as a stream; for a broker use ``readStream.format('kafka')``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def subscribed(quotes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Keep the quotes of subscribed (exchange, symbol) pairs.

    Unsubscribing is an empty subscription table at the next start of the stream.
    """
    keys = [c for c in ("exchange", "symbol") if c in subscriptions.columns]
    return quotes.join(subscriptions.select(*keys).distinct(), keys, "left_semi")

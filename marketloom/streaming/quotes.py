"""Live quotes and bars.

Every micro-batch writes the changed keys under its batch number and replaces them if the batch
is run again, so a restart leaves no trace. Every few batches these are merged into one row per key;
what a merge replaces goes with the next one. Only folders written to the end count. A snapshot takes the newest state of each key.
State per key is one row. With a watermark, bars leave the state once it has passed them, and what
comes later is lost; ``late_rows`` counts that.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.functions.scalars import trade_side

# Weeks start on Monday; the epoch was a Thursday.
_WINDOWS = {"day": ("1 day", "1 day", "0 days"), "week": ("1 week", "1 week", "4 days")}


def sided(quotes: DataFrame) -> DataFrame:
    """T2, P19."""
    return quotes.withColumn("side", trade_side(F.col("price"), F.col("bid"), F.col("ask")))


def quote_totals(quotes: DataFrame) -> DataFrame:
    """Running totals, last trade and best quotes per symbol; batch or stream.

    ``seq`` orders the ticks; among ticks of one instant the later one counts.
    """
    qty = F.col("qty")
    return (
        sided(quotes)
        .groupBy("symbol")
        .agg(
            F.sum("qty").alias("totalVolume"),
            F.sum(F.when(F.col("side") == "OUT", qty).otherwise(0)).alias("outsideVolume"),
            F.sum(F.when(F.col("side") == "IN", qty).otherwise(0)).alias("insideVolume"),
            F.max_by("price", "seq").alias("lastPrice"),
            F.max_by("ts", "seq").alias("lastTime"),
            F.max_by("bid", "seq").alias("bestBid"),
            F.max_by("ask", "seq").alias("bestAsk"),
        )
    )


def stream_bars(quotes: DataFrame, unit: str = "day", lateness: str | None = "1 hour") -> DataFrame:
    """Day or week bars on the stream. The watermark is ours; it bounds the state.

    ``lateness`` must cover how far ticks come out of order. None sets no watermark: nothing is ever
    late, and the state keeps one row per bar; so for landed files in any order. Months vary in length: re-aggregate day bars with ``months_from_days``.
    """
    length, slide, start = _WINDOWS[unit]
    when = F.window("ts", length, slide, start)
    timed = quotes if lateness is None else quotes.withWatermark("ts", lateness)
    return (
        timed.groupBy(when.alias("_w"), "symbol")
        .agg(
            F.min_by("price", "seq").alias("O"),
            F.max("price").alias("H"),
            F.min("price").alias("L"),
            F.max_by("price", "seq").alias("C"),
            F.sum("qty").alias("V"),
        )
        .select(F.col("_w.start").cast("date").alias("dt"), "symbol", "O", "H", "L", "C", "V")
    )


def months_from_days(days: DataFrame) -> DataFrame:
    """Month bars from day bars."""
    return (
        days.groupBy("symbol", F.trunc("dt", "month").alias("dt"))
        .agg(
            F.min_by("O", "dt").alias("O"),
            F.max("H").alias("H"),
            F.min("L").alias("L"),
            F.max_by("C", "dt").alias("C"),
            F.sum("V").alias("V"),
        )
        .select("dt", "symbol", "O", "H", "L", "C", "V")
    )


def _folders(spark: SparkSession, path: str) -> tuple[dict[int, str], dict[int, str]]:
    """Folders of batches and of merges that are written to the end, by batch number."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"batch": {}, "merged": {}}
    for status in fs.listStatus(hadoop) if fs.exists(hadoop) else ():
        kind, _, number = status.getPath().getName().partition("=")
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if kind in found and fs.exists(done):
            found[kind][int(number)] = status.getPath().toString()
    return found["batch"], found["merged"]


def _remove(spark: SparkSession, folders: Iterable[str]) -> None:
    for f in folders:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def compact(spark: SparkSession, path: str, keys: Sequence[str], number: int) -> None:
    """K8: merge all up to batch ``number`` into ``path/merged=<number>``, then remove what went into the merge before.

    A merge counts once it is complete; run again after a failure, it changes nothing. The merge before and the batches
    since then stay until the next one, so that a reader who has planned on them can finish.
    """
    batches, merged = _folders(spark, path)
    if number not in merged:
        snapshot(spark, path, keys).write.mode("overwrite").parquet(f"{path}/merged={number}")
    last = max((n for n in merged if n < number), default=-1)
    old = [f for n, f in batches.items() if n <= last] + [f for n, f in merged.items() if n < last]
    _remove(spark, old)


def run_to_table(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    keys: Sequence[str] = (),
    compact_every: int = 20,
) -> StreamingQuery:
    """K8: start the stream; changed keys go to ``path/batch=<n>``.

    With ``keys``, every ``compact_every`` batches are merged, so the table keeps two merges of one row per key and
    at most twice so many batches.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if keys and (number + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys, number)

    writer = (
        changes.writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were not counted, over the reported batches."""
    return sum(
        s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"]
    )


def snapshot(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """K8: the newest state of each key, from the last merge and the batches after it."""
    batches, merged = _folders(spark, path)
    last = max(merged, default=-1)
    parts = [
        spark.read.parquet(f).withColumn("batch", F.lit(n))
        for n, f in sorted(batches.items())
        if n > last
    ]
    if merged:
        parts.append(spark.read.parquet(merged[last]).withColumn("batch", F.lit(last)))
    if not parts:
        raise ValueError(f"no batch in {path} yet")
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    state = [c for c in log.columns if c not in (*keys, "batch")]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*state), "batch").alias("_s"))
        .select(*keys, "_s.*")
    )

"""Row numbers over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.session import stage

# Layout of monotonically_increasing_id: partition number above, row of the partition below.
_ROW_BITS = 33


def with_row_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """0-based position in the given order.

    A range-partitioned sort is written with partition and row numbers; the number of rows of
    each partition then gives its offset. Written first, so a re-run task cannot move rows.
    """
    ordered = stage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", _ROW_BITS)
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per sort partition.
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_id", "_part", "_offset")
    )

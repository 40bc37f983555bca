"""File sinks: flow and metadata tables, matrix and vector sheets, bars as JSON, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketloom.functions.indexing import with_row_index
from marketloom.functions.scalars import finite_or_zero
from marketloom.session import stage

FLOW_HEADER = ("date", "symbol", "broker_netbuy_topk")
META_HEADER = ("symbol", "lot", "odd_lot_unit", "industry", "group", "tradable_flag")


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def flow_rows(flow: DataFrame) -> DataFrame:
    """K1: the written columns; the date keeps its input spelling. Sorted by real date."""
    return flow.orderBy("dt", "symbol").select(
        "date", "symbol", F.col("netbuy").alias("broker_netbuy_topk")
    )


def write_flow(flow: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(flow_rows(flow), path, fmt)


def metadata_rows(meta: DataFrame) -> DataFrame:
    """K2: the written columns, sorted by symbol. Text with commas is quoted in CSV."""
    return meta.orderBy("symbol").select(*META_HEADER)


def write_metadata(meta: DataFrame, path: str, fmt: str = "parquet") -> Observation:
    """K2 with K6: the counters come with the write, without a second pass.

    They sit behind the sort, whose sampling reads its input once more.
    """
    seen = Observation("metadata")
    observed = meta.orderBy("symbol").observe(
        seen,
        F.count(F.lit(1)).alias("rows_written"),
        F.count_if(F.col("etf")).alias("etf_count"),
        F.count_if(~F.col("found")).alias("missing_meta"),
    )
    _write(observed.select(*META_HEADER), path, fmt)
    return seen


def default_labels(prefix: str, n: int) -> list[str]:
    """K5: C0, C1, ... for columns."""
    return [f"{prefix}{i}" for i in range(n)]


def default_label(prefix: str, index: Column) -> Column:
    """K5 for rows."""
    return F.concat(F.lit(prefix), index)


def matrix_sheet(cells: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """K3: one row per ``row`` label and one column for each label of ``columns``; non-finite is 0.

    Other labels are left out; of several values of one cell the largest stays. For all labels, however many,
    see ``matrix_lines``.
    """
    wide = cells.groupBy(row).pivot(column, list(columns)).agg(F.max(value))
    return wide.select(row, *[finite_or_zero(F.col(f"`{c}`")).alias(c) for c in columns])


def dense_rows(cells: DataFrame, row: str, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """K3 with any number of labels: (``index``, ``label``) of the columns in order, and (``row``, ``cells``), one dense
    array for each row label. Non-finite and missing are 0; of several values of one cell the largest stays. Rows and
    columns without a label are left out."""
    known = cells.select(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("label"), F.col(value).alias("x")).where(
        "row IS NOT NULL AND label IS NOT NULL"
    )
    labels = stage(with_row_index(known.select("label").distinct(), "label"), "labels")
    n = labels.count()
    entry = F.struct(F.col("index").alias("i"), F.col("x").alias("x"))
    filled = known.join(labels, "label").groupBy("row", "index").agg(finite_or_zero(F.max("x")).alias("x"))
    listed = filled.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    # Zeros up to each entry, the entry, and zeros after the last one.
    before = F.transform("e", lambda e, k: e["i"] - F.when(k > 0, F.col("e")[k - 1]["i"] + 1).otherwise(0))
    gaps = listed.withColumn("g", before)
    parts = F.transform(
        F.arrays_zip("g", "e"), lambda z: F.concat(F.array_repeat(F.lit(0.0), z["g"].cast("int")), F.array(z["e"]["x"].cast("double")))
    )
    tail = F.array_repeat(F.lit(0.0), (F.lit(n - 1) - F.element_at("e", -1)["i"]).cast("int"))
    return labels.select("index", "label"), gaps.select("row", F.concat(F.flatten(parts), tail).alias("cells"))


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def matrix_lines(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """K3 as the lines of one CSV sheet (``line``), header first, rows by label. No label passes through the driver."""
    labels, rows = dense_rows(cells, row, column, value)
    names = F.transform(F.sort_array(F.collect_list(F.struct("index", "label"))), lambda e: _quoted(e["label"]))
    header = labels.agg(F.array_join(F.concat(F.array(F.lit(row)), names), ",").alias("line"))
    body = rows.select(
        F.lit(1).alias("kind"), F.col("row").alias("at"),
        F.array_join(F.concat(F.array(_quoted(F.col("row"))), F.col("cells").cast("array<string>")), ",").alias("line"),
    )
    return header.select(F.lit(0).alias("kind"), F.lit("").alias("at"), "line").unionByName(body).orderBy("kind", "at").select("line")


def write_matrix(cells: DataFrame, row: str, column: str, value: str, path: str) -> None:
    """K3: the sheet as text files; read in order of their names they are the sheet."""
    matrix_lines(cells, row, column, value).write.mode("overwrite").text(path)


def vector_sheet(df: DataFrame, value: str, *order: str, keep_whole: bool = False) -> DataFrame:
    """K4: (index, value) in the given order; non-finite is 0, whole numbers pass as they are."""
    out = with_row_index(df, *order)
    return out.select("index", (F.col(value) if keep_whole else finite_or_zero(F.col(value))).alias("value"))


def write_sheet(sheet: DataFrame, path: str) -> None:
    _write(sheet, path, "csv")


def kline_json(bars: DataFrame) -> DataFrame:
    """K7: all bars of a symbol as one JSON text, oldest first; as long as the calendar."""
    bar = F.struct(F.col("dt"), *[F.col(c) for c in ("O", "H", "L", "C", "V")])
    return bars.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(bar))).alias("kline"))

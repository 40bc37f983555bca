"""CSV scans: daily prices (S1), institutional flow (S2), security metadata (S3), line split.

Columns are found by trimmed, case-insensitive header name. Only named columns are read on,
so the reader prunes the rest.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import finite, header_key, or_unknown, to_date, trim_all
from marketloom.session import stage

_MOST_HEADERS = 10_000
_FIELD = '((?:[^",]++|"[^"]*+")*+),'

DAILY_REQUIRED = ("date", "symbol", "o", "h", "l", "c", "v", "val")
DAILY_OPTIONAL = ("inside_vol", "outside_vol", "adj_close")
# Spelling of the panel columns; Spark resolves names without regard to case anyway.
_DAILY_NAMES = {"o": "O", "h": "H", "l": "L", "c": "C", "v": "V", "val": "VAL"}


def split_csv_line(line: Column) -> Column:
    """Split at commas outside quotes; a quote toggles anywhere and is itself dropped.

    An open quote runs to the end of the line. There is no doubled-quote escape.
    """
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    closed = F.when(quotes % 2 == 1, F.concat(line, F.lit('"'))).otherwise(line)
    fields = F.regexp_extract_all(F.concat(closed, F.lit(",")), F.lit(_FIELD), F.lit(1))
    return F.transform(fields, lambda f: F.replace(f, F.lit('"'), F.lit("")))


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line``: the first line of every file that has one. Tasks find them where a file begins."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.struct(F.monotonically_increasing_id().alias("i"), "value").alias("first"),
    )
    firsts = lines.where("start = 0").groupBy("file").agg(F.min("first").alias("first"))
    return firsts.select("file", F.regexp_replace("first.value", "^\ufeff|\r$", "").alias("line"))


def _toggled(line: str) -> list[str]:
    """S4 for one header line."""
    cells, quoted = [""], False
    for c in line.rstrip("\r"):
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            cells.append("")
        else:
            cells[-1] += c
    return cells


def _cells(spark: SparkSession, path: str, width: int, toggle_quotes: bool) -> DataFrame:
    """Rows of all files as text cells ``_0, _1, ...`` with their ``file``; header rows only with ``toggle_quotes``."""
    file = F.col("_metadata.file_path").alias("file")
    if toggle_quotes:
        lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"), file)
        cut = lines.where(trim_all(F.col("value")) != "").select("file", "value", split_csv_line(F.col("value")).alias("c"))
        return cut.select("file", "value", *[F.get("c", F.lit(i)).alias(f"_{i}") for i in range(width)])
    schema = ", ".join(f"_{i} string" for i in range(width))
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    return reader.csv(path).select(*[f"_{i}" for i in range(width)], file)


def read_named_csv(spark: SparkSession, path: str, toggle_quotes: bool = False) -> DataFrame:
    """All columns as text under their normalised names; the first of two equal names wins.

    Every file goes by its own header, so column order and columns may differ between the files of a
    folder; a column that a file lacks is NULL there. ``toggle_quotes`` reads lines and applies S4,
    for files whose quotes open inside a field.

    The headers are found by tasks; the driver sees the distinct ones, 10,000 at most, and no list of files. A folder with
    one header is read as it is; else each row takes its file's header from a join.
    """
    found = stage(header_lines(spark, path), "headers")
    lines = sorted(r.line for r in found.select("line").distinct().limit(_MOST_HEADERS + 1).collect())
    if not lines:
        raise ValueError(f"no header in {path}")
    if len(lines) > _MOST_HEADERS:
        raise ValueError(f"more than {_MOST_HEADERS} different headers in {path}")
    places: dict[str, dict[str, int]] = {}
    for line in lines:
        at: dict[str, int] = {}
        for i, name in enumerate(_toggled(line) if toggle_quotes else next(csv.reader([line]), [])):
            at.setdefault(header_key(name), i)
        places[line] = {k: i for k, i in at.items() if k}
    width = max((i + 1 for at in places.values() for i in at.values()), default=1)
    rows = _cells(spark, path, width, toggle_quotes)
    rows = rows.withColumn("line", F.lit(lines[0])) if len(lines) == 1 else rows.join(found, "file")
    if toggle_quotes:  # the header comes back as a row in every file
        rows = rows.where("value <> line")
    names = dict.fromkeys(k for at in places.values() for k in at)

    def column(name: str) -> Column:
        by_place: dict[int, list[str]] = {}
        for line, at in places.items():
            if name in at:
                by_place.setdefault(at[name], []).append(line)
        if len(by_place) == 1 and len(lines) == 1:
            return F.col(f"_{next(iter(by_place))}")
        return F.coalesce(*[F.when(F.col("line").isin(of), F.col(f"_{i}")) for i, of in by_place.items()])

    return rows.select(*[column(name).alias(name) for name in names])


def _number(name: str) -> Column:
    return finite(F.replace(trim_all(F.col(name)), F.lit(","), F.lit("")).try_cast("double"))


def _require(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_daily(spark: SparkSession, path: str, toggle_quotes: bool = False) -> DataFrame:
    """S1 with P10: dated rows with a symbol; absent optional columns are NULL."""
    raw = read_named_csv(spark, path, toggle_quotes)
    _require(raw, DAILY_REQUIRED)
    numbers = [
        (_number(n) if n in raw.columns else F.lit(None).cast("double")).alias(
            _DAILY_NAMES.get(n, n)
        )
        for n in (*DAILY_REQUIRED[2:], *DAILY_OPTIONAL)
    ]
    return raw.select(
        to_date(F.col("date")).alias("dt"),
        trim_all(F.col("date")).alias("date_text"),
        trim_all(F.col("symbol")).alias("symbol"),
        *numbers,
    ).where("symbol <> '' AND dt IS NOT NULL")


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """Net buying as given, or buying minus selling."""
    raw = read_named_csv(spark, path)
    _require(raw, ("date", "symbol"))

    def whole(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast("bigint")
        return trim_all(F.col(name)).try_cast("bigint")

    net = F.coalesce(
        whole("broker_netbuy_topk"), whole("broker_buy_topk") - whole("broker_sell_topk")
    )
    return raw.select(
        to_date(F.col("date")).alias("dt"),
        trim_all(F.col("symbol")).alias("symbol"),
        net.alias("netbuy"),
    ).where("symbol <> '' AND dt IS NOT NULL")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``lot`` and ``lot_size`` are one column; every missing value has a default."""
    raw = read_named_csv(spark, path)
    _require(raw, ("symbol",))

    def text(name: str) -> Column:
        return trim_all(F.col(name)) if name in raw.columns else F.lit(None).cast("string")

    def whole(*names: str) -> Column:
        return F.coalesce(*[text(n).try_cast("int") for n in names], F.lit(1))

    return raw.select(
        text("symbol").alias("symbol"),
        whole("lot", "lot_size").alias("lot"),
        whole("odd_lot_unit").alias("odd_lot_unit"),
        or_unknown(text("industry")).alias("industry"),
        or_unknown(text("group")).alias("group"),
        whole("tradable_flag").alias("tradable_flag"),
    ).where("symbol <> ''")

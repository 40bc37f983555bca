"""Landed JSON responses: institutional trades (S5) and the list of companies.

Cells keep their JSON type (VARIANT), because string and number cells mean different things.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import first_text, whole_number

# Field names of the company list.
CODE_KEYS = ("公司代號", "有價證券代號")
MARKET_KEYS = ("市場別", "上市別")
INDUSTRY_KEY = "產業別"
SECURITY_TYPE_KEY = "有價證券別"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file; partition folders such as ``date=20240102`` become columns."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body")


def trading_day_rows(responses: DataFrame, *keys: str) -> DataFrame:
    """Rows of responses whose status is OK, with their position and first cell.

    Broken JSON, other statuses, absent data, rows that are no arrays or shorter than three
    cells yield nothing. ``code`` is NULL where the first cell is no string.
    """
    doc = F.try_parse_json("body")
    open_days = responses.select(*keys, doc.alias("doc")).where(
        F.schema_of_variant(F.try_variant_get("doc", "$.stat", "variant")).eqNullSafe("STRING")
        & F.try_variant_get("doc", "$.stat", "string").eqNullSafe("OK")
    )
    items = open_days.select(
        *keys,
        F.posexplode(F.try_variant_get("doc", "$.data", "array<variant>")).alias("pos", "item"),
    )
    cells = F.try_variant_get("item", "$", "array<variant>")
    return (
        items.select(*keys, "pos", cells.alias("cells"))
        .where("size(cells) >= 3")
        .withColumn("code", _text(F.col("cells")[0]))
    )


def response_counts(responses: DataFrame, *keys: str) -> DataFrame:
    """Q1: what ``trading_day_rows`` takes and what it sets aside, per key or in all.

    ``responses``; of these ``broken`` (no JSON), ``not_ok`` (another status or none) and ``no_data``;
    ``rows`` of the others, of these ``short_rows`` (no array of three cells) and ``codeless_rows``.
    """
    doc = F.try_parse_json("body")
    stat = F.try_variant_get("doc", "$.stat", "variant")
    ok = F.coalesce(
        (F.schema_of_variant(stat) == "STRING") & (F.try_variant_get("doc", "$.stat", "string") == "OK"), F.lit(False)
    )
    cells = F.transform("data", lambda v: F.try_variant_get(v, "$", "array<variant>"))
    long = F.filter("cells", lambda c: F.coalesce(F.size(c), F.lit(0)) >= 3)
    codeless = F.filter(long, lambda c: ~F.coalesce(F.schema_of_variant(c[0]) == "STRING", F.lit(False)))
    each = (
        responses.select(*keys, doc.alias("doc"))
        .withColumn("ok", ok)
        .withColumn("data", F.when(F.col("ok"), F.try_variant_get("doc", "$.data", "array<variant>")))
        .withColumn("cells", cells)
    )

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("data").isNotNull(), c)), F.lit(0))

    return each.groupBy(*keys).agg(
        F.count("*").alias("responses"),
        F.count_if(F.col("doc").isNull()).alias("broken"),
        F.count_if(F.col("doc").isNotNull() & ~F.col("ok")).alias("not_ok"),
        F.count_if(F.col("ok") & F.col("data").isNull()).alias("no_data"),
        total(F.size("cells")).alias("rows"),
        total(F.size("cells") - F.size(long)).alias("short_rows"),
        total(F.size(codeless)).alias("codeless_rows"),
    )


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def rightmost_amount(cells: Column) -> Column:
    """The last string cell past the second, read as a whole number; 0 without one."""
    tail = F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0)))
    texts = F.filter(tail, lambda v: F.schema_of_variant(v) == "STRING")
    return whole_number(F.coalesce(F.try_element_at(texts, F.lit(-1)).cast("string"), F.lit("")))


def read_companies(responses: DataFrame, *keys: str) -> DataFrame:
    """S6 with P9: (pos, code, industry, market, sec_type); rows without a code are skipped.

    ``keys`` (a page or file number) come first; over several pages they tell which row is last.
    """
    items = responses.select(
        *keys,
        F.posexplode(
            F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
        ).alias("pos", "item")
    )

    def field(key: str) -> Column:
        return _text(F.try_variant_get("item", f"$['{key}']", "variant"))

    return items.select(
        *keys,
        "pos",
        first_text(*map(field, CODE_KEYS)).alias("code"),
        F.coalesce(field(INDUSTRY_KEY), F.lit("")).alias("industry"),
        F.coalesce(first_text(*map(field, MARKET_KEYS)), F.lit("")).alias("market"),
        F.coalesce(field(SECURITY_TYPE_KEY), F.lit("")).alias("sec_type"),
    ).where("code IS NOT NULL")


def last_per_code(rows: DataFrame, *keys: str, value: Column, pages: tuple[str, ...] = ()) -> DataFrame:
    """A2: the last row of a code wins: in the last of the ``pages``, if there are several, there by
    position."""
    return rows.groupBy(*keys, "code").agg(F.max_by(value, F.struct(*pages, "pos")).alias("value"))

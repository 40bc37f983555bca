"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import stage

SPACES = " \t\n\x0b\f\r"
"""The characters of ``[\\x20\\x09-\\x0D]``; also what ``bytes.split()`` and ``bytes.strip()`` take."""

WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z only; ``lower`` would change other alphabets too."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_of(name: str) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(c: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: two hashes with different seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def packed(df: DataFrame, name: str = "__row") -> DataFrame:
    """All columns as one struct, so that no column of the caller can clash with added ones."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Texts go to Python in batches of at most so many megabytes.

    The default of 64 is held several times over, in the JVM and in Python, by every running task: a
    large part of a small executor. Only ever lowers the session's setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key)
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size.lower().rstrip("b")[-1:], 1)
    now = int("".join(c for c in size if c.isdigit() or c == "-")) * unit
    if now <= 0 or now > megabytes << 20:
        spark.conf.set(key, f"{megabytes}m")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["SPACES", "WORD", "ascii_lower", "bounded_batches", "fold", "packed", "read", "stage", "text_key", "text_of"]

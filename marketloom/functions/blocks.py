"""Blocks of keys for products of large matrices.

A pair result (covariance, quadratic form) is cut into pairs of blocks of a set size. Each task
multiplies two blocks at a time: it reads them from the table of blocks, a row each, so the shuffle
does not grow with the number of pairs; no task holds more than its blocks, and no key is larger than another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_count(df: DataFrame, key: str, size: int) -> int:
    """Number of blocks for about ``size`` distinct keys each; costs one aggregation."""
    n = df.agg(F.approx_count_distinct(key)).first()[0]
    return max(1, math.ceil(n / size))


def block_of(key: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def paired(df: DataFrame, block: str, n_blocks: int) -> DataFrame:
    """The pairs of rows of a table with a row for each block: columns ``bi`` <= ``bj``, and ``left`` and ``right`` with
    the other columns of either row. A nested loop over the partitions of the table, which should be staged: tasks read it
    again for each partner, and nothing is shuffled."""
    held = F.struct(*[c for c in df.columns if c != block])
    if n_blocks == 1:
        return df.select(F.col(block).alias("bi"), F.col(block).alias("bj"), held.alias("left"), held.alias("right"))
    left, right = df.select(F.col(block).alias("bi"), held.alias("left")), df.select(F.col(block).alias("bj"), held.alias("right"))
    return left.join(right.hint("shuffle_replicate_nl"), F.col("bi") <= F.col("bj")).select("bi", "bj", "left", "right")

"""Exact quantiles per group without gathering a large group.

The built-in ``percentile`` keeps every distinct value of a group in one task. That is the
quickest way as long as no group is large, which is counted first. For larger groups a mergeable
sketch gives a narrow bracket around each wanted rank. One more pass then counts the rows
between the brackets (collapsed to a counter on the map side) and keeps single values only
inside them. Ranks come out exact; a group holding a third of all rows is just more input to
the map-side counters, as the brackets are brought to the rows: by broadcast up to a checked
number of groups, by a salted join beyond it. Both passes read ``df``, so hand in a staged table.

Both ways give the same rows: one per group, NULL keys and groups of NULLs only included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.session import stage

SKETCH_ACCURACY = 10_000
# Half-width of a bracket, in shares of the group; twice the error the sketch guarantees.
BRACKET = 2.0 / SKETCH_ACCURACY
# Doubles in a table of brackets that may be broadcast (64 MB); beyond, rows are salted.
BROADCAST_DOUBLES = 8_000_000
SALTS = 32
# Largest group for the built-in: a task holds 128 groups of such values at most.
SMALL_GROUP = 10_000


def same_keys(by: Sequence[str], left: str, right: str) -> Column:
    """Equal group keys; NULL is a key like any other. No keys: one group."""
    out = F.lit(True)
    for k in by:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _with_edges(
    df: DataFrame, edges: DataFrame, by: Sequence[str], size: int, limit: int
) -> DataFrame:
    """Each row with its group's brackets; rows are never shuffled on the group key alone."""
    if not by or edges.count() * size <= limit:
        joined = df.alias("d").join(F.broadcast(edges).alias("e"), same_keys(by, "d", "e"))
        return joined.select("d.*", *[F.col(f"e.{c}") for c in edges.columns if c not in by])
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.alias("d").join(copies.alias("e"), same_keys([*by, "_salt"], "d", "e"))
    return joined.select("d.*", *[F.col(f"e.{c}") for c in edges.columns if c not in by]).drop("_salt")


def _zones(
    df: DataFrame, edges: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], limit: int
) -> DataFrame:
    """(by, name, zone, first, last, n, total): bracketed values and the gaps between them."""
    cuts = _cuts(probs)
    melted = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("name"), F.col(c).alias("x"), F.col(f"_e_{c}").alias("e"))
                for c in cols
            ]
        )
    )
    long = (
        _with_edges(df.select(*by, *cols), edges, by, len(cuts) * len(cols), limit)
        .select(*by, melted.alias("m"))
        .select(*by, "m.name", "m.x", "m.e")
        .where("x IS NOT NULL")
    )
    brackets = [
        (
            cuts.index(min(max(p - BRACKET, 0.0), 1.0)),
            cuts.index(min(max(p + BRACKET, 0.0), 1.0)),
        )
        for p in sorted(probs)
    ]
    inside, gap = F.lit(False), F.lit(0)
    for lo, hi in brackets:
        inside = inside | F.col("x").between(F.col("e")[lo], F.col("e")[hi])
        gap = gap + F.when(F.col("x") > F.col("e")[hi], 1).otherwise(0)
    return (
        long.withColumn("value", F.when(inside, F.col("x")))
        .withColumn("gap", F.when(inside, F.lit(-1)).otherwise(gap))
        .groupBy(*by, "name", "gap", "value")
        .agg(
            F.min("x").alias("first"),
            F.max("x").alias("last"),
            F.count("x").alias("n"),
            F.sum("x").alias("total"),
        )
    )


def _cuts(probs: Sequence[float]) -> list[float]:
    return sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-BRACKET, BRACKET)})


def _edges(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per group: brackets around the wanted ranks of each column, from a sketch."""
    cuts = _cuts(probs)
    return stage(
        df.groupBy(*by).agg(
            *[F.percentile_approx(c, cuts, SKETCH_ACCURACY).alias(f"_e_{c}") for c in cols]
        ),
        "edges",
    )


def _ranked(zones: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "name"]
    order = Window.partitionBy(*keys).orderBy("first")
    return zones.withColumn(
        "upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("size", F.sum("n").over(Window.partitionBy(*keys)))


def _value_at(rank: Column) -> Column:
    """The value of 0-based ``rank``, taken from the zone that covers it, else NULL.

    A gap knows its first and its last value only. The sketch's guarantee leaves no rank
    further inside a gap; should one ever be, the job stops instead of guessing.
    """
    start = F.col("upto") - F.col("n")
    at_first = (rank == start) | (F.col("first") == F.col("last"))
    value = (
        F.when(at_first, F.col("first"))
        .when(rank == F.col("upto") - 1, F.col("last"))
        .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
    )
    return F.max(F.when((rank >= start) & (rank < F.col("upto")), value))


def _quantile(p: float) -> Column:
    """Linear interpolation between the two neighbouring ranks of p * (n - 1)."""
    position = F.lit(float(p)) * (F.col("size") - 1)
    low, high = _value_at(F.floor(position)), _value_at(F.ceil(position))
    weight = F.max(position - F.floor(position))
    return low + (high - low) * weight


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    keep: Callable[[DataFrame], DataFrame] = lambda d: d,
    small_group: int = SMALL_GROUP,
    broadcast_doubles: int = BROADCAST_DOUBLES,
) -> DataFrame:
    """One row per group; column ``<c>_q`` is the array of quantiles of ``c`` in ``probs`` order.

    NULLs are left out, and a column of NULLs only gives NULL; NaN must be NULL already. The largest
    group is counted up front; it decides how the work is done, not what comes out. ``keep`` is
    accepted for the caller's sake; the size of the brackets is checked here.
    """
    probs = [float(p) for p in probs]
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= small_group:
        return df.groupBy(*by).agg(*[F.percentile(c, probs).alias(f"{c}_q") for c in cols])
    edges = _edges(df, by, cols, probs)
    ranked = _ranked(_zones(df, edges, by, cols, probs, broadcast_doubles), by)
    per_name = ranked.groupBy(*by, "name").agg(
        F.array(*[_quantile(p) for p in probs]).alias("q")
    )
    found = per_name.groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"{c}_q") for c in cols]
    )
    # Groups without any value have no zone.
    return (
        edges.select(*by).alias("d").join(found.alias("e"), same_keys(by, "d", "e"), "left")
        .select("d.*", *[F.col(f"e.{c}_q") for c in cols])
        if by
        else found
    )


def tail_mean(
    df: DataFrame,
    by: Sequence[str],
    loss: str,
    alpha: float,
    keep: Callable[[DataFrame], DataFrame] = lambda d: d,
    broadcast_doubles: int = BROADCAST_DOUBLES,
) -> DataFrame:
    """A9 (ours): value at risk (alpha quantile of loss) and mean of the losses at or above it.

    The zone counters carry sums, so the tail needs no third pass over the samples. They are
    staged: the quantile and the tail both read them.
    """
    edges = _edges(df, by, [loss], [float(alpha)])
    zones = _zones(df, edges, by, [loss], [float(alpha)], broadcast_doubles)
    ranked = _ranked(stage(zones, "zones"), by)
    var = ranked.groupBy(*by).agg(_quantile(alpha).alias("var"))
    # Two rows or so per bracketed value: both sides of this join are counters, not samples.
    tail = ranked.join(var, list(by)).where(F.col("last") >= F.col("var"))
    edge = (F.col("first") < F.col("var")) & (F.col("gap") >= 0)
    n = F.when(edge, F.lit(1)).otherwise(F.col("n"))
    total = F.when(edge, F.col("last")).otherwise(F.col("total"))
    return tail.groupBy(*by).agg(
        F.max("size").alias("n"),
        F.max("var").alias("var"),
        (F.sum(total) / F.sum(n)).alias("cvar"),
    )

"""Bars, dense panel, cleaning.

One shuffle by (symbol, dt) for the bars, one by symbol for everything ordered in time. After
the bars a symbol has one row per date, so a symbol's window is as long as the calendar and
no longer, however many ticks it had.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import PANEL_FIELDS, PRICE_FIELDS, CleanConfig
from marketloom.functions.scalars import finite, safe_div
from marketloom.session import by_date

# Cells of the dense panel that a task sorts and holds in its windows, about a kilobyte each.
CELLS_PER_TASK = 250_000
# Below, more tasks only cost time.
FEWEST_CELLS = 20_000

_UNITS = {"day": None, "week": "week", "month": "month"}


def in_time() -> Window:
    return Window.partitionBy("symbol").orderBy("t")


def bar_date(ts: Column, unit: str) -> Column:
    if unit not in _UNITS:
        raise ValueError(f"unit must be one of {sorted(_UNITS)}, got {unit!r}")
    day = ts.cast("date")
    return day if unit == "day" else F.trunc(day, _UNITS[unit])


def bar_columns() -> list[Column]:
    qty = F.col("qty")
    return [
        F.min_by("price", "seq").alias("O"),
        F.max("price").alias("H"),
        F.min("price").alias("L"),
        F.max_by("price", "seq").alias("C"),
        F.sum("qty").cast("double").alias("V"),
        F.sum("val").cast("double").alias("VAL"),
        F.sum(F.when(F.col("side") == "IN", qty).otherwise(0)).cast("double").alias("inside_vol"),
        F.sum(F.when(F.col("side") == "OUT", qty).otherwise(0)).cast("double").alias("outside_vol"),
    ]


def bars(ticks: DataFrame, unit: str = "day") -> DataFrame:
    """OHLCV per symbol and day, week (from Monday) or month.

    All buffers are fixed-width, so ticks are hash-aggregated before the shuffle and a hot
    symbol costs its task one row per date.
    """
    return (
        ticks.withColumn("dt", bar_date(F.col("ts"), unit))
        .groupBy("symbol", "dt")
        .agg(*bar_columns())
    )


def calendar(days: DataFrame) -> DataFrame:
    """Dense ordinal ``t`` (from 0) per distinct date, and the number of dates.

    The window has no partition: it runs over distinct dates only.
    """
    return (
        days.select("dt")
        .where("dt IS NOT NULL")
        .distinct()
        .select(
            "dt",
            (F.row_number().over(Window.orderBy("dt")) - 1).alias("t"),
            F.count("*").over(Window.partitionBy()).cast("int").alias("n_dates"),
        )
    )


def nth_last(cal: DataFrame, n: int = 2) -> int:
    """L3: ordinal of the ``n``-th last date, by default the day before the last one."""
    row = cal.where(F.col("t") == F.col("n_dates") - n).select("t").first()
    if row is None:
        raise ValueError(f"need at least {n} dates")
    return row.t


def day_before_last(panel: DataFrame) -> int:
    """L3 on a dense panel that is already staged: ordinal of the second-last date."""
    last = panel.agg(F.max("t")).first()[0]
    if last is None or last < 1:
        raise ValueError("need at least 2 dates")
    return last - 1


def join_inputs(daily: DataFrame, flow: DataFrame | None, meta: DataFrame | None) -> DataFrame:
    """Prices with flow on (symbol, dt) and metadata on symbol.

    The flow join is full outer: a cell with flow but no bar must survive until the grid is
    filled. Symbols and dates without any price row drop out later (``dense_panel``).
    """
    out = daily.withColumn("has_bar", F.lit(True))
    if flow is not None:
        out = out.join(flow.select("symbol", "dt", "netbuy"), ["symbol", "dt"], "full")
    if meta is not None:
        out = out.join(meta, "symbol", "left")
    return out


def symbol_tasks(daily: DataFrame, n_dates: int) -> int:
    """Tasks for windows by symbol over a panel of ``n_dates`` dates, so that one holds about ``CELLS_PER_TASK`` cells whatever
    the number of symbols. A shuffle left to itself goes by its bytes, which know nothing of the grid filled after it."""
    symbols = daily.agg(F.approx_count_distinct("symbol")).first()[0]
    cells = symbols * n_dates
    busy = min(daily.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / FEWEST_CELLS))
    return max(1, busy, math.ceil(cells / CELLS_PER_TASK))


def dense_panel(cells: DataFrame, cal: DataFrame, constant: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """One row per (symbol, date of the calendar); absent cells are NULL.

    The grid comes from the gaps: each row stands for the dates up to the next row of its
    symbol, the first one also for those before it. No date x symbol product, no join back.
    ``constant`` columns belong to the symbol and are repeated on every row. Of several rows of one
    cell, the largest in the order of its fields (NULL is least) stays, whatever their partitions. ``tasks``:
    see ``symbol_tasks``.
    """
    fields = [c for c in cells.columns if c not in ("symbol", "dt", "t", *constant)]
    on_cal = cells.join(by_date(cal), "dt")
    if tasks is not None:
        on_cal = on_cal.repartition(tasks, "symbol")
    if "has_bar" in fields:
        known = F.max("has_bar").over(Window.partitionBy("symbol").orderBy("t").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
        on_cal = on_cal.withColumn("_known", known).where("_known")
        fields.remove("has_bar")
    w = Window.partitionBy("symbol").orderBy("t", *fields)
    spans = on_cal.withColumn(
        "_from", F.when(F.lag("t").over(w).isNull(), F.lit(0)).otherwise(F.col("t"))
    ).withColumn("_to", F.coalesce(F.lead("t").over(w), F.col("n_dates")) - 1)
    grid = spans.select(
        "symbol",
        *constant,
        F.col("t").alias("_at"),
        *fields,
        # A second row for one cell spans nothing and falls away.
        F.explode(F.when(F.col("_to") >= F.col("_from"), F.sequence("_from", "_to"))).alias("t"),
    )
    here = F.col("t") == F.col("_at")
    return grid.join(by_date(cal.select("t", "dt")), "t").select(
        "dt", "t", "symbol", *constant, *[F.when(here, F.col(f)).alias(f) for f in fields]
    )


def adjust_prices(panel: DataFrame, adj_close: str = "adj_close") -> DataFrame:
    """Scale O, H, L, C by adj_close / C, where an adjusted close is known."""
    factor = F.when(
        F.col(adj_close).isNotNull() & F.col("C").isNotNull(), safe_div(F.col(adj_close), F.col("C"))
    ).otherwise(1.0)
    return panel.withColumns({p: F.col(p) * factor for p in PRICE_FIELDS})


def impute(
    panel: DataFrame,
    fields: Sequence[str] = PANEL_FIELDS,
    forward: bool = True,
    back: bool = True,
) -> DataFrame:
    """Forward fill, then back fill of the leading gap.

    Behind the forward fill only leading NULLs are left, so the back fill is the symbol's
    first value: a whole-partition frame, linear, where a running frame would be quadratic.
    The back fill looks ahead; switch it off for a strict backtest.
    """
    w = in_time()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def filled(c: str) -> Column:
        tries = [F.last(c, ignorenulls=True).over(past)] if forward else [F.col(c)]
        if back and forward:
            tries.append(F.first(c, ignorenulls=True).over(whole))
        elif back:
            seen = F.last(c, ignorenulls=True).over(past)
            tries.append(F.when(seen.isNull(), F.first(c, ignorenulls=True).over(whole)))
        return F.coalesce(*tries)

    return panel.withColumns({c: filled(c) for c in fields})


def mark_tradable(panel: DataFrame, auto: bool = True) -> DataFrame:
    """No volume or no value means not tradable; a metadata flag of 0 always counts."""
    flag = F.coalesce(F.col("tradable_flag"), F.lit(1)) if "tradable_flag" in panel.columns else F.lit(1)
    if auto:
        zero = F.lit(0.0)
        idle = (F.coalesce("V", zero) == 0) | (F.coalesce("VAL", zero) == 0)
        flag = F.when(idle, F.lit(0)).otherwise(flag)
    return panel.withColumn("tradable_flag", flag.cast("int"))


def clean(panel: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """P14, W3, W4, P15 on a dense panel; non-finite input counts as missing."""
    out = panel.withColumns({c: finite(F.col(c)) for c in PANEL_FIELDS})
    if cfg.adjust_by_adj_close and "adj_close" in out.columns:
        out = adjust_prices(out)
    if cfg.forward_fill or cfg.back_fill:
        out = impute(out, PANEL_FIELDS, cfg.forward_fill, cfg.back_fill)
    return mark_tradable(out, cfg.auto_non_tradable)

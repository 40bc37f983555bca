"""Per-date statistics: z-scores, winsorising, quantiles, finite means.

Statistics are pre-aggregated per date and joined back as one row per date. Each function reads
its input more than once: give it a staged table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.config import StandardizeConfig
from marketloom.functions.quantiles import exact_quantiles
from marketloom.functions.scalars import clip, finite, safe_div
from marketloom.session import by_date, stage


def finite_mean(x: Column) -> Column:
    """A4: mean of the finite values, 0 without any."""
    return F.coalesce(F.avg(finite(x)), F.lit(0.0))


def section_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: mean and population deviation per date."""
    return df.groupBy("dt").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols],
    )


def zscore(
    df: DataFrame,
    cols: Sequence[str],
    cfg: StandardizeConfig = StandardizeConfig(),
    suffix: str = "",
) -> DataFrame:
    """Clipped z-scores per date; a constant cross-section scores 0."""

    def score(c: str) -> Column:
        z = clip(safe_div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), cfg.clip)
        z = F.when(F.col(c).isNotNull(), z)
        return F.coalesce(z, F.lit(0.0)) if cfg.fill_missing_with_zero else z

    scored = df.join(by_date(stage(section_stats(df, cols), "section_stats")), "dt")
    extra = [p + c for c in cols for p in ("_m_", "_s_")]
    return scored.withColumns({c + suffix: score(c) for c in cols}).drop(*extra)


def winsorize(df: DataFrame, cols: Sequence[str], p: float, by: str = "dt") -> DataFrame:
    """Pull values beyond the p and 1-p quantiles back to them.

    Per date by default. ``by='symbol'`` uses a symbol's whole history and so looks ahead.
    """
    keep = by_date if by == "dt" else (lambda d: d)
    # Written, as every reader of the result joins them in.
    limits = keep(stage(exact_quantiles(df, [by], cols, [p, 1.0 - p], keep), "limits"))

    def pulled(c: str) -> Column:
        q = F.col(f"{c}_q")
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), q[1]), q[0]))

    return (
        df.join(limits, by, "left")
        .withColumns({c: pulled(c) for c in cols})
        .drop(*[f"{c}_q" for c in cols])
    )

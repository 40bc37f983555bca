"""The ten panel features. All but the turnover share are windows over one (symbol, t) sort."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import FEATURES, CleanConfig
from marketloom.functions.scalars import (
    ema_alpha_from_half_life,
    ema_alpha_from_span,
    finite,
    garman_klass,
    liquidity,
    order_imbalance,
    safe_div,
)
from marketloom.operators.panel import in_time
from marketloom.session import by_date, stage

# A weight this small changes no double any more.
NEGLIGIBLE = 1e-17


Pair = tuple[Column, Column]


def change(now: Column, before: Column) -> Column:
    return safe_div(now - before, before)


def with_changes(df: DataFrame, **pairs: Pair) -> DataFrame:
    """Relative change of each (now, before) pair.

    Both sides become columns first: a window inside a guarded division would otherwise be
    evaluated once per mention.
    """
    sides = {f"_{k}_{i}": side for k, pair in pairs.items() for i, side in enumerate(pair)}
    out = df.withColumns(sides)
    done = {k: change(F.col(f"_{k}_0"), F.col(f"_{k}_1")) for k in pairs}
    return out.withColumns(done).drop(*sides)


def gap() -> Pair:
    """Open against the last close."""
    return F.col("O"), F.lag("C", 1).over(in_time())


def momentum(k: int) -> Pair:
    """W2."""
    return F.col("C"), F.lag("C", k).over(in_time())


def trailing_mean(c: str, n: int) -> Column:
    return F.avg(c).over(in_time().rowsBetween(-(n - 1), 0))


def adv(n: int = 30) -> Column:
    """Mean traded value over the last ``n`` rows, fewer at the start."""
    return trailing_mean("VAL", n)


def rolling_std(c: str, n: int = 30) -> Column:
    """Sample standard deviation over the last ``n`` rows."""
    return F.stddev_samp(c).over(in_time().rowsBetween(-(n - 1), 0))


def with_ema(panel: DataFrame, value: Column, alpha: float, name: str) -> DataFrame:
    """Exponential mean per symbol, seeded by the first value; NULLs are passed over.

    A recursion as running sums: values are numbered, cut into blocks so long that a weight
    spanning one is negligible, and summed within the block with growing weights. Whatever lies
    before comes from the block just before. Linear, free of overflow, no Python, and the same
    (symbol, t) order throughout.
    """
    q = 1.0 - alpha
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie between 0 and 1, got {alpha}")
    size = math.ceil(math.log(NEGLIGIBLE) / math.log(q))
    past = in_time().rowsBetween(Window.unboundedPreceding, 0)
    numbered = panel.withColumn("_x", value).withColumn("_k", F.count("_x").over(past) - 1)
    # Rows before the first value have _k = -1; they join block 0 and stay NULL.
    at = F.greatest(F.col("_k"), F.lit(0))
    placed = numbered.withColumn("_b", F.floor(at / size)).withColumn("_j", at % size)
    first = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    term = first * F.col("_x") * F.pow(F.lit(q), -F.col("_j").cast("double"))
    inside = Window.partitionBy("symbol", "_b").orderBy("t").rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = Window.partitionBy("symbol").orderBy("_b").rangeBetween(-1, -1)
    summed = placed.withColumn("_s", term)
    # The block before is complete, so its last weight is q ** (size - 1).
    own = F.sum("_s").over(inside) * F.pow(F.lit(q), F.col("_j").cast("double"))
    carried = F.coalesce(F.sum("_s").over(before), F.lit(0.0)) * F.pow(
        F.lit(q), F.col("_j") + F.lit(float(size))
    )
    ema = F.when(F.col("_k") >= 0, F.coalesce(own, F.lit(0.0)) + carried)
    return summed.withColumn(name, ema).drop("_x", "_k", "_b", "_j", "_s")


def bias(n: int = 10) -> Pair:
    """W5 with a moving average; NULL until the average has all its ``n`` rows."""
    frame = in_time().rowsBetween(-(n - 1), 0)
    return F.col("C"), F.when(F.count("C").over(frame) == n, trailing_mean("C", n))


def turnover_share(panel: DataFrame, name: str = "turnover_share") -> DataFrame:
    """Share of the day's traded value.

    Sums per date are pre-aggregated and sent back as one row per date; a window by date would
    draw each cross-section into one task.
    """
    total = stage(panel.groupBy("dt").agg(F.sum("VAL").alias("_total")), "day_totals")
    share = safe_div(F.col("VAL"), F.col("_total"))
    return panel.join(by_date(total), "dt", "left").withColumn(name, share).drop("_total")


def time_features(panel: DataFrame, cfg: CleanConfig = CleanConfig(), changes: Mapping[str, Pair] | None = None) -> DataFrame:
    """Every feature that needs one symbol only, and ADV; ``changes`` are further relative changes by name."""
    pairs = {"gap": gap(), "mom5": momentum(5), "mom10": momentum(10), "mom20": momentum(20)}
    if cfg.bias_use_ema:
        alpha = ema_alpha_from_half_life(cfg.bias_ema_half_life)
        panel = with_ema(panel, F.col("C"), alpha, "_ema")
        pairs["bias"] = (F.col("C"), F.col("_ema"))
    else:
        pairs["bias"] = bias(cfg.bias_ma_n)
    pairs.update(changes or {})
    out = with_changes(panel.withColumn("adv", adv(cfg.adv_window)), **pairs).drop("_ema")
    out = out.withColumns(
        {
            "gk_vol": garman_klass(F.col("O"), F.col("H"), F.col("L"), F.col("C")),
            "liquidity": liquidity(F.col("VAL")),
            "imbalance": order_imbalance(F.col("outside_vol"), F.col("inside_vol")),
        }
    )
    flow = F.col("netbuy").cast("double") if "netbuy" in panel.columns else F.lit(None).cast("double")
    strength = safe_div(flow, F.col("V"))
    return with_ema(out, strength, ema_alpha_from_span(cfg.broker_strength_ema), "broker_strength")


def build_features(
    panel: DataFrame, cfg: CleanConfig = CleanConfig(), keep: Sequence[str] | None = None, changes: Mapping[str, Pair] | None = None,
    since: int | None = None,
) -> DataFrame:
    """All ten features on a clean dense panel; non-finite results are NULL.

    Staged before the turnover share, whose sums per date are a second reading of the panel. With
    ``keep``, only these columns (and the features) are computed and written. ``changes``: see ``time_features``. With ``since``, the
    days before it are looked back on but not written.
    """
    timed = time_features(panel, cfg, changes)
    if keep is not None:
        wanted = dict.fromkeys(["dt", "t", "symbol", "VAL", *keep, *FEATURES, *(changes or {})])
        timed = timed.select(*[c for c in wanted if c in timed.columns])
    if since is not None:
        timed = timed.where(F.col("t") >= since)
    out = turnover_share(stage(timed, "features"))
    return out.withColumns({f: finite(F.col(f)) for f in FEATURES})

"""Walk-forward return forecasts.

A fit needs only sums of products. They are taken once per date (partial aggregation on the map
side), rolled into decayed trailing windows on the date table, and solved there, so all dates
are fitted in one pass over the panel. Python sees P x P systems, never panel rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import (
    FEATURES,
    CalibrationConfig,
    EnhanceConfig,
    StandardizeConfig,
    TrainConfig,
)
from marketloom.functions.quantiles import exact_quantiles
from marketloom.functions.scalars import safe_div
from marketloom.operators.crosssection import zscore
from marketloom.operators.features import Pair, with_changes
from marketloom.operators.panel import in_time
from marketloom.session import by_date, compiled_apart, stage

TARGETS = ("OO", "OC", "CC")
# What ``enhance`` reads beside the calibrated forecast.
ENHANCED_BY = ("broker_strength_z", "imbalance_z", "turnover_share_z", "bias")


def label_name(target: str, label_offset: int = 0) -> str:
    """Column of a panel that already has this return of each row."""
    return f"_label_{target}_{label_offset}"


def target_return(target: str = "CC", label_offset: int = 0) -> Pair:
    """The two prices of the return from day s to s+1, on the row of day s.

    OO starts at the open of day s, before that day's closing features exist; a
    ``label_offset`` of 1 moves the label one day on and removes the overlap.
    """
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, got {target!r}")

    def ahead(c: str, n: int) -> Column:
        return F.lead(c, n + label_offset).over(in_time()) if n + label_offset else F.col(c)

    if target == "OO":
        return ahead("O", 1), ahead("O", 0)
    if target == "OC":
        return ahead("C", 1), ahead("O", 1)
    return ahead("C", 1), ahead("C", 0)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def gram_layout(p: int) -> list[str]:
    """Order of the sums in a gram array: upper triangle of X'X by rows, X'y, row count."""
    return [*[f"g_{i}_{j}" for i, j in _pairs(p)], *[f"b_{i}" for i in range(p)], "n"]


def daily_gram(labelled: DataFrame, xs: Sequence[str], y: str = "label") -> DataFrame:
    """(dt, t, gram) over the rows with a label; dates without any hold zeros."""
    products = [
        *[f"CASE WHEN {y} IS NOT NULL THEN {xs[i]} * {xs[j]} END" for i, j in _pairs(len(xs))],
        *[f"{x} * {y}" for x in xs],
        f"CASE WHEN {y} IS NOT NULL THEN 1D END",
    ]
    sums = ", ".join(f"coalesce(sum({e}), 0D)" for e in products)
    return labelled.groupBy("dt", "t").agg(F.expr(f"array({sums})").alias("gram"))


def trailing_gram(gram: DataFrame, cfg: TrainConfig) -> DataFrame:
    """Decayed sums over the days [t - W, t - 1]; the newest of them has weight 1.

    Each sum of the gram array becomes its own window partition of one row per date. The weights
    grow along a block of days and start again with the next one, so they cannot overflow; a
    window touches two blocks at most, told apart by parity. A block is as long as the window, but no longer than 400
    half-lives: products older than that weigh less than 2 ** -400, and only the row count still sees them.
    """
    hl = cfg.half_life
    w = min(cfg.window, max(1, math.ceil(400 * hl)))
    n_at = F.size("gram") - 1
    long = gram.select("dt", "t", n_at.alias("n_at"), F.posexplode("gram").alias("k", "v"))
    block = F.floor(F.col("t") / w)
    grow = F.pow(F.lit(2.0), (F.col("t") - block * w) / hl)
    scaled = long.withColumns({"even": block % 2 == 0, "x": F.col("v") * grow})
    own = Window.partitionBy("k").orderBy("t").rangeBetween(-w, -1)

    def total(parity: Column) -> Column:
        return F.coalesce(F.sum(F.when(parity, F.col("x"))).over(own), F.lit(0.0))

    last = F.col("t") - 1
    newer = F.floor(last / w)
    sums = scaled.select(
        "dt", "t", "k", "n_at", total(F.col("even")).alias("e"), total(~F.col("even")).alias("o"),
        F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(-cfg.window, -1)), F.lit(0.0)).alias("rows"),
    )
    new = F.when(newer % 2 == 0, F.col("e")).otherwise(F.col("o"))
    old = F.when(newer % 2 == 0, F.col("o")).otherwise(F.col("e"))
    decayed = (new + old * 2.0 ** (-w / hl)) * F.pow(F.lit(2.0), -(last - newer * w) / hl)
    value = F.when(F.col("k") == F.col("n_at"), F.col("rows")).otherwise(decayed)
    packed = (
        sums.groupBy("dt", "t")
        .agg(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("g"))
        .select("dt", "t", F.transform("g", lambda x: x.v).alias("gram"))
    )
    return packed.where(F.element_at("gram", -1) > 0)


def ridge(g: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    """(G + lam I) beta = b for a stack of systems; a singular one gets the least-norm answer."""
    a = g + lam * np.eye(g.shape[1])
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.einsum("nij,nj->ni", np.linalg.pinv(a, hermitian=True), b)


def lasso(g: np.ndarray, b: np.ndarray, lam: float, max_iter: int, tol: float) -> np.ndarray:
    """Coordinate descent on 1/2 b'Gb - b'c + lam |b|_1, all systems side by side.

    A system stops by its own test, so its result does not depend on its company.
    """
    out = np.zeros_like(b)
    open_ = np.arange(len(b))
    for _ in range(max_iter):
        if not len(open_):
            break
        gs, bs, beta = g[open_], b[open_], out[open_]
        diag = np.einsum("nii->ni", gs)
        moved = np.zeros(len(open_))
        for j in range(b.shape[1]):
            rest = bs[:, j] - np.einsum("nk,nk->n", gs[:, j], beta) + diag[:, j] * beta[:, j]
            size = np.maximum(np.abs(rest) - lam, 0.0)
            new = np.where(
                diag[:, j] > 0, np.sign(rest) * size / np.where(diag[:, j] > 0, diag[:, j], 1.0), 0.0
            )
            moved = np.maximum(moved, np.abs(new - beta[:, j]))
            beta[:, j] = new
        out[open_] = beta
        open_ = open_[moved >= tol]
    return out


def fit(trailing: DataFrame, p: int, cfg: TrainConfig) -> DataFrame:
    """M2, M3: (dt, t, n, beta) per date."""
    upper = np.triu_indices(p)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            sums = np.stack(rows["gram"].to_numpy())
            g = np.zeros((len(rows), p, p))
            g[:, upper[0], upper[1]] = g[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
            b = sums[:, len(upper[0]) : -1]
            if cfg.model == "LASSO":
                beta = lasso(g, b, cfg.lam, cfg.lasso_max_iter, cfg.lasso_tol)
            else:
                beta = ridge(g, b, cfg.lam)
            yield pd.DataFrame(
                {
                    "dt": rows["dt"],
                    "t": rows["t"],
                    "n": sums[:, -1].astype("int64"),
                    "beta": list(beta),
                }
            )

    return trailing.mapInPandas(solve, "dt date, t int, n bigint, beta array<double>")


def raw_score(scored: DataFrame, beta: DataFrame, xs: Sequence[str]) -> DataFrame:
    """M5: beta'x on every row of a date with a fit; no intercept."""
    total = None
    for i, x in enumerate(xs):
        term = F.col("beta")[i] * F.col(x)
        total = term if total is None else total + term
    return scored.join(by_date(beta.select("dt", "beta")), "dt").withColumn("rhat_raw", total)


def external_score(forecast: DataFrame, scores: DataFrame) -> DataFrame:
    """M6: scores (dt, symbol, score) of another model replace beta'x where there is one."""
    return (
        forecast.join(scores.select("dt", "symbol", "score"), ["dt", "symbol"], "left")
        .withColumn("rhat_raw", F.coalesce("score", "rhat_raw"))
        .drop("score")
    )


def calibrate(forecast: DataFrame, cfg: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """M7 (ours): map |z| of the raw score through (0, 0), (p50, q50), (p75, q75), keep the sign.

    Past p75 the last slope goes on. Reads the scores of its input several times: give it a staged table.
    """
    z = zscore(forecast, ["rhat_raw"], StandardizeConfig(clip=cfg.z_clip), suffix="_z")
    z = z.withColumn("_a", F.abs("rhat_raw_z"))
    points = stage(exact_quantiles(z.select("dt", "_a"), ["dt"], ["_a"], [0.5, 0.75], by_date), "points")
    p50, p75 = F.col("_a_q")[0], F.col("_a_q")[1]
    low = safe_div(F.col("_a"), p50) * cfg.q50
    high = safe_div(F.col("_a") - p50, p75 - p50) * (cfg.q75 - cfg.q50) + cfg.q50
    size = F.when(F.col("_a") <= p50, low).otherwise(high)
    return (
        z.join(by_date(points), "dt")
        .withColumn("rhat_cal", F.signum("rhat_raw_z") * size)
        .drop("_a", "_a_q", "rhat_raw_z")
    )


def enhance(forecast: DataFrame, cfg: EnhanceConfig = EnhanceConfig()) -> DataFrame:
    """M8 (ours): tilt by the z-scores of flow, imbalance and turnover share; damp large bias."""
    tilt = (
        F.lit(1.0)
        + cfg.theta_b * F.col("broker_strength_z")
        + cfg.theta_imb * F.col("imbalance_z")
        + cfg.theta_ts * F.col("turnover_share_z")
    )
    excess = F.greatest(F.coalesce(F.abs("bias"), F.lit(0.0)) - cfg.theta_bias, F.lit(0.0))
    damp = F.greatest(F.lit(0.0), 1.0 - cfg.kappa_bias * excess)
    return forecast.withColumn("rhat_enh", F.col("rhat_cal") * tilt * damp)


def labelled_sections(
    features: DataFrame,
    target: str = "CC",
    px: StandardizeConfig = StandardizeConfig(),
    label_offset: int = 0,
    winsorize_label: float = 0.0,
) -> DataFrame:
    """M1 with W9: standardised features (``<f>_z``), the raw bias and the label, staged.

    ``features`` is read twice: give it a staged table. A panel that has the label (``label_name``) is not sorted again.
    ``winsorize_label`` > 0 pulls the returns of
    each date to these quantiles from both ends (W14).
    """
    z = zscore(compiled_apart(features), FEATURES, px, suffix="_z")
    kept = ["dt", "t", "symbol", "bias", *[f"{f}_z" for f in FEATURES]]
    known = label_name(target, label_offset)
    labelled = z.withColumnRenamed(known, "label") if known in z.columns else with_changes(z, label=target_return(target, label_offset))
    out = stage(labelled.select(*kept, "label"), "sections")
    if winsorize_label <= 0:
        return out
    # The limits, a row for each date, are written; every reader of the sections joins them in.
    limits = stage(exact_quantiles(out, ["dt"], ["label"], [winsorize_label, 1.0 - winsorize_label], by_date), "label_limits")
    low, high = F.col("label_q")[0], F.col("label_q")[1]
    pulled = F.when(F.col("label").isNotNull(), F.greatest(F.least(F.col("label"), high), low))
    return out.join(by_date(limits), "dt", "left").withColumn("label", pulled).drop("label_q")

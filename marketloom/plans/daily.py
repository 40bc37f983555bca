"""The daily chain: panel with features (Q3), risk and stage-1 forecast (Q4), forecast (Q5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.config import FEATURES, PRICE_FIELDS, STAGE1, CleanConfig, Config, RiskConfig, TrainConfig
from marketloom.functions.scalars import finite, garman_klass
from marketloom.operators.crosssection import winsorize
from marketloom.operators import forecast as fc
from marketloom.operators.features import adv, build_features
from marketloom.operators.risk import Tiles, liquidity_scaled_risk
from marketloom.operators.panel import clean, dense_panel, join_inputs, symbol_tasks
from marketloom.session import stage

META_COLUMNS = ("lot", "odd_lot_unit", "industry", "group", "tradable_flag")


def clean_panel(
    daily: DataFrame,
    cal: DataFrame,
    flow: DataFrame | None = None,
    meta: DataFrame | None = None,
    cfg: CleanConfig = CleanConfig(),
) -> DataFrame:
    """Q3, first half: join, fill the grid, clean. Symbols are counted first: give it a staged ``daily``."""
    cal = stage(cal, "calendar")
    cells = join_inputs(daily, flow, meta)
    constant = [c for c in META_COLUMNS if meta is not None and c in meta.columns]
    n_dates = cal.count()
    return clean(dense_panel(cells, cal, constant, symbol_tasks(daily, n_dates)), cfg)


def feature_panel(
    daily: DataFrame,
    cal: DataFrame,
    flow: DataFrame | None = None,
    meta: DataFrame | None = None,
    cfg: CleanConfig = CleanConfig(),
    keep: Sequence[str] | None = None,
    target: str | None = None,
) -> DataFrame:
    """Q3: clean panel with the ten features, winsorised; ``keep`` names the other columns wanted, ``target`` a return
    (W9) that fits will ask for, so that they need not sort the panel again."""
    ahead = {} if target is None else {fc.label_name(target): fc.target_return(target)}
    features = build_features(clean_panel(daily, cal, flow, meta, cfg), cfg, keep, ahead)
    if cfg.winsorize_p <= 0:
        return features
    return winsorize(features, FEATURES, cfg.winsorize_p, cfg.winsorize_by)


# What forecasts read beside the features.
FORECAST_COLUMNS = ("O", "C")


def risk_panel(daily: DataFrame, cal: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """What the risk of a day reads: close, winsorised volatility and ADV, staged; no other feature."""
    panel = clean_panel(daily, cal, cfg=cfg)
    needed = panel.withColumns(
        {"adv": adv(cfg.adv_window), "gk_vol": finite(garman_klass(*[F.col(c) for c in PRICE_FIELDS]))}
    ).select("dt", "t", "symbol", "C", "adv", "gk_vol")
    staged = stage(needed, "risk-panel")
    if cfg.winsorize_p <= 0:
        return staged
    return winsorize(staged, ["gk_vol"], cfg.winsorize_p, cfg.winsorize_by)


def fitted(
    sections: DataFrame, cfg: TrainConfig = TrainConfig(), xs: Sequence[str] = FEATURES
) -> DataFrame:
    """M2, M3: (dt, t, n, beta) for every date with a training window."""
    cols = [f"{x}_z" for x in xs]
    gram = fc.daily_gram(sections, cols)
    return fc.fit(fc.trailing_gram(gram, cfg), len(cols), cfg)


def forecast(
    features: DataFrame,
    cfg: Config = Config(),
    target: str = "CC",
    xs: Sequence[str] = FEATURES,
    scores: DataFrame | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Q5 for all dates at once: raw, calibrated and enhanced forecast per (dt, symbol).

    Fits see returns winsorised as the features are (W14). ``features`` is read twice: give it a staged table, or what
    ``feature_panel`` makes. With ``keep``, only these columns are computed and written beside the keys and forecasts.
    """
    wanted = [c for c in ("dt", "t", "symbol", *FORECAST_COLUMNS, *FEATURES, fc.label_name(target)) if c in features.columns]
    sections = fc.labelled_sections(features.select(*wanted), target, cfg.standardize, winsorize_label=cfg.clean.winsorize_p)
    beta = stage(fitted(sections, cfg.train, xs), "beta")
    raw = fc.raw_score(sections, beta, [f"{x}_z" for x in xs])
    if scores is not None:
        raw = fc.external_score(raw, scores)
    if keep is None:
        return fc.enhance(fc.calibrate(stage(raw, "raw"), cfg.calibrate), cfg.enhance)
    raw = raw.select(*dict.fromkeys(["dt", "t", "symbol", *fc.ENHANCED_BY, *keep, "rhat_raw"]))
    out = fc.enhance(fc.calibrate(stage(raw, "raw"), cfg.calibrate), cfg.enhance)
    return out.select(*dict.fromkeys(["dt", "t", "symbol", *keep, "rhat_raw", "rhat_cal", "rhat_enh"]))


def risk_and_stage1(
    features: DataFrame, at: int, risk: RiskConfig = RiskConfig(), train: TrainConfig = STAGE1, clean_cfg: CleanConfig = CleanConfig()
) -> tuple[DataFrame, Tiles, DataFrame]:
    """Q4: names with volatility, covariance tiles, and the raw forecast of day ``at``.

    Only the days that day ``at`` looks back on are read.
    """
    features = stage(features, "features")
    names, cov = liquidity_scaled_risk(features, at, risk)
    recent = features.where(F.col("t").between(at - train.window, at))
    sections = fc.labelled_sections(recent, "CC", winsorize_label=clean_cfg.winsorize_p)
    beta = fitted(sections, train).where(F.col("t") == at)
    today = sections.where(F.col("t") == at)
    raw = fc.raw_score(today, stage(beta, "beta"), [f"{x}_z" for x in FEATURES])
    return names, cov, raw.select("dt", "symbol", "rhat_raw")

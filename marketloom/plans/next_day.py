"""Q5 for one new day from a carried state, without the history.

What a forecast needs of the past is small: for each symbol its last filled fields, twenty closes, the mean of its flow
and the standardised features of the last day; for each date of the training window one array of sums. A new day is
joined to that, forecast, and folded in.
"""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.config import FEATURES, PANEL_FIELDS, PRICE_FIELDS, Config
from marketloom.functions.scalars import (
    ema_alpha_from_span, finite, garman_klass, liquidity, order_imbalance, safe_div,
)
from marketloom.operators import forecast as fc
from marketloom.operators.crosssection import winsorize, zscore
from marketloom.operators.features import build_features, change, turnover_share
from marketloom.operators.panel import adjust_prices
from marketloom.session import stage

CLOSES = 20
Z = [f"{f}_z" for f in FEATURES]


@dataclasses.dataclass
class State:
    """After the day ``dt`` with ordinal ``t``. ``names``: symbol, last (struct of the filled fields), closes (at most twenty,
    oldest first), flow (mean, NULL before its first value), z (array). ``grams``: dt, t, gram of the window's days, without
    the last day, whose returns are not known yet."""

    dt: datetime.date
    t: int
    names: DataFrame
    grams: DataFrame

    def write(self, path: str) -> None:
        self.names.write.mode("overwrite").parquet(f"{path}/names")
        self.grams.write.mode("overwrite").parquet(f"{path}/grams")
        spark = self.names.sparkSession
        spark.createDataFrame([(self.dt, self.t)], "dt date, t int").coalesce(1).write.mode("overwrite").parquet(f"{path}/day")

    @staticmethod
    def read(spark: SparkSession, path: str) -> State:
        """Write the next state to another path: this one is read until that is done."""
        day = spark.read.parquet(f"{path}/day").first()
        return State(day.dt, day.t, spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/grams"))


def _supported(cfg: Config) -> None:
    if cfg.clean.bias_use_ema or not cfg.clean.forward_fill or cfg.clean.winsorize_by != "dt":
        raise ValueError("the state holds for forward filling, a moving-average bias and limits by date")
    if cfg.clean.bias_ma_n > CLOSES + 1:
        raise ValueError(f"the bias may look back {CLOSES + 1} rows")


def _label(target: str, last: dict[str, Column]) -> Column:
    """Return of the last day, known with today's prices."""
    now, before = {"CC": (F.col("C"), last["C"]), "OO": (F.col("O"), last["O"]), "OC": (F.col("C"), F.col("O"))}[target]
    return change(now, before)


def initial_state(panel: DataFrame, cfg: Config = Config(), target: str = "CC", top: int | None = None) -> State:
    """From the whole history: ``panel`` is clean and dense (``plans.daily.clean_panel``). Without ``top``, the ordinal of its last
    day, the panel is read for it; stage it then. Else it is read and sorted once, and only the days a state looks back on are written.
    """
    _supported(cfg)
    if top is None:
        top = panel.agg(F.max("t")).first()[0]
    window = cfg.train.window
    label = {fc.label_name(target): fc.target_return(target)}
    features = build_features(panel, cfg.clean, PANEL_FIELDS, label, min(top - window, top - CLOSES + 1))
    today = features.where(F.col("t") == top)
    recent = features.where(F.col("t") >= top - window).select("dt", "t", "symbol", *FEATURES, *label)
    pulled = winsorize(recent, FEATURES, cfg.clean.winsorize_p) if cfg.clean.winsorize_p > 0 else recent
    sections = fc.labelled_sections(pulled, target, cfg.standardize, winsorize_label=cfg.clean.winsorize_p)
    grams = fc.daily_gram(sections.where(F.col("t") < top), Z)
    closes = features.where(F.col("t") > top - CLOSES).groupBy("symbol").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("t", "C"))), lambda x: x["C"]).alias("closes")
    )
    # The mean of the flow goes on from its own value, not from the winsorised one.
    last = today.select(
        "symbol", F.struct(*[F.col(c).cast("double").alias(c) for c in PANEL_FIELDS]).alias("last"), F.col("broker_strength").alias("flow")
    )
    z = sections.where(F.col("t") == top).select("symbol", F.array(*Z).alias("z"))
    names = last.join(closes, "symbol").join(z, "symbol").select("symbol", "last", "closes", "flow", "z")
    dt = today.select("dt").first().dt
    return State(dt, top, stage(names, "state_names"), stage(grams, "state_grams"))


def predict_day(day: DataFrame, state: State, cfg: Config = Config(), target: str = "CC") -> tuple[DataFrame, State]:
    """Forecast (dt, symbol, rhat_raw, rhat_cal, rhat_enh) of the one new date in ``day`` (dt, symbol, fields, optionally
    netbuy and adj_close), and the state after it.

    Symbols without a row today go on with their last fields. A symbol that is new today has no past: a run over the
    whole history would fill its earlier days with today's prices, this one does not look ahead.
    """
    _supported(cfg)
    dates = [r.dt for r in day.select("dt").distinct().limit(2).collect()]
    if len(dates) != 1 or dates[0] <= state.dt:
        raise ValueError(f"need one date after {state.dt}, got {dates}")
    t = state.t + 1
    known = {c.lower() for c in day.columns}
    fields = [(F.col(c) if c.lower() in known else F.lit(None)).cast("double") for c in PANEL_FIELDS]
    extra = [c for c in ("netbuy", "adj_close") if c in day.columns]
    rows = day.select("symbol", *[finite(f).alias(c) for c, f in zip(PANEL_FIELDS, fields)], *extra)
    if cfg.clean.adjust_by_adj_close and "adj_close" in extra:
        rows = adjust_prices(rows)
    met = rows.join(state.names, "symbol", "full")
    netbuy = F.col("netbuy").cast("double") if "netbuy" in extra else F.lit(None).cast("double")
    past = F.coalesce("closes", F.array().cast("array<double>"))
    filled = met.select(
        F.lit(dates[0]).alias("dt"), F.lit(t).alias("t"), "symbol", "last", past.alias("closes"), "flow", "z", netbuy.alias("netbuy"),
        *[F.coalesce(F.col(c), F.col(f"last.{c}")).alias(c) for c in PANEL_FIELDS],
    ).where(F.col("last").isNotNull() | F.coalesce(*PANEL_FIELDS).isNotNull())
    size = F.size("closes")
    before = lambda k: F.when(size >= k, F.get("closes", size - k))
    n = cfg.clean.bias_ma_n
    frame = F.concat(F.slice("closes", F.greatest(size - (n - 2), F.lit(1)), F.lit(n - 1)), F.array("C"))
    full = (size >= n - 1) & ~F.exists(frame, lambda c: c.isNull())
    mean = F.when(full, F.aggregate(frame, F.lit(0.0), lambda a, c: a + c) / n)
    alpha = ema_alpha_from_span(cfg.clean.broker_strength_ema)
    x = safe_div(F.col("netbuy"), F.col("V"))
    flow = F.when(x.isNull(), F.col("flow")).when(F.col("flow").isNull(), x).otherwise((1 - alpha) * F.col("flow") + alpha * x)
    own = {
        "gap": change(F.col("O"), before(1)), "mom5": change(F.col("C"), before(5)), "mom10": change(F.col("C"), before(10)),
        "mom20": change(F.col("C"), before(20)), "bias": change(F.col("C"), mean), "broker_strength": flow,
        "gk_vol": garman_klass(*[F.col(c) for c in PRICE_FIELDS]), "liquidity": liquidity(F.col("VAL")),
        "imbalance": order_imbalance(F.col("outside_vol"), F.col("inside_vol")),
    }
    today = turnover_share(stage(filled.withColumns(own), "today"))
    raw_flow = F.col("broker_strength").alias("raw_flow")
    today = stage(today.select("*", raw_flow).withColumns({f: finite(F.col(f)) for f in FEATURES}), "today")
    pulled = stage(winsorize(today, FEATURES, cfg.clean.winsorize_p), "today") if cfg.clean.winsorize_p > 0 else today
    sections = stage(zscore(pulled, FEATURES, cfg.standardize, suffix="_z"), "today_z")

    # Yesterday's returns are known now: its sums join the window.
    last = {c: F.col(f"last.{c}") for c in ("O", "C")}
    yesterday = sections.where("z IS NOT NULL").select(
        F.lit(state.dt).alias("dt"), F.lit(state.t).alias("t"), *[F.col("z")[i].alias(f"y{i}") for i in range(len(Z))], _label(target, last).alias("label")
    )
    if cfg.clean.winsorize_p > 0:
        yesterday = winsorize(stage(yesterday, "yesterday"), ["label"], cfg.clean.winsorize_p)
    gram = fc.daily_gram(yesterday, [f"y{i}" for i in range(len(Z))])
    grams = stage(state.grams.where(F.col("t") >= t - cfg.train.window).unionByName(gram), "state_grams")
    blank = F.array_repeat(F.lit(0.0), len(fc.gram_layout(len(Z))))
    here = day.sparkSession.createDataFrame([(dates[0], t)], "dt date, t int").select("dt", "t", blank.alias("gram"))
    beta = fc.fit(fc.trailing_gram(grams.unionByName(here), cfg.train).where(F.col("t") == t), len(Z), cfg.train)
    raw = fc.raw_score(sections, stage(beta, "beta"), Z)
    out = fc.enhance(fc.calibrate(stage(raw.select("dt", "symbol", "bias", *Z, "rhat_raw"), "raw"), cfg.calibrate), cfg.enhance)

    closes = F.concat("closes", F.array("C"))
    names = sections.select(
        "symbol", F.struct(*[F.col(c) for c in PANEL_FIELDS]).alias("last"),
        F.slice(closes, F.greatest(F.size(closes) - (CLOSES - 1), F.lit(1)), F.lit(CLOSES)).alias("closes"),
        F.col("raw_flow").alias("flow"), F.array(*Z).alias("z"),
    )
    return out.select("dt", "symbol", "rhat_raw", "rhat_cal", "rhat_enh"), State(dates[0], t, stage(names, "state_names"), grams)

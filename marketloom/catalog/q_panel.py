"""Queries: bars, panel, cleaning, features, cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.catalog import roles
from marketloom.catalog.base import query, rounded, sql
from marketloom.catalog.views import PAST, WHOLE, W, bars_sql, chg, div, ema, rows
from marketloom.config import FEATURES, PANEL_FIELDS, CleanConfig
from marketloom.functions.quantiles import exact_quantiles
from marketloom.functions.scalars import (
    ema_alpha_from_half_life,
    finite_or_zero,
    garman_klass,
    liquidity,
    order_imbalance,
    safe_div,
)
from marketloom.operators import features as ft
from marketloom.operators.crosssection import finite_mean, section_stats, winsorize, zscore
from marketloom.operators.flow import last_dates, trading_dates, universe
from marketloom.operators.forecast import target_return
from marketloom.operators.panel import adjust_prices, bars, calendar, dense_panel, impute, join_inputs, mark_tradable, symbol_tasks
from marketloom.operators.risk import with_close_return
from marketloom.plans.daily import META_COLUMNS, clean_panel, feature_panel
from marketloom.session import by_date, stage


# Prices and means of cents often end on half a digit, which the engines round apart.
NUDGE = 1.23457e-8


def weekly(spark, sf, symbol=None):
    return bars(roles.ticks(spark, sf, symbol), "week")


def weekly_and_calendar(spark, sf, symbol=None):
    """Staged bars and their weeks: the ticks are read once."""
    staged = stage(weekly(spark, sf, symbol), "weekly")
    return staged, calendar(staged)


def cells(spark, sf):
    """Dense, not yet cleaned."""
    daily, cal = weekly_and_calendar(spark, sf)
    joined = join_inputs(daily, roles.flow(spark, sf), roles.metadata(spark, sf))
    cal = stage(cal, "calendar")
    return dense_panel(joined, cal, META_COLUMNS, symbol_tasks(daily, cal.count()))


def panel(spark, sf):
    return clean_panel(*weekly_and_calendar(spark, sf), roles.flow(spark, sf), roles.metadata(spark, sf))


def name_panel(spark, sf):
    """The same chain for the 64 names of the portfolios."""
    return clean_panel(*weekly_and_calendar(spark, sf, roles.by_name()), roles.flow(spark, sf, roles.customer_name()))


def features(spark, sf, cfg=CleanConfig(), keep=None, target=None):
    """With ``keep``, metadata is left out, as no feature reads it."""
    meta = roles.metadata(spark, sf) if keep is None else None
    return feature_panel(*weekly_and_calendar(spark, sf), roles.flow(spark, sf), meta, cfg, keep, target)


def _bars_query(unit):
    digits = (8, "O", "H", "L", "C", "VAL")
    cols = ", ".join(f"round({c}, 8) AS {c}" for c in ("O", "H", "L", "C", "VAL"))
    text = sql(
        f"SELECT symbol, dt, {cols}, V, inside_vol, outside_vol FROM ({bars_sql('ticks', unit)})",
        "ticks",
    )

    @query(f"a14_bars_{unit}", text)
    def run(spark, sf):
        return rounded(bars(roles.ticks(spark, sf), unit), *digits)


for _unit in ("day", "week", "month"):
    _bars_query(_unit)


@query("s8_dense_panel", sql(
    "SELECT dt, t, symbol, " + ", ".join(f"round({c}, 8) AS {c}" for c in PANEL_FIELDS)
    + ", netbuy FROM cells", "cells"))
def s8(spark, sf):
    out = cells(spark, sf).select("dt", "t", "symbol", *PANEL_FIELDS, "netbuy")
    return rounded(out, 8, *PANEL_FIELDS)


@query("j5_panel_join", sql(
    """SELECT b.symbol, b.dt, round(C, 8) AS C, netbuy, lot, industry, "group" FROM bars b
    LEFT JOIN flow f ON b.symbol = f.symbol AND b.dt = f.dt LEFT JOIN meta m ON m.symbol = b.symbol""",
    "bars", "flow", "meta"))
def j5(spark, sf):
    out = join_inputs(weekly(spark, sf), roles.flow(spark, sf), roles.metadata(spark, sf))
    out = out.where("has_bar").select("symbol", "dt", "C", "netbuy", "lot", "industry", "group")
    return rounded(out, 8, "C")


@query("a1_symbols_dates", sql(
    """SELECT 'symbol' AS kind, symbol AS label FROM (SELECT DISTINCT symbol FROM bars)
    UNION ALL SELECT 'date', CAST(dt AS VARCHAR) FROM (SELECT DISTINCT dt FROM bars)""", "bars"))  # fmt: skip
def a1(spark, sf):
    daily = roles.ticks(spark, sf).withColumn("dt", F.trunc(F.col("ts").cast("date"), "week"))
    syms = universe(daily).select(F.lit("symbol").alias("kind"), F.col("symbol").alias("label"))
    days = trading_dates(daily).select(F.lit("date").alias("kind"), F.col("dt").cast("string").alias("label"))
    return syms.unionByName(days)


@query("u1_distinct_pairs", sql("SELECT symbol, dt FROM bars", "bars"))
def u1(spark, sf):
    t = roles.ticks(spark, sf)
    return t.select("symbol", F.trunc(F.col("ts").cast("date"), "week").alias("dt")).distinct()


@query("l1_sorted_dates", sql("SELECT dt FROM cal ORDER BY dt", "cal"))
def l1(spark, sf):
    return roles.weeks(spark, sf).select("dt").orderBy("dt")


@query("l2_last_60_dates", sql("SELECT dt FROM cal ORDER BY dt DESC LIMIT 60", "cal"))
def l2(spark, sf):
    t = roles.ticks(spark, sf)
    return last_dates(t.withColumn("dt", F.trunc(F.col("ts").cast("date"), "week")))


@query("l3_second_last_date", sql(
    "SELECT dt, t FROM cal WHERE t = (SELECT max(t) - 1 FROM cal)", "cal"))
def l3(spark, sf):
    return roles.weeks(spark, sf).where("t = n_dates - 2").select("dt", "t")


@query("p14_adjusted_prices", sql(
    f"""SELECT symbol, dt, round(O * f + {NUDGE}, 6) AS O, round(H * f + {NUDGE}, 6) AS H, round(L * f + {NUDGE}, 6) AS L, round(C * f + {NUDGE}, 6) AS C
    FROM (SELECT *, CASE WHEN adj IS NULL THEN 1.0 ELSE {div('adj', 'C')} END AS f
          FROM (SELECT *, CASE WHEN day(dt) % 3 > 0 THEN C * (1 - day(dt) / 100) END AS adj FROM bars))""",
    "bars"))
def p14(spark, sf):
    day = F.dayofmonth("dt")
    adj = F.when(day % 3 > 0, F.col("C") * (1 - day / 100))
    out = adjust_prices(weekly(spark, sf).withColumn("adj_close", adj))
    return out.select("symbol", "dt", *[F.round(F.col(c) + NUDGE, 6).alias(c) for c in "OHLC"])


@query("w3_forward_fill", sql(
    "SELECT symbol, t, " + ", ".join(
        f"round(last_value({c} IGNORE NULLS) OVER {PAST}, 8) AS {c}" for c in PANEL_FIELDS)
    + " FROM cells", "cells"))
def w3(spark, sf):
    out = impute(cells(spark, sf), PANEL_FIELDS, back=False)
    return rounded(out.select("symbol", "t", *PANEL_FIELDS), 8, *PANEL_FIELDS)


@query("w4_back_fill", sql(
    "SELECT symbol, t, " + ", ".join(
        f"round(CASE WHEN last_value({c} IGNORE NULLS) OVER {PAST} IS NULL THEN first_value({c} IGNORE NULLS) OVER {WHOLE} ELSE {c} END, 8) AS {c}"
        for c in PANEL_FIELDS) + " FROM cells", "cells"))
def w4(spark, sf):
    out = impute(cells(spark, sf), PANEL_FIELDS, forward=False)
    return rounded(out.select("symbol", "t", *PANEL_FIELDS), 8, *PANEL_FIELDS)


@query("p15_tradable", sql(
    """SELECT symbol, t, CAST(CASE WHEN coalesce(V, 0) = 0 OR coalesce(VAL, 0) = 0 THEN 0 ELSE meta_flag END AS INTEGER) AS tradable_flag
    FROM cells""", "cells"))  # fmt: skip
def p15(spark, sf):
    return mark_tradable(cells(spark, sf)).select("symbol", "t", "tradable_flag")


@query("q3a_clean_panel", sql(
    "SELECT dt, t, symbol, " + ", ".join(f"round({c}, 8) AS {c}" for c in PANEL_FIELDS)
    + ", netbuy, CAST(tradable_flag AS INTEGER) AS tradable_flag FROM panel", "panel"))
def q3a(spark, sf):
    out = panel(spark, sf).select("dt", "t", "symbol", *PANEL_FIELDS, "netbuy", "tradable_flag")
    return rounded(out, 8, *PANEL_FIELDS)


def _on_panel(name, expr, text, digits=6):
    """A query of one window or scalar over the clean panel."""

    @query(name, sql(f"SELECT symbol, t, round({text}, {digits}) AS value FROM panel", "panel"))
    def run(spark, sf):
        what, df = expr(), panel(spark, sf)
        if isinstance(what, tuple):
            df = ft.with_changes(df, value=what)
        else:
            df = df.withColumn("value", what)
        return df.select("symbol", "t", F.round("value", digits).alias("value"))


_on_panel("w1_gap", ft.gap, chg("O", f"lag(C) OVER {W}"))
for _k in (5, 10, 20):
    _on_panel(f"w2_momentum_{_k}", lambda k=_k: ft.momentum(k), chg("C", f"lag(C, {_k}) OVER {W}"))
_on_panel(
    "w5_bias_ma",
    ft.bias,
    f"CASE WHEN count(C) OVER {rows(10)} = 10 THEN {chg('C', f'avg(C) OVER {rows(10)}')} END",
)
_on_panel("w8_adv", lambda: ft.adv() + NUDGE, f"avg(VAL) OVER {rows(30)} + {NUDGE}", 3)
_on_panel(
    "p16_garman_klass",
    lambda: garman_klass(F.col("O"), F.col("H"), F.col("L"), F.col("C")),
    "sqrt(greatest(0.5 * pow(ln(H / L), 2) - (2 * ln(2.0) - 1) * pow(ln(C / O), 2), 0.0))",
)
_on_panel("p17_liquidity", lambda: liquidity(F.col("VAL")), "ln(VAL + 1)")
_on_panel(
    "p18_imbalance",
    lambda: order_imbalance(F.col("outside_vol"), F.col("inside_vol")),
    div("outside_vol - inside_vol", "outside_vol + inside_vol"),
)
_on_panel(
    "p12_safe_division",
    lambda: safe_div(F.col("outside_vol"), F.col("inside_vol")),
    div("outside_vol", "inside_vol"),
)
_on_panel(
    "p20_finite_or_zero",
    lambda: finite_or_zero(F.ln(F.lag("outside_vol", 1).over(ft.in_time()))),
    f"coalesce(CASE WHEN lag(outside_vol) OVER {W} > 0 THEN ln(greatest(lag(outside_vol) OVER {W}, 1)) END, 0.0)",
)
_on_panel("w9_label_cc", lambda: target_return("CC"), chg(f"lead(C) OVER {W}", "C"))
_on_panel("w9_label_oo", lambda: target_return("OO"), chg(f"lead(O) OVER {W}", "O"))
_on_panel("w9_label_oc", lambda: target_return("OC"), chg(f"lead(C) OVER {W}", f"lead(O) OVER {W}"))


@query("j6_feature_with_label", sql(
    f"""SELECT s.symbol, s.t, round({chg('s.C', 'b.C')}, 6) AS mom5, round({chg('n.C', 's.C')}, 6) AS label
    FROM panel s LEFT JOIN panel b ON b.symbol = s.symbol AND b.t = s.t - 5
    LEFT JOIN panel n ON n.symbol = s.symbol AND n.t = s.t + 1""", "panel"))  # fmt: skip
def j6(spark, sf):
    out = ft.with_changes(panel(spark, sf), mom5=ft.momentum(5), label=target_return("CC"))
    return rounded(out.select("symbol", "t", "mom5", "label"), 6, "mom5", "label")


@query("w6_ema_3", sql(
    f"SELECT symbol, t, round({ema('x', 0.5)}, 4) AS value FROM (SELECT symbol, t, {div('netbuy', 'V')} AS x FROM panel)", "panel"))
def w6(spark, sf):
    out = ft.with_ema(panel(spark, sf), safe_div(F.col("netbuy").cast("double"), F.col("V")), 0.5, "value")
    return rounded(out.select("symbol", "t", "value"), 4, "value")


_HL10 = ema_alpha_from_half_life(10.0)


@query("p13_w6_ema_half_life", sql(
    f"SELECT symbol, t, round({chg('C', 'e')}, 6) AS value FROM (SELECT symbol, t, C, {ema('C', _HL10)} AS e FROM panel)", "panel"))
def w6_half_life(spark, sf):
    """Bias against the mean with a half-life of 10."""
    out = ft.with_ema(panel(spark, sf), F.col("C"), _HL10, "e")
    return rounded(out.select("symbol", "t", ft.change(F.col("C"), F.col("e")).alias("value")), 6, "value")


@query("w7_rolling_std", sql(
    f"""SELECT symbol, t, round(CASE WHEN count(r) OVER {rows(30)} > 1 THEN stddev_samp(r) OVER {rows(30)} END, 6) AS value
    FROM (SELECT symbol, t, {chg('C', f'lag(C) OVER {W}')} AS r FROM panel)""", "panel"))  # fmt: skip
def w7(spark, sf):
    r = with_close_return(panel(spark, sf))
    return r.select("symbol", "t", F.round(ft.rolling_std("r", 30), 6).alias("value"))


@query("w13_turnover_share", sql(
    f"SELECT symbol, t, round({div('VAL', 'sum(VAL) OVER (PARTITION BY dt)')}, 8) AS value FROM panel", "panel"))
def w13(spark, sf):
    out = ft.turnover_share(stage(panel(spark, sf).select("dt", "t", "symbol", "VAL"), "values"), "value")
    return rounded(out.select("symbol", "t", "value"), 8, "value")


@query("q3_features", sql(
    "SELECT dt, t, symbol, " + ", ".join(f"round({f}, 5) AS {f}" for f in FEATURES)
    + ", CAST(tradable_flag AS INTEGER) AS tradable_flag FROM wins", "wins"))
def q3(spark, sf):
    out = features(spark, sf).select("dt", "t", "symbol", *FEATURES, "tradable_flag")
    return rounded(out, 5, *FEATURES)


def section(spark, sf):
    """Week returns and traded values as a cross-section, staged."""
    return stage(with_close_return(panel(spark, sf)).select("dt", "t", "symbol", "VAL", "r"), "section")


_SECTION = f"(SELECT dt, t, symbol, VAL, {chg('C', f'lag(C) OVER {W}')} AS r FROM panel)"


@query("w14_winsorize_by_date", sql(
    f"""SELECT symbol, t, round(CASE WHEN r IS NOT NULL THEN greatest(least(r, hi), lo) END, 6) AS value FROM {_SECTION} s
    JOIN (SELECT dt AS d, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM {_SECTION} GROUP BY dt) q ON d = dt""",
    "panel"))
def w14(spark, sf):
    out = winsorize(section(spark, sf), ["r"], 0.01)
    return out.select("symbol", "t", F.round("r", 6).alias("value"))


@query("w14_winsorize_by_symbol", sql(
    f"""SELECT s.symbol, t, round(CASE WHEN r IS NOT NULL THEN greatest(least(r, hi), lo) END, 6) AS value FROM {_SECTION} s
    JOIN (SELECT symbol, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM {_SECTION} GROUP BY symbol) q ON q.symbol = s.symbol""",
    "panel"))
def w14_symbol(spark, sf):
    out = winsorize(section(spark, sf), ["r"], 0.05, by="symbol")
    return out.select("symbol", "t", F.round("r", 6).alias("value"))


@query("w12_zscore", sql(
    f"""SELECT symbol, t, round(coalesce(greatest(least({div('r - m', 's')}, 3.0), -3.0) * CASE WHEN r IS NOT NULL THEN 1 END, 0.0), 5) AS value
    FROM {_SECTION} x JOIN (SELECT dt AS d, avg(r) AS m, stddev_pop(r) AS s FROM {_SECTION} GROUP BY dt) q ON d = dt""",
    "panel"))
def w12(spark, sf):
    out = zscore(section(spark, sf), ["r"])
    return out.select("symbol", "t", F.round("r", 5).alias("value"))


@query("a5_section_stats", sql(
    f"SELECT dt, round(avg(VAL) + {NUDGE}, 3) AS mean_val, round(stddev_pop(VAL), 3) AS std_val FROM {_SECTION} GROUP BY dt", "panel"))
def a5(spark, sf):
    out = section_stats(panel(spark, sf), ["VAL"])
    return out.select("dt", F.round(F.col("_m_VAL") + NUDGE, 3).alias("mean_val"), F.round("_s_VAL", 3).alias("std_val"))


@query("a7_exact_quantiles", sql(
    f"""SELECT dt, round(quantile_cont(r, 0.01), 6) AS p01, round(quantile_cont(r, 0.5), 6) AS p50,
    round(quantile_cont(r, 0.75), 6) AS p75, round(quantile_cont(r, 0.99), 6) AS p99 FROM {_SECTION}
    WHERE r IS NOT NULL GROUP BY dt""", "panel"))  # fmt: skip
def a7(spark, sf):
    q = exact_quantiles(section(spark, sf).where("r IS NOT NULL"), ["dt"], ["r"], [0.01, 0.5, 0.75, 0.99], by_date)
    return q.select("dt", *[F.round(F.col("r_q")[i], 6).alias(n) for i, n in enumerate(("p01", "p50", "p75", "p99"))])


@query("a7_bracketed_quantiles", sql(
    f"""SELECT symbol, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.5), 6) AS p50,
    round(quantile_cont(r, 0.95), 6) AS p95, round(quantile_cont(VAL, 0.5) + {NUDGE}, 4) AS val50 FROM {_SECTION}
    GROUP BY symbol""", "panel"))  # fmt: skip
def a7_bracketed(spark, sf):
    """The way for large groups, on groups of any size."""
    q = exact_quantiles(section(spark, sf), ["symbol"], ["r", "VAL"], [0.05, 0.5, 0.95], small_group=0)
    return q.select(
        "symbol",
        *[F.round(F.col("r_q")[i], 6).alias(n) for i, n in enumerate(("p05", "p50", "p95"))],
        F.round(F.col("VAL_q")[1] + NUDGE, 4).alias("val50"),
    )


@query("a4_finite_mean", sql(
    """SELECT l_suppkey, round(coalesce(avg(CASE WHEN l_discount > 0.02 THEN l_tax / l_discount END), 0.0), 8) AS mean_ratio
    FROM lineitem GROUP BY l_suppkey"""))  # fmt: skip
def a4(spark, sf):
    ratio = F.when(F.col("l_discount") > 0.02, F.try_divide("l_tax", "l_discount")).otherwise(F.lit(float("nan")))
    return roles.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(finite_mean(ratio), 8).alias("mean_ratio")
    )


@query("l7_preview", sql("SELECT symbol, t, round(C, 8) AS C FROM panel ORDER BY t DESC, symbol LIMIT 5", "panel"))
def l7(spark, sf):
    out = panel(spark, sf).select("symbol", "t", "C").orderBy(F.desc("t"), "symbol").limit(5)
    return rounded(out, 8, "C")


@query("w11_rank_by_value", sql(
    """SELECT dt, symbol, CAST(r AS INTEGER) AS rank FROM (
      SELECT dt, symbol, row_number() OVER (PARTITION BY dt ORDER BY VAL DESC, symbol) AS r FROM bars) WHERE r <= 3""", "bars"))  # fmt: skip
def w11(spark, sf):
    best = Window.partitionBy("dt").orderBy(F.desc("VAL"), "symbol")
    ranked = weekly(spark, sf).withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    return ranked.select("dt", "symbol", "rank")

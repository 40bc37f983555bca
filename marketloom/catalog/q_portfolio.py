"""Queries: costs, caps, candidates, sweeps, deduplication, lots and orders."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from marketloom.catalog import roles
from marketloom.catalog.base import query, rounded, sql, view
from marketloom.catalog.q_forecast import AT, RISK
from marketloom.catalog.q_panel import name_panel
from marketloom.config import (
    FEATURES,
    CapConfig,
    CostConfig,
    ExecutionConfig,
    RiskTarget,
    SweepConfig,
)
from marketloom.functions import scalars as sc
from marketloom.operators import dedup as dd
from marketloom.operators import portfolio as pf
from marketloom.operators import risk as rk
from marketloom.operators.crosssection import winsorize, zscore
from marketloom.operators.features import build_features
from marketloom.operators.neighbours import near_links
from marketloom.operators.panel import day_before_last
from marketloom.plans.decide import choose_candidates, execute
from marketloom.session import stage

NOTIONAL = 1e9
CAPS = CapConfig(a_b=0.1, a_bias=0.5, kappa_adv=2.0, kappa_ts=0.5)
COST = CostConfig(beta_imb_impact=0.2)
TARGET = RiskTarget(sigma_star=0.25, tau_max=0.70)
SWEEP = SweepConfig(sigma_star=(0.15, 0.20, 0.30, 2.0), tau=(0.55, 0.60, 0.65, 0.90))
EXEC = ExecutionConfig(notional=NOTIONAL, lambda_risk=0.01)
PWL = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04)
GROUP_CAPS = {"G0": 0.24, "G1": 0.21, "G2": 0.30}


def name_features(spark, sf):
    return stage(winsorize(build_features(name_panel(spark, sf)), FEATURES, 0.01), "name-features")


def names_of(spark, sf, feat):
    """One row per name on the second-last date."""
    at = day_before_last(feat)
    today = zscore(feat.where(F.col("t") == at), ["mom5"], suffix="_z")
    i = F.col("symbol").cast("int")
    lot = F.when(i % 2 == 0, 10).otherwise(100)
    n0 = F.floor(NOTIONAL / 64 / (F.col("C") * lot))
    return stage(
        today.select(
            "dt", "symbol",
            F.col("C").alias("price"),
            lot.alias("lot"),
            n0.alias("n0"),
            (0.01 * F.col("mom5_z")).alias("rhat_enh"),
            (n0 * lot * F.col("C") / NOTIONAL).alias("w0"),
            F.when(i % 4 == 0, 0.5).otherwise(1.0).alias("w_turn"),
            "adv", "gk_vol",
            F.col("imbalance").alias("imb"),
            F.col("broker_strength").alias("bf"),
            "bias",
            F.col("turnover_share").alias("ts"),
            F.concat(F.lit("G"), i % 5).alias("group"),
            F.when(i % 7 == 0, 0.0).otherwise(0.045).alias("wmax_base"),
        ),
        "names",
    )


view(
    "names",
    f"""SELECT *, n0 * lot * price / 1e9 AS w0 FROM (SELECT *, floor(1e9 / 64 / (price * lot)) AS n0 FROM (
      SELECT dt, symbol, C AS price, CASE WHEN i % 2 = 0 THEN 10 ELSE 100 END AS lot, 0.01 * mom5_z AS rhat_enh,
        CASE WHEN i % 4 = 0 THEN 0.5 ELSE 1.0 END AS w_turn, adv, gk_vol, imbalance AS imb, broker_strength AS bf, bias,
        turnover_share AS ts, 'G' || CAST(i % 5 AS VARCHAR) AS "group", CASE WHEN i % 7 = 0 THEN 0.0 ELSE 0.045 END AS wmax_base
      FROM (SELECT *, CAST(symbol AS INTEGER) AS i FROM nzed WHERE t = {AT.format(p='n')})))""",
    "nzed", "ncal",
)
view(
    "limits2",
    """SELECT *, CASE WHEN adv > 0 THEN 4e-4 * (1 + 0.2 * abs(imb)) * gk_vol / sqrt(adv) END AS k_imp,
      greatest(least(CASE WHEN wmax_base = 0 THEN 1.0 ELSE wmax_base END * (1 + 0.1 * coalesce(bf, 0)) * (1 - 0.5 * greatest(abs(coalesce(bias, 0)) - 0.1, 0)),
        2.0 * coalesce(adv, 0) / 1e9, 0.5 * coalesce(ts, 0) / (SELECT quantile_cont(ts, 0.5) FROM names), 1.0), 0.0) AS cap FROM names""",
    "names",
)


# The sweep's caps bind for about seven candidates in ten.
SWEEP_CAPS = CapConfig()
view(
    "limits3",
    "SELECT * REPLACE (CASE WHEN wmax_base = 0 THEN 1.0 ELSE wmax_base END AS cap) FROM limits2",
    "limits2",
)


def limited(spark, sf, feat=None, caps=CAPS):
    names = names_of(spark, sf, feat if feat is not None else name_features(spark, sf))
    return stage(pf.names_with_limits(names, COST, caps, NOTIONAL), "limits")


@query("p21_p23_limits", sql("SELECT symbol, round(k_imp * 1e6, 6) AS k_imp_ppm, round(cap, 7) AS cap FROM limits2", "limits2"))
def p21(spark, sf):
    out = limited(spark, sf)
    return out.select("symbol", F.round(F.col("k_imp") * 1e6, 6).alias("k_imp_ppm"), F.round("cap", 7).alias("cap"))


def _pwl_sql(u):
    parts = []
    for i, (a, b) in enumerate(zip(PWL[:-1], PWL[1:])):
        chord = f"pow({a!r}, 1.5) + (pow({b!r}, 1.5) - pow({a!r}, 1.5)) / ({b!r} - {a!r}) * ({u} - {a!r})"
        parts.append(f"ELSE {chord}" if i == len(PWL) - 2 else f"WHEN {u} <= {b!r} THEN {chord}")
    return "CASE " + " ".join(parts) + " END"


@query("p22_impact_chords", sql(
    f"SELECT cand_id, symbol, round(pow(w, 1.5), 8) AS exact, round({_pwl_sql('w')}, 8) AS chord FROM cands", "cands"))
def p22(spark, sf):
    c = roles.candidates(spark, sf)
    return c.select(
        "cand_id", "symbol",
        F.round(sc.impact_power(F.col("w")), 8).alias("exact"),
        F.round(sc.impact_power(F.col("w"), PWL), 8).alias("chord"),
    )


@query("p24_unit_weights", sql(
    "SELECT symbol, round(price * lot / 1e9, 10) AS lot_w, round(price / 1e9, 12) AS share_w FROM names", "names"))
def p24(spark, sf):
    names = names_of(spark, sf, name_features(spark, sf))
    lot_w, share_w = sc.unit_weights(F.col("price"), F.col("lot"), NOTIONAL)
    return names.select("symbol", F.round(lot_w, 10).alias("lot_w"), F.round(share_w, 12).alias("share_w"))


@query("p25_p26_p27_trades", sql(
    """SELECT cand_id, symbol, round(w - v, 9) AS dw, round(greatest(w - v, 0), 9) AS buy, round(greatest(v - w, 0), 9) AS sell,
    round(abs(w - v), 9) AS size, round(least(w, v), 9) AS reduced,
    round(0.001425 * greatest(w - v, 0) + 0.004425 * greatest(v - w, 0), 10) AS fee
    FROM (SELECT *, (CAST(symbol AS INTEGER) % 5) / 128.0 AS v FROM cands)""", "cands"))  # fmt: skip
def p25(spark, sf):
    v = F.col("symbol").cast("int") % 5 / 128.0
    x = pf.trade(F.col("w"), v)
    out = roles.candidates(spark, sf).select(
        "cand_id", "symbol",
        *[F.round(c, 9).alias(k) for k, c in x.items()],
        F.round(pf.reduce_only(F.col("w"), v), 9).alias("reduced"),
        F.round(sc.linear_fee(x["buy"], x["sell"], CostConfig()), 10).alias("fee"),
    )
    return out


@query("p29_priorities", sql(
    """SELECT dt, symbol, round(buy, 5) AS buy_score, round(-buy, 5) AS sell_score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY dt ORDER BY buy DESC, symbol) AS rank FROM (
        SELECT dt, symbol, mom5_z + broker_strength_z + imbalance_z + turnover_share_z - greatest(coalesce(abs(bias), 0) - 0.1, 0) AS buy FROM nzed))
""", "nzed"))  # fmt: skip
def p29(spark, sf):
    f = name_features(spark, sf).select(
        "dt", "symbol", "bias",
        F.col("mom5").alias("rhat_enh"), F.col("broker_strength").alias("bf"),
        F.col("imbalance").alias("imb"), F.col("turnover_share").alias("ts"),
    )
    return rounded(pf.priorities(f, ranked=True), 5, "buy_score", "sell_score")


# ---- risk of candidates -----------------------------------------------------------------

view(
    "crisk",
    """SELECT a.cand_id, sqrt(sum(CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END * a.w * b.w * cov)) AS risk
    FROM ncov JOIN cands a ON a.symbol = sym_i JOIN cands b ON b.symbol = sym_j AND b.cand_id = a.cand_id GROUP BY a.cand_id""",
    "ncov",
    "cands",
)


def vectors(spark, sf, feat):
    at = day_before_last(feat)
    return stage(rk.risk_vectors(feat, at, RISK)[1], "vectors")


def candidate_risk(spark, sf, feat):
    return stage(rk.factor_risk(roles.candidates(spark, sf), vectors(spark, sf, feat), RISK.eps), "risk")


@query("a12_portfolio_risk", sql("SELECT cand_id, round(risk, 6) AS risk FROM crisk", "crisk"))
def a12(spark, sf):
    return rounded(candidate_risk(spark, sf, name_features(spark, sf)), 6, "risk")


view("gcaps", "SELECT \"group\", CAST(gcap AS DOUBLE) AS gcap FROM (VALUES " + ", ".join(f"('{g}', {c})" for g, c in GROUP_CAPS.items()) + ') v("group", gcap)')


def scores_view(name, norm, limits="limits2"):
    turn = "sum(w_turn * abs(w - w0))" if norm == "L1" else "sqrt(sum(pow(w_turn * (w - w0), 2)))"
    view(
        name,
        f"""SELECT s.*, over_group, risk, ret_part - lin_cost - imp_cost AS obj FROM (
          SELECT cand_id, sum(w) AS sum_w, min(w) AS min_w, sum(w * rhat_enh) AS ret_part,
            sum(0.001425 * greatest(w - w0, 0) + 0.004425 * greatest(w0 - w, 0)) AS lin_cost,
            sum(coalesce(k_imp, 0) * pow(1e9 * abs(w - w0), 1.5) / 1e9) AS imp_cost, {turn} AS turnover,
            count(CASE WHEN w > cap + 1e-9 THEN 1 END) AS over_cap,
            count(CASE WHEN k_imp IS NULL AND w <> w0 THEN 1 END) AS unpriced
          FROM cands JOIN {limits} USING (symbol) GROUP BY cand_id) s
        JOIN (SELECT cand_id, count(CASE WHEN exposure > gcap + 1e-9 THEN 1 END) AS over_group FROM (
            SELECT cand_id, "group", sum(w) AS exposure FROM cands JOIN {limits} USING (symbol) GROUP BY 1, 2)
          LEFT JOIN gcaps USING ("group") GROUP BY cand_id) g ON g.cand_id = s.cand_id
        JOIN crisk r ON r.cand_id = s.cand_id""",
        "cands", limits, "gcaps", "crisk",
    )


scores_view("scores", "L1")
scores_view("scores2", "L2")
scores_view("scores3", "L1", "limits3")


def group_caps(spark):
    return spark.createDataFrame(list(GROUP_CAPS.items()), '"group" string, cap double'.replace('"', "`"))


def scores(spark, sf, target=TARGET, caps=CAPS):
    feat = name_features(spark, sf)
    names = limited(spark, sf, feat, caps)
    risk = candidate_risk(spark, sf, feat)
    return stage(
        pf.score_candidates(
            roles.candidates(spark, sf), names, risk, group_caps(spark), COST, target, NOTIONAL
        ),
        "scores",
    )


_PARTS = ("ret_part", "lin_cost", "imp_cost", "obj", "turnover", "sum_w", "min_w")
_COLS = ", ".join(f"round({c}, 7) AS {c}" for c in _PARTS) + ", round(risk, 6) AS risk, over_cap, over_group, unpriced"


@query("r3_a17_candidate_scores", sql(f"SELECT cand_id, {_COLS} FROM scores", "scores"))
def r3(spark, sf):
    out = rounded(rounded(scores(spark, sf), 7, *_PARTS), 6, "risk")
    return out.select("cand_id", *_PARTS, "risk", "over_cap", "over_group", "unpriced")


@query("a13_turnover_l2", sql("SELECT cand_id, round(turnover, 7) AS turnover FROM scores2", "scores2"))
def a13(spark, sf):
    out = scores(spark, sf, dataclasses.replace(TARGET, turn_norm="L2"))
    return rounded(out.select("cand_id", "turnover"), 7, "turnover")


@query("a10_budget", sql(
    "SELECT cand_id, round(sum(w), 9) AS sum_w, abs(sum(w) - 1) <= 1e-9 AS on_budget, min(w) >= 0 AS long_only FROM cands GROUP BY cand_id", "cands"))
def a10(spark, sf):
    return roles.candidates(spark, sf).groupBy("cand_id").agg(
        F.round(F.sum("w"), 9).alias("sum_w"),
        (F.abs(F.sum("w") - 1) <= pf.TOLERANCE).alias("on_budget"),
        (F.min("w") >= 0).alias("long_only"),
    )


@query("a11_j10_group_exposure", sql(
    """SELECT cand_id, "group", round(sum(w), 8) AS exposure, any_value(gcap) AS cap, coalesce(sum(w) > any_value(gcap) + 1e-9, false) AS over
    FROM (SELECT *, 'G' || CAST(CAST(symbol AS INTEGER) % 5 AS VARCHAR) AS "group" FROM cands) LEFT JOIN gcaps USING ("group") GROUP BY 1, 2""",
    "cands", "gcaps"))
def a11(spark, sf):
    group = F.concat(F.lit("G"), F.col("symbol").cast("int") % 5)
    sums = roles.candidates(spark, sf).groupBy("cand_id", group.alias("group")).agg(F.sum("w").alias("exposure"))
    over = F.coalesce(F.col("exposure") > F.col("cap") + pf.TOLERANCE, F.lit(False))
    out = sums.join(group_caps(spark), "group", "left").withColumn("over", over)
    return rounded(out, 8, "exposure")


def _violated(sigma, tau):
    rules = {
        "budget": "abs(sum_w - 1) > 1e-9", "long_only": "min_w < -1e-9", "risk": f"risk > {sigma} + 1e-9",
        "turnover": f"turnover > {tau} + 1e-9", "name_cap": "over_cap > 0", "group_cap": "over_group > 0",
        "no_liquidity": "unpriced > 0", "no_risk": "risk IS NULL",
    }
    return [f"CASE WHEN {r} THEN '{n}' END" for n, r in rules.items()]


@query("r4_feasibility", sql(
    f"SELECT cand_id, concat_ws(',', {', '.join(_violated(0.25, 0.70))}) AS violated FROM scores", "scores"))
def r4(spark, sf):
    out = pf.feasibility(scores(spark, sf), TARGET)
    return out.select("cand_id", F.concat_ws(",", "violated").alias("violated"))


view(
    "swept",
    """SELECT s.cand_id, sigma_star, tau_max, impact_scale, ret_part - lin_cost - imp_cost * impact_scale AS obj,
      coalesce(abs(sum_w - 1) <= 1e-9 AND min_w >= -1e-9 AND risk <= sigma_star + 1e-9 AND turnover <= tau_max + 1e-9 AND over_cap = 0 AND over_group = 0 AND unpriced = 0, false) AS feasible
    FROM scores3 s, (SELECT unnest([0.15, 0.20, 0.30, 2.0]) AS sigma_star), (SELECT unnest([0.55, 0.60, 0.65, 0.90]) AS tau_max),
      (SELECT unnest([0.7, 1.0, 1.3]) AS impact_scale)""",
    "scores3",
)


def sweep_scores(spark, sf):
    return scores(spark, sf, caps=SWEEP_CAPS)


_CELL = "CAST(sigma_star AS DOUBLE) AS sigma_star, CAST(tau_max AS DOUBLE) AS tau_max, CAST(impact_scale AS DOUBLE) AS impact_scale"


@query("j8_parameter_sweep", sql(f"SELECT cand_id, {_CELL}, round(obj, 7) AS obj, feasible FROM swept", "swept"))
def j8(spark, sf):
    out = pf.sweep(sweep_scores(spark, sf), SWEEP)
    return rounded(out.select("cand_id", *pf.CELL, "obj", "feasible"), 7, "obj")


@query("r5_best_per_cell", sql(
    f"""SELECT cand_id, {_CELL}, round(obj, 7) AS obj FROM (SELECT *, row_number() OVER (PARTITION BY sigma_star, tau_max, impact_scale
      ORDER BY obj DESC, cand_id) AS r FROM swept WHERE feasible) WHERE r = 1""", "swept"))  # fmt: skip
def r5(spark, sf):
    out = pf.best_per_cell(pf.sweep(sweep_scores(spark, sf), SWEEP))
    return rounded(out.select("cand_id", *pf.CELL, "obj"), 7, "obj")


view(
    "bestcand",
    """SELECT cand_id, obj, sigma_star, tau_max, impact_scale FROM (SELECT *, row_number() OVER (PARTITION BY cand_id
      ORDER BY obj DESC, sigma_star, tau_max, impact_scale) AS r FROM swept WHERE feasible) WHERE r = 1""",
    "swept",
)


@query("l4_best_candidates", sql(f"SELECT cand_id, {_CELL}, round(obj, 7) AS obj FROM bestcand ORDER BY obj DESC, cand_id LIMIT 30", "bestcand"))
def l4(spark, sf):
    out = pf.best_per_candidate(sweep_scores(spark, sf), SWEEP).orderBy(F.desc("obj"), "cand_id").limit(SWEEP.k_keep)
    return rounded(out, 7, "obj")


# ---- deduplication ----------------------------------------------------------------------


def crowd(spark, sf):
    """Every candidate with two near copies, and one portfolio many times over."""
    c = roles.candidates(spark, sf)
    kinds = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    every = c.select("cand_id", "symbol", "w", kinds.alias("k")).select(
        (F.col("cand_id") * 3 + F.col("k")).alias("cand_id"), "symbol",
        F.when(F.col("k") == 0, F.col("w"))
        .when(F.col("k") == 1, 0.99 * F.col("w") + 0.01 / 64)
        .otherwise(F.lit(1.0) / 64 + (F.col("cand_id") % 7 + 1) * 0.0004 * F.when(F.col("symbol").cast("int") % 2 == 0, 1).otherwise(-1))
        .alias("w"),
    )
    return every


view(
    "crowd",
    """SELECT cand_id * 3 + k AS cand_id, symbol, CASE k WHEN 0 THEN w WHEN 1 THEN 0.99 * w + 0.01 / 64
      ELSE 1.0 / 64 + (cand_id % 7 + 1) * 0.0004 * CASE WHEN CAST(symbol AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END END AS w
    FROM cands, (SELECT unnest([0, 1, 2]) AS k)""",
    "cands",
)
view(
    "crowdobj",
    "SELECT cand_id, round(sum(w * ((CAST(symbol AS INTEGER) * 37) % 64) / 64), 9) AS obj FROM crowd GROUP BY cand_id",
    "crowd",
)
def crowd_objective(c):
    i = F.col("symbol").cast("int")
    return c.groupBy("cand_id").agg(F.round(F.sum(F.col("w") * (i * 37 % 64) / 64), 9).alias("obj"))


_NEAR = """SELECT o.n, o.cand_id, o.obj, coalesce(list(p.m), CAST([] AS BIGINT[])) AS near FROM ranked o LEFT JOIN (
      SELECT a.n, b.n AS m FROM (SELECT n, symbol, w FROM ranked JOIN crowd USING (cand_id)) a
      JOIN (SELECT n, symbol, w FROM ranked JOIN crowd USING (cand_id)) b ON a.symbol = b.symbol AND b.n < a.n
      GROUP BY 1, 2 HAVING sum(abs(a.w - b.w)) <= 0.02) p ON p.n = o.n GROUP BY 1, 2, 3"""
view("ranked", "SELECT row_number() OVER (ORDER BY obj DESC, cand_id) AS n, cand_id, obj FROM crowdobj", "crowdobj")
view("crowdnear", _NEAR, "ranked", "crowd")
view(
    "greedy",
    """SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL
    SELECT c.n, CASE WHEN len(g.kept) >= 30 OR list_has_any(c.near, g.kept) THEN g.kept ELSE list_append(g.kept, c.n) END
    FROM greedy g JOIN crowdnear c ON c.n = g.n + 1""",
    "crowdnear",
)
view(
    "leaders",
    """SELECT r.cand_id, r.obj, k.place FROM (SELECT unnest(kept) AS n, generate_subscripts(kept, 1) AS place FROM greedy
      WHERE n = (SELECT max(n) FROM greedy)) k JOIN ranked r USING (n)""",
    "greedy",
    "ranked",
)


@query("u2_greedy_dedup", sql("SELECT cand_id, round(obj, 9) AS obj, CAST(place AS INTEGER) AS place FROM leaders", "leaders"))
def u2(spark, sf):
    c = stage(crowd(spark, sf), "crowd")
    return dd.greedy_keep(stage(crowd_objective(c), "objectives"), c, 0.02, 30)


@query("j9_link_counts", sql(
    """SELECT c.cand_id, c.class_id, c.n - 1 AS n_equal, count(p.m) AS n_links FROM (
      SELECT cand_id, min(cand_id) OVER (PARTITION BY ws) AS class_id, count(*) OVER (PARTITION BY ws) AS n
      FROM (SELECT cand_id, list(w ORDER BY symbol) AS ws FROM crowd GROUP BY 1)) c
    LEFT JOIN (SELECT a.cand_id, b.cand_id AS m FROM crowd a JOIN crowd b ON a.symbol = b.symbol AND a.cand_id <> b.cand_id
      GROUP BY 1, 2 HAVING sum(abs(a.w - b.w)) <= 0.02) p ON p.cand_id = c.cand_id GROUP BY ALL""", "crowd"))  # fmt: skip
def j9_counts(spark, sf):
    """All links among all candidates, copies included."""
    return near_links(stage(crowd(spark, sf), "crowd"), 0.02).counts()


@query("j9_near_duplicates", sql(
    """SELECT c.cand_id, l.cand_id AS leader_id, round(sum(abs(c.w - v.w)), 8) AS l1 FROM crowd c JOIN crowd v ON v.symbol = c.symbol
    JOIN leaders l ON l.cand_id = v.cand_id GROUP BY 1, 2 HAVING sum(abs(c.w - v.w)) <= 0.02""", "crowd", "leaders"))  # fmt: skip
def j9(spark, sf):
    c = stage(crowd(spark, sf), "crowd")
    kept = dd.greedy_keep(stage(crowd_objective(c), "objectives"), c, 0.02, 30)
    leaders = c.join(kept.select("cand_id"), "cand_id").withColumnRenamed("cand_id", "leader_id")
    out = dd.near_leaders(c, stage(leaders, "leaders"), 0.02)
    # A leader's distance to itself is 0 but for rounding.
    return out.withColumn("l1", F.round(F.abs("l1"), 8))


view("q6ranked", "SELECT row_number() OVER (ORDER BY obj DESC, cand_id) AS n, cand_id, obj FROM bestcand", "bestcand")
view("q6near", _NEAR.replace("ranked", "q6ranked").replace("crowd", "cands"), "q6ranked", "cands")
view(
    "q6greedy",
    """SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL
    SELECT c.n, CASE WHEN len(g.kept) >= 30 OR list_has_any(c.near, g.kept) THEN g.kept ELSE list_append(g.kept, c.n) END
    FROM q6greedy g JOIN q6near c ON c.n = g.n + 1""",
    "q6near",
)


@query("q6_chosen_candidates", sql(
    f"""SELECT b.cand_id, round(b.obj, 7) AS obj, CAST(k.place AS INTEGER) AS place, {_CELL} FROM (SELECT unnest(kept) AS n, generate_subscripts(kept, 1) AS place
      FROM q6greedy WHERE n = (SELECT max(n) FROM q6greedy)) k JOIN q6ranked r USING (n) JOIN bestcand b ON b.cand_id = r.cand_id""",
    "q6greedy", "q6ranked", "bestcand"))
def q6(spark, sf):
    out = choose_candidates(sweep_scores(spark, sf), roles.candidates(spark, sf), SWEEP)
    return rounded(out, 7, "obj")


# ---- objective, lots, orders ------------------------------------------------------------


@query("a18_objective", sql(
    """SELECT cand_id, round(ret_part - 0.01 / 2 * risk * risk - lin_cost - imp_cost - 0.1 * (sum_w - 1) * (sum_w - 1), 7) AS objective FROM scores""", "scores"))  # fmt: skip
def a18(spark, sf):
    out = pf.objective(scores(spark, sf), EXEC)
    return rounded(out.select("cand_id", "objective"), 7, "objective")


TIGHT = RiskTarget(sigma_star=0.12)
view(
    "scaled",
    """SELECT c.cand_id, symbol, k, w * pow(0.9, k) AS w FROM cands c JOIN (
      SELECT cand_id, CAST(CASE WHEN risk > 0.12 THEN ceil(ln(0.12 / risk) / ln(0.9)) ELSE 0 END AS INTEGER) AS k FROM crisk) f USING (cand_id)""",
    "cands",
    "crisk",
)


@query("r6_scaled_to_risk", sql("SELECT cand_id, symbol, k, round(w, 9) AS w FROM scaled", "scaled"))
def r6(spark, sf):
    feat = name_features(spark, sf)
    out = pf.scale_to_risk(roles.candidates(spark, sf), candidate_risk(spark, sf, feat), TIGHT, EXEC)
    return rounded(out, 9, "w")


def lots_view(name, weights):
    """Target lots; a held name that a candidate does not list has weight 0."""
    view(
        name,
        f"""SELECT cand_id, symbol, price, lot, n0, k_imp, lots, total - lots * lot AS odd,
          lots * lw + (total - lots * lot) * sw AS w FROM (SELECT *, floor(total / lot) AS lots FROM (
          SELECT *, floor(w / sw + (abs(w / sw) + 1) * 1e-11) AS total FROM (
          SELECT c.cand_id, n.symbol, coalesce(s.w, 0) AS w, price, lot, n0, k_imp, price / 1e9 * lot AS lw, price / 1e9 AS sw
          FROM (SELECT DISTINCT cand_id FROM {weights}) c CROSS JOIN limits2 n
          LEFT JOIN {weights} s ON s.cand_id = c.cand_id AND s.symbol = n.symbol WHERE s.w IS NOT NULL OR n.n0 <> 0)))""",
        weights,
        "limits2",
    )


# Every candidate leaves a third of the names out; those it holds must be sold.
_LISTED = "(cand_id + CAST(symbol AS INTEGER)) % 3 <> 0"
view("sparse", f"SELECT * FROM cands WHERE {_LISTED}", "cands")
lots_view("lots", "sparse")


def sparse(spark, sf):
    return roles.candidates(spark, sf).where(_LISTED.replace("INTEGER", "INT"))


def lots(spark, sf, names, weights=None):
    weights = sparse(spark, sf) if weights is None else weights
    return pf.to_lots(weights, names.select("symbol", "price", "lot", "n0"), EXEC)


@query("r7_whole_lots", sql(
    "SELECT cand_id, symbol, CAST(lots AS BIGINT) AS lots, CAST(odd AS BIGINT) AS odd, round(w + 1.23457e-12, 9) AS w FROM lots", "lots"))
def r7(spark, sf):
    out = lots(spark, sf, limited(spark, sf))
    return out.select("cand_id", "symbol", "lots", "odd", F.round(F.col("w") + 1.23457e-12, 9).alias("w"))


@query("r7_execution_result", sql(
    """SELECT l.cand_id, CAST(sum(lots) AS BIGINT) AS lots, CAST(sum(odd) AS BIGINT) AS odd, round(abs(sum(w) - 1), 8) AS budget_violation,
      round(any_value(risk), 6) AS risk FROM lots l JOIN (
      SELECT a.cand_id, sqrt(sum(CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END * a.w * b.w * cov)) AS risk
      FROM ncov JOIN lots a ON a.symbol = sym_i JOIN lots b ON b.symbol = sym_j AND b.cand_id = a.cand_id GROUP BY 1) r ON r.cand_id = l.cand_id GROUP BY 1""",
    "lots", "ncov"))
def r7_result(spark, sf):
    feat = name_features(spark, sf)
    whole = stage(lots(spark, sf, limited(spark, sf, feat)), "lots")
    risk = rk.factor_risk(whole, vectors(spark, sf, feat), RISK.eps)
    return rounded(rounded(pf.execution_result(whole, risk), 8, "budget_violation"), 6, "risk")


_ORDERS = """SELECT cand_id, sid, side, CAST(shares AS BIGINT) AS shares, lot_type, round(shares * price + 1.23457e-7, 4) AS estimated_notional,
      round(greatest(shares * price * CASE WHEN side = 'BUY' THEN 0.001425 ELSE 0.004425 END, 20.0)
        + coalesce(k_imp * pow(total * price, 1.5), 0) * shares / total + 1.23457e-7, 4) AS estimated_cost FROM (
      SELECT cand_id, symbol AS sid, side, price, k_imp, total, unnest(['BOARD', 'ODD']) AS lot_type,
        unnest([floor(total / lot) * lot, total - floor(total / lot) * lot]) AS shares FROM (
        SELECT *, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(d) AS total FROM (SELECT *, lots * lot + odd - n0 * lot AS d FROM {lots}) WHERE d <> 0))
      WHERE shares > 0"""


def _order_output(out):
    # Amounts often end on half a digit; the nudge keeps the engines' rounding together.
    cols = ("estimated_notional", "estimated_cost")
    return out.withColumns({c: F.round(F.col(c) + 1.23457e-7, 4) for c in cols})


@query("r8_p28_orders", sql(_ORDERS.format(lots="lots"), "lots"))
def r8(spark, sf):
    names = limited(spark, sf)
    out = pf.orders(lots(spark, sf, names), names, COST)
    return _order_output(out)


lots_view("clots", "cands")


@query("r7_complete_lots", sql(
    "SELECT cand_id, symbol, CAST(lots AS BIGINT) AS lots, CAST(odd AS BIGINT) AS odd, round(w + 1.23457e-12, 9) AS w FROM clots", "clots"))
def r7_complete(spark, sf):
    """Candidates that list every name."""
    out = lots(spark, sf, limited(spark, sf), roles.candidates(spark, sf))
    return out.select("cand_id", "symbol", "lots", "odd", F.round(F.col("w") + 1.23457e-12, 9).alias("w"))


@query("r8_complete_orders", sql(_ORDERS.format(lots="clots"), "clots"))
def r8_complete(spark, sf):
    names = limited(spark, sf)
    return _order_output(pf.orders(lots(spark, sf, names, roles.candidates(spark, sf)), names, COST))


view(
    "sparserisk",
    """SELECT a.cand_id, sqrt(sum(CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END * a.w * b.w * cov)) AS risk
    FROM ncov JOIN sparse a ON a.symbol = sym_i JOIN sparse b ON b.symbol = sym_j AND b.cand_id = a.cand_id GROUP BY a.cand_id""",
    "ncov",
    "sparse",
)
view(
    "q8scaled",
    """SELECT c.cand_id, symbol, w * pow(0.9, k) AS w FROM sparse c JOIN (
      SELECT cand_id, CAST(CASE WHEN risk > 0.12 THEN ceil(ln(0.12 / risk) / ln(0.9)) ELSE 0 END AS INTEGER) AS k FROM sparserisk) f USING (cand_id)""",
    "sparse",
    "sparserisk",
)
lots_view("q8lots", "q8scaled")


@query("q8_orders_of_scaled_weights", sql(_ORDERS.format(lots="q8lots"), "q8lots"))
def q8(spark, sf):
    feat = name_features(spark, sf)
    names = limited(spark, sf, feat)
    out, _ = execute(sparse(spark, sf), names, vectors(spark, sf, feat), TIGHT, COST, EXEC)
    return _order_output(out)

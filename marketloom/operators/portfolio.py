"""Costs, limits and scores of candidate portfolios; lots and orders of a chosen one.

Candidates are long rows (cand_id, symbol, w). A name without a row has weight 0; if it is held,
selling it is part of the candidate. ``names`` has one row per symbol (see ``NAME_COLUMNS``);
stage it, so that its true size decides between broadcast and shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import CapConfig, CostConfig, ExecutionConfig, RiskTarget, SweepConfig
from marketloom.functions.quantiles import exact_quantiles
from marketloom.functions.scalars import (
    impact_coefficient,
    impact_power,
    linear_fee,
    order_fee,
    unit_weights,
    weight_cap,
)
from marketloom.operators.crosssection import zscore

NAME_COLUMNS = (
    "symbol", "rhat_enh", "w0", "w_turn", "adv", "gk_vol", "imb", "bf", "bias", "ts", "group", "wmax_base",
)

# Fixed value: numerical tolerance of the limits.
TOLERANCE = 1e-9
# Ours: relative, far above rounding and far below one share.
SHARE_TOLERANCE = 1e-11


def trade(w: Column, w0: Column) -> dict[str, Column]:
    """P25: change of weight, its bought and its sold part, its size."""
    dw = w - w0
    return {
        "dw": dw,
        "buy": F.greatest(dw, F.lit(0.0)),
        "sell": F.greatest(-dw, F.lit(0.0)),
        "size": F.abs(dw),
    }


def reduce_only(w: Column, w0: Column) -> Column:
    """No name may grow."""
    return F.least(w, w0)


def names_with_limits(
    names: DataFrame,
    cost: CostConfig = CostConfig(),
    caps: CapConfig = CapConfig(),
    notional: float = 1.0,
) -> DataFrame:
    """Impact coefficient ``k_imp`` and weight cap ``cap`` per name."""
    median = F.lit(None).cast("double")
    out = names
    if caps.kappa_ts > 0:
        mid = exact_quantiles(names, [], ["ts"], [0.5]).select(F.col("ts_q")[0])
        median = mid.scalar()
    return out.withColumns(
        {
            "k_imp": impact_coefficient(F.col("gk_vol"), F.col("imb"), F.col("adv"), cost),
            "cap": weight_cap(
                F.col("wmax_base"), F.col("bf"), F.col("bias"), F.col("adv"), F.col("ts"),
                median, notional, caps,
            ),
        }
    )


def _name_terms(w: Column, cost: CostConfig, notional: float, norm: str, pwl) -> dict[str, Column]:
    """Cost and turnover terms of one name at weight ``w``; all add up over names."""
    x = trade(w, F.col("w0"))
    moved = F.col("w_turn") * x["size"]
    return {
        "lin": linear_fee(x["buy"], x["sell"], cost),
        # K (P0 u)^1.5 / P0 = K sqrt(P0) u^1.5
        "imp": F.coalesce(F.col("k_imp"), F.lit(0.0))
        * math.sqrt(notional)
        * impact_power(x["size"], pwl),
        "turn": moved if norm == "L1" else moved * moved,
        "unpriced": F.when(F.col("k_imp").isNull() & (x["size"] > 0), 1).otherwise(0),
    }


def score_candidates(
    weights: DataFrame,
    names: DataFrame,
    risk: DataFrame,
    group_caps: DataFrame | None = None,
    cost: CostConfig = CostConfig(),
    target: RiskTarget = RiskTarget(),
    notional: float = 1.0,
    pwl: tuple[float, ...] = (),
) -> DataFrame:
    """A10, A11, A13, A17 and counts of broken limits, one row per candidate.

    ``names`` come from ``names_with_limits``, ``risk`` from ``portfolio_risk``. The terms of
    the untouched holdings are summed once; a candidate's rows add the difference they make.
    """
    norm = target.turn_norm
    idle = _name_terms(F.lit(0.0), cost, notional, norm, pwl)
    acting = _name_terms(F.col("w"), cost, notional, norm, pwl)
    base = names.agg(F.struct(*[F.sum(v).alias(k) for k, v in idle.items()])).scalar()

    # A name that ``names`` does not list has neither price nor liquidity; it is counted as unpriced.
    rows = weights.join(names, "symbol", "left").fillna({"w0": 0.0, "w_turn": 1.0, "rhat_enh": 0.0})
    sums = {k: F.sum(acting[k] - idle[k]) for k in acting}
    per_group = rows.groupBy("cand_id", "group").agg(
        F.sum("w").alias("exposure"),
        F.min("w").alias("low"),
        F.sum(F.col("w") * F.col("rhat_enh")).alias("ret_part"),
        F.count_if(F.col("w") > F.col("cap") + TOLERANCE).alias("over_cap"),
        *[v.alias(k) for k, v in sums.items()],
    )
    if group_caps is not None:
        per_group = per_group.join(group_caps.select("group", F.col("cap").alias("gcap")), "group", "left")
    else:
        per_group = per_group.withColumn("gcap", F.lit(None).cast("double"))
    totals = per_group.groupBy("cand_id").agg(
        F.sum("exposure").alias("sum_w"),
        F.min("low").alias("min_w"),
        F.sum("ret_part").alias("ret_part"),
        F.sum("over_cap").alias("over_cap"),
        F.count_if(F.col("exposure") > F.col("gcap") + TOLERANCE).alias("over_group"),
        *[F.sum(k).alias(k) for k in sums],
    )
    turn = F.col("turn") + base["turn"]
    return (
        totals.join(risk.select("cand_id", "risk"), "cand_id", "left")
        .withColumn("lin_cost", F.col("lin") + base["lin"])
        .withColumn("imp_cost", F.col("imp") + base["imp"])
        .withColumn("turnover", turn if norm == "L1" else F.sqrt(F.greatest(turn, F.lit(0.0))))
        .withColumn("unpriced", F.col("unpriced") + base["unpriced"])
        .withColumn("obj", F.col("ret_part") - F.col("lin_cost") - F.col("imp_cost"))
        .drop("lin", "imp", "turn")
    )


def violations(sigma_star: Column, tau: Column, m: float = 1.0, budget: float = 1.0) -> Column:
    """Names of the broken rules, in a fixed order; empty means feasible. ``budget`` is the total
    that the weights must have."""
    rules = [
        ("budget", F.abs(F.col("sum_w") - budget) > TOLERANCE),
        ("long_only", F.col("min_w") < -TOLERANCE),
        ("risk", F.col("risk") > m * sigma_star + TOLERANCE),
        ("turnover", F.col("turnover") > tau + TOLERANCE),
        ("name_cap", F.col("over_cap") > 0),
        ("group_cap", F.col("over_group") > 0),
        ("no_liquidity", F.col("unpriced") > 0),
        ("no_risk", F.col("risk").isNull()),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def feasibility(scores: DataFrame, target: RiskTarget = RiskTarget(), budget: float = 1.0) -> DataFrame:
    out = scores.withColumn(
        "violated", violations(F.lit(target.sigma_star), F.lit(target.tau_max), target.m, budget)
    )
    return out.withColumn("feasible", F.size("violated") == 0)


def sweep_cells(cfg: SweepConfig) -> Column:
    """The parameter grid as an array of constants."""
    return F.array(
        *[
            F.struct(
                F.lit(s).alias("sigma_star"), F.lit(t).alias("tau_max"), F.lit(i).alias("impact_scale")
            )
            for s in cfg.sigma_star
            for t in cfg.tau
            for i in cfg.impact_scale
        ]
    )


def sweep(
    scores: DataFrame, cfg: SweepConfig = SweepConfig(), m: float = 1.0, budget: float = 1.0
) -> DataFrame:
    """Every candidate in every cell; the grid rides along as a constant array."""
    cells = scores.select("*", F.explode(sweep_cells(cfg)).alias("_c")).select("*", "_c.*").drop("_c")
    return cells.withColumns(
        {
            "imp_cost": F.col("imp_cost") * F.col("impact_scale"),
            "obj": F.col("ret_part") - F.col("lin_cost") - F.col("imp_cost") * F.col("impact_scale"),
            "feasible": F.size(violations(F.col("sigma_star"), F.col("tau_max"), m, budget)) == 0,
        }
    )


CELL = ("sigma_star", "tau_max", "impact_scale")


def best_per_cell(swept: DataFrame) -> DataFrame:
    """The best feasible candidate of each cell, the smaller id among equals.

    The limit per cell runs before the shuffle, so a cell sends one row per task.
    """
    best = Window.partitionBy(*CELL).orderBy(F.desc("obj"), "cand_id")
    return (
        swept.where("feasible")
        .withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .drop("_r")
    )


def best_per_candidate(
    scores: DataFrame, cfg: SweepConfig = SweepConfig(), m: float = 1.0, budget: float = 1.0
) -> DataFrame:
    """Q6: each candidate once, under its best feasible cell: the input of the deduplication.

    Worked out within the candidate's row: the grid is an array of constants, nothing is shuffled.
    """
    feasible = F.filter(
        sweep_cells(cfg), lambda c: F.size(violations(c["sigma_star"], c["tau_max"], m, budget)) == 0
    )

    def graded(c: Column) -> Column:
        obj = F.col("ret_part") - F.col("lin_cost") - F.col("imp_cost") * c["impact_scale"]
        return F.struct(obj.alias("obj"), *[(-c[k]).alias(k) for k in CELL])

    best = F.array_max(F.transform(feasible, graded))
    return (
        scores.withColumn("_c", best)
        .where("_c IS NOT NULL")
        .select("cand_id", F.col("_c.obj").alias("obj"), *[(-F.col(f"_c.{k}")).alias(k) for k in CELL])
    )


def objective(
    scores: DataFrame, cfg: ExecutionConfig = ExecutionConfig(), budget: float = 1.0
) -> DataFrame:
    """Return less half the risk penalty, costs and the budget penalty."""
    return scores.withColumn(
        "objective",
        F.col("ret_part")
        - cfg.lambda_risk / 2.0 * F.col("risk") * F.col("risk")
        - F.col("lin_cost")
        - F.col("imp_cost")
        - cfg.lambda_budget * (F.col("sum_w") - budget) * (F.col("sum_w") - budget),
    )


def scale_to_risk(
    weights: DataFrame,
    risk: DataFrame,
    target: RiskTarget = RiskTarget(),
    cfg: ExecutionConfig = ExecutionConfig(),
) -> DataFrame:
    """R6 (ours): shrink a portfolio by the smallest power of rho that meets the risk limit."""
    rho, limit = cfg.risk_quick_scale, target.m * target.sigma_star
    if not 0.0 < rho < 1.0:
        raise ValueError("risk_quick_scale must lie between 0 and 1")
    steps = F.ceil(F.ln(F.lit(limit) / F.col("risk")) / math.log(rho))
    k = F.when(F.col("risk") > limit, steps).otherwise(0).cast("int")
    factors = risk.select("cand_id", k.alias("k"), F.pow(F.lit(rho), k).alias("factor"))
    return weights.join(factors, "cand_id").select(
        "cand_id", "symbol", "k", (F.col("w") * F.col("factor")).alias("w")
    )


def to_lots(
    weights: DataFrame, holdings: DataFrame, cfg: ExecutionConfig = ExecutionConfig()
) -> DataFrame:
    """R7, P24 (ours): whole lots, rounded down; the rest in whole shares if odd lots are on.

    ``holdings`` has (symbol, price, lot, n0). ``w`` becomes the realised weight. A held name that a
    candidate does not list gets weight 0, so that it is sold. Where price, lot or holding is missing
    or not positive, ``tradable`` is false and the name stays as it is held.
    """
    own = weights.groupBy("cand_id").agg(F.collect_set("symbol").alias("own"))
    held = holdings.where("n0 <> 0").agg(F.collect_set("symbol")).scalar()
    unlisted = own.select("cand_id", F.explode(F.array_except(held, "own")).alias("symbol"))
    targets = weights.select("cand_id", "symbol", "w").unionByName(unlisted.withColumn("w", F.lit(0.0)))
    lot_w, share_w = unit_weights(F.col("price"), F.col("lot"), cfg.notional)
    tradable = F.coalesce((F.col("price") > 0) & (F.col("lot") > 0) & F.col("n0").isNotNull(), F.lit(False))
    out = targets.join(holdings, "symbol", "left").withColumns(
        {"lot_w": lot_w, "share_w": share_w, "tradable": tradable}
    )
    if cfg.reduce_only:
        out = out.withColumn("w", reduce_only(F.col("w"), F.col("n0") * F.col("lot_w")))
    # Counted in whole shares; the tolerance keeps a quotient a hair below a whole number whole.
    quotient = F.when(F.col("tradable"), F.try_divide("w", "share_w"))
    shares = F.floor(quotient + (F.abs(quotient) + 1) * SHARE_TOLERANCE)
    lots = F.when(F.col("tradable"), F.floor(F.try_divide("shares", "lot"))).otherwise(F.col("n0").cast("bigint"))
    odd = F.col("shares") - F.col("lots") * F.col("lot") if cfg.odd_lots else F.lit(0)
    return (
        out.withColumn("shares", shares)
        .withColumn("lots", lots)
        .withColumn("odd", F.when(F.col("tradable"), odd).otherwise(0).cast("bigint"))
        .withColumn("w", F.col("lots") * F.col("lot_w") + F.col("odd") * F.col("share_w"))
        .drop("lot_w", "share_w", "shares")
    )


def execution_result(lots: DataFrame, risk: DataFrame, budget: float = 1.0) -> DataFrame:
    """Residual budget and realised risk of the rounded portfolios."""
    totals = lots.groupBy("cand_id").agg(
        F.sum("w").alias("sum_w"), F.sum("lots").alias("lots"), F.sum("odd").alias("odd")
    )
    return (
        totals.join(risk, "cand_id", "left")
        .withColumn("budget_violation", F.abs(F.col("sum_w") - budget))
        .drop("sum_w")
    )


def orders(
    lots: DataFrame, names: DataFrame, cost: CostConfig = CostConfig()
) -> DataFrame:
    """Board-lot and odd-lot orders from the holdings to the target.

    The estimate holds fee, tax and the order's share of the name's impact. Names that are not
    tradable have no order; ``to_lots`` lists them.
    """
    target = F.col("lots") * F.col("lot") + F.col("odd")
    delta = target - F.col("n0") * F.col("lot")
    moved = (
        lots.withColumn("delta", delta)
        .where("tradable AND delta <> 0")
        .join(names.select("symbol", "k_imp"), "symbol", "left")
        .withColumns(
            {
                "side": F.when(F.col("delta") > 0, "BUY").otherwise("SELL"),
                "total": F.abs("delta"),
            }
        )
        .withColumn("board", F.floor(F.col("total") / F.col("lot")) * F.col("lot"))
    )
    parts = F.explode(
        F.array(
            F.struct(F.lit("BOARD").alias("lot_type"), F.col("board").alias("shares")),
            F.struct(F.lit("ODD").alias("lot_type"), (F.col("total") - F.col("board")).alias("shares")),
        )
    )
    notional = F.col("shares") * F.col("price")
    impact = F.col("k_imp") * F.pow(F.col("total") * F.col("price"), F.lit(1.5))
    return (
        moved.select("cand_id", "symbol", "side", "price", "k_imp", "total", parts.alias("_p"))
        .select("*", "_p.*")
        .where("shares > 0")
        .select(
            "cand_id",
            F.col("symbol").alias("sid"),
            "side",
            F.col("shares").cast("bigint").alias("shares"),
            "lot_type",
            notional.alias("estimated_notional"),
            (
                order_fee(F.col("side"), notional, cost)
                + F.coalesce(impact, F.lit(0.0)) * F.col("shares") / F.col("total")
            ).alias("estimated_cost"),
        )
    )


def priorities(
    names: DataFrame, theta_bias: float = 0.10, top: int = 0, ranked: bool = False
) -> DataFrame:
    """P29, W11 (ours): buy score per name and date, sell score its opposite.

    ``names`` has (dt, symbol, rhat_enh, bf, imb, ts, bias). ``ranked`` adds the rank of every name,
    ``top`` > 0 keeps the best ranks only.
    """
    cols = ["rhat_enh", "bf", "imb", "ts"]
    z = zscore(names, cols, suffix="_z")
    excess = F.greatest(F.coalesce(F.abs("bias"), F.lit(0.0)) - theta_bias, F.lit(0.0))
    buy = F.col("rhat_enh_z") + F.col("bf_z") + F.col("imb_z") + F.col("ts_z") - excess
    out = z.select("dt", "symbol", buy.alias("buy_score"), (-buy).alias("sell_score"))
    if top or ranked:
        best = Window.partitionBy("dt").orderBy(F.desc("buy_score"), "symbol")
        out = out.withColumn("rank", F.row_number().over(best))
    return out.where(F.col("rank") <= top) if top else out

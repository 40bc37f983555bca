"""From candidates to orders (Q6, Q8) and policy evaluation (Q7)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketloom.config import CostConfig, ExecutionConfig, PolicyConfig, RiskTarget, SweepConfig
from marketloom.operators import policy as pol
from marketloom.operators import portfolio as pf
from marketloom.operators.dedup import greedy_keep
from marketloom.operators.risk import factor_risk
from marketloom.session import stage


def choose_candidates(
    scores: DataFrame, weights: DataFrame, cfg: SweepConfig = SweepConfig(), m: float = 1.0
) -> DataFrame:
    """Q6: best feasible cell per candidate, near-duplicates removed, the best ``k_keep`` kept."""
    best = stage(pf.best_per_candidate(scores, cfg, m), "best")
    kept = greedy_keep(best, stage(weights, "weights"), cfg.dedup_l1_radius, cfg.k_keep)
    return best.join(kept.select("cand_id", "place"), "cand_id")


def execute(
    weights: DataFrame,
    names: DataFrame,
    vectors: DataFrame,
    target: RiskTarget = RiskTarget(),
    cost: CostConfig = CostConfig(),
    cfg: ExecutionConfig = ExecutionConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Q8: orders, and the realised risk and budget of the rounded portfolios (a plan until it is read).

    ``vectors`` is the factor form of the risk (``operators.risk.risk_vectors``).
    """
    scaled = pf.scale_to_risk(weights, stage(factor_risk(weights, vectors), "risk"), target, cfg)
    holdings = names.select("symbol", "price", "lot", "n0")
    whole = stage(pf.to_lots(scaled, holdings, cfg), "lots")
    result = pf.execution_result(whole, factor_risk(whole, vectors))
    return pf.orders(whole, names, cost), result


def evaluate_policy(
    samples: DataFrame,
    occupation: DataFrame,
    transitions: DataFrame,
    cfg: PolicyConfig = PolicyConfig(),
) -> DataFrame:
    """Q7: per state the policy's expected return, expected tail loss and inflow.

    Only the base pairs (L5, L6) enter, if the configuration asks for a selection.
    """
    if cfg.top_k_by_mean or cfg.max_pairs:
        pairs = stage(pol.base_pairs(pol.mean_returns(samples), cfg), "pairs")
        samples = samples.join(pairs.select("state", "action"), ["state", "action"], "left_semi")
        occupation = occupation.join(
            pairs.select("state", "action"), ["state", "action"], "left_semi"
        )
    states = pol.evaluate(samples, occupation, cfg)
    return states.join(pol.next_states(occupation, transitions), "state", "left")

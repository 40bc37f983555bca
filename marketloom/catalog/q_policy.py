"""Queries: policy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import roles
from marketloom.catalog.base import query, rounded, sql, view
from marketloom.config import PolicyConfig
from marketloom.operators import policy as pol
from marketloom.plans.decide import evaluate_policy
from marketloom.session import stage

view("means", "SELECT state, action, avg(ret) AS mean_ret FROM samples GROUP BY 1, 2", "samples")
view(
    "tails",
    """SELECT s.state, s.action, count(*) AS n, any_value(v) AS var, avg(CASE WHEN -ret >= v - 1e-12 THEN -ret END) AS cvar FROM samples s
    JOIN (SELECT state, action, quantile_cont(-ret, 0.95) AS v FROM samples GROUP BY 1, 2) q ON q.state = s.state AND q.action = s.action GROUP BY 1, 2""",
    "samples",
)
view(
    "pis",
    """SELECT *, CASE WHEN sum(x) OVER (PARTITION BY state) > 0 THEN x / sum(x) OVER (PARTITION BY state) ELSE x END AS pi FROM occ""",
    "occ",
)


def samples(spark, sf):
    return stage(roles.policy_samples(spark, sf), "samples")


@query("a8_mean_returns", sql("SELECT state, action, round(mean_ret, 8) AS mean_ret FROM means", "means"))
def a8(spark, sf):
    return rounded(pol.mean_returns(roles.policy_samples(spark, sf)), 8, "mean_ret")


@query("a9_tail_risk", sql("SELECT state, action, n, round(var, 7) AS var, round(cvar, 7) AS cvar FROM tails", "tails"))
def a9(spark, sf):
    return rounded(pol.tail_risk(samples(spark, sf)), 7, "var", "cvar")


@query("w15_policy", sql("SELECT state, action, x, round(pi, 8) AS pi FROM pis", "pis"))
def w15(spark, sf):
    return rounded(pol.policy(roles.occupation(spark, sf)), 8, "pi")


@query("j11_next_states", sql(
    """SELECT j AS state, round(sum(p * x), 5) AS inflow, round(sum(p * x) / (SELECT sum(p * x) FROM trans t JOIN occ o ON t.i = o.state AND t.a = o.action), 8) AS share
    FROM trans JOIN occ ON i = state AND a = action GROUP BY j""", "trans", "occ"))  # fmt: skip
def j11(spark, sf):
    out = pol.next_states(roles.occupation(spark, sf), roles.transitions(spark, sf))
    return rounded(rounded(out, 5, "inflow"), 8, "share")


_TOP = """SELECT state, action, row_number() OVER (PARTITION BY state ORDER BY mean_ret DESC, action) AS r, mean_ret FROM means"""


@query("l5_top_actions", sql(
    f"SELECT state, action, round(mean_ret, 8) AS mean_ret, CAST(r AS INTEGER) AS rank FROM ({_TOP}) WHERE r <= 3", "means"))
def l5(spark, sf):
    return rounded(pol.top_actions(pol.mean_returns(roles.policy_samples(spark, sf)), 3), 8, "mean_ret")


_PAIRS = f"""SELECT state, action, r <= 2 AS is_top FROM ({_TOP})
    ORDER BY r <= 2 DESC, md5(state || '|' || action || '|12345') LIMIT 20"""
PICK = PolicyConfig(top_k_by_mean=2, max_pairs=20)


@query("l6_base_pairs", sql(_PAIRS, "means"))
def l6(spark, sf):
    return pol.base_pairs(stage(pol.mean_returns(roles.policy_samples(spark, sf)), "means"), PICK)


def _evaluated(pairs):
    """Evaluation over all pairs, or over the base pairs."""
    keep = f"JOIN ({_PAIRS}) k ON k.state = o.state AND k.action = o.action" if pairs else ""
    return f"""SELECT state, round(exp_ret, 7) AS exp_ret, round(exp_cvar, 7) AS exp_cvar, round(pi_total, 7) AS pi_total, round(inflow, 5) AS inflow, round(share, 8) AS share
    FROM (SELECT e.state, sum(pi * mean_ret) AS exp_ret, sum(pi * cvar) AS exp_cvar, sum(pi) AS pi_total FROM (
        SELECT o.state, o.action, CASE WHEN sum(x) OVER (PARTITION BY o.state) > 0 THEN x / sum(x) OVER (PARTITION BY o.state) ELSE x END AS pi FROM occ o {keep}) e
      JOIN means m ON m.state = e.state AND m.action = e.action JOIN tails t ON t.state = e.state AND t.action = e.action GROUP BY 1) s
    LEFT JOIN (SELECT j, inflow, inflow / sum(inflow) OVER () AS share FROM (
        SELECT j, sum(p * x) AS inflow FROM trans JOIN (SELECT o.* FROM occ o {keep}) z ON i = z.state AND a = z.action GROUP BY j)) f ON f.j = s.state"""


def _output(df):
    return rounded(rounded(rounded(df, 7, "exp_ret", "exp_cvar", "pi_total"), 5, "inflow"), 8, "share")


@query("r9_policy_evaluation", sql(_evaluated(False), "occ", "means", "tails", "trans"))
def r9(spark, sf):
    occ = stage(roles.occupation(spark, sf), "occupation")
    return _output(evaluate_policy(samples(spark, sf), occ, roles.transitions(spark, sf)))


@query("q7_policy_on_base_pairs", sql(_evaluated(True), "occ", "means", "tails", "trans"))
def q7(spark, sf):
    occ = stage(roles.occupation(spark, sf), "occupation")
    return _output(evaluate_policy(samples(spark, sf), occ, roles.transitions(spark, sf), PICK))

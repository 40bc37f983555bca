"""Evaluation of a given policy from return samples, transitions and occupations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import PolicyConfig
from marketloom.functions.quantiles import tail_mean


def mean_returns(samples: DataFrame) -> DataFrame:
    """Mean return per (state, action)."""
    return samples.groupBy("state", "action").agg(F.avg("ret").alias("mean_ret"))


def tail_risk(samples: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """A9 (ours): VaR and CVaR of the loss (minus the return) per (state, action)."""
    losses = samples.select("state", "action", (-F.col("ret")).alias("loss"))
    return tail_mean(losses, ["state", "action"], "loss", cfg.alpha)


def policy(occupation: DataFrame) -> DataFrame:
    """pi(a | s) = x / sum of the state's x; a state without occupation stays as it is."""
    total = occupation.groupBy("state").agg(F.sum("x").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("x") / F.col("_total")).otherwise(F.col("x"))
    return occupation.join(total, "state").withColumn("pi", share).drop("_total")


def top_actions(means: DataFrame, k: int) -> DataFrame:
    """The ``k`` best actions of each state by mean return; 0 keeps all.

    The limit runs ahead of the shuffle as well, so a crowded state sends k rows per task.
    """
    if k <= 0:
        return means
    best = Window.partitionBy("state").orderBy(F.desc("mean_ret"), "action")
    return means.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def base_pairs(means: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """The top actions, then pairs in a seeded random order, up to ``max_pairs`` in all.

    The order is a hash of pair and seed, hence the same on every run and cluster size.
    """
    if cfg.top_k_by_mean <= 0 and cfg.max_pairs <= 0:
        return means.select("state", "action", F.lit(True).alias("is_top"))
    top = top_actions(means, cfg.top_k_by_mean or 0).select(
        "state", "action", F.lit(cfg.top_k_by_mean > 0).alias("is_top")
    )
    if cfg.max_pairs <= 0:
        return top
    key = F.concat_ws("|", "state", "action", F.lit(str(cfg.seed)))
    marked = means.join(top, ["state", "action"], "left").select(
        "state", "action", F.coalesce("is_top", F.lit(False)).alias("is_top")
    )
    return marked.orderBy(F.desc("is_top"), F.md5(key)).limit(cfg.max_pairs)


def next_states(occupation: DataFrame, transitions: DataFrame) -> DataFrame:
    """Flow into each next state, and its share of the whole."""
    flow = (
        transitions.join(
            occupation, (F.col("i") == F.col("state")) & (F.col("a") == F.col("action"))
        )
        .groupBy("j")
        .agg(F.sum(F.col("p") * F.col("x")).alias("inflow"))
    )
    total = flow.agg(F.sum("inflow")).scalar()
    share = F.when(total > 0, F.col("inflow") / total)
    return flow.select(F.col("j").alias("state"), "inflow", share.alias("share"))


def evaluate(
    samples: DataFrame, occupation: DataFrame, cfg: PolicyConfig = PolicyConfig()
) -> DataFrame:
    """Expected return and expected tail loss per state under the policy."""
    pi = policy(occupation)
    stats = mean_returns(samples).join(tail_risk(samples, cfg), ["state", "action"])
    return (
        pi.join(stats, ["state", "action"])
        .groupBy("state")
        .agg(
            F.sum(F.col("pi") * F.col("mean_ret")).alias("exp_ret"),
            F.sum(F.col("pi") * F.col("cvar")).alias("exp_cvar"),
            F.sum("pi").alias("pi_total"),
        )
    )

"""Greedy removal of near-duplicate portfolios.

Candidates are taken in order of (objective descending, id); one within the l1 radius of an
already kept one goes. Only the best can be kept, so a few of them are settled at a time. All links among all
candidates are in ``operators.neighbours``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.session import stage


def near_leaders(weights: DataFrame, leaders: DataFrame, radius: float) -> DataFrame:
    """(cand_id, leader_id, l1) for every candidate within ``radius`` of a leader.

    ``leaders`` are long weights of a few portfolios (leader_id, symbol, w). Summing
    |w - v| - |v| over a candidate's rows and adding the leader's total leaves out names
    that only the leader holds, so sparse rows are enough.
    """
    v = leaders.withColumnRenamed("w", "v")
    per_name = v.groupBy("symbol").agg(F.collect_list(F.struct("leader_id", "v")).alias("held"))
    masses = leaders.groupBy("leader_id").agg(F.sum(F.abs("w")).alias("mass"))
    mass_of = masses.agg(F.map_from_entries(F.collect_list(F.struct("leader_id", "mass")))).scalar()
    own = weights.groupBy("cand_id").agg(F.sum(F.abs("w")).alias("own"))

    delta = F.abs(F.col("w") - F.col("h.v")) - F.abs("h.v") - F.abs("w")
    common = (
        weights.join(per_name, "symbol")
        .select("cand_id", "w", F.explode("held").alias("h"))
        .select("cand_id", F.col("h.leader_id").alias("leader_id"), delta.alias("delta"))
    )
    # Without a common name the distance is both masses: near only where both are almost empty.
    apart = (
        own.select("cand_id", "own", F.explode(mass_of).alias("leader_id", "mass"))
        .where(F.col("own") + F.col("mass") <= radius)
        .select("cand_id", "leader_id", F.lit(0.0).alias("delta"))
    )
    parts = common.unionByName(apart).groupBy("cand_id", "leader_id").agg(F.sum("delta").alias("delta"))
    return (
        parts.join(own, "cand_id")
        .withColumn("l1", F.col("delta") + F.col("own") + mass_of[F.col("leader_id")])
        .where(F.col("l1") <= radius)
        .select("cand_id", "leader_id", "l1")
    )


def _greedy(batch: pd.DataFrame, radius: float) -> list[bool]:
    """Which of the candidates (``w`` maps names to weights, best first) stay."""
    names = {n: k for k, n in enumerate(sorted({n for w in batch["w"] for n in w}))}
    x = np.zeros((len(batch), len(names)))
    for i, w in enumerate(batch["w"]):
        for n, v in w.items():
            x[i, names[n]] = v or 0.0
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or np.abs(x[kept] - x[i]).sum(axis=1).min() > radius:
            kept.append(i)
    stays = np.zeros(len(x), bool)
    stays[kept] = True
    return stays.tolist()


def greedy_keep(
    scored: DataFrame, weights: DataFrame, radius: float = 0.02, k_keep: int = 30, batch: int = 256
) -> DataFrame:
    """(cand_id, obj, place) of the kept candidates, best first.

    A round takes the ``batch`` best undecided candidates, settles them among themselves by their true distances in one
    small task, and drops from the rest whoever is near a kept one. Each round keeps one at least, and it ends as
    soon as ``k_keep`` are kept, so mostly one round suffices whatever the objectives follow. Rounds are staged tables; the
    driver sees counts. Both inputs are read per round: stage them. ``scored`` is (cand_id, obj), a null objective is the
    worst; a candidate without weights lies at zero.
    """
    if k_keep < 1 or batch < 1:
        raise ValueError("k_keep and batch must be positive")
    order = (F.col("obj").desc_nulls_last(), F.col("cand_id"))
    pool = scored.select("cand_id", "obj")
    kept, n = None, 0
    kind = pool.schema["cand_id"].dataType.simpleString()

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        return rows.loc[_greedy(rows, radius), ["cand_id", "obj"]]

    while n < k_keep:
        best = stage(pool.orderBy(*order).limit(batch), "best")
        held = weights.join(best.select("cand_id"), "cand_id", "left_semi").groupBy("cand_id").agg(
            F.map_from_entries(F.collect_list(F.struct("symbol", "w"))).alias("w")
        )
        # At most ``batch`` rows.
        place = F.row_number().over(Window.orderBy(*order))
        some = best.join(held, "cand_id", "left").select(
            "cand_id", "obj", F.coalesce("w", F.create_map().cast("map<string,double>")).alias("w"), place.alias("nth"), F.lit(0).alias("one")
        )
        new = stage(some.groupBy("one").applyInPandas(settle, f"cand_id {kind}, obj double"), "settled")
        found = new.count()
        if not found:
            break
        kept = new if kept is None else kept.unionByName(new)
        n += found
        if n >= k_keep:
            break
        leaders = stage(weights.join(new.select("cand_id"), "cand_id", "left_semi").withColumnRenamed("cand_id", "leader_id"), "leaders")
        rest = pool.join(best.select("cand_id"), "cand_id", "left_anti")
        near = near_leaders(weights, leaders, radius).select("cand_id")
        rest = rest.join(near, "cand_id", "left_anti")
        # Whoever is near zero goes if a kept candidate holds nothing; it has no weights to join on.
        pool = stage(_without_empty(rest, weights, new, radius), "undecided")
    kept = pool.limit(0) if kept is None else kept
    return kept.select("cand_id", "obj", F.row_number().over(Window.orderBy(*order)).alias("place")).where(F.col("place") <= k_keep)


def _without_empty(rest: DataFrame, weights: DataFrame, kept: DataFrame, radius: float) -> DataFrame:
    """Candidates whose total weight is within the radius are near a kept one without weights, and those without any
    are near a kept one whose total is."""
    mass = weights.groupBy("cand_id").agg(F.sum(F.abs("w")).alias("mass"))
    light = kept.join(mass, "cand_id", "left").select(F.coalesce("mass", F.lit(0.0)).alias("m")).agg(F.min("m")).first()[0]
    if light > radius:
        return rest
    own = F.coalesce("mass", F.lit(0.0))
    alone = rest.join(mass, "cand_id", "left")
    near = (own <= radius) if light == 0 else (own == 0)
    return alone.where(~near).select(*rest.columns)

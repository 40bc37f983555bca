"""Boosted trees by distributed histograms, walk-forward (M4).

Every ``step`` days a model is fitted on the days of its window and scores the days until the next one. All models grow
side by side, level by level: tasks add up weights and residuals for each model, node, feature and bin of their rows, one
aggregation merges these sums, and the best split of each node is found on them. A row is kept once, with its bins, whatever
the number of models it trains: its residual and its node under a model follow from the trees so far, which are a few
numbers for each node and travel with the tasks. What is shuffled is sums, at most models x nodes x features x bins for
each task.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.config import FEATURES
from marketloom.session import stage

_MOST_NODES = 2_000_000
# Sums that a task holds before it hands them on (16 bytes each).
_MOST_SUMS = 4_000_000

# Of one model: for each level the feature (-1: no split) and the cut by node, and the value by node.
Tree = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]


@dataclasses.dataclass(frozen=True)
class BoostConfig:
    """M4 (ours): squared loss, no intercept. ``clip`` is that of the z-scores; bins are of equal width between."""

    window: int = 252
    half_life: float = 60.0
    step: int = 21
    trees: int = 10
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    lam: float = 1.0
    clip: float = 3.0

    def __post_init__(self):
        if min(self.window, self.step, self.trees, self.depth, self.bins) < 1:
            raise ValueError("window, step, trees, depth and bins must be positive")


def bin_of(x: str, cfg: BoostConfig) -> Column:
    """Place of a standardised value; a missing one counts as 0, as in the linear fits."""
    at = F.floor((F.coalesce(F.col(x), F.lit(0.0)) + cfg.clip) * (cfg.bins / (2 * cfg.clip)))
    return F.greatest(F.least(at, F.lit(cfg.bins - 1)), F.lit(0)).cast("int")


def binned_rows(sections: DataFrame, xs: Sequence[str], cfg: BoostConfig) -> DataFrame:
    """``dt, t, symbol, label, b0, ...``: each row once, with the bins of its values."""
    return sections.select("dt", "t", "symbol", "label", *[bin_of(x, cfg).alias(f"b{i}") for i, x in enumerate(xs)])


def _nodes(bins: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Node of each row; the children of ``n`` are ``2 n`` and ``2 n + 1``, and a node without a split keeps its rows."""
    node, at = np.ones(len(bins), "int64"), np.arange(len(bins))
    for feature, cut in levels:
        f = feature[node]
        node = np.where(f < 0, node, node * 2 + (bins[at, f] > cut[node]))
    return node


def _residuals(bins: np.ndarray, r: np.ndarray, trees: list[dict[int, Tree]], fit: int) -> np.ndarray:
    for tree in trees:
        if fit in tree:
            levels, value = tree[fit]
            r = r - value[_nodes(bins, levels)]
    return r


def _batch(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Days and bins of a batch's rows."""
    t = batch.column("t").to_numpy().astype("int64")
    return t, np.stack([batch.column(f"b{i}").to_numpy() for i in range(p)], axis=1)


def histograms(rows: DataFrame, p: int, cfg: BoostConfig, last_fit: int, trees: list[dict[int, Tree]], grown: dict[int, list], level: int) -> DataFrame:
    """``fit, node, feature, bin, h, g``: sums of weights and of weighted residuals. Model k is fitted on the ``window`` days
    before day ``k step``; a day's rows weigh by their age. ``grown``: the splits so far of the tree that grows."""
    top = 2 << level

    def summed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for fit, both in sums.items():
            node, feature, at = np.nonzero(both[0])
            h, g = (x[node, feature, at] for x in both)
            ints = [np.full(len(h), fit, "int64"), node.astype("int64"), feature.astype("int32"), at.astype("int32")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ints, h, g)], names=["fit", "node", "feature", "bin", "h", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            t, bins = _batch(batch, p)
            order = np.argsort(t, kind="stable")
            t, bins, label = t[order], bins[order], batch.column("label").to_numpy(zero_copy_only=False)[order]
            for fit in range(int(t[0]) // cfg.step + 1, min((int(t[-1]) + cfg.window) // cfg.step, last_fit) + 1):
                a, b = np.searchsorted(t, [fit * cfg.step - cfg.window, fit * cfg.step])
                if a == b:
                    continue
                x = bins[a:b]
                w = 2.0 ** ((t[a:b] - (fit * cfg.step - 1)) / cfg.half_life)
                g = w * _residuals(x, label[a:b], trees, fit)
                place = _nodes(x, grown.get(fit, [])) * cfg.bins
                if fit not in sums:
                    if len(sums) * top * p * cfg.bins * 2 > _MOST_SUMS:
                        yield from summed(sums)
                        sums = {}
                    sums[fit] = np.zeros((2, top, p, cfg.bins))
                for i in range(p):
                    for total, each in zip(sums[fit], (w, g)):
                        total[:, i] += np.bincount(place + x[:, i], each, top * cfg.bins).reshape(top, cfg.bins)
        yield from summed(sums)

    known = rows.where("label IS NOT NULL").select("t", "label", *[f"b{i}" for i in range(p)])
    parts = known.mapInArrow(run, "fit bigint, node bigint, feature int, bin int, h double, g double")
    return parts.groupBy("fit", "node", "feature", "bin").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))


def best_splits(sums: DataFrame, cfg: BoostConfig) -> DataFrame:
    """``fit, node, feature, bin, hl, gl``: values up to ``bin`` go left, ``hl`` and ``gl`` are their sums. Ties go to the lower
    feature, then the lower bin."""
    # One row for each bin of a feature at most.
    left = Window.partitionBy("fit", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("fit", "node", "feature")
    run = sums.select(
        "fit", "node", "feature", "bin", F.sum("h").over(left).alias("hl"), F.sum("g").over(left).alias("gl"),
        F.sum("h").over(whole).alias("h"), F.sum("g").over(whole).alias("g"), F.max("bin").over(whole).alias("top"),
    ).where("bin < top")
    part = lambda g, h: g * g / (h + cfg.lam)
    c = {k: F.col(k) for k in ("hl", "gl", "h", "g")}
    gain = part(c["gl"], c["hl"]) + part(c["g"] - c["gl"], c["h"] - c["hl"]) - part(c["g"], c["h"])
    best = run.select("fit", "node", gain.alias("gain"), "feature", "bin", "hl", "gl").where("gain > 1e-12")
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "hl", "gl")
    return best.groupBy("fit", "node").agg(F.max(order).alias("s")).select(
        "fit", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.hl", "s.gl"
    )


def _grow(rows: DataFrame, p: int, cfg: BoostConfig, last_fit: int, trees: list[dict[int, Tree]]) -> dict[int, Tree]:
    """One more tree of every model. A level's splits and sums by node come to the driver, a row for each node."""
    grown: dict[int, list] = {}
    for level in range(cfg.depth):
        sums = stage(histograms(rows, p, cfg, last_fit, trees, grown, level), "boost_sums")
        totals = sums.where("feature = 0").groupBy("fit", "node").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))
        found = totals.join(best_splits(sums, cfg), ["fit", "node"], "left").collect()
        for fit in {r.fit for r in found}:
            grown.setdefault(fit, []).append((np.full(2 << level, -1), np.zeros(2 << level, "int64")))
        for r in found:
            if r.feature is not None:
                feature, cut = grown[r.fit][level]
                feature[r.node], cut[r.node] = r.feature, r.bin
    value = {fit: np.zeros(2 << cfg.depth) for fit in grown}
    leaf = lambda g, h: cfg.rate * g / (h + cfg.lam)
    for r in found:
        if r.feature is None:
            value[r.fit][r.node] = leaf(r.g, r.h)
        else:
            value[r.fit][2 * r.node : 2 * r.node + 2] = leaf(r.gl, r.hl), leaf(r.g - r.gl, r.h - r.hl)
    return {fit: (grown[fit], value[fit]) for fit in grown}


def boosted_trees(sections: DataFrame, xs: Sequence[str] = tuple(f"{f}_z" for f in FEATURES), cfg: BoostConfig = BoostConfig()) -> DataFrame:
    """M4: (dt, symbol, rhat_raw) of every day from ``step`` on, by the model fitted last before it.

    ``sections`` is (dt, t, symbol, label, xs), staged; labels that were not known when a model was fitted are left out
    only by the window's end, as in the linear fits. A day's rows weigh by their age.
    """
    p = len(xs)
    last_fit = (sections.agg(F.max("t")).first()[0] or 0) // cfg.step
    if (last_fit + 1) << cfg.depth > _MOST_NODES:
        raise ValueError("too many models and nodes at once: raise step or lower depth")
    rows = stage(binned_rows(sections, xs, cfg), "boost_rows")
    trees: list[dict[int, Tree]] = []
    for _ in range(cfg.trees):
        trees.append(_grow(rows, p, cfg, last_fit, trees))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, bins = _batch(batch, p)
            r = np.zeros(len(t))
            for fit in np.unique(t // cfg.step):
                here = t // cfg.step == fit
                r[here] = _residuals(bins[here], r[here], trees, int(fit))
            yield pa.RecordBatch.from_arrays([batch.column("dt"), batch.column("symbol"), pa.array(-r)], names=["dt", "symbol", "rhat_raw"])

    symbol = sections.schema["symbol"].dataType.simpleString()
    return rows.where(F.col("t") >= cfg.step).drop("label").mapInArrow(scored, f"dt date, symbol {symbol}, rhat_raw double")

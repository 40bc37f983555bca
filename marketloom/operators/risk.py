"""Liquidity-scaled covariance of one date (R1, R2) and portfolio risk."""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.config import RiskConfig
from marketloom.functions.blocks import block_count, block_of, paired
from marketloom.functions.indexing import with_row_index
from marketloom.functions.scalars import safe_div
from marketloom.operators.features import rolling_std, with_changes
from marketloom.operators.panel import in_time
from marketloom.session import stage


def with_close_return(panel: DataFrame, name: str = "r") -> DataFrame:
    return with_changes(panel, **{name: (F.col("C"), F.lag("C", 1).over(in_time()))})


def name_volatility(panel: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """``sigma`` per row, from the day's range or from the trailing returns."""
    if cfg.sigma_source == "GK":
        return panel.withColumn("sigma", F.col("gk_vol"))
    # Fewer rows than the window near the start; the first return of a symbol has no deviation.
    return (
        with_close_return(panel, "_r")
        .withColumn("sigma", rolling_std("_r", cfg.std_window))
        .drop("_r")
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def return_directions(panel: DataFrame, at: int, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """A6, first half: per symbol the decayed, centred, unit-length vector of trailing returns.

    The correlation of two symbols is the inner product of their vectors. No return is left out that a double could
    tell: see ``RiskConfig.horizon``. A missing return counts as no move.
    """
    recent = panel.where(F.col("t").between(at - cfg.horizon, at))
    returns = with_close_return(recent.select("symbol", "t", "C")).where(F.col("t") > max(at - cfg.horizon, 0))
    weight = F.pow(F.lit(2.0), (F.col("t") - at) / cfg.corr_half_life)
    r = F.coalesce("r", F.lit(0.0))
    listed = returns.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("t", weight.alias("w"), r.alias("r")))).alias("x")
    )
    sums = F.aggregate(
        "x", F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wr")),
        lambda a, e: F.struct((a.w + e.w).alias("w"), (a.wr + e.w * e.r).alias("wr")), lambda a: a.wr / a.w,
    )
    centred = bound(sums, lambda mean: F.transform("x", lambda e: F.sqrt(e.w) * (e.r - mean)))
    centred = listed.select("symbol", centred.alias("d"))

    def unit(d: Column) -> Column:
        return bound(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)), lambda n: F.transform(d, lambda v: safe_div(v, n)))

    return centred.select("symbol", bound(F.col("d"), unit).alias("u"))


def liquidity_scale(names: DataFrame, c_liq: float) -> DataFrame:
    """D16 (ours): names of one date; the least liquid one is scaled by 1 + c_liq.

    The percent rank comes from row numbers over a range sort: the first of equal values counts.
    """
    indexed = stage(with_row_index(names.select("adv"), "adv", name="i"), "liquidity")
    first = indexed.groupBy("adv").agg(F.min("i").alias("i")).withColumnRenamed("adv", "_adv")
    n = indexed.count()
    rank = F.col("i") / F.lit(max(n - 1, 1)).cast("double")
    same = F.col("adv").eqNullSafe(F.col("_adv"))
    return names.join(first, same).withColumn("scale", 1.0 + c_liq * (1.0 - rank)).drop("_adv", "i")


# Symbols whose vectors a task of ``Tiles`` holds for each side.
SPAN = 4096
# Correlations in the tiles of one batch on their way out of a task.
BATCH = 1_000_000


@dataclasses.dataclass
class Tiles:
    """R2 in blocks of symbols, from ``source`` (symbol, u, size). ``frame`` has a row for each pair of blocks ``bi <= bj``: the
    symbols ``rows`` and ``columns``, their sizes ``left`` and ``right``, and the correlations ``rho`` by rows. Covariance is
    rho x size x size, plus ``eps`` where both symbols are the same. Vectors are written when first asked for."""

    source: DataFrame
    block_size: int
    eps: float

    @functools.cached_property
    def vectors(self) -> DataFrame:
        return stage(self.source, "directions")

    @functools.cached_property
    def n_blocks(self) -> int:
        return block_count(self.vectors, "symbol", self.block_size)

    @functools.cached_property
    def frame(self) -> DataFrame:
        """Neighbouring blocks make a span of about ``SPAN`` symbols, which is one row of a table. Tasks read two spans at a
        time and hand on their tiles by and by. Vectors are shuffled once, however many spans there are."""
        per_span = max(1, SPAN // self.block_size)
        n_spans = math.ceil(self.n_blocks / per_span)
        placed = self.vectors.withColumn("b", block_of("symbol", self.n_blocks))
        placed = placed.withColumn("span", F.floor(F.col("b") / per_span).cast("int"))
        held = F.sort_array(F.collect_list(F.struct("b", "symbol", "size", "u"))).alias("names")
        # A file for each span, so that tasks can share them out.
        spans = stage(placed.groupBy("span").agg(held), "spans", maxRecordsPerFile="1")
        names = ["bi", "bj", "rows", "columns", "left", "right", "rho"]
        strings, doubles = pa.list_(pa.string()), pa.list_(pa.float64())
        kinds = [pa.int32(), pa.int32(), strings, strings, doubles, doubles, doubles]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for left, right in zip(batch.column("left"), batch.column("right")):
                    yield from tiles_of(left["names"].values, right["names"].values)

        def tiles_of(left: pa.StructArray, right: pa.StructArray) -> Iterator[pa.RecordBatch]:
            u, v = vectors(left), vectors(right).T
            of_row, of_column = blocks(left), blocks(right)
            tiles, ready = [], 0
            for bi, (i, rows, heights) in of_row.items():
                strip = u[i] @ v
                for bj, (j, columns, widths) in of_column.items():
                    if bi > bj:
                        continue
                    rho = strip[:, j].copy()
                    if bi == bj:
                        np.fill_diagonal(rho, 1.0)
                    tiles.append([bi, bj, rows, columns, heights, widths, rho.ravel()])
                    ready += rho.size
                    if ready >= BATCH:
                        yield batch_of(tiles)
                        tiles, ready = [], 0
            if tiles:
                yield batch_of(tiles)

        def batch_of(tiles: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind, from_pandas=True) for c, kind in zip(zip(*tiles), kinds)], names=names)

        def vectors(side: pa.StructArray) -> np.ndarray:
            return np.stack(side.field("u").to_numpy(zero_copy_only=False))

        def blocks(side: pa.StructArray) -> dict:
            b = side.field("b").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            spans = [slice(x, y) for x, y in zip(cuts, [*cuts[1:], len(side)])]
            symbol, size = side.field("symbol").to_pylist(), side.field("size").to_numpy(zero_copy_only=False)
            return {int(b[s.start]): (s, symbol[s], size[s]) for s in spans}

        schema = "bi int, bj int, rows array<string>, columns array<string>, left array<double>, right array<double>, rho array<double>"
        return paired(spans, "span", n_spans).select("left", "right").mapInArrow(multiply, schema)

    def _entries(self, tiles: DataFrame) -> DataFrame:
        width = F.size("columns")
        row, column = F.floor(F.col("k") / width).cast("int"), (F.col("k") % width).cast("int")
        cells = tiles.select("bi", "bj", "rows", "columns", "left", "right", F.posexplode("rho").alias("k", "rho")).select(
            "bi", "bj", F.col("rows")[row].alias("a"), F.col("columns")[column].alias("b"), "rho",
            (F.col("left")[row] * F.col("right")[column]).alias("size"),
        )
        cells = cells.where((F.col("bi") < F.col("bj")) | (F.col("a") <= F.col("b")))
        own = F.when(F.col("a") == F.col("b"), self.eps).otherwise(0.0)
        return cells.select(
            F.least("a", "b").alias("sym_i"), F.greatest("a", "b").alias("sym_j"), "rho", (F.col("rho") * F.col("size") + own).alias("cov")
        )

    def pairs(self) -> DataFrame:
        """(sym_i, sym_j, rho, cov) of all pairs sym_i <= sym_j: a row for each, as a list of all pairs is."""
        return self._entries(self.frame)

    def asked(self, pairs: DataFrame) -> DataFrame:
        """The entries of ``pairs`` (sym_i, sym_j, in any order), each multiplied from its two vectors: as many products as
        pairs are asked for, and no tile."""
        side = lambda n: self.vectors.select(F.col("symbol").alias(f"sym_{n}"), F.col("u").alias(f"u{n}"), F.col("size").alias(f"s{n}"))
        met = pairs.select("sym_i", "sym_j").join(side("i"), "sym_i").join(side("j"), "sym_j")
        same = F.col("sym_i") == F.col("sym_j")
        product = F.aggregate(F.zip_with("ui", "uj", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        found = met.select("sym_i", "sym_j", F.when(same, 1.0).otherwise(product).alias("rho"), "si", "sj", F.when(same, self.eps).otherwise(0.0).alias("own"))
        return found.select("sym_i", "sym_j", "rho", (F.col("rho") * F.col("si") * F.col("sj") + F.col("own")).alias("cov"))


def covariance(vectors: DataFrame, cfg: RiskConfig = RiskConfig()) -> Tiles:
    """Correlations and sizes in tiles from (symbol, u, size).

    Blocks of symbols are multiplied as matrices; see ``functions.blocks``.
    """
    return Tiles(vectors, cfg.block_size, cfg.eps)


def risk_vectors(
    features: DataFrame, at: int, cfg: RiskConfig = RiskConfig()
) -> tuple[DataFrame, DataFrame]:
    """Names (symbol, sigma, adv, scale) of the day with ordinal ``at`` and their factor
    form (symbol, u, size): covariance is size_i size_j u_i'u_j off the diagonal, size^2 + eps on it.

    ``size`` is NULL without a volatility. Only the days of the windows are read.
    """
    past = max(cfg.horizon, cfg.std_window)
    recent = features.where(F.col("t").between(at - past, at))
    today = name_volatility(recent, cfg).where(F.col("t") == at)
    names = liquidity_scale(today.select("dt", "symbol", "sigma", "adv"), cfg.c_liq)
    vectors = return_directions(recent, at, cfg).join(names, "symbol").select(
        "symbol", "u", (F.col("sigma") * F.col("scale")).alias("size")
    )
    return names, vectors


def liquidity_scaled_risk(
    features: DataFrame, at: int, cfg: RiskConfig = RiskConfig()
) -> tuple[DataFrame, Tiles]:
    """R2: names (symbol, sigma, adv, scale) and covariance tiles of the day with ordinal ``at``.

    ``features`` has C, gk_vol and adv; only the days of the windows are read. The tiles are R2's own
    output; portfolio risk takes the factors (``factor_risk``).
    """
    names, vectors = risk_vectors(features, at, cfg)
    known = vectors.withColumn("size", F.coalesce("size", F.lit(0.0)))
    return names, covariance(known, cfg)


def factor_risk(
    weights: DataFrame, vectors: DataFrame, eps: float = RiskConfig().eps, name_block: int = 2048, candidate_block: int = 2048
) -> DataFrame:
    """(cand_id, risk) from the factor form of ``risk_vectors``, without any pair of names.

    Variance = |sum w size u|^2 + sum w^2 (size^2 (1 - |u|^2) + eps). A name with weight but without
    a vector or a size makes the risk NULL: unknown is not riskless.

    A block of candidates and a block of names meet as matrices: one product gives the block's share of every
    candidate's factor loadings, one row per candidate. The shares are added for each block of candidates, then squared.
    """
    n = weights.agg(F.approx_count_distinct("cand_id").alias("c"), F.approx_count_distinct("symbol").alias("s")).first()
    n_cand, n_name = max(1, math.ceil(n.c / candidate_block)), max(1, math.ceil(n.s / name_block))
    kind = weights.schema["cand_id"].dataType.simpleString()
    placed = weights.select("cand_id", "symbol", "w", block_of("cand_id", n_cand).alias("cb"), block_of("symbol", n_name).alias("b"))
    factors = vectors.select(
        "symbol", "u", "size", block_of("symbol", n_name).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("cb")
    )
    empty = pd.DataFrame({"cand_id": [], "cb": [], "loading": [], "own": [], "unknown": []})

    def multiply(key: tuple, held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return empty
        known = known[known["u"].notna() & known["size"].notna()]
        held = held[held["w"].notna()]
        cands, ci = np.unique(held["cand_id"].to_numpy(), return_inverse=True)
        place = pd.Index(known["symbol"]).get_indexer(held["symbol"])
        w, found = held["w"].to_numpy(dtype=float), place >= 0
        unknown = np.bincount(ci, (~found) & (w != 0), len(cands)) > 0
        if known.empty:
            loading, own = [np.zeros(0)] * len(cands), np.zeros(len(cands))
        else:
            u, size = np.stack(known["u"].to_numpy()), known["size"].to_numpy(dtype=float)
            m = np.zeros((len(cands), len(known)))
            np.add.at(m, (ci[found], place[found]), w[found])
            loading = list((m * size) @ u)
            own = (m * m) @ (size**2 * (1.0 - (u * u).sum(axis=1)) + eps)
        return pd.DataFrame({"cand_id": cands, "cb": int(key[0]), "loading": loading, "own": own, "unknown": unknown})

    shares = (
        placed.groupBy("cb", "b").cogroup(factors.groupBy("cb", "b"))
        .applyInPandas(multiply, f"cand_id {kind}, cb int, loading array<double>, own double, unknown boolean")
    )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        cands, ci = np.unique(rows["cand_id"].to_numpy(), return_inverse=True)
        total = np.zeros((len(cands), max(len(x) for x in rows["loading"])))
        for i, x in zip(ci, rows["loading"]):
            total[i, : len(x)] += x
        variance = (total * total).sum(axis=1) + np.bincount(ci, rows["own"], len(cands))
        risk = np.sqrt(np.maximum(variance, 0.0))
        risk[np.bincount(ci, rows["unknown"], len(cands)) > 0] = np.nan
        return pd.DataFrame({"cand_id": cands, "risk": risk})

    risks = shares.groupBy("cb").applyInPandas(add, f"cand_id {kind}, risk double")
    return risks.select("cand_id", F.when(~F.isnan("risk"), F.col("risk")).alias("risk"))

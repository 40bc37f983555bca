import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.config import (
    FEATURES,
    CostConfig,
    ExecutionConfig,
    PolicyConfig,
    RiskConfig,
    RiskTarget,
    SweepConfig,
    TrainConfig,
)
from marketloom.functions.blocks import block_count, block_of
from marketloom.operators import dedup, policy
from marketloom.operators import forecast as fc
from marketloom.operators import portfolio as pf
from marketloom.operators import risk as rk
from marketloom.session import stage

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=int(i))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows, n, p = [], 6, 3
    for t in range(30):
        for i in range(n):
            x = rng.normal(size=p)
            y = None if t == 29 or rng.random() < 0.1 else float(x @ [1.0, -2.0, 0.0] + rng.normal() * 0.1)
            rows.append((day(t), t, f"s{i}", *map(float, x), y))
    df = spark.createDataFrame(rows, "dt date, t int, symbol string, x0 double, x1 double, x2 double, label double")
    return stage(df, "labelled")


XS = ["x0", "x1", "x2"]


@pytest.mark.parametrize("window,half_life", [(7, 4.0), (60, 20.0)])
def test_walk_forward_ridge(labelled, window, half_life):
    cfg = TrainConfig(window=window, half_life=half_life, lam=0.5)
    got = {r.t: r for r in fc.fit(fc.trailing_gram(fc.daily_gram(labelled, XS), cfg), 3, cfg).collect()}
    data = labelled.toPandas()
    assert set(got) == set(range(1, 30))
    for t in got:
        d = data[(data.t >= t - window) & (data.t < t) & data.label.notna()]
        w = 2.0 ** ((d.t.to_numpy() - (t - 1)) / half_life)
        x, y = d[XS].to_numpy(), d.label.to_numpy()
        beta = np.linalg.solve((x.T * w) @ x + 0.5 * np.eye(3), (x.T * w) @ y)
        assert got[t].beta == pytest.approx(list(beta), abs=1e-9) and got[t].n == len(d)


def test_lasso_drops_the_idle_feature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.0]
    beta = fc.lasso((x.T @ x)[None], (x.T @ y)[None], 20.0, 500, 1e-10)[0]
    grad = x.T @ x @ beta - x.T @ y
    assert beta[2] == 0 and abs(grad[2]) <= 20
    assert grad[:2] + 20 * np.sign(beta[:2]) == pytest.approx([0, 0], abs=1e-6)


def test_calibration_keeps_sign_and_anchor_points(spark):
    rng = np.random.default_rng(4)
    rows = [(day(0), f"s{i}", float(x)) for i, x in enumerate(rng.normal(size=201))]
    df = stage(spark.createDataFrame(rows, "dt date, symbol string, rhat_raw double"), "raw")
    got = fc.calibrate(df).toPandas()
    centred = got.rhat_raw - got.rhat_raw.mean()
    assert (np.sign(got.rhat_cal) == np.sign(centred)).all()
    size = got.rhat_cal.abs()
    assert np.quantile(size, 0.5) == pytest.approx(0.003) and np.quantile(size, 0.75) == pytest.approx(0.010)


def test_external_scores_win(spark):
    base = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", 2.0)], "dt date, symbol string, rhat_raw double")
    other = spark.createDataFrame([(day(0), "b", 9.0)], "dt date, symbol string, score double")
    assert {r.symbol: r.rhat_raw for r in fc.external_score(base, other).collect()} == {"a": 1.0, "b": 9.0}


def test_covariance_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    n, days = 40, 25
    close = np.exp(np.cumsum(rng.normal(size=(days, n)) * 0.02, axis=0))
    close[:, 3] = 1.0
    rows = [
        (day(t), t, f"s{i:02d}", float(close[t, i]), 0.01 + i / 1000, float((i * 7) % n))
        for t in range(days)
        for i in range(n)
    ]
    df = stage(
        spark.createDataFrame(rows, "dt date, t int, symbol string, C double, gk_vol double, adv double"), "f"
    )
    cfg = RiskConfig(corr_half_life=5.0, block_size=7)
    at = days - 2
    assert block_count(df, "symbol", 7) > 1
    names, cov = rk.liquidity_scaled_risk(df, at, cfg)
    assert cov.frame.count() == cov.n_blocks * (cov.n_blocks + 1) // 2
    got = cov.pairs().toPandas()
    assert len(got) == n * (n + 1) // 2 and (got.sym_i <= got.sym_j).all()
    r = (close[1:] / close[:-1] - 1)[:at]
    w = 2.0 ** ((np.arange(len(r)) - (len(r) - 1)) / 5.0)
    dev = r - (w[:, None] * r).sum(0) / w.sum()
    c = (dev * w[:, None]).T @ dev
    s = np.sqrt(np.diag(c))
    rho = np.divide(c, np.outer(s, s), out=np.zeros_like(c), where=np.outer(s, s) > 0)
    np.fill_diagonal(rho, 1.0)
    rank = np.array([(i * 7) % n for i in range(n)]) / (n - 1)
    size = (0.01 + np.arange(n) / 1000) * (1 + 0.6 * (1 - rank))
    full = rho * np.outer(size, size) + 1e-8 * np.eye(n)
    i, j = got.sym_i.str[1:].astype(int), got.sym_j.str[1:].astype(int)
    assert got["cov"].to_numpy() == pytest.approx(full[i, j], abs=1e-12)
    asked = [("s03", "s11"), ("s11", "s03"), ("s05", "s05"), ("s39", "s00"), ("s00", "none")]
    some = cov.asked(spark.createDataFrame(asked, "sym_i string, sym_j string")).collect()
    assert {(r.sym_i, r.sym_j) for r in some} == set(asked[:4])
    for r in some:
        assert r["cov"] == pytest.approx(full[int(r.sym_i[1:]), int(r.sym_j[1:])], abs=1e-12)
    # Portfolio risk from the factors, cut into several blocks; some weights are absent.
    weights = rng.random((33, n)) * (rng.random((33, n)) < 0.6)
    long = [(k, f"s{m:02d}", float(weights[k, m])) for k in range(33) for m in range(n) if weights[k, m]]
    wdf = stage(spark.createDataFrame(long, "cand_id bigint, symbol string, w double"), "w")
    _, vectors = rk.risk_vectors(df, at, cfg)
    risk = rk.factor_risk(wdf, stage(vectors, "v"), name_block=9, candidate_block=10)
    # The only rows made are the vectors, once for each block of candidates: none for each candidate, name and day.
    assert risk._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    var = {r.cand_id: r.risk**2 for r in risk.collect()}
    exact = np.einsum("ki,ij,kj->k", weights, full, weights)
    assert [var[k] for k in range(33)] == pytest.approx(list(exact), rel=1e-9)


def test_blocks_cover_every_key(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("s"))
    sizes = [r["count"] for r in df.groupBy(block_of("s", 10)).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200


def greedy(ids, objs, w, radius, k):
    kept = []
    for i in sorted(range(len(ids)), key=lambda i: (-objs[i], ids[i])):
        if len(kept) < k and all(np.abs(w[i] - w[j]).sum() > radius for j in kept):
            kept.append(i)
    return [ids[i] for i in kept]


@pytest.mark.parametrize("k_keep", [1, 12, 60])
def test_greedy_dedup_equals_brute_force(spark, k_keep):
    """A third of the candidates are copies of one."""
    rng = np.random.default_rng(11)
    base = rng.dirichlet(np.ones(8), size=20)
    w = np.vstack([base[rng.integers(0, 20, 40)], np.repeat(base[:1], 20, axis=0)])
    w = np.where(w < 0.05, 0.0, w + rng.normal(size=w.shape) * 1e-4)
    objs = np.round(rng.random(60), 2)
    long = [(i, f"n{j}", float(w[i, j])) for i in range(60) for j in range(8) if w[i, j] != 0]
    weights = stage(spark.createDataFrame(long, "cand_id bigint, symbol string, w double"), "w")
    scored = spark.createDataFrame([(i, float(o)) for i, o in enumerate(objs)], "cand_id bigint, obj double")
    got = dedup.greedy_keep(stage(scored, "s"), weights, 0.05, k_keep).orderBy("place").collect()
    assert [r.cand_id for r in got] == greedy(list(range(60)), objs, w, 0.05, k_keep)


def test_near_leaders_with_disjoint_names(spark):
    weights = spark.createDataFrame(
        [(1, "a", 0.004), (2, "b", 0.5), (3, "c", 0.003), (3, "a", 0.001)], "cand_id bigint, symbol string, w double"
    )
    leaders = spark.createDataFrame([(9, "z", 0.005), (8, "b", 0.495)], "leader_id bigint, symbol string, w double")
    got = {(r.cand_id, r.leader_id): round(r.l1, 6) for r in dedup.near_leaders(weights, leaders, 0.01).collect()}
    assert got == {(1, 9): 0.009, (3, 9): 0.009, (2, 8): 0.005}


def names(spark):
    rows = [
        ("a", 0.02, 0.3, 1.0, 100.0, 0.1, 0.5, 0.0, 0.0, 0.5, "g", 0.0, 10.0, 10, 1),
        ("b", 0.01, 0.2, 2.0, 400.0, 0.2, None, 0.0, 0.0, 0.5, "h", 0.4, 20.0, 10, 0),
        ("c", 0.00, 0.0, 1.0, 0.0, 0.2, 0.0, 0.0, 0.0, 0.5, "h", 0.4, 5.0, 10, 0),
    ]
    cols = [*pf.NAME_COLUMNS, "price", "lot", "n0"]
    return spark.createDataFrame(rows, cols)


def test_scores_of_sparse_candidates(spark):
    """Candidate 1 does not list the held name b; candidate 2 buys c, which has no liquidity."""
    limits = pf.names_with_limits(names(spark).fillna({"imb": 0.0}), CostConfig())
    weights = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.3), (2, "c", 0.2)], "cand_id bigint, symbol string, w double")
    risk = spark.createDataFrame([(1, 0.005), (2, 0.02)], "cand_id bigint, risk double")
    caps = spark.createDataFrame([("h", 0.45)], "`group` string, cap double")
    got = {r.cand_id: r for r in pf.feasibility(pf.score_candidates(weights, limits, risk, caps), RiskTarget(tau_max=1.2)).collect()}
    assert got[1].lin_cost == pytest.approx(0.7 * 0.001425 + 0.2 * 0.004425)
    assert got[1].turnover == pytest.approx(0.7 + 0.4)
    k = {"a": 4e-4 * 0.1 / 10, "b": 4e-4 * 0.2 / 20}
    assert got[1].imp_cost == pytest.approx(k["a"] * 0.7**1.5 + k["b"] * 0.2**1.5)
    assert got[1].violated == [] and got[1].feasible
    assert got[2].violated == ["risk", "group_cap", "no_liquidity"]
    best = pf.best_per_candidate(
        pf.score_candidates(weights, limits, risk, caps), SweepConfig(sigma_star=(0.004, 0.006), tau=(1.2, 1.3))
    ).collect()
    assert [(r.cand_id, r.sigma_star, r.tau_max, r.impact_scale) for r in best] == [(1, 0.006, 1.2, 0.7)]


def test_lots_and_orders(spark):
    cfg = ExecutionConfig(notional=1000.0)
    weights = spark.createDataFrame([(1, "a", 0.237), (1, "b", 0.0)], "cand_id bigint, symbol string, w double")
    limits = pf.names_with_limits(names(spark))
    lots = pf.to_lots(weights, names(spark).select("symbol", "price", "lot", "n0"), cfg)
    a = lots.where("symbol = 'a'").first()
    assert (a.lots, a.odd, round(a.w, 6)) == (2, 3, 0.23)
    got = {(r.sid, r.lot_type): r for r in pf.orders(lots, limits).collect()}
    assert set(got) == {("a", "BOARD"), ("a", "ODD")}
    assert (got["a", "BOARD"].side, got["a", "BOARD"].shares, got["a", "ODD"].shares) == ("BUY", 10, 3)
    assert got["a", "ODD"].estimated_cost >= 20.0
    shrunk = pf.to_lots(weights, names(spark).select("symbol", "price", "lot", "n0"), ExecutionConfig(notional=1000.0, reduce_only=True))
    assert shrunk.where("symbol = 'a'").first().w <= 0.1 + 1e-12


def test_scaling_meets_the_limit_with_the_smallest_power(spark):
    weights = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "cand_id bigint, symbol string, w double")
    risk = spark.createDataFrame([(1, 0.02), (2, 0.009)], "cand_id bigint, risk double")
    got = {r.cand_id: r for r in pf.scale_to_risk(weights, risk).collect()}
    assert got[2].k == 0 and got[2].w == 1.0
    assert 0.02 * got[1].w <= 0.01 < 0.02 * got[1].w / 0.9


def test_policy_rows(spark):
    occ = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("z", "a", 0.0)], "state string, action string, x double")
    got = {(r.state, r.action): r.pi for r in policy.policy(occ).collect()}
    assert got == {("s", "a"): 0.25, ("s", "b"): 0.75, ("z", "a"): 0.0}


def test_base_pairs(spark):
    means = spark.createDataFrame(
        [(s, a, float(i)) for s in "xyz" for i, a in enumerate("abcd")], "state string, action string, mean_ret double"
    )
    assert policy.base_pairs(means, PolicyConfig()).count() == 12
    top = policy.base_pairs(means, PolicyConfig(top_k_by_mean=1)).collect()
    assert {(r.state, r.action) for r in top} == {("x", "d"), ("y", "d"), ("z", "d")}
    some = policy.base_pairs(means, PolicyConfig(top_k_by_mean=1, max_pairs=7)).collect()
    assert len(some) == 7 and sum(r.is_top for r in some) == 3


def test_features_are_ten():
    assert len(FEATURES) == 10

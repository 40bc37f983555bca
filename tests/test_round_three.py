"""Covariance tiles of any block size, asked entries, tasks of the panel, and forecasts that sort it once."""

import datetime

import numpy as np
import pytest

from marketloom.config import RiskConfig
from marketloom.operators import forecast as fc
from marketloom.operators import panel as pn
from marketloom.operators import risk as rk
from marketloom.plans.daily import clean_panel, feature_panel, forecast
from marketloom.session import stage


def day(t):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=t)


def test_vectors_travel_by_span_not_by_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    u = rng.normal(size=(60, 9))
    u /= np.linalg.norm(u, axis=1)[:, None]
    size = rng.random(60)
    df = spark.createDataFrame([(f"s{i:02d}", u[i].tolist(), float(size[i])) for i in range(60)], "symbol string, u array<double>, size double")
    parts = []
    paired = rk.paired
    monkeypatch.setattr(rk, "paired", lambda d, b, n: parts.append(n) or paired(d, b, n))
    monkeypatch.setattr(rk, "SPAN", 24, raising=False)
    cov = rk.covariance(df, RiskConfig(block_size=3))
    some = cov.asked(spark.createDataFrame([("s01", "s07"), ("s07", "s01"), ("s02", "s02")], "sym_i string, sym_j string")).collect()
    assert parts == []
    assert sorted((r.sym_i, r.sym_j) for r in some) == [("s01", "s07"), ("s02", "s02"), ("s07", "s01")]
    got = cov.pairs().toPandas()
    assert cov.n_blocks > 12 and parts and max(parts) <= 4
    full = (u @ u.T) * np.outer(size, size)
    np.fill_diagonal(full, size * size + cov.eps)
    assert len(got) == 60 * 61 // 2 and not got.duplicated(["sym_i", "sym_j"]).any()
    i, j = got.sym_i.str[1:].astype(int), got.sym_j.str[1:].astype(int)
    assert got["cov"].to_numpy() == pytest.approx(full[i, j], abs=1e-12)
    for r in some:
        assert r["cov"] == pytest.approx(full[int(r.sym_i[1:]), int(r.sym_j[1:])], abs=1e-12)


def prices(spark, symbols=9, days=40):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(symbols):
        c = 50.0
        for t in range(days):
            o, c = c * (1 + rng.normal() * 0.01), c * (1 + rng.normal() * 0.02)
            v = float(rng.integers(1, 500))
            if rng.random() < 0.9:
                rows.append((day(t), f"s{i}", o, max(o, c) * 1.01, min(o, c) * 0.99, c, v, v * c, v / 3, v / 2, int(rng.integers(-90, 90))))
    df = spark.createDataFrame(rows, "dt date, symbol string, O double, H double, L double, C double, V double, VAL double, inside_vol double, outside_vol double, netbuy bigint")
    return stage(df.drop("netbuy"), "prices"), stage(df.select("dt", "symbol", "netbuy"), "flow")


def test_tasks_of_the_panel_follow_its_cells(spark, monkeypatch):
    daily, flow = prices(spark)
    plain = {(r.symbol, r.t): tuple(r) for r in clean_panel(daily, pn.calendar(daily), flow).collect()}
    monkeypatch.setattr(pn, "CELLS_PER_TASK", 20, raising=False)
    panel = clean_panel(daily, pn.calendar(daily), flow)
    assert panel.rdd.getNumPartitions() == 18  # 9 symbols x 40 dates, 20 cells each
    assert {(r.symbol, r.t): tuple(r) for r in panel.collect()} == plain


def test_returns_of_the_panel_are_those_sorted_for(spark):
    daily, flow = prices(spark)
    cal = pn.calendar(daily)
    with_label = feature_panel(daily, cal, flow, keep=("O", "C"), target="CC")
    without = stage(feature_panel(daily, cal, flow, keep=("O", "C")), "plain")
    key = lambda df: sorted(map(tuple, df.select("dt", "symbol", "label", "gap_z", "bias").collect()), key=str)
    a, b = (fc.labelled_sections(x, winsorize_label=0.01) for x in (with_label, without))
    assert key(a) == key(b) and a.where("label IS NOT NULL").count() == 9 * 39
    lean, full = forecast(with_label, keep=()), forecast(without)
    assert lean.columns == ["dt", "t", "symbol", "rhat_raw", "rhat_cal", "rhat_enh"]
    rows = lambda df: {(r.dt, r.symbol): (r.rhat_raw, r.rhat_cal, r.rhat_enh) for r in df.collect()}
    x, y = rows(lean), rows(full)
    assert x.keys() == y.keys() and x
    for k in x:
        assert x[k] == pytest.approx(y[k], rel=1e-9, abs=1e-12, nan_ok=True)


def test_vectors_are_not_shuffled_for_each_pair_of_spans(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"s{i:02d}", rng.normal(size=5).tolist(), float(i)) for i in range(50)] + [(None, [1.0] * 5, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, u array<double>, size double")
    monkeypatch.setattr(rk, "SPAN", 6)
    pairs = rk.covariance(df, RiskConfig(block_size=3)).pairs()
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.sym_i, r.sym_j): r.rho for r in pairs.where("sym_i <> sym_j").collect()}
    known = {a: np.array(u) for a, u, _ in rows if a}
    assert {k for k in got if None not in k} == {(a, b) for a in known for b in known if a < b}
    assert all(got[a, b] == pytest.approx(known[a] @ known[b]) for a, b in got)


def test_covariances_cross_spans_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(9)
    u, size = rng.normal(size=(20, 4)), rng.random(20)
    df = spark.createDataFrame([(f"s{i:02d}", u[i].tolist(), float(size[i])) for i in range(20)], "symbol string, u array<double>, size double")
    monkeypatch.setattr(rk, "SPAN", 4)
    cov = rk.covariance(df, RiskConfig(block_size=2, eps=0.25))
    pairs = cov.pairs().select("sym_i", "sym_j", "cov")
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    full = (u @ u.T) * np.outer(size, size)
    np.fill_diagonal(full, size * size + 0.25)
    got = {(int(r.sym_i[1:]), int(r.sym_j[1:])): r.cov for r in pairs.collect()}
    assert got == {(i, j): pytest.approx(full[i, j]) for i in range(20) for j in range(i, 20)}

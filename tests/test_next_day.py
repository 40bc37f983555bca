"""A day's forecast from the carried state equals that of the whole history."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.config import Config, TrainConfig
from marketloom.operators import features
from marketloom.operators.panel import calendar
from marketloom.plans.daily import clean_panel, feature_panel, forecast
from marketloom.plans.next_day import State, initial_state, predict_day
from marketloom.session import stage

D0 = dt.date(2024, 1, 1)
SCHEMA = "dt date, symbol string, O double, H double, L double, C double, V double, VAL double, inside_vol double, outside_vol double"


def history(days=34, names=9):
    rng = np.random.default_rng(9)
    bars, flow = [], []
    for i in range(names):
        close = 100 * np.exp(np.cumsum(rng.normal(size=days) * 0.05))
        for t in range(days):
            if t > 0 and rng.random() < 0.12:
                continue  # a gap: the last fields go on
            o, c = float(close[t] * (1 + rng.normal() * 0.01)), float(close[t])
            v = float(rng.integers(0, 50))
            bars.append((D0 + dt.timedelta(days=t), f"s{i}", o, max(o, c) * 1.01, min(o, c) * 0.98, c, v, v * c, v * 0.4, None if rng.random() < 0.1 else v * 0.5))
            if rng.random() < 0.5:
                flow.append((D0 + dt.timedelta(days=t), f"s{i}", int(rng.integers(-20, 20))))
    flow.append((D0 + dt.timedelta(days=days - 1), "only flow", 5))
    return bars, flow


@pytest.mark.parametrize("target", ["CC", "OO"])
def test_three_days_from_state(spark, tmp_path, target):
    bars, flow = history()
    daily = stage(spark.createDataFrame(bars, SCHEMA), "daily")
    flows = stage(spark.createDataFrame(flow, "dt date, symbol string, netbuy bigint"), "flow")
    cal = stage(calendar(daily), "cal")
    cfg = Config(train=TrainConfig(window=12, half_life=6.0))
    whole = forecast(feature_panel(daily, cal, flows, cfg=cfg.clean), cfg, target)
    expected = {(r.dt, r.symbol): (r.rhat_raw, r.rhat_cal, r.rhat_enh) for r in whole.where(F.col("dt") >= D0 + dt.timedelta(days=31)).collect()}
    first = D0 + dt.timedelta(days=31)
    past = daily.where(F.col("dt") < first)
    panel = stage(clean_panel(past, calendar(past), flows.where(F.col("dt") < first), cfg=cfg.clean), "panel")
    state = initial_state(panel, cfg, target)
    got = {}
    for k in range(3):
        day = first + dt.timedelta(days=k)
        state.write(f"{tmp_path}/{k}")
        state = State.read(spark, f"{tmp_path}/{k}")
        rows = daily.where(F.col("dt") == day).join(flows.where(F.col("dt") == day), ["dt", "symbol"], "full")
        out, state = predict_day(rows, state, cfg, target)
        got |= {(r.dt, r.symbol): (r.rhat_raw, r.rhat_cal, r.rhat_enh) for r in out.collect()}
        assert state.grams.count() <= cfg.train.window + 1
    assert set(got) == set(expected) and len(got) == 27
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError):
        predict_day(daily, state, cfg, target)


def test_first_state_reads_its_panel_once(spark, monkeypatch):
    """The days it looks back on are written once; a panel that is not staged gives the same state."""
    bars, flow = history()
    daily = stage(spark.createDataFrame(bars, SCHEMA), "daily")
    flows = stage(spark.createDataFrame(flow, "dt date, symbol string, netbuy bigint"), "flow")
    cfg = Config(train=TrainConfig(window=12, half_life=6.0))
    panel = clean_panel(daily, calendar(daily), flows, cfg=cfg.clean)
    plain = initial_state(stage(panel, "panel"), cfg)
    written = []
    monkeypatch.setattr(features, "stage", lambda d, name: written.append(stage(d, name)) or written[-1])
    state = initial_state(panel, cfg, top=33)
    assert [w.count() for w in written] == [20 * 9, 20]  # the twenty last days of nine names, and their totals
    assert (state.dt, state.t) == (plain.dt, plain.t) == (D0 + dt.timedelta(days=33), 33)
    for a, b in ((state.names, plain.names), (state.grams, plain.grams)):
        x, y = (sorted(map(str, df.collect())) for df in (a, b))
        assert x and len(x) == len(y)
    assert sorted(r.t for r in state.grams.collect()) == list(range(21, 33))
    names = {r.symbol: r for r in plain.names.collect()}
    for r in state.names.collect():
        assert r.closes == names[r.symbol].closes and r["last"] == names[r.symbol]["last"] and len(r.closes) == 20
        assert r.z == pytest.approx(names[r.symbol].z, abs=1e-9)

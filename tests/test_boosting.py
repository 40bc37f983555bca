"""Histogram boosting against a plain version."""

import datetime as dt

import numpy as np

from marketloom.operators import boosting
from marketloom.operators.boosting import BoostConfig, boosted_trees
from marketloom.session import stage


def plain(rows, cfg, p):
    """rows: (t, symbol, label, x...). Predictions by (t, symbol), one model at a time."""
    out = {}
    top = max(r[0] for r in rows) // cfg.step
    bins = lambda x: np.clip(np.floor((np.nan_to_num(x) + cfg.clip) * cfg.bins / (2 * cfg.clip)), 0, cfg.bins - 1).astype(int)
    for k in range(1, top + 1):
        train = [r for r in rows if k * cfg.step - cfg.window <= r[0] < k * cfg.step and r[2] is not None]
        test = [r for r in rows if k * cfg.step <= r[0] < (k + 1) * cfg.step]
        if not test:
            continue
        value = lambda some: bins(np.array([[np.nan if v is None else v for v in r[3:]] for r in some], float).reshape(-1, p))
        x, z = value(train), value(test)
        w = np.array([2.0 ** ((r[0] - (k * cfg.step - 1)) / cfg.half_life) for r in train])
        r = np.array([t[2] for t in train], float)
        pred = np.zeros(len(test))
        for _ in range(cfg.trees):
            groups = [(np.arange(len(train)), np.arange(len(test)))]
            for _ in range(cfg.depth):
                new = []
                for a, b in groups:
                    g, h = (w[a] * r[a]).sum(), w[a].sum()
                    best = (1e-12, None, None)
                    for f in range(p):
                        for c in sorted(set(x[a, f]))[:-1]:
                            left = x[a, f] <= c
                            gl, hl = (w[a] * r[a])[left].sum(), w[a][left].sum()
                            gain = gl**2 / (hl + cfg.lam) + (g - gl) ** 2 / (h - hl + cfg.lam) - g**2 / (h + cfg.lam)
                            if gain > best[0]:
                                best = (gain, f, c)
                    if best[1] is None:
                        new.append((a, b))
                    else:
                        _, f, c = best
                        new += [(a[x[a, f] <= c], b[z[b, f] <= c]), (a[x[a, f] > c], b[z[b, f] > c])]
                groups = new
            for a, b in groups:
                v = cfg.rate * (w[a] * r[a]).sum() / (w[a].sum() + cfg.lam) if len(a) else 0.0
                r[a] -= v
                pred[b] += v
        out.update({(t[0], t[1]): q for t, q in zip(test, pred)})
    return out


def test_walk_forward_equals_plain_trees(spark):
    rng = np.random.default_rng(6)
    rows = []
    for t in range(36):
        for i in range(12):
            x = np.clip(rng.normal(size=3), -3, 3)
            label = None if (t + i) % 11 == 0 else float(np.sign(x[0]) * 0.5 + x[1] * (x[2] > 0) + rng.normal() * 0.1)
            rows.append((t, f"s{i}", label, *[None if rng.random() < 0.03 else float(v) for v in x]))
    cfg = BoostConfig(window=15, half_life=8.0, step=7, trees=3, depth=2, bins=8)
    day = dt.date(2024, 1, 1)
    table = [(day + dt.timedelta(days=r[0]), *r) for r in rows]
    df = stage(spark.createDataFrame(table, "dt date, t int, symbol string, label double, a double, b double, c double"), "z")
    got = {((r.dt - day).days, r.symbol): r.rhat_raw for r in boosted_trees(df, ("a", "b", "c"), cfg).collect()}
    expected = plain(rows, cfg, 3)
    assert set(got) == set(expected)
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9
    assert np.corrcoef([got[r[0], r[1]] for r in rows if r[0] >= 7 and r[2] is not None], [r[2] for r in rows if r[0] >= 7 and r[2] is not None])[0, 1] > 0.5
    assert boosted_trees(df.limit(0), ("a", "b", "c"), cfg).count() == 0


def test_a_row_is_kept_once_whatever_its_models(spark, monkeypatch):
    rng = np.random.default_rng(2)
    day = dt.date(2024, 1, 1)
    table = [(day + dt.timedelta(days=t), t, f"s{i}", float(rng.normal()), float(rng.normal()), float(rng.normal())) for t in range(40) for i in range(15)]
    df = stage(spark.createDataFrame(table, "dt date, t int, symbol string, label double, a double, b double"), "z")
    cfg, written = BoostConfig(window=30, half_life=9.0, step=5, trees=2, depth=2, bins=4), []
    monkeypatch.setattr(boosting, "stage", lambda d, name: written.append(stage(d, name)) or written[-1])
    assert boosted_trees(df, ("a", "b"), cfg).count() == 35 * 15
    assert max(w.count() for w in written) == len(table)
    # Sums that are handed on early are the same sums.
    few = {(r.dt, r.symbol): r.rhat_raw for r in boosted_trees(df, ("a", "b"), cfg).collect()}
    monkeypatch.setattr(boosting, "_MOST_SUMS", 1)
    for r in boosted_trees(df, ("a", "b"), cfg).collect():
        assert abs(r.rhat_raw - few[r.dt, r.symbol]) < 1e-9

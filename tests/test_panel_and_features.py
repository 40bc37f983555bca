import datetime as dt

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.config import PANEL_FIELDS, CleanConfig
from marketloom.functions.indexing import with_row_index
from marketloom.functions.quantiles import exact_quantiles, tail_mean
from marketloom.operators.crosssection import winsorize, zscore
from marketloom.operators.features import turnover_share, with_ema
from marketloom.operators.panel import bars, calendar, clean, dense_panel, join_inputs, nth_last
from marketloom.plans.daily import clean_panel
from marketloom.session import by_date

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def price_rows(spark, cells):
    rows = [(day(t), s, c, c, c, c, v, v, v, 0.0) for s, t, c, v in cells]
    cols = "dt date, symbol string, " + ", ".join(f"{c} double" for c in PANEL_FIELDS)
    return spark.createDataFrame(rows, cols)


CELLS = [
    ("a", 1, 10.0, 5.0), ("a", 3, 12.0, 0.0), ("b", 0, 1.0, 1.0), ("b", 2, None, None), ("b", 3, 2.0, 2.0),
    ("gone", 2, None, None), ("b", 4, 3.0, 3.0),
]


def test_dense_grid_and_fill(spark):
    daily = price_rows(spark, CELLS)
    flow = spark.createDataFrame(
        [(day(2), "a", 7), (day(2), "stranger", 1), (day(9), "a", 1)], "dt date, symbol string, netbuy bigint"
    )
    panel = clean_panel(daily, calendar(daily), flow).orderBy("symbol", "t").collect()
    by = {(r.symbol, r.t): r for r in panel}
    assert set(by) == {(s, t) for s in ("a", "b", "gone") for t in range(5)}
    assert [by["a", t].C for t in range(5)] == [10.0, 10.0, 10.0, 12.0, 12.0]
    assert [by["b", t].C for t in range(5)] == [1.0, 1.0, 1.0, 2.0, 3.0]
    assert [by["gone", t].C for t in range(5)] == [None] * 5
    assert by["a", 2].netbuy == 7 and by["a", 1].netbuy is None
    assert [by["a", t].tradable_flag for t in range(5)] == [1, 1, 1, 0, 0]
    assert by["gone", 0].tradable_flag == 0


def test_fills_can_be_switched_off(spark):
    daily = price_rows(spark, CELLS)
    raw = dense_panel(join_inputs(daily, None, None), calendar(daily))
    strict = clean(raw, CleanConfig(back_fill=False))
    got = [r.C for r in strict.where("symbol = 'a'").orderBy("t").collect()]
    assert got == [None, 10.0, 10.0, 12.0, 12.0]
    none = clean(raw, CleanConfig(back_fill=False, forward_fill=False))
    assert [r.C for r in none.where("symbol = 'a'").orderBy("t").collect()] == [None, 10.0, None, 12.0, None]


def test_adjusted_prices_and_non_finite_input(spark):
    daily = price_rows(spark, [("a", 0, 10.0, 1.0), ("a", 1, float("nan"), 1.0)])
    daily = daily.withColumn("adj_close", F.when(F.col("dt") == F.lit(day(0)), 5.0))
    got = clean(dense_panel(join_inputs(daily, None, None), calendar(daily))).orderBy("t").collect()
    assert [(r.O, r.C) for r in got] == [(5.0, 5.0), (5.0, 5.0)]


def test_too_few_dates(spark):
    cal = calendar(price_rows(spark, [("a", 0, 1.0, 1.0)]))
    assert nth_last(cal, 1) == 0
    with pytest.raises(ValueError):
        nth_last(cal)


def test_bars_plan_has_no_sort_before_the_shuffle(spark, sf):
    from marketloom.catalog import roles

    plan = bars(roles.ticks(spark, sf), "week")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min_by" in plan


@pytest.mark.parametrize("alpha", [0.5, 0.067])
def test_ema_equals_the_recursion(spark, alpha):
    rng = random.Random(3)
    xs = [None, None] + [rng.uniform(-5, 5) if rng.random() < 0.8 else None for _ in range(1500)]
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate(xs)], "symbol string, t int, x double")
    got = [r.e for r in with_ema(df, F.col("x"), alpha, "e").orderBy("t").collect()]
    state = None
    for x, g in zip(xs, got):
        if x is not None:
            state = x if state is None else alpha * x + (1 - alpha) * state
        assert g == (None if state is None else pytest.approx(state, abs=1e-12))


def test_turnover_shares_add_up(spark):
    daily = price_rows(spark, CELLS)
    shares = turnover_share(clean_panel(daily, calendar(daily)), "s").groupBy("t").agg(F.sum("s").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in shares.collect())


def skewed(spark):
    rng = np.random.default_rng(7)
    big = [("hot", float(x)) for x in np.round(rng.exponential(10, 30000), 2)]
    rest = [("cold", float(x)) for x in rng.normal(size=37)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("nil", None)]
    same = [("same", 3.0)] * 5000
    return spark.createDataFrame(big + rest + same, "g string, x double").repartition(8)


@pytest.mark.parametrize("small", [0, 10**9])
def test_quantiles_are_exact(spark, small):
    df = skewed(spark).cache()
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: r.x_q for r in exact_quantiles(df, ["g"], ["x"], probs, small_group=small).collect()}
    data = df.where("x IS NOT NULL").toPandas().groupby("g").x
    for g, xs in data:
        assert got[g] == pytest.approx(list(np.quantile(xs, probs)), abs=1e-9)


def test_tail_mean(spark):
    df = skewed(spark).where("x IS NOT NULL").cache()
    got = {r.g: r for r in tail_mean(df, ["g"], "x", 0.95).collect()}
    for g, xs in df.toPandas().groupby("g").x:
        var = np.quantile(xs, 0.95)
        assert got[g].var == pytest.approx(var) and got[g].n == len(xs)
        assert got[g].cvar == pytest.approx(xs[xs >= var - 1e-12].mean())
        assert got[g].cvar >= got[g].var - 1e-12


def section(spark):
    rng = np.random.default_rng(1)
    rows = [(day(t), f"s{i}", float(rng.standard_t(2)) if i else None) for t in range(3) for i in range(400)]
    return spark.createDataFrame(rows, "dt date, symbol string, x double")


def test_zscore_and_winsorize(spark):
    df = section(spark).cache()
    z = zscore(df, ["x"]).toPandas()
    assert z.x.abs().max() <= 3 and (z[z.symbol == "s0"].x == 0).all()
    w = winsorize(df, ["x"], 0.05).toPandas()
    raw = df.toPandas()
    for d, xs in raw.groupby("dt").x:
        lo, hi = np.quantile(xs.dropna(), [0.05, 0.95])
        mine = w[w.dt == d].x.dropna()
        assert mine.min() == pytest.approx(lo) and mine.max() == pytest.approx(hi)


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert all(r["index"] == r.k for r in with_row_index(df, "k").collect())


def test_broadcast_needs_a_date_key(spark):
    with pytest.raises(TypeError):
        by_date(spark.range(1).select(F.col("id").alias("dt")))


"""Orders of unlisted holdings, unknown risk, quantile plans, compaction and late rows."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.config import ExecutionConfig, RiskTarget
from marketloom.functions.quantiles import _edges, _with_edges, exact_quantiles, tail_mean
from marketloom.operators import portfolio as pf
from marketloom.operators import risk as rk
from marketloom.session import stage
from marketloom.sources.ticks import QUOTE_SCHEMA, stream_quotes
from marketloom.streaming import quotes as live


def test_factor_risk_equals_the_pairs(spark):
    rng = np.random.default_rng(3)
    n, k, eps = 12, 5, 1e-8
    u = rng.normal(size=(n, k))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u[4] = 0.0
    size = rng.random(n)
    cov = (u @ u.T) * np.outer(size, size)
    np.fill_diagonal(cov, size**2 + eps)
    vectors = stage(
        spark.createDataFrame([(f"s{i}", u[i].tolist(), float(size[i])) for i in range(n)], "symbol string, u array<double>, size double"),
        "v",
    )
    w = rng.random((9, n)) * (rng.random((9, n)) < 0.6)
    long = spark.createDataFrame(
        [(c, f"s{i}", float(w[c, i])) for c in range(9) for i in range(n) if w[c, i]], "cand_id bigint, symbol string, w double"
    )
    got = {r.cand_id: r.risk for r in rk.factor_risk(long, vectors, eps).collect()}
    assert [got[c] for c in range(9)] == pytest.approx(list(np.sqrt(np.einsum("ci,ij,cj->c", w, cov, w))))


def test_unknown_risk_is_a_broken_rule(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0], 0.2), ("b", [0.0, 1.0], None)], "symbol string, u array<double>, size double")
    weights = spark.createDataFrame(
        [(1, "a", 0.1), (1, "z", 0.9), (2, "a", 1.0), (3, "b", 1.0), (4, "a", 1.0), (4, "z", 0.0)], "cand_id bigint, symbol string, w double"
    )
    got = {r.cand_id: r.risk for r in rk.factor_risk(weights, vectors).collect()}
    assert got[1] is None and got[3] is None and got[2] == pytest.approx(0.2, rel=1e-6) and got[4] == pytest.approx(0.2, rel=1e-6)
    scores = spark.createDataFrame(
        [(1, 1.0, 0.0, 0.1, 0, 0, 0)], "cand_id bigint, sum_w double, min_w double, turnover double, over_cap int, over_group int, unpriced int"
    ).withColumn("risk", F.lit(None).cast("double"))
    assert pf.feasibility(scores, RiskTarget()).first().violated == ["no_risk"]


HOLDINGS = "symbol string, price double, lot int, n0 int"


def test_unlisted_holdings_are_sold(spark):
    weights = spark.createDataFrame([(1, "A", 1.0), (2, "B", 0.5)], "cand_id bigint, symbol string, w double")
    holdings = spark.createDataFrame([("A", 10.0, 10, 0), ("B", 20.0, 10, 5), ("C", 1.0, 10, 0)], HOLDINGS)
    lots = pf.to_lots(weights, holdings, ExecutionConfig(notional=10_000.0))
    names = spark.createDataFrame([("A", 0.0), ("B", 0.0)], "symbol string, k_imp double")
    got = {(r.cand_id, r.sid): (r.side, r.shares) for r in pf.orders(lots, names).collect()}
    assert got == {(1, "A"): ("BUY", 1000), (1, "B"): ("SELL", 50), (2, "B"): ("BUY", 200)}


def test_no_order_at_unchanged_weights(spark):
    rng = np.random.default_rng(1)
    price = np.round(rng.random(199) * 100 + 1, 2)
    n0 = rng.integers(1, 50, 199)
    notional = float((price * n0 * 1000).sum())
    holdings = spark.createDataFrame([(f"s{i}", float(p), 1000, int(n)) for i, (p, n) in enumerate(zip(price, n0))], HOLDINGS)
    weights = holdings.select(F.lit(1).alias("cand_id"), "symbol", (F.col("price") * F.col("lot") * F.col("n0") / notional).alias("w"))
    for odd in (True, False):
        lots = pf.to_lots(weights, holdings, ExecutionConfig(notional=notional, odd_lots=odd))
        assert pf.orders(lots, holdings.select("symbol", F.lit(0.0).alias("k_imp"))).count() == 0


def test_untradable_names_stay_and_are_listed(spark):
    weights = spark.createDataFrame([(1, s, 0.2) for s in "ABCD"], "cand_id bigint, symbol string, w double")
    holdings = spark.createDataFrame([("A", 0.0, 10, 3), ("B", None, 10, 3), ("C", 5.0, 10, None), ("E", 5.0, 10, 2)], HOLDINGS)
    rows = {r.symbol: r for r in pf.to_lots(weights, holdings, ExecutionConfig(notional=1000.0)).collect()}
    assert {s for s, r in rows.items() if not r.tradable} == {"A", "B", "C", "D"} and rows["A"].lots == 3
    names = holdings.select("symbol", F.lit(0.0).alias("k_imp"))
    assert [r.sid for r in pf.orders(pf.to_lots(weights, holdings), names).collect()] == ["E"]


@pytest.mark.parametrize("doubles", [8_000_000, 0])
def test_both_quantile_plans_give_the_same_rows(spark, doubles):
    rng = np.random.default_rng(7)
    rows = [("a", float(x), None) for x in rng.normal(size=400)] + [(None, float(i), 1.0) for i in range(9)] + [("n", None, None)] * 3
    df = stage(spark.createDataFrame(rows, "g string, x double, y double"), "q")
    small = {r.g: (r.x_q, r.y_q) for r in exact_quantiles(df, ["g"], ["x", "y"], [0.1, 0.5]).collect()}
    large = {r.g: (r.x_q, r.y_q) for r in exact_quantiles(df, ["g"], ["x", "y"], [0.1, 0.5], small_group=0, broadcast_doubles=doubles).collect()}
    assert set(small) == set(large) == {"a", None, "n"}
    for g in small:
        for a, b in zip(small[g], large[g]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b))
    one = exact_quantiles(df, [], ["x"], [0.5], small_group=0).first().x_q[0]
    assert one == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))


def test_samples_are_not_shuffled_on_the_group_key(spark):
    df = stage(spark.range(5000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x")), "hot")
    edges = _edges(df, ["g"], ["x"], [0.5])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plans = [
            _with_edges(df, edges, ["g"], 2, doubles)._jdf.queryExecution().executedPlan().toString() for doubles in (1000, 0)
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plans[0] and "hashpartitioning" not in plans[0]
    assert all("_salt" in x for x in re.findall(r"hashpartitioning\(.*", plans[1])) and "hashpartitioning" in plans[1]
    salted = tail_mean(df, ["g"], "x", 0.9, broadcast_doubles=0)
    plain = tail_mean(df, ["g"], "x", 0.9)
    for x, y in zip(sorted(map(tuple, salted.collect())), sorted(map(tuple, plain.collect()))):
        assert x == pytest.approx(y)


T0 = dt.datetime(2024, 1, 1)


def landed(spark, path, hours):
    for i, h in enumerate(hours):
        row = ("X", f"s{i % 2}", T0 + dt.timedelta(hours=h), i, 10.0 + i, 9.0, 11.0, 1)
        spark.createDataFrame([row], QUOTE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_many_batches_keep_a_bounded_number_of_folders(spark, tmp_path):
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    landed(spark, path, range(7))
    changes = live.quote_totals(stream_quotes(spark, path, max_files=1))
    q = live.run_to_table(changes, table, str(tmp_path / "mark"), keys=["symbol"], compact_every=3)
    q.awaitTermination()
    assert q.exception() is None
    folders = sorted(p.name for p in (tmp_path / "table").iterdir())
    # The last two merges, and the batches since the first of them.
    assert folders == ["batch=3", "batch=4", "batch=5", "batch=6", "merged=2", "merged=5"]
    got = {r.symbol: r.totalVolume for r in live.snapshot(spark, table, ["symbol"]).collect()}
    assert got == {"s0": 4, "s1": 3}
    planned = live.snapshot(spark, table, ["symbol"])
    (tmp_path / "table" / "batch=7").mkdir()  # begun, not ended
    (tmp_path / "table" / "batch=7" / "part-0.parquet").write_bytes(b"half")
    assert {r.symbol: r.totalVolume for r in live.snapshot(spark, table, ["symbol"]).collect()} == got
    live.compact(spark, table, ["symbol"], 6)
    assert {r.symbol: r.totalVolume for r in planned.collect()} == got  # planned before the merge, read after it
    live.compact(spark, table, ["symbol"], 6)  # again: nothing changes
    assert {r.symbol: r.totalVolume for r in live.snapshot(spark, table, ["symbol"]).collect()} == got


def test_late_rows_are_counted_and_none_are_lost_without_a_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    landed(spark, path, [500, 499, 1, 0])
    for lateness, late in (("1 hour", True), (None, False)):
        name = f"bars-{lateness}"
        bars = live.stream_bars(stream_quotes(spark, path, max_files=1), "day", lateness)
        q = live.run_to_table(bars, str(tmp_path / name), str(tmp_path / f"{name}-mark"))
        q.awaitTermination()
        assert (live.late_rows(q) > 0) == late
        volume = live.snapshot(spark, str(tmp_path / name), ["dt", "symbol"]).agg(F.sum("V")).first()[0]
        assert (volume < 4) == late


def test_repeated_cells_leave_the_same_row_whatever_the_partitions(spark):
    from marketloom.operators.panel import calendar, dense_panel

    rows = [(dt.date(2024, 1, d), s, float(c)) for d, s, c in [(1, "a", 3), (1, "a", 5), (1, "a", 4), (2, "a", 1), (2, "b", 7), (2, "b", 2)]]
    cells = spark.createDataFrame(rows, "dt date, symbol string, C double")
    cal = stage(calendar(cells), "cal")
    for n in (1, 3):
        got = {(r.symbol, r.t): r.C for r in dense_panel(cells.repartition(n), cal).collect()}
        assert got == {("a", 0): 5.0, ("a", 1): 1.0, ("b", 0): None, ("b", 1): 7.0}


def test_listed_labels_get_a_column(spark):
    from marketloom.sinks.tables import matrix_sheet

    cells = spark.createDataFrame([("x", "a", 1.0), ("x", "b", float("nan")), ("y", "c", 2.0)], "r string, c string, v double")
    sheet = matrix_sheet(cells, "r", "c", "v", ["a", "b", "c"])
    assert sheet.columns == ["r", "a", "b", "c"]
    assert {tuple(r) for r in sheet.collect()} == {("x", 1.0, 0.0, 0.0), ("y", 0.0, 0.0, 2.0)}


def test_budget_is_a_parameter(spark):
    scores = spark.createDataFrame(
        [(1, 0.5, 0.0, 0.001, 0.1, 0, 0, 0)],
        "cand_id bigint, sum_w double, min_w double, risk double, turnover double, over_cap int, over_group int, unpriced int",
    )
    assert pf.feasibility(scores).first().violated == ["budget"]
    assert pf.feasibility(scores, budget=0.5).first().feasible


def test_skipped_responses_are_counted(spark):
    from marketloom.sources.json_feeds import last_per_code, response_counts

    bodies = [
        '{"stat":"OK","data":[["2330","n","1"],["1","n"],7,[1,"n","2"]]}', '{"stat":"OK"}', '{"stat":"NO DATA","data":[]}',
        '{"data":[["2330","n","1"]]}', '{"stat":1}', "{broken", None,
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = response_counts(df).first().asDict()
    assert got == {"responses": 7, "broken": 2, "not_ok": 3, "no_data": 1, "rows": 4, "short_rows": 2, "codeless_rows": 1}
    pages = spark.createDataFrame([(1, 9, "a", 1), (2, 0, "a", 2), (1, 3, "a", 3)], "page int, pos int, code string, v int")
    assert last_per_code(pages, value=F.col("v"), pages=("page",)).first().value == 2

"""Steps of the checking SQL: the same roles and chains, written for DuckDB."""

from __future__ import annotations

from marketloom.catalog.base import view
from marketloom.config import FEATURES, PANEL_FIELDS

GUARD = 1e-12


def div(a: str, b: str) -> str:
    return (
        f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
        f"WHEN abs({b}) < {GUARD} THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"
    )


def chg(now: str, before: str) -> str:
    return div(f"({now}) - ({before})", before)


def _ticks(symbol: str) -> str:
    return f"""
    SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS d,
           CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1099511627776
             + CAST(round(l_extendedprice * 100) AS BIGINT) * 64 + CAST(l_quantity AS BIGINT) AS seq,
           l_extendedprice / l_quantity AS price, CAST(l_quantity AS BIGINT) AS qty,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS val, l_returnflag AS flag
    FROM lineitem"""


def bars_sql(ticks: str, unit: str) -> str:
    return f"""
    SELECT symbol, CAST(date_trunc('{unit}', d) AS DATE) AS dt,
           arg_min(price, seq) AS O, max(price) AS H, min(price) AS L, arg_max(price, seq) AS C,
           CAST(sum(qty) AS DOUBLE) AS V, CAST(sum(val) AS DOUBLE) AS VAL,
           CAST(sum(CASE WHEN flag = 'A' THEN qty ELSE 0 END) AS DOUBLE) AS inside_vol,
           CAST(sum(CASE WHEN flag = 'R' THEN qty ELSE 0 END) AS DOUBLE) AS outside_vol
    FROM {ticks} GROUP BY 1, 2"""


def _flow(symbol: str) -> str:
    return f"""
    SELECT {symbol} AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS dt,
           CAST(sum(CASE o_orderstatus WHEN 'F' THEN CAST(floor(o_totalprice) AS BIGINT)
                         WHEN 'O' THEN -CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS netbuy
    FROM orders GROUP BY 1, 2"""


META = """
    SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 1000 END AS lot,
           n_name AS industry, r_name AS "group",
           CASE WHEN s_suppkey % 25 = 7 THEN 0 ELSE 1 END AS meta_flag
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

W = "(PARTITION BY symbol ORDER BY t)"


def rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


PAST = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def filled(c: str) -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER {PAST}, "
        f"first_value({c} IGNORE NULLS) OVER {WHOLE}) AS {c}"
    )


def ema(x: str, alpha: float) -> str:
    """A fold over the list of values so far."""
    return (
        f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {PAST}, "
        f"lambda a, v: {alpha!r} * v + (1 - {alpha!r}) * a)"
    )


GK = (
    "sqrt(greatest(0.5 * ln(H / L) * ln(H / L) - (2 * ln(2.0) - 1) * ln(C / O) * ln(C / O), 0.0))"
)


def _chain(p: str, symbol: str, flow_symbol: str, meta: bool) -> None:
    """Panel and features for one kind of symbol; ``p`` prefixes the step names."""
    view(f"{p}ticks", _ticks(symbol))
    view(f"{p}bars", bars_sql(f"{p}ticks", "week"), f"{p}ticks")
    view(
        f"{p}cal",
        f"SELECT dt, CAST(row_number() OVER (ORDER BY dt) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT dt FROM {p}bars)",
        f"{p}bars",
    )
    view(f"{p}flow", _flow(flow_symbol))
    if meta:
        view("meta", META)
    fields = ", ".join(f"b.{c}" for c in PANEL_FIELDS)
    extra = ', m.lot, m.industry, m."group", m.meta_flag' if meta else ", 1 AS meta_flag"
    join = "LEFT JOIN meta m ON m.symbol = g.symbol" if meta else ""
    view(
        f"{p}cells",
        f"""SELECT g.dt, g.t, g.symbol, {fields}, f.netbuy {extra}
        FROM (SELECT c.dt, c.t, s.symbol FROM {p}cal c, (SELECT DISTINCT symbol FROM {p}bars) s) g
        LEFT JOIN {p}bars b ON b.dt = g.dt AND b.symbol = g.symbol
        LEFT JOIN {p}flow f ON f.dt = g.dt AND f.symbol = g.symbol {join}""",
        f"{p}bars", f"{p}cal", f"{p}flow", *(["meta"] if meta else []),
    )
    view(
        f"{p}panel",
        f"""SELECT *, CASE WHEN coalesce(V, 0) = 0 OR coalesce(VAL, 0) = 0 THEN 0
                   ELSE coalesce(meta_flag, 1) END AS tradable_flag
        FROM (SELECT dt, t, symbol, netbuy, meta_flag, {', '.join(filled(c) for c in PANEL_FIELDS)} FROM {p}cells)""",
        f"{p}cells",
    )
    strength = div("netbuy", "V")
    view(
        f"{p}feat",
        f"""SELECT *, {chg('O', 'pc')} AS gap, {chg('C', 'c5')} AS mom5, {chg('C', 'c10')} AS mom10,
             {chg('C', 'c20')} AS mom20, {GK} AS gk_vol, ln(1 + VAL) AS liquidity,
             {div('VAL', 'day_val')} AS turnover_share,
             {div('outside_vol - inside_vol', 'outside_vol + inside_vol')} AS imbalance,
             CASE WHEN n10 = 10 THEN {chg('C', 'ma10')} END AS bias,
             {ema('strength', 0.5)} AS broker_strength
        FROM (SELECT *, lag(C) OVER {W} AS pc, lag(C, 5) OVER {W} AS c5, lag(C, 10) OVER {W} AS c10,
                lag(C, 20) OVER {W} AS c20, avg(C) OVER {rows(10)} AS ma10, count(C) OVER {rows(10)} AS n10,
                avg(VAL) OVER {rows(30)} AS adv, CAST(sum(CAST(VAL AS DECIMAL(38,4))) OVER (PARTITION BY dt) AS DOUBLE) AS day_val,
                {strength} AS strength FROM {p}panel)""",
        f"{p}panel",
    )
    limits = ", ".join(
        f"quantile_cont({f}, 0.01) AS lo_{f}, quantile_cont({f}, 0.99) AS hi_{f}" for f in FEATURES
    )
    view(f"{p}limits", f"SELECT dt, {limits} FROM {p}feat GROUP BY dt", f"{p}feat")
    pulled = ", ".join(
        f"CASE WHEN {f} IS NOT NULL THEN greatest(least({f}, hi_{f}), lo_{f}) END AS {f}"
        for f in FEATURES
    )
    view(
        f"{p}wins",
        f"SELECT dt, t, symbol, O, H, L, C, V, VAL, netbuy, adv, tradable_flag, {pulled} FROM {p}feat JOIN {p}limits USING (dt)",
        f"{p}feat", f"{p}limits",
    )
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    view(f"{p}stats", f"SELECT dt, {stats} FROM {p}wins GROUP BY dt", f"{p}wins")
    zs = ", ".join(
        f"coalesce(greatest(least({div(f'{f} - m_{f}', f's_{f}')}, 3.0), -3.0) * CASE WHEN {f} IS NULL THEN NULL ELSE 1 END, 0.0) AS {f}_z"
        for f in FEATURES
    )
    view(
        f"{p}zraw",
        f"SELECT w.*, {zs}, {chg(f'lead(C) OVER {W}', 'C')} AS label FROM {p}wins w JOIN {p}stats USING (dt)",
        f"{p}wins", f"{p}stats",
    )
    view(
        f"{p}zed",
        f"""SELECT z.* REPLACE (CASE WHEN label IS NOT NULL THEN greatest(least(label, hi), lo) END AS label) FROM {p}zraw z
        JOIN (SELECT dt AS d, quantile_cont(label, 0.01) AS lo, quantile_cont(label, 0.99) AS hi FROM {p}zraw GROUP BY dt) ON d = dt""",
        f"{p}zraw",
    )


_chain("", "CAST(l_suppkey AS VARCHAR)", "CAST(o_custkey // 15 AS VARCHAR)", meta=True)
_chain("n", "CAST(l_partkey % 64 AS VARCHAR)", "CAST(o_custkey % 64 AS VARCHAR)", meta=False)

view(
    "quotes",
    """SELECT 'X' || CAST(user_id % 3 AS VARCHAR) AS exchange, CAST(user_id AS VARCHAR) AS symbol, ts,
        event_id AS seq, value AS price, k * CAST(0.5 AS DOUBLE) AS bid, k * CAST(0.5 AS DOUBLE) + 20 AS ask, k AS qty
    FROM (SELECT *, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events)""",
)
view(
    "sided",
    """SELECT *, CASE WHEN price >= ask THEN 'OUT' WHEN price <= bid THEN 'IN' END AS side FROM quotes""",
    "quotes",
)
view(
    "cands",
    """SELECT vec_id AS cand_id, CAST(i - 1 AS VARCHAR) AS symbol, abs(CAST(embedding[i] AS DOUBLE)) / total AS w
    FROM (SELECT vec_id, embedding, list_reduce(list_prepend(0.0, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), lambda a, x: a + x) AS total,
                 unnest(range(1, 65)) AS i FROM embeddings)""",
)
view(
    "samples",
    """SELECT event_type AS state, CAST(user_id % 8 AS VARCHAR) AS action, event_id AS ell, value / 1000 - 0.05 AS ret FROM events""",
)
view(
    "trans",
    """SELECT i, a, j, n / sum(n) OVER (PARTITION BY i, a) AS p FROM (
      SELECT event_type AS i, CAST(user_id % 8 AS VARCHAR) AS a,
             ['click', 'error', 'purchase', 'signup', 'view'][1 + CAST(props::JSON ->> '$.k' AS INTEGER) % 5] AS j,
             count(*) AS n FROM events GROUP BY 1, 2, 3)""",
)
view(
    "occ",
    """SELECT event_type AS state, CAST(user_id % 8 AS VARCHAR) AS action,
        CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) END AS x
    FROM events GROUP BY 1, 2""",
)

"""Queries: standardised sections, fits, forecasts, covariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import roles
from marketloom.catalog.base import query, rounded, sql, view
from marketloom.catalog.q_panel import features, weekly_and_calendar
from marketloom.catalog.views import W, chg, div
from marketloom.config import FEATURES, STAGE1, Config, RiskConfig, TrainConfig
from marketloom.operators import forecast as fc
from marketloom.operators import risk as rk
from marketloom.operators.boosting import BoostConfig, boosted_trees
from marketloom.operators.panel import calendar, day_before_last
from marketloom.plans.daily import FORECAST_COLUMNS, clean_panel, fitted, forecast, risk_and_stage1, risk_panel
from marketloom.plans.next_day import initial_state, predict_day
from marketloom.session import stage

TWO = ("gap", "mom5")
PAIRS = [(i, j) for i in range(10) for j in range(i, 10)]
TRAIN = TrainConfig()


def sections(spark, sf):
    return fc.labelled_sections(features(spark, sf, keep=FORECAST_COLUMNS, target="CC"), winsorize_label=0.01)


@query("w14_winsorised_returns", sql("SELECT dt, symbol, round(label, 6) AS label FROM zed WHERE label IS NOT NULL", "zed"))
def w14_returns(spark, sf):
    """The returns that fits see, pulled to the first and last percent of their date."""
    return rounded(sections(spark, sf).where("label IS NOT NULL").select("dt", "symbol", "label"), 6, "label")


@query("m1_standardised_features", sql(
    "SELECT dt, symbol, " + ", ".join(f"round({f}_z, 4) AS {f}" for f in FEATURES) + " FROM zed", "zed"))
def m1(spark, sf):
    z = sections(spark, sf)
    return z.select("dt", "symbol", *[F.round(f"{f}_z", 4).alias(f) for f in FEATURES])


_G = {f"g_{i}_{j}": f"{FEATURES[i]}_z * {FEATURES[j]}_z" for i, j in PAIRS}
_B = {f"b_{i}": f"{f}_z * label" for i, f in enumerate(FEATURES)}
view(
    "gram",
    "SELECT dt, t, count(label) AS n, "
    + ", ".join(f"coalesce(sum({e}) FILTER (WHERE label IS NOT NULL), 0.0) AS {c}" for c, e in {**_G, **_B}.items())
    + " FROM zed GROUP BY dt, t",
    "zed",
)
_ALL = [*_G, *_B]


def trailing_view(name, window, half_life, cols):
    view(
        name,
        "SELECT d.dt, d.t, CAST(sum(g.n) AS BIGINT) AS n, "
        + ", ".join(f"sum(g.{c} * pow(2.0, (g.t - d.t + 1) / {half_life})) AS {c}" for c in cols)
        + f" FROM gram d JOIN gram g ON g.t >= d.t - {window} AND g.t <= d.t - 1 GROUP BY d.dt, d.t HAVING sum(g.n) > 0",
        "gram",
    )


trailing_view("tgram", 252, 60.0, _ALL)
trailing_view("tgram1", 60, 20.0, _ALL)


def solve_views(name, trailing, lam=1.0, n=10):
    """(G + lam I) beta = b by elimination, one view for each step; then back substitution.

    The matrix is symmetric and positive definite, so no pivoting is needed. View ``name`` has
    (dt, t, n, beta_0, ...).
    """
    g = {(i, j): f"g_{i}_{j}" + (f" + {lam}" if i == j else "") for i in range(n) for j in range(i, n)}
    cols = [f"{e} AS a_{i}_{j}" for (i, j), e in g.items()] + [f"b_{i} AS y_{i}" for i in range(n)]
    view(f"{name}_0", f"SELECT dt, t, n, {', '.join(cols)} FROM {trailing}", trailing)
    for k in range(n - 1):
        new = [
            f"a_{i}_{j} - a_{k}_{i} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in range(k + 1, n) for j in range(i, n)
        ] + [f"y_{i} - a_{k}_{i} * y_{k} / a_{k}_{k} AS y_{i}" for i in range(k + 1, n)]
        view(f"{name}_{k + 1}", f"SELECT * REPLACE ({', '.join(new)}) FROM {name}_{k}", f"{name}_{k}")
    last = f"{name}_{n - 1}"
    for k in range(n - 1, -1, -1):
        rest = "".join(f" - a_{k}_{j} * beta_{j}" for j in range(k + 1, n))
        view(f"{name}_back{k}", f"SELECT *, (y_{k}{rest}) / a_{k}_{k} AS beta_{k} FROM {last}", last)
        last = f"{name}_back{k}"
    view(name, "SELECT dt, t, n, " + ", ".join(f"beta_{i}" for i in range(n)) + f" FROM {last}", last)


solve_views("beta10", "tgram")
solve_views("beta10s", "tgram1")
_SCORE10 = " + ".join(f"beta_{i} * {f}_z" for i, f in enumerate(FEATURES))


def _spread(g, digits):
    """A gram array as columns."""
    names = fc.gram_layout(10)
    cols = [f"round(gram[{k}], {digits}) AS {n}" for k, n in enumerate(names[:-1])]
    return g.selectExpr("dt", "t", f"CAST(gram[{len(names) - 1}] AS BIGINT) AS n", *cols)


@query("a16_normal_equations", sql(
    "SELECT dt, t, n, " + ", ".join(f"round({c}, 3) AS {c}" for c in _ALL) + " FROM gram", "gram"))
def a16(spark, sf):
    g = fc.daily_gram(sections(spark, sf), [f"{f}_z" for f in FEATURES])
    return _spread(g, 3)


@query("w10_trailing_window", sql(
    "SELECT dt, t, n, " + ", ".join(f"round({c}, 2) AS {c}" for c in _ALL) + " FROM tgram", "tgram"))
def w10(spark, sf):
    g = fc.daily_gram(sections(spark, sf), [f"{f}_z" for f in FEATURES])
    return _spread(fc.trailing_gram(g, TRAIN), 2)


def _beta_sql(trailing, lam=1.0):
    """Cramer's rule for two features."""
    a, d = f"(g_0_0 + {lam})", f"(g_1_1 + {lam})"
    det = f"({a} * {d} - g_0_1 * g_0_1)"
    return (
        f"SELECT dt, t, n, (b_0 * {d} - g_0_1 * b_1) / {det} AS b1, ({a} * b_1 - g_0_1 * b_0) / {det} AS b2 FROM {trailing}"
    )


view("beta2", _beta_sql("tgram"), "tgram")


@query("m2_ridge_two_features", sql(
    "SELECT dt, n, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM beta2", "beta2"))
def m2_two(spark, sf):
    beta = fitted(sections(spark, sf), TRAIN, TWO)
    return beta.select("dt", "n", F.round(F.col("beta")[0], 5).alias("b1"), F.round(F.col("beta")[1], 5).alias("b2"))


def _gradients(spark, sf, cfg):
    """(dt, n, feature, beta, gradient of the squared loss, sum of |G|) of the ten-feature fit."""
    g = stage(fc.trailing_gram(fc.daily_gram(sections(spark, sf), [f"{f}_z" for f in FEATURES]), cfg), "gram")
    beta = fc.fit(g, 10, cfg).select("t", "beta")
    names = fc.gram_layout(10)
    both = g.join(beta, "t").withColumn("n", F.element_at("gram", -1).cast("bigint"))

    def entry(i, j):
        return F.col("gram")[names.index(f"g_{min(i, j)}_{max(i, j)}")]

    rows = [
        F.struct(
            F.lit(FEATURES[i]).alias("feature"),
            F.col("beta")[i].alias("beta"),
            (sum((entry(i, j) * F.col("beta")[j] for j in range(10)), F.lit(0.0)) - F.col("gram")[names.index(f"b_{i}")]).alias("gradient"),
            sum((F.abs(entry(i, j)) for j in range(10)), F.lit(0.0)).alias("scale"),
        )
        for i in range(10)
    ]
    return both.select("dt", "n", F.explode(F.array(*rows)).alias("r")).select("dt", "n", "r.*")


_EXPECT = f"SELECT dt, n, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, true AS optimal FROM tgram"


@query("m2_ridge_optimality", sql(_EXPECT, "tgram"))
def m2(spark, sf):
    """The ten-feature fit solves its normal equations: the penalised gradient vanishes."""
    left = F.abs(F.col("gradient") + TRAIN.lam * F.col("beta"))
    return _gradients(spark, sf, TRAIN).select("dt", "n", "feature", (left < 1e-6).alias("optimal"))


@query("m3_lasso_optimality", sql(_EXPECT, "tgram"))
def m3(spark, sf):
    """The lasso fit meets its optimality conditions, to what its tolerance moves a gradient by."""
    cfg = TrainConfig(model="LASSO")
    out = _gradients(spark, sf, cfg)
    still = F.when(
        F.col("beta") == 0, F.greatest(F.abs("gradient") - cfg.lam, F.lit(0.0))
    ).otherwise(F.abs(F.col("gradient") + cfg.lam * F.signum("beta")))
    near = cfg.lasso_tol * F.col("scale") + 1e-9
    return out.select("dt", "n", "feature", (still <= near).alias("optimal"))


def boost_views(name, cfg):
    """The same trees in SQL, a view for each level; leaves ``{name}`` (dt, symbol, rhat_raw)."""
    bins = ", ".join(f"greatest(least(CAST(floor(({f}_z + 3.0) * {cfg.bins / 6!r}) AS INTEGER), {cfg.bins - 1}), 0)" for f in FEATURES)
    last = f"(SELECT max(t) // {cfg.step} FROM zed)"
    view(
        f"{name}_rows0",
        f"""SELECT fit, dt, symbol, pow(2.0, (t - (fit * {cfg.step} - 1)) / {cfg.half_life}) AS w, label AS r, false AS score, bins FROM (
          SELECT *, unnest(range(t // {cfg.step} + 1, least((t + {cfg.window}) // {cfg.step}, {last}) + 1)) AS fit, [{bins}] AS bins FROM zed WHERE label IS NOT NULL)
        UNION ALL SELECT t // {cfg.step} AS fit, dt, symbol, 0.0 AS w, 0.0 AS r, true AS score, [{bins}] AS bins FROM zed WHERE t >= {cfg.step}""",
        "zed",
    )
    rows = f"{name}_rows0"
    for tree in range(cfg.trees):
        view(f"{name}_{tree}_0", f"SELECT *, 1 AS node FROM {rows}", rows)
        for level in range(cfg.depth):
            at = f"{name}_{tree}_{level}"
            view(
                f"{at}_split",
                f"""SELECT fit, node, feature, bin FROM (SELECT *, row_number() OVER (PARTITION BY fit, node ORDER BY gain DESC, feature, bin) AS place FROM (
                  SELECT fit, node, feature, bin, gl * gl / (hl + {cfg.lam}) + (g - gl) * (g - gl) / (h - hl + {cfg.lam}) - g * g / (h + {cfg.lam}) AS gain FROM (
                    SELECT fit, node, feature, bin, sum(h) OVER l AS hl, sum(g) OVER l AS gl, sum(h) OVER a AS h, sum(g) OVER a AS g, max(bin) OVER a AS top FROM (
                      SELECT fit, node, feature, bins[feature] AS bin, sum(w) AS h, sum(w * r) AS g FROM {at}, range(1, {len(FEATURES) + 1}) f(feature) WHERE NOT score GROUP BY ALL)
                    WINDOW l AS (PARTITION BY fit, node, feature ORDER BY bin), a AS (PARTITION BY fit, node, feature))
                  WHERE bin < top) WHERE gain > 1e-12) WHERE place = 1""",
                at,
            )
            view(
                f"{name}_{tree}_{level + 1}",
                f"""SELECT r.* REPLACE (CASE WHEN s.bin IS NULL THEN r.node ELSE r.node * 2 + CASE WHEN r.bins[s.feature] > s.bin THEN 1 ELSE 0 END END AS node)
                FROM {at} r LEFT JOIN {at}_split s ON s.fit = r.fit AND s.node = r.node""",
                at, f"{at}_split",
            )
        grown = f"{name}_{tree}_{cfg.depth}"
        rows = f"{name}_rows{tree + 1}"
        view(
            rows,
            f"""SELECT x.* EXCLUDE (node) REPLACE (r - coalesce(v, 0.0) AS r) FROM {grown} x
            LEFT JOIN (SELECT fit, node, {cfg.rate} * sum(w * r) / (sum(w) + {cfg.lam}) AS v FROM {grown} WHERE NOT score GROUP BY 1, 2) USING (fit, node)""",
            grown,
        )
    view(name, f"SELECT dt, symbol, -r AS rhat_raw FROM {rows} WHERE score", rows)


STUMP = BoostConfig(step=63, trees=1, depth=1, bins=16)
TREES = BoostConfig(step=63, trees=2, depth=2, bins=16)
boost_views("stump", STUMP)
boost_views("trees", TREES)


@query("m4_one_split", sql("SELECT dt, symbol, round(rhat_raw, 7) AS rhat_raw FROM stump", "stump"))
def m4_stump(spark, sf):
    return rounded(boosted_trees(sections(spark, sf), cfg=STUMP), 7, "rhat_raw")


@query("m4_boosted_trees", sql("SELECT dt, symbol, round(rhat_raw, 7) AS rhat_raw FROM trees", "trees"))
def m4(spark, sf):
    """Two trees of two levels for each of the walk-forward's models, every date scored."""
    return rounded(boosted_trees(sections(spark, sf), cfg=TREES), 7, "rhat_raw")


view(
    "raw",
    "SELECT z.*, b1 * gap_z + b2 * mom5_z AS rhat_raw FROM zed z JOIN beta2 USING (dt)",
    "zed",
    "beta2",
)


def raw(spark, sf):
    z = sections(spark, sf)
    beta = stage(fitted(z, TRAIN, TWO), "beta")
    return fc.raw_score(z, beta, [f"{x}_z" for x in TWO])


@query("m5_raw_score", sql("SELECT dt, symbol, round(rhat_raw, 5) AS rhat_raw FROM raw", "raw"))
def m5(spark, sf):
    return rounded(raw(spark, sf).select("dt", "symbol", "rhat_raw"), 5, "rhat_raw")


def outside_scores(z):
    even = F.col("symbol").cast("int") % 2 == 0
    return z.where(even).select("dt", "symbol", (0.01 * F.col("mom10_z")).alias("score"))


view(
    "raw6",
    "SELECT * REPLACE (CASE WHEN CAST(symbol AS INTEGER) % 2 = 0 THEN 0.01 * mom10_z ELSE rhat_raw END AS rhat_raw) FROM raw",
    "raw",
)


@query("m6_external_scores", sql("SELECT dt, symbol, round(rhat_raw, 5) AS rhat_raw FROM raw6", "raw6"))
def m6(spark, sf):
    r = stage(raw(spark, sf), "raw")
    out = fc.external_score(r, outside_scores(r))
    return rounded(out.select("dt", "symbol", "rhat_raw"), 5, "rhat_raw")


view("raw10", f"SELECT z.*, {_SCORE10} AS rhat_raw FROM zed z JOIN beta10 USING (dt)", "zed", "beta10")


def calibrated_views(name, raw_scores):
    view(
        f"{name}z",
        f"""SELECT r.*, greatest(least({div('rhat_raw - m', 's')}, 3.0), -3.0) AS z FROM {raw_scores} r
        JOIN (SELECT dt AS d, avg(rhat_raw) AS m, stddev_pop(rhat_raw) AS s FROM {raw_scores} GROUP BY dt) ON d = dt""",
        raw_scores,
    )
    view(
        name,
        f"""SELECT *, sign(z) * CASE WHEN abs(z) <= p50 THEN {div('abs(z)', 'p50')} * 0.003
      ELSE {div('abs(z) - p50', 'p75 - p50')} * (0.010 - 0.003) + 0.003 END AS rhat_cal
        FROM {name}z JOIN (SELECT dt AS d, quantile_cont(abs(z), 0.5) AS p50, quantile_cont(abs(z), 0.75) AS p75 FROM {name}z GROUP BY dt) ON d = dt""",
        f"{name}z",
    )


calibrated_views("cal2", "raw")
calibrated_views("cal10", "raw10")


@query("m7_calibrated", sql("SELECT dt, symbol, round(rhat_cal, 7) AS rhat_cal FROM cal2", "cal2"))
def m7(spark, sf):
    out = fc.calibrate(stage(raw(spark, sf), "raw"))
    return rounded(out.select("dt", "symbol", "rhat_cal"), 7, "rhat_cal")


_ENHANCED = """SELECT dt, symbol, round(rhat_raw, 5) AS rhat_raw, round(rhat_cal, 7) AS rhat_cal,
    round(rhat_cal * (1 + 0.1 * broker_strength_z + 0.1 * imbalance_z + 0.1 * turnover_share_z)
      * greatest(0.0, 1 - greatest(coalesce(abs(bias), 0.0) - 0.1, 0.0)), 7) AS rhat_enh FROM {}"""


@query("m8_q5_forecast_two_features", sql(_ENHANCED.format("cal2"), "cal2"))
def m8(spark, sf):
    out = forecast(features(spark, sf, keep=FORECAST_COLUMNS, target="CC"), Config(), "CC", TWO, keep=()).select("dt", "symbol", "rhat_raw", "rhat_cal", "rhat_enh")
    return rounded(rounded(out, 5, "rhat_raw"), 7, "rhat_cal", "rhat_enh")


@query("q5_forecast", sql(_ENHANCED.format("cal10"), "cal10"))
def q5(spark, sf):
    """All ten features, every date."""
    out = forecast(features(spark, sf, keep=FORECAST_COLUMNS, target="CC"), keep=()).select("dt", "symbol", "rhat_raw", "rhat_cal", "rhat_enh")
    return rounded(rounded(out, 5, "rhat_raw"), 7, "rhat_cal", "rhat_enh")


@query("q5_next_days_from_state", sql(
    _ENHANCED.format("cal10 WHERE t >= (SELECT max(t) - 1 FROM cal)"), "cal10", "cal"))
def q5_next(spark, sf):
    """The last two dates, each from the state after the one before and its own rows."""
    daily, cal = weekly_and_calendar(spark, sf)
    cal = stage(cal, "calendar")
    first, second = [r.dt for r in cal.where("t >= n_dates - 2").orderBy("t").collect()]
    flow = stage(roles.flow(spark, sf), "flow")
    history = daily.where(F.col("dt") < first)
    days = stage(calendar(history), "calendar")
    panel = clean_panel(history, days, flow.where(F.col("dt") < first))
    state, out = initial_state(panel, top=days.agg(F.max("t")).first()[0]), []
    for dt in (first, second):
        rows = daily.where(F.col("dt") == dt).join(flow.where(F.col("dt") == dt), ["symbol", "dt"], "full")
        made, state = predict_day(rows, state)
        out.append(stage(made, "forecast"))
    return rounded(rounded(out[0].unionByName(out[1]), 5, "rhat_raw"), 7, "rhat_cal", "rhat_enh")


# ---- risk -------------------------------------------------------------------------------

AT = "(SELECT max(t) - 1 FROM {p}cal)"


def risk_views(p):
    at = AT.format(p=p)
    view(
        f"{p}rets",
        f"""SELECT symbol, t, coalesce(r, 0.0) AS r, pow(2.0, (t - {at}) / 30.0) AS w
        FROM (SELECT symbol, t, {chg('C', f'lag(C) OVER {W}')} AS r FROM {p}wins)
        WHERE t > 0 AND t <= {at}""",
        f"{p}wins", f"{p}cal",
    )
    view(
        f"{p}devs",
        f"""SELECT symbol, t, sqrt(w) * (r - m) AS d FROM {p}rets JOIN
        (SELECT symbol, sum(w * r) / sum(w) AS m FROM {p}rets GROUP BY symbol) USING (symbol)""",
        f"{p}rets",
    )
    view(
        f"{p}sized",
        f"""SELECT dt, symbol, gk_vol AS sigma, adv, 1 + 0.6 * (1 - percent_rank() OVER (ORDER BY adv)) AS scale, norm
        FROM {p}wins JOIN (SELECT symbol, sqrt(sum(d * d)) AS norm FROM {p}devs GROUP BY symbol) USING (symbol) WHERE t = {at}""",
        f"{p}wins", f"{p}cal", f"{p}devs",
    )
    view(
        f"{p}cov",
        f"""SELECT sym_i, sym_j, rho, rho * a.sigma * b.sigma * a.scale * b.scale + CASE WHEN sym_i = sym_j THEN 1e-8 ELSE 0 END AS cov
        FROM (SELECT sym_i, sym_j, CASE WHEN sym_i = sym_j THEN 1.0 ELSE {div('dd', 'na * nb')} END AS rho FROM
           (SELECT x.symbol AS sym_i, y.symbol AS sym_j, sum(x.d * y.d) AS dd, any_value(a.norm) AS na, any_value(b.norm) AS nb
            FROM {p}devs x JOIN {p}devs y ON x.t = y.t AND x.symbol <= y.symbol
            JOIN {p}sized a ON a.symbol = x.symbol JOIN {p}sized b ON b.symbol = y.symbol GROUP BY 1, 2)) p
        JOIN {p}sized a ON a.symbol = sym_i JOIN {p}sized b ON b.symbol = sym_j""",
        f"{p}devs", f"{p}sized",
    )


risk_views("")
risk_views("n")
# Small blocks, so that the small tables are cut into several block pairs too.
RISK = RiskConfig(block_size=16)


@query("r1_name_volatility_gk", sql("SELECT symbol, t, round(gk_vol, 6) AS sigma FROM wins", "wins"))
def r1(spark, sf):
    out = rk.name_volatility(risk_panel(*weekly_and_calendar(spark, sf)))
    return out.select("symbol", "t", F.round("sigma", 6).alias("sigma"))


@query("r1_name_volatility_std", sql(
    f"""SELECT symbol, t, round(CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) > 1
      THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END, 6) AS sigma
    FROM (SELECT symbol, t, {chg('C', f'lag(C) OVER {W}')} AS r FROM wins)""", "wins"))  # fmt: skip
def r1_std(spark, sf):
    out = rk.name_volatility(risk_panel(*weekly_and_calendar(spark, sf)), RiskConfig(sigma_source="STD"))
    return out.select("symbol", "t", F.round("sigma", 6).alias("sigma"))


def day_risk(spark, sf):
    panel = risk_panel(*weekly_and_calendar(spark, sf))
    return rk.liquidity_scaled_risk(panel, day_before_last(panel), RISK)


@query("j7_a6_decayed_correlation", sql("SELECT sym_i, sym_j, round(rho, 6) AS rho FROM cov", "cov"))
def a6(spark, sf):
    _, cov = day_risk(spark, sf)
    return rounded(cov.pairs().select("sym_i", "sym_j", "rho"), 6, "rho")


@query("r2_liquidity_scaled_covariance", sql("SELECT sym_i, sym_j, round(cov, 5) AS cov FROM cov", "cov"))
def r2(spark, sf):
    _, cov = day_risk(spark, sf)
    return rounded(cov.pairs().select("sym_i", "sym_j", "cov"), 5, "cov")


@query("r2_asked_pairs", sql(
    """SELECT sym_i, sym_j, round(cov, 5) AS cov FROM (SELECT sym_i, sym_j, cov FROM cov UNION ALL
      SELECT sym_j, sym_i, cov FROM cov WHERE sym_i <> sym_j) WHERE CAST(sym_i AS INTEGER) + 1 = CAST(sym_j AS INTEGER) OR sym_i = sym_j
      OR (CAST(sym_j AS INTEGER) = 1 AND CAST(sym_i AS INTEGER) % 7 = 3)""", "cov"))  # fmt: skip
def r2_asked(spark, sf):
    """Some entries of the matrix: of its tiles, only the cells asked for are multiplied."""
    names, cov = day_risk(spark, sf)
    i = F.col("symbol").cast("int")
    others = F.array(i, i + 1, F.when(i % 7 == 3, F.lit(1)))
    asked = names.select(F.col("symbol").alias("sym_i"), F.explode(F.array_distinct(F.array_compact(others)).cast("array<string>")).alias("sym_j"))
    return rounded(cov.asked(asked).select("sym_i", "sym_j", "cov"), 5, "cov")


@query("q4_risk_names", sql(
    """SELECT dt, symbol, round(sigma, 6) AS sigma, round(scale, 6) AS scale FROM sized""", "sized"))  # fmt: skip
def q4_names(spark, sf):
    names, _ = day_risk(spark, sf)
    return rounded(names.select("dt", "symbol", "sigma", "scale"), 6, "sigma", "scale")


@query("q4_stage1_two_features", sql(
    f"""SELECT dt, symbol, round(b1 * gap_z + b2 * mom5_z, 5) AS rhat_raw FROM zed JOIN ({_beta_sql("tgram1")}) b USING (dt)
    WHERE zed.t = {AT.format(p='')}""", "zed", "tgram1", "cal"))  # fmt: skip
def q4_two(spark, sf):
    z = sections(spark, sf)
    at = day_before_last(z)
    beta = stage(fitted(z, STAGE1, TWO).where(F.col("t") == at), "beta")
    out = fc.raw_score(z.where(F.col("t") == at), beta, [f"{x}_z" for x in TWO])
    return rounded(out.select("dt", "symbol", "rhat_raw"), 5, "rhat_raw")


@query("q4_stage1_forecast", sql(
    f"SELECT dt, symbol, round({_SCORE10}, 5) AS rhat_raw FROM zed JOIN beta10s USING (dt) WHERE zed.t = {AT.format(p='')}",
    "zed", "beta10s", "cal"))
def q4(spark, sf):
    panel = features(spark, sf, keep=(*FORECAST_COLUMNS, "adv"), target="CC")
    out = risk_and_stage1(panel, day_before_last(panel), RISK)[2]
    return rounded(out, 5, "rhat_raw")

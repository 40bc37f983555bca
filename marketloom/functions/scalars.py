"""Column expressions: text cleaning, safe arithmetic, feature, cost and cap formulas.

Everything here stays inside generated JVM code; there is no Python on the row path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.config import CapConfig, CostConfig

# Division guard, ETF rule and lot sizes.
DIVISION_GUARD = 1e-12
ETF_CODE_PREFIX = "00"
ETF_WORD = "etf"
ETF_SECURITY_TYPE = "受益"
ETF_LOT = 100
STOCK_LOT = 1000
UNKNOWN = "-1"
ROC_YEAR_OFFSET = 1911
ROC_YEAR_LIMIT = 200

# C-locale white space, which Spark's trim (blanks only) would leave in place.
_EDGE_SPACE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
_SLASH_DATE = r"^\s*([+-]?\d{1,9})/\s*([+-]?\d{1,9})/\s*([+-]?\d{1,9})"


# ---- text -------------------------------------------------------------------------------


def trim_all(s: Column) -> Column:
    """Strip white space of every kind, carriage returns included, from both ends."""
    return F.regexp_replace(s, _EDGE_SPACE, "")


def header_key(name: str) -> str:
    """P5: header spelling used for look-ups; ``code`` is another word for ``symbol``."""
    key = name.strip().lower()
    return "symbol" if key == "code" else key


def yyyymmdd(d: Column) -> Column:
    """``yyyy-mm-dd``, ROC or AD ``y/m/d`` and eight digits become ``YYYYMMDD``.

    Anything else passes through unchanged, as text.
    """
    dashed = (F.length(d) == 10) & (F.substring(d, 5, 1) == "-") & (F.substring(d, 8, 1) == "-")

    def part(i: int) -> Column:
        return F.regexp_extract(d, _SLASH_DATE, i).try_cast("int")

    year = part(1)
    western = F.when(year < ROC_YEAR_LIMIT, year + ROC_YEAR_OFFSET).otherwise(year)
    return (
        F.when(dashed, F.concat(F.substring(d, 1, 4), F.substring(d, 6, 2), F.substring(d, 9, 2)))
        .when(d.rlike(_SLASH_DATE), F.format_string("%04d%02d%02d", western, part(2), part(3)))
        .otherwise(d)
    )


def to_date(d: Column) -> Column:
    """P1 and a parse; text that is no date becomes NULL."""
    ymd = yyyymmdd(trim_all(d))
    return F.when(ymd.rlike(r"^\d{8}$"), F.try_to_date(ymd, "yyyyMMdd"))


def whole_number(s: Column) -> Column:
    """Keep digits and minus signs, read the longest leading integer, else 0.

    ``1,234`` is 1234, ``5-3`` is 5, ``--5`` is 0, ``1.5`` is 15; a value beyond BIGINT is 0.
    """
    kept = F.regexp_replace(s, "[^0-9-]", "")
    lead = F.nullif(F.regexp_extract(kept, "^(-?[0-9]+)", 1), F.lit(""))
    return F.coalesce(lead.try_cast("bigint"), F.lit(0).cast("bigint"))


def or_unknown(s: Column) -> Column:
    """Empty or missing text becomes the unknown marker."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(UNKNOWN))


def first_text(*cols: Column) -> Column:
    """The first non-empty of several alternative fields."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def is_etf(code: Column, market: Column, sec_type: Column) -> Column:
    """By code prefix, or by a word in the market or security type."""
    market, sec_type = (F.lower(F.coalesce(c, F.lit(""))) for c in (market, sec_type))
    return (
        F.coalesce(code, F.lit("")).startswith(ETF_CODE_PREFIX)
        | market.contains(ETF_WORD)
        | sec_type.contains(ETF_WORD)
        | sec_type.contains(ETF_SECURITY_TYPE)
    )


def lot_size(etf: Column) -> Column:
    """P7."""
    return F.when(etf, F.lit(ETF_LOT)).otherwise(F.lit(STOCK_LOT)).cast("int")


# ---- arithmetic -------------------------------------------------------------------------


def finite(x: Column) -> Column:
    """NaN and the infinities become NULL, the only missing value inside the library."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def finite_or_zero(x: Column) -> Column:
    """P20."""
    return F.coalesce(finite(x), F.lit(0.0))


def safe_div(num: Column, den: Column) -> Column:
    """0 where the divisor is (nearly) 0; NULL where either side is NULL."""
    return F.when(num.isNull() | den.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(F.abs(den) < DIVISION_GUARD, F.lit(0.0)).otherwise(
            F.try_divide(num.cast("double"), den.cast("double"))
        )
    )


def ema_alpha_from_half_life(half_life: float) -> float:
    """P13."""
    return 1.0 - math.exp(math.log(0.5) / half_life)


def ema_alpha_from_span(n: int) -> float:
    return 2.0 / (n + 1)


def clip(x: Column, bound: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(bound))), F.lit(-float(bound)))


# ---- features ---------------------------------------------------------------------------


def garman_klass(o: Column, h: Column, low: Column, c: Column) -> Column:
    """Published range estimator of one day's volatility; floored at 0."""
    hl, co = F.ln(F.try_divide(h, low)), F.ln(F.try_divide(c, o))
    variance = 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co
    return F.sqrt(F.greatest(variance, F.when(variance.isNotNull(), F.lit(0.0))))


def liquidity(val: Column) -> Column:
    """Log of traded value plus one."""
    return F.log1p(val)


def order_imbalance(outside: Column, inside: Column) -> Column:
    """P18 (ours): buyer- minus seller-initiated volume over their sum."""
    return safe_div(outside - inside, outside + inside)


def trade_side(px: Column, bid: Column, ask: Column) -> Column:
    """At or above the ask buys (OUT); at or below the bid sells (IN); else neither."""
    return F.when(px >= ask, F.lit("OUT")).when(px <= bid, F.lit("IN"))


# ---- cost and caps ----------------------------------------------------------------------


def impact_coefficient(sigma: Column, imb: Column, adv: Column, cost: CostConfig) -> Column:
    """P21 (ours): impact per TWD^1.5; NULL where ADV is not positive."""
    scale = cost.gamma_impact * (1.0 + cost.beta_imb_impact * F.abs(imb))
    return F.when(adv > 0, scale * sigma / F.sqrt(adv))


def impact_power(u: Column, breakpoints: tuple[float, ...] = ()) -> Column:
    """u^1.5, or its chords on the breakpoints.

    The breakpoints are plan-time constants, so the segment search is a chain of comparisons.
    Past the last breakpoint the last chord goes on, and there it is no upper bound any more.
    """
    if not breakpoints:
        return F.pow(u, F.lit(1.5))
    b = sorted(float(x) for x in breakpoints)
    if len(b) < 2:
        raise ValueError("need two breakpoints or none")
    out = None
    for x0, x1 in zip(b[:-1], b[1:]):
        slope = (x1**1.5 - x0**1.5) / (x1 - x0)
        chord = F.lit(x0**1.5) + F.lit(slope) * (u - F.lit(x0))
        if x1 == b[-1]:
            return chord if out is None else out.otherwise(chord)
        out = F.when(u <= x1, chord) if out is None else out.when(u <= x1, chord)
    return out


def weight_cap(
    base: Column,
    bf: Column,
    bias: Column,
    adv: Column,
    ts: Column,
    median_ts: Column,
    notional: float,
    caps: CapConfig,
) -> Column:
    """P23 (ours): base cap loosened by flow, tightened by bias, bounded by liquidity; in [0, 1].

    A base of 0 stands for "no base cap" (1.0). Unknown flow or bias leaves the base as it is;
    unknown liquidity, where a liquidity term is on, allows nothing.
    """
    zero = F.lit(0.0)
    bf, bias, adv, ts = (F.coalesce(c, zero) for c in (bf, bias, adv, ts))
    full = F.when(base == 0, F.lit(1.0)).otherwise(base)
    excess = F.greatest(F.abs(bias) - caps.theta_bias, F.lit(0.0))
    terms = [full * (1.0 + caps.a_b * bf) * (1.0 - caps.a_bias * excess)]
    if caps.kappa_adv > 0:
        terms.append(caps.kappa_adv * adv / notional)
    if caps.kappa_ts > 0:
        terms.append(caps.kappa_ts * safe_div(ts, median_ts))
    smallest = F.least(*terms) if len(terms) > 1 else terms[0]
    return F.greatest(F.least(smallest, F.lit(1.0)), F.lit(0.0))


def unit_weights(price: Column, lot: Column, notional: float) -> tuple[Column, Column]:
    """Weight of one lot and of one share."""
    share = price / F.lit(float(notional))
    return share * lot, share


def linear_fee(buy: Column, sell: Column, cost: CostConfig) -> Column:
    """P27 without the minimum: fee on bought and on sold amounts."""
    return cost.fee_buy * buy + cost.fee_sell * sell


def order_fee(side: Column, notional: Column, cost: CostConfig) -> Column:
    """P27 for one order: proportional fee, but never less than the minimum."""
    rate = F.when(side == "BUY", F.lit(cost.fee_buy)).otherwise(F.lit(cost.fee_sell))
    return F.greatest(notional * rate, F.lit(float(cost.min_fee)))

"""Operators with a state of their own: calendar months (T3) and subscriptions that change while the stream runs.

Both keep a row or a few per key in the state store (RocksDB), so the state does not live in the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.functions.scalars import trade_side

MONTH_SCHEMA = "dt date, symbol string, O double, H double, L double, C double, V bigint, closed boolean"
TOTAL_SCHEMA = (
    "exchange string, symbol string, totalVolume bigint, outsideVolume bigint, insideVolume bigint, "
    "lastPrice double, lastTime timestamp, bestBid double, bestAsk double, ticks bigint, ignored bigint"
)
FOREVER = "36500 days"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> None:
    """These operators need the store that keeps its state on disk."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _end_ms(month: np.datetime64) -> int:
    """First instant of the next month, UTC."""
    return int((month.astype("datetime64[M]") + 1).astype("datetime64[ms]").astype("int64"))


class MonthBars(StatefulProcessor):
    """One bar for each open month of a symbol. A timer at the month's end closes it: its last row is marked and its
    state goes. Until then each batch gives the changed bars again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "end bigint", "O double, o bigint, H double, L double, C double, c bigint, V bigint")

    def _row(self, symbol: str, end: int, bar: tuple, closed: bool) -> list:
        month = (np.datetime64(end, "ms").astype("datetime64[M]") - 1).astype("datetime64[D]").item()
        first, _, high, low, last, _, volume = bar
        return [month, symbol, first, high, low, last, volume, closed]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[int, tuple] = {}
        for ticks in rows:
            months = ticks["ts"].to_numpy().astype("datetime64[M]")
            for month, part in ticks.groupby(months):
                end = _end_ms(np.datetime64(month, "M"))
                bar = changed.get(end) or (tuple(self.bars.getValue((end,))) if self.bars.containsKey((end,)) else None)
                if bar is None:
                    self.handle.registerTimer(end)
                changed[end] = _merged(bar, part)
        for end, bar in changed.items():
            self.bars.updateValue((end,), bar)
        yield pd.DataFrame([self._row(key[0], e, b, False) for e, b in changed.items()], columns=_MONTH_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.bars.containsKey((end,)):
            bar = tuple(self.bars.getValue((end,)))
            self.bars.removeKey((end,))
            yield pd.DataFrame([self._row(key[0], end, bar, True)], columns=_MONTH_NAMES)

    def close(self) -> None:
        pass


_MONTH_NAMES = ["dt", "symbol", "O", "H", "L", "C", "V", "closed"]


def _merged(bar: tuple | None, ticks: pd.DataFrame) -> tuple:
    """Open and close go by ``seq``; nulls in prices or quantities do not count."""
    priced = ticks[ticks["price"].notna()]
    volume = int(ticks["qty"].fillna(0).sum()) + (bar[6] if bar else 0)
    first, o, high, low, last, c = bar[:6] if bar else (None, None, None, None, None, None)
    if len(priced):
        lo, hi = priced.loc[priced["seq"].idxmin()], priced.loc[priced["seq"].idxmax()]
        if o is None or lo["seq"] < o:
            first, o = float(lo["price"]), int(lo["seq"])
        if c is None or hi["seq"] > c:
            last, c = float(hi["price"]), int(hi["seq"])
        top, bottom = float(priced["price"].max()), float(priced["price"].min())
        high, low = (top if high is None else max(high, top)), (bottom if low is None else min(low, bottom))
    return first, o, high, low, last, c, volume


def month_bars(quotes: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Month bars on the stream, ``closed`` once the watermark has passed the month's end; update mode.

    The watermark is ours. A tick behind it does not count; ``quotes.late_rows`` has their number. None: nothing is
    ever late and no month closes. The session must be in UTC.
    """
    with_state_store(quotes.sparkSession)
    ticks = quotes.withWatermark("ts", lateness or FOREVER).select("symbol", "ts", "seq", "price", "qty")
    return ticks.groupBy("symbol").transformWithStateInPandas(MonthBars(), MONTH_SCHEMA, "Update", "EventTime")


class SubscribedTotals(StatefulProcessor):
    """Running totals of the ticks that fall into the subscribed spans of their (exchange, symbol)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.controls = handle.getMapState("controls", "us bigint", "active boolean")
        self.total = handle.getValueState(
            "total", "volume bigint, outside bigint, inside bigint, seq bigint, price double, us bigint, bid double, ask double, ticks bigint, ignored bigint"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["us"] = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        control = batch[batch["active"].notna()]
        for us, active in zip(control["us"], control["active"]):
            self.controls.updateValue((int(us),), (bool(active),))
        ticks = batch[batch["active"].isna()]
        if ticks.empty:
            return
        known = sorted((k[0], v[0]) for k, v in self.controls.iterator())
        times, states = np.array([k for k, _ in known], np.int64), np.array([False, *[v for _, v in known]])
        counted = ticks[states[np.searchsorted(times, ticks["us"].to_numpy(), side="right")]]
        old = tuple(self.total.get()) if self.total.exists() else (0, 0, 0, None, None, None, None, None, 0, 0)
        volume, outside, inside, seq, price, us, bid, ask, n, ignored = old
        qty = counted["qty"].fillna(0).astype("int64")
        volume, n, ignored = volume + int(qty.sum()), n + len(counted), ignored + len(ticks) - len(counted)
        outside += int(qty[counted["side"] == "OUT"].sum())
        inside += int(qty[counted["side"] == "IN"].sum())
        if len(counted):
            last = counted.loc[counted["seq"].idxmax()]
            if seq is None or last["seq"] > seq:
                seq, us = int(last["seq"]), int(last["us"])
                price, bid, ask = (None if pd.isna(last[c]) else float(last[c]) for c in ("price", "bid", "ask"))
        new = (volume, outside, inside, seq, price, us, bid, ask, n, ignored)
        self.total.update(new)
        time = None if us is None else pd.Timestamp(us, unit="us")
        yield pd.DataFrame([[*key, volume, outside, inside, price, time, bid, ask, n, ignored]], columns=_TOTAL_NAMES)

    def close(self) -> None:
        pass


_TOTAL_NAMES = [c.split()[0] for c in TOTAL_SCHEMA.split(", ")]


def subscribed_totals(quotes: DataFrame, controls: DataFrame) -> DataFrame:
    """Totals of ``quotes`` while subscribed, by a stream of ``controls`` (exchange, symbol, ts, active).

    A tick counts if the last control at or before its ``ts`` is active; without any it does not. Controls are known from
    the batch they come with on, and what was counted stays counted: a subscription is asked for, or ended, no later than
    the ticks it concerns. Of several controls of one instant one counts. ``ignored``: ticks outside any span.
    """
    with_state_store(quotes.sparkSession)
    side = trade_side(F.col("price"), F.col("bid"), F.col("ask"))
    ticks = quotes.select("exchange", "symbol", "ts", "seq", "price", "bid", "ask", "qty", side.alias("side"), F.lit(None).cast("boolean").alias("active"))
    none = {c: t for c, t in ticks.dtypes if c not in ("exchange", "symbol", "ts", "active")}
    asked = controls.select("exchange", "symbol", "ts", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "active")
    both = ticks.unionByName(asked)
    return both.groupBy("exchange", "symbol").transformWithStateInPandas(SubscribedTotals(), TOTAL_SCHEMA, "Update", "None")

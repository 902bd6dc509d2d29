"""States of the market at a time: calendar mode, sentiment index, netflow, benchmark moves, order books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import div
from tidemark.operators.features import true_range
from tidemark.operators.series import SERIES, by_time, latest, pct_change, rolling


def with_scan_mode(df: DataFrame, time: str = "ts") -> DataFrame:
    """Mode and its thresholds by weekday and hour (UTC)."""
    hour, weekend = F.hour(time), F.weekday(F.col(time)) >= 5
    active = (hour >= 8) & (hour < 20)
    peak = F.when(((hour >= 9) & (hour < 12)) | ((hour >= 13) & (hour < 17)), 1.2).otherwise(1.0)
    pick = lambda wa, wq, a, q: F.when(weekend & active, wa).when(weekend, wq).when(active, a).otherwise(q)
    return df.withColumns({
        "mode": pick("weekend_active", "weekend_quiet", "active", "quiet"), "min_confidence": pick(50, 50, 45, 50), "min_score": pick(3, 4, 3, 3),
        "min_adx": pick(18, 22, 15, 18), "interval_min": pick(15, 30, 15, 30), "risk_mult": F.round(pick(0.85, 0.50, 1.0, 0.5) * peak, 3),
    })


def classify_fear_greed(df: DataFrame, value: str = "value") -> DataFrame:
    """Bias, hard blocks, condition, action and warning of a 0-100 sentiment index."""
    v = F.col(value)
    return df.withColumns({
        "fg_bias": F.when(v >= 75, "SELL").when(v <= 25, "BUY"), "fg_score_mod": F.when((v >= 75) | (v <= 25), 1).otherwise(0),
        "fg_blocks_sell": v <= 20, "fg_blocks_buy": v >= 70,
        "condition": F.when(v < 25, "CRISIS / EXTREME FEAR").when(v < 45, "BEARISH / FEAR").when(v < 55, "NEUTRAL").when(v < 75, "BULLISH / GREED").otherwise("EXTREME GREED"),
        "action": F.when(v < 30, "BUY_ZONE").when(v > 75, "SELL_ZONE").otherwise("NEUTRAL"),
        "warning": F.when(v < 20, "EXTREME FEAR").when(v > 80, "EXTREME GREED").otherwise(""), "trade_ok": (v > 25) & (v < 75),
    })


def classify_netflow(flows: DataFrame, bound: float = 50e6) -> DataFrame:
    """The newest netflow of each symbol and its bias: large inflow sells, large outflow buys."""
    now = latest(flows.withColumnRenamed("ts", "open_time"), ("symbol",)).withColumnRenamed("open_time", "ts")
    x = F.col("net_inflow")
    return now.withColumns({"flow_bias": F.when(x > bound, "SELL").when(x < -bound, "BUY"), "flow_score_mod": F.when(F.abs(x) > bound, 1).otherwise(0)})


def benchmark_momentum(bars: DataFrame, bound: float = 1.5, by: Sequence[str] = SERIES) -> DataFrame:
    change = 100 * pct_change(F.col("close"), 1, by_time(by))
    out = bars.withColumn("change_pct", change)
    c = F.col("change_pct")
    bias = F.when(c >= bound, "BUY").when(c <= -bound, "SELL")
    return out.withColumns({"btc_bias": bias, "btc_score_mod": F.when(F.abs(c) >= bound, 1).otherwise(0)})


def volatility_state(bars: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """State of a series by the plain 14-bar mean of its true range, in percent of the close."""
    w = by_time(by)
    df = bars.withColumn("_tr", true_range(w))
    df = df.withColumn("range_pct", 100 * div(rolling(F.avg, "_tr", 14, w), "close")).drop("_tr")
    state, risk = states_of(F.col("range_pct"))
    return df.withColumns({"vol_state": state, "vol_risk_mult": risk, "skip": F.coalesce(F.col("range_pct") < 0.05, F.lit(False))})


def states_of(p: Column) -> tuple[Column, Column]:
    """State of the mean range in percent, and what it does to the risk."""
    state = F.when(p.isNull(), "UNKNOWN").when(p > 4.0, "VERY_HIGH").when(p > 2.0, "HIGH").when(p < 0.05, "DEAD").otherwise("NORMAL")
    return state, F.when(p > 4.0, 0.25).when(p > 2.0, 0.5).when(p < 0.05, 0.0).otherwise(1.0)


def effective_risk(mode: Column, volatility: Column, ratchet: Column) -> Column:
    return F.when(ratchet > 0, F.greatest(mode * volatility * ratchet, F.lit(0.25))).otherwise(0.0)


def book_spread(books: DataFrame, wide: float = 0.003, ceiling: float = 0.05) -> DataFrame:
    """Best prices and relative spread of order books (bids, asks: arrays of [price, size])."""
    bid, ask = F.get(F.get("bids", F.lit(0)), F.lit(0)), F.get(F.get("asks", F.lit(0)), F.lit(0))
    both = bid.isNotNull() & ask.isNotNull()
    mid = (bid + ask) / 2
    spread = F.when(both, F.when(mid > 0, (ask - bid) / mid).otherwise(0.0)).otherwise(999.0)
    out = books.withColumns({"best_bid": F.when(both, bid).otherwise(0.0), "best_ask": F.when(both, ask).otherwise(0.0), "spread_pct": spread})
    return out.withColumns({"is_wide": F.col("spread_pct") > wide, "tradeable": F.col("spread_pct") <= ceiling})

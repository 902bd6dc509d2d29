"""Schemas at the boundary, declared and never inferred."""

from __future__ import annotations

KLINES_RAW = "symbol string, interval string, batch int, payload string"
TICKS = "symbol string, ts timestamp, price double, qty double, is_taker_buy boolean"
BARS = (
    "symbol string, interval string, segment string, open_time timestamp, "
    "open double, high double, low double, close double, volume double, taker_buy_base_vol double"
)
TRADE = (
    "symbol string, signal string, entry double, stop double, tp1 double, tp2 double, qty double, qty_tp1 double, "
    "qty_tp2 double, risk_usd double, balance_at_open double, risk_mult double, order_ids map<string,string>, "
    "opened_at string, tp1_hit boolean, tp2_hit boolean, closed boolean, confidence double, score int, "
    "reasons array<string>, tier string, exchange string"
)
LEDGER = TRADE + ", close_price double, pnl double, closed_at string, close_reason string, partial boolean"


def open_trades_type() -> str:
    """A JSON map from symbol to trade."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in TRADE.split(", "))
    return f"map<string,struct<{fields}>>"

"""The words that count for and against a coin in news texts, and the tiers and sectors of coins."""

from __future__ import annotations

# Fixed values.
BULLISH = (
    "surge", "rally", "bullish", "breakout", "adoption", "partnership", "upgrade", "launch", "record", "high", "buy", "growth", "approval",
    "etf", "institutional", "moon", "pump", "rise", "gains", "positive", "boost",
)
BEARISH = (
    "crash", "dump", "bearish", "ban", "hack", "lawsuit", "sell", "drop", "fear", "loss", "regulation", "fraud", "scam", "war", "crisis",
    "inflation", "recession", "bubble", "collapse", "fine", "investigation", "decline",
)
MAJORS = ("BTCUSDT", "ETHUSDT", "BNBUSDT")
SECTORS = {
    "L1": ("SOLUSDT", "AVAXUSDT", "NEARUSDT", "APTUSDT", "SUIUSDT", "MATICUSDT", "TRXUSDT", "ATOMUSDT"),
    "DeFi": ("UNIUSDT", "AAVEUSDT", "LINKUSDT"),
    "BTC_family": ("BTCUSDT", "LTCUSDT", "BCHUSDT"),
}

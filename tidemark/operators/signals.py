"""Scoring, filtering, pricing and sizing of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicon import BEARISH, BULLISH, MAJORS
from tidemark.functions.scalars import clip, div, mood, page_score, reasons, title_score
from tidemark.operators.series import TIME, by_time, rolling

STOP_ATR, TP1_ATR, TP2_ATR = 2.5, 3.5, 7.5
RISK_PER_TRADE = 0.01


def with_tier(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """``df`` with the tier of its symbol."""
    return df.join(tiers.select("symbol", "tier"), "symbol", "left").withColumn("tier", F.coalesce("tier", F.lit("Unknown")))


def trend_bars(slow: DataFrame, by: Sequence[str] = ("symbol", "segment"), most: int = 5) -> DataFrame:
    """For each slow bar, how many bars just before it had EMA20 above (or below) EMA50 without a break."""
    w = by_time(by)

    def run(side: Column) -> Column:
        before = [F.coalesce(F.lag(side).over(w) if k == 1 else F.lag(side, k).over(w), F.lit(False)) for k in range(1, most + 1)]
        length = F.lit(most)
        for k in range(most, 0, -1):
            length = F.when(~before[k - 1], k - 1).otherwise(length)
        return length

    return slow.withColumns({"up_bars": run(F.col("ema20") > F.col("ema50")), "down_bars": run(F.col("ema20") < F.col("ema50"))})


def volume_gate(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last closed bar's volume and its 20-bar mean, on the row of the unfinished one."""
    w = by_time(by)
    mean = rolling(F.avg, "volume", 20, w)
    return bars.withColumn("_mean", mean).withColumns({"vol_prev": F.lag("volume").over(w), "vol_mean_prev": F.lag("_mean").over(w)}).drop("_mean")


def sided(buy: Column, sell: Column) -> Column:
    """A test that holds for the signal's own side."""
    return F.coalesce(F.when(F.col("signal") == "BUY", buy).when(F.col("signal") == "SELL", sell), F.lit(False))


def _counter_trend() -> Column:
    return F.coalesce((F.col("signal") == "SELL") & (F.col("ema20_4h") > F.col("ema50_4h")), F.lit(False))


def score_signals(df: DataFrame) -> DataFrame:
    """Additive score with its reasons.

    Needs signal, confidence, adx, rsi, ema20, ema50, their _1h and _4h (rsi) versions, trend_bars, btc_bias,
    flow_bias, fg_bias (null: none) with their score_mod, vol_prev and vol_mean_prev.
    """
    c = F.col
    confident, trending = c("confidence") >= 60, c("adx") > 18
    rsi = sided(c("rsi") < 65, c("rsi") > 35)
    own = sided(c("ema20") > c("ema50"), c("ema20") < c("ema50"))
    hour = sided(c("ema20_1h") > c("ema50_1h"), c("ema20_1h") < c("ema50_1h"))
    slow = sided((c("ema20_4h") > c("ema50_4h")) & (c("rsi_4h") > 45), (c("ema20_4h") < c("ema50_4h")) & (c("rsi_4h") < 55))
    settled = c("trend_bars") >= 4
    surge = (c("vol_prev") > 0) & (c("vol_mean_prev") > 0) & (c("vol_prev") > 1.5 * c("vol_mean_prev"))
    points = [(confident, 1), (trending, 1), (rsi, 1), (own, 1), (hour, 1), (slow, 1), (settled, 1), (surge, 1), (_counter_trend(), -1)]
    total = sum((F.when(test, p).otherwise(0) for test, p in points), F.lit(0))
    texts = [
        (_counter_trend(), "4h counter-trend (-1)"), (confident, F.format_string("confidence %.0f", c("confidence"))), (trending, F.format_string("ADX %.0f", c("adx"))),
        (rsi, "RSI on side"), (own, "EMA on side"), (hour, "1h confirms"), (slow, "4h trend aligns"), (settled, "4h trend established"),
    ]
    for bias, mod, name in (("btc_bias", "btc_score_mod", "benchmark"), ("flow_bias", "flow_score_mod", "netflow"), ("fg_bias", "fg_score_mod", "sentiment")):
        agrees = c(bias) == c("signal")
        total = total + F.coalesce(F.when(agrees, c(mod)).when(~agrees, -c(mod)), F.lit(0))
        texts += [(agrees, f"{name} aligned"), (~agrees & (c(mod) > 0), f"{name} opposed")]
    texts.append((surge, "volume surge"))
    return df.withColumns({"score": total, "reasons": reasons(*texts)})


def filter_signals(scored: DataFrame, majors: Sequence[str] = MAJORS) -> DataFrame:
    """Every row with ``reject_reason``, null for accepted ones; the first failing filter names it.

    Needs the columns of ``score_signals`` and min_confidence, min_adx, min_score, fg_blocks_buy, fg_blocks_sell.
    """
    c = F.col
    blocked = sided(c("fg_blocks_buy"), c("fg_blocks_sell"))
    against = F.when(c("signal") == "BUY", c("ema20_4h") < c("ema50_4h")).when(_counter_trend(), c("symbol").isin(*majors) | (c("rsi_4h") > 65))
    thin = (c("vol_prev") > 0) & (c("vol_mean_prev") > 0) & (c("vol_prev") < 0.5 * c("vol_mean_prev"))
    unsound = ~(c("close") > 0) | ~(c("atr") > 0) | F.isnan("close") | F.isnan("atr")
    return scored.withColumn("reject_reason", F.when(c("signal") == "NO_TRADE", "no trade").when(c("confidence") < c("min_confidence"), "confidence").when(blocked, "sentiment")
        .when(c("adx") < c("min_adx"), "adx").when(against, "4h bias").when(c("trend_bars") < 1, "4h fresh").when(thin, "volume")
        .when(c("score") < c("min_score"), "score").when(F.coalesce(unsound, F.lit(True)), "price"))


def accepted(filtered: DataFrame) -> DataFrame:
    return filtered.where("reject_reason IS NULL")


def rejected(filtered: DataFrame) -> DataFrame:
    return filtered.where("reject_reason IS NOT NULL")


def quality_score(df: DataFrame) -> DataFrame:
    """The scanner's score of up to 6, with stricter bounds."""
    c = F.col
    tests = [
        (c("confidence") >= 75, "confidence"), (c("adx") > 20, "trend"), (sided(c("rsi") < 40, c("rsi") > 60), "RSI zone"),
        (sided((c("ema20") > c("ema50")) & (c("ema50") > c("ema200")), (c("ema20") < c("ema50")) & (c("ema50") < c("ema200"))), "EMA stack"),
        (sided(c("ema20_1h") > c("ema50_1h"), c("ema20_1h") < c("ema50_1h")), "1h confirms"), (sided(c("ema20_4h") > c("ema50_4h"), c("ema20_4h") < c("ema50_4h")), "4h confirms"),
    ]
    total = sum((F.when(t, 1).otherwise(0) for t, _ in tests), F.lit(0))
    return df.withColumns({"quality": total, "quality_reasons": reasons(*tests)})


def news_sentiment(news: DataFrame, newest: int = 10, up: Sequence[str] = BULLISH, down: Sequence[str] = BEARISH, word_boundary: bool = False) -> DataFrame:
    """Score and mood of each coin from its newest titles."""
    last = Window.partitionBy("coin").orderBy(F.desc("published_at"))
    some = news.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= newest)
    score = F.sum(title_score("title", up, down, word_boundary)).cast("long")
    out = some.groupBy("coin").agg(score.alias("score"), F.count("*").alias("articles"))
    return out.withColumn("sentiment", mood("score"))


def page_sentiment(pages: DataFrame, up: Sequence[str] = BULLISH, down: Sequence[str] = BEARISH, word_boundary: bool = False) -> DataFrame:
    """Score and mood of whole pages, by occurrences; the mood needs more than 2 either way."""
    out = pages.withColumn("score", page_score("text", up, down, word_boundary))
    return out.withColumn("sentiment", mood("score", 2))


def apply_news(signals: DataFrame, news: DataFrame) -> DataFrame:
    """+1 where the coin's mood agrees with the signal, and a note where it opposes it."""
    out = signals.join(news.select("coin", "sentiment"), "coin", "left")
    agrees = sided(F.col("sentiment") == "BULLISH", F.col("sentiment") == "BEARISH")
    opposes = sided(F.col("sentiment") == "BEARISH", F.col("sentiment") == "BULLISH")
    note = F.when(agrees, "news agrees").when(opposes, "news opposes: caution")
    return out.withColumns({"score": F.col("score") + F.when(agrees, 1).otherwise(0), "reasons": F.array_compact(F.array_append(F.coalesce("reasons", F.array().cast("array<string>")), note))})


def dedupe_signals(passing: DataFrame, by: Sequence[str] = ("symbol",), time: str = TIME) -> DataFrame:
    """Passing signals that differ from the passing one before."""
    before = F.lag("signal").over(Window.partitionBy(*by).orderBy(time))
    return passing.withColumn("_before", before).where(~F.col("signal").eqNullSafe(F.col("_before"))).drop("_before")


def price_digits(entry: Column) -> Column:
    return F.when(entry < 10, 4).otherwise(2)


def rounded(c: Column, entry: Column) -> Column:
    """Half-even to 4 digits below a price of 10, else to 2."""
    return F.when(entry < 10, F.bround(c, 4)).otherwise(F.bround(c, 2))


def with_levels(signals: DataFrame, vol_state: str = "vol_state", unsound: bool = False) -> DataFrame:
    """Stop and targets from entry and ATR; rows whose levels are not positive numbers are left out, or stay without levels if ``unsound``."""
    e, a = F.col("entry"), F.col("atr")
    stretch = F.when(F.col(vol_state) == "VERY_HIGH", 1.5).when(F.col(vol_state).isin("DEAD", "UNKNOWN"), 0.8).otherwise(1.0)
    side = F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    level = lambda k: rounded(e + side * a * k, e)
    out = signals.withColumns({"stop": level(F.lit(-STOP_ATR)), "tp1": level(TP1_ATR * stretch), "tp2": level(TP2_ATR * stretch)})
    sound = lambda c: (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    levels = ("stop", "tp1", "tp2")
    all_sound = sound("stop") & sound("tp1") & sound("tp2")
    return out.withColumns({c: F.when(all_sound, F.col(c)) for c in levels}) if unsound else out.where(all_sound)


def round_amount(raw: Column, step: Column) -> Column:
    """Down to whole lots, one lot at least."""
    return F.when(raw > 0, F.greatest(step, F.floor(raw / step) * step)).otherwise(0.0)


def round_price(price: Column, tick: Column, fallback: Column) -> Column:
    """To the nearest tick; a tick of more than half the price is not believed."""
    use = F.when((tick <= 0) | (tick > price / 2) | tick.isNull(), fallback).otherwise(tick)
    use = F.when(use > 0, use).otherwise(0.0001)
    near = F.bround(F.bround(price / use) * use, 10)
    return F.when(price <= 0, 0.0).when(near > 0, near).otherwise(F.bround(price, 6))


def split_amount(total: Column, step: Column) -> tuple[Column, Column]:
    """Two lots of a quantity; the first is all of it when the second would be below one lot."""
    half = F.greatest(step, F.floor(total / 2 / step) * step)
    whole = total - half < step
    return F.when(total <= 0, 0.0).when(whole, total).otherwise(half), F.when((total <= 0) | whole, 0.0).otherwise(total - half)


def position_size(signals: DataFrame, instruments: DataFrame, balance: Column, risk_mult: Column) -> DataFrame:
    """Quantity from risked money, volatility and conviction, inside the limits of the instrument.

    Needs entry, atr, stop and confidence; instruments has symbol, min_amount and max_amount.
    """
    e = F.col("entry")
    boost = F.when(F.col("confidence") >= 60, 1.5).otherwise(1.0)
    calm = F.coalesce(clip(div(F.lit(0.003), div("atr", e)), 0.4, 2.0), F.lit(1.0))
    mult = risk_mult * boost * calm
    df = signals.join(instruments.select("symbol", "min_amount", "max_amount"), "symbol").withColumn("final_risk_mult", mult)
    risk = balance * RISK_PER_TRADE * F.col("final_risk_mult")
    raw = F.least(div(risk, F.abs(e - F.col("stop"))), div(balance * 0.05, e), div(10 * risk, e), F.col("max_amount"))
    df = df.withColumns({"risk_usd": F.bround(risk, 2), "qty": round_amount(raw, F.col("min_amount"))})
    first, second = split_amount(F.col("qty"), F.col("min_amount"))
    return df.withColumns({"qty_tp1": first, "qty_tp2": second})


def expire_drifted(signals: DataFrame, prices: DataFrame, most_pct: float = 0.5) -> DataFrame:
    """Signals whose live price is near their entry, with the live price as entry; an unknown price keeps both."""
    df = signals.join(prices.select("symbol", F.col("price").alias("_live")), "symbol", "left")
    live = F.col("_live") > 0
    drift = 100 * F.abs(F.col("_live") - F.col("entry")) / F.col("entry")
    kept = df.where(F.coalesce(~live | (drift <= most_pct), F.lit(True)))
    return kept.withColumn("entry", F.when(live, F.col("_live")).otherwise(F.col("entry"))).drop("_live")


def tradeable(config: DataFrame, active: DataFrame) -> DataFrame:
    return config.join(active, "symbol", "left_semi")

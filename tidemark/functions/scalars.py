"""Column expressions. Missing is NULL, never NaN; a division by zero is missing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Missing stays missing, as ``greatest`` and ``least`` alone would not have it."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def epoch_ms(time: Column | str) -> Column:
    return F.unix_millis(col(time).cast("timestamp"))


def age_hours(since: Column | str, now: Column | str) -> Column:
    return F.timestamp_diff("SECOND", col(since), col(now)) / F.lit(3600.0)


def is_stale(since: Column | str, now: Column | str, hours: float = 48.0) -> Column:
    return age_hours(since, now) > hours


def cyclical_time(time: Column | str) -> dict[str, Column]:
    """Hour of day and weekday (Monday 0) on the circle."""
    turn = 2 * math.pi
    hour, day = F.hour(col(time)) * (turn / 24), F.weekday(col(time)) * (turn / 7)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day)}


def candle_shape() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), h - low + EPS
    above, below = h - F.greatest(c, o), F.least(c, o) - low
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    return {
        "body_pct": body / span,
        "high_low_pct": div(h - low, c) * 100,
        "bullish_candle": flag((c > o) & (body > 0.6 * span)),
        "doji": flag(body < 0.1 * span),
        "hammer": flag((below > 2 * body) & (above < body)),
    }


def trend_sign(fast: Column | str, slow: Column | str) -> Column:
    return F.coalesce(F.signum(col(fast) - col(slow)), F.lit(0.0))


def taker_buy_ratio() -> Column:
    return clip(F.coalesce(div("taker_buy_base_vol", "volume"), F.lit(0.5)), 0.0, 1.0)


def base_asset(instrument: Column | str, quote: str = "USDT") -> Column:
    """'ETH_USDC-PERPETUAL' and 'ETH-PERPETUAL' to 'ETHUSDT'."""
    name = col(instrument)
    part = F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise(F.substring_index(name, "-", 1))
    return F.concat(part, F.lit(quote))


def coin_of(symbol: Column | str, quote: str = "USDT") -> Column:
    return F.lower(F.replace(col(symbol), F.lit(quote), F.lit("")))


def day_of(time: Column | str) -> Column:
    """The date part of an ISO string or a time."""
    return F.substring(col(time).cast("string"), 1, 10)


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose test holds."""
    text = lambda t: F.lit(t) if isinstance(t, str) else t
    return F.array_compact(F.array(*[F.when(test, text(t)) for test, t in pairs]))


def best_class(probs: Column | str) -> Column:
    """Index of the largest probability, from 0; the first of equals."""
    p = col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def title_score(text: Column | str, up: Sequence[str], down: Sequence[str], word_boundary: bool = False) -> Column:
    """+1 for each up word that the text contains, -1 for each down word; parts of words count too."""
    low = F.lower(col(text))
    has = (lambda w: low.rlike(rf"\b{w}\b")) if word_boundary else (lambda w: F.contains(low, F.lit(w)))
    return sum((has(w).cast("int") for w in up), F.lit(0)) - sum((has(w).cast("int") for w in down), F.lit(0))


def occurrences(low: Column, word: str, word_boundary: bool = False) -> Column:
    """Non-overlapping occurrences of a word in lower-cased text."""
    if word_boundary:
        return F.regexp_count(low, F.lit(rf"\b{word}\b"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")


def page_score(text: Column | str, up: Sequence[str], down: Sequence[str], word_boundary: bool = False) -> Column:
    low = F.lower(col(text))
    return sum((occurrences(low, w, word_boundary) for w in up), F.lit(0)) - sum((occurrences(low, w, word_boundary) for w in down), F.lit(0))


def mood(score: Column | str, beyond: int = 0) -> Column:
    s = col(score)
    return F.when(s > beyond, "BULLISH").when(s < -beyond, "BEARISH").otherwise("NEUTRAL")

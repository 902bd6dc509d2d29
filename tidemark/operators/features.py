"""Technical features of bars.

All window expressions share one specification, so a series is shuffled and sorted once per pass over the
exponential averages. The parameters are the reference values of the indicators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import EPS, candle_shape, cyclical_time, div, taker_buy_ratio, trend_sign
from tidemark.operators.ewm import Ewm, ewm, ewm_blocks
from tidemark.operators.series import SERIES, TIME, by_time, change, fill_features, finite, pct_change, rolling
from tidemark.operators.stretches import carried, in_blocks, with_halo
from tidemark.sources.shared import written

PRICE_AVERAGES = (9, 12, 20, 26, 50, 200)
RAW = {*SERIES, TIME, "open", "high", "low", "close", "volume", "taker_buy_base_vol"}


def true_range(w) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def ema(bars: DataFrame, column: str, span: int, by: Sequence[str] = SERIES) -> DataFrame:
    return ewm(bars, [Ewm.span(f"ema{span}", column, span)], by)


def atr(bars: DataFrame, span: int = 14, by: Sequence[str] = SERIES) -> DataFrame:
    """Average true range by an exponential average of the span, and its share of the close in percent."""
    ranged = bars.withColumn("tr", true_range(by_time(by)))
    return ewm(ranged, [Ewm.span("atr", "tr", span)], by).withColumn("atr_pct", div("atr", "close") * 100).drop("tr")


def rsi(bars: DataFrame, n: int = 14, by: Sequence[str] = SERIES, name: str = "rsi") -> DataFrame:
    """Relative strength from averages with centre of mass n - 1; 50 where nothing was lost."""
    moved = bars.withColumns(_moves(by_time(by)))
    out = ewm(moved, [Ewm.com("_g", "gain", n - 1), Ewm.com("_l", "loss", n - 1)], by)
    return out.withColumn(name, strength("_g", "_l")).drop("gain", "loss", "_g", "_l")


def _moves(w: WindowSpec) -> dict[str, Column]:
    moved = change(F.col("close"), 1, w)
    return {"gain": F.when(moved.isNotNull(), F.greatest(moved, F.lit(0.0))), "loss": F.when(moved.isNotNull(), F.greatest(-moved, F.lit(0.0)))}


def strength(gain: str, loss: str) -> Column:
    return F.coalesce(100 - 100 / (1 + div(gain, loss)), F.lit(50.0))


def _directional(w: WindowSpec) -> dict[str, Column]:
    """Moves up and down. Down is compared with the up that has already lost: on a tie down survives."""
    up, down = change(F.col("high"), 1, w), -change(F.col("low"), 1, w)
    up, down = F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))), F.when(down.isNotNull(), F.greatest(down, F.lit(0.0)))
    kept = F.coalesce(F.when(up > down, up), F.lit(0.0))
    return {"dm_up": kept, "dm_down": F.coalesce(F.when(down > kept, down), F.lit(0.0))}


FIRST = [
    *(Ewm.span(f"ema{n}", "close", n) for n in PRICE_AVERAGES),
    Ewm.com("_g14", "gain", 13), Ewm.com("_l14", "loss", 13), Ewm.com("_g7", "gain", 6), Ewm.com("_l7", "loss", 6),
    Ewm.span("atr", "tr", 14), Ewm.span("_up", "dm_up", 14), Ewm.span("_down", "dm_down", 14),
]
SECOND = [Ewm.span("macd_signal", "macd", 9), Ewm.span("adx", "_dx", 14)]
INPUTS = ("gain", "loss", "dm_up", "dm_down", "tr", "ema12", "ema26")
REACH = 24  # rows before a bar that its frames see at most: 20 of a mean, or 14 of an oscillator and 3 of its mean


def _moved(bars: DataFrame, w: WindowSpec) -> DataFrame:
    return bars.withColumns({**_moves(w), **_directional(w), "tr": true_range(w)})


def _between(df: DataFrame) -> DataFrame:
    """What the second pass of averages is made of."""
    df = df.withColumns({"macd": F.col("ema12") - F.col("ema26"), "adx_pos": 100 * div("_up", "atr"), "adx_neg": 100 * div("_down", "atr")})
    return df.withColumn("_dx", 100 * F.abs(F.col("adx_pos") - F.col("adx_neg")) / (F.col("adx_pos") + F.col("adx_neg") + EPS))


def add_features(bars: DataFrame, by: Sequence[str] = SERIES, block_rows: int | None = None, fill: bool = True) -> DataFrame:
    """Bars with all features of one timeframe.

    Two passes of exponential averages: first of prices, moves and ranges, then of what is made of these. With
    ``block_rows`` no task sees more of a series than a block and the few rows before it.
    """
    if block_rows:
        return _blocked_features(bars, by, block_rows, fill)
    w = by_time(by)
    df = ewm(_between(ewm(_moved(bars, w), FIRST, by)), SECOND, by)
    df = _framed(df, w, F.col("close") * F.col("volume"), F.col("volume"))
    return fill_features(df, _made(df, bars), by) if fill else df


def _blocked_features(bars: DataFrame, by: Sequence[str], block_rows: int, fill: bool) -> DataFrame:
    """The same in blocks: frames see the rows before a block, averages, sums and last values are carried into it.

    What two passes read is written in between, so that nothing is made twice.
    """
    key = (*by, "_block")
    w, upto = by_time(key), by_time(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(in_blocks(bars, block_rows, by), "blocks")
    sums = {"_paid": F.sum(F.col("close") * F.col("volume")), "_traded": F.sum("volume")}
    moved = _moved(with_halo(rows, 1, block_rows), w).where("NOT _halo").drop("_halo")
    first = written(carried(moved, sums, F.sum, by), "moved")
    second = written(_between(ewm_blocks(first, FIRST, by)), "averages")
    df = with_halo(ewm_blocks(second, SECOND, by), REACH, block_rows)
    own = lambda c: F.when(~F.col("_halo"), c).otherwise(0.0)
    df = _framed(df, w, own(F.col("close") * F.col("volume")), own(F.col("volume")), F.coalesce("_paid", F.lit(0.0)), F.coalesce("_traded", F.lit(0.0)), ("_block", "_row", "_halo"))
    df = df.where("NOT _halo").drop("_halo")
    if fill:
        df = written(df, "features")
        made = _made(df.drop("_block", "_row"), bars)
        last = {f"_last_{c}": F.max_by(finite(c), F.when(finite(c).isNotNull(), F.col("_row"))) for c in made}
        df = carried(df, last, lambda n: F.last(n, ignorenulls=True), by)
        df = df.withColumns({c: F.coalesce(F.last(finite(c), ignorenulls=True).over(upto), F.col(f"_last_{c}"), F.lit(0.0)) for c in made}).drop(*last)
    return df.drop("_block", "_row")


def _made(df: DataFrame, bars: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RAW and c not in bars.columns]


def _framed(df: DataFrame, w: WindowSpec, paid: Column, traded: Column, paid_before: Column | None = None, traded_before: Column | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """All features but the averages. ``paid`` and ``traded`` are summed from the start of ``w``, onto what was before it."""
    close, volume = F.col("close"), F.col("volume")
    df = df.withColumns({
        "rsi": strength("_g14", "_l14"), "rsi_fast": strength("_g7", "_l7"), "macd_hist": F.col("macd") - F.col("macd_signal"),
        "di_diff": F.col("adx_pos") - F.col("adx_neg"), "atr_pct": div("atr", close) * 100,
        "price_vs_ema20": div(close - F.col("ema20"), "ema20") * 100, "price_vs_ema50": div(close - F.col("ema50"), "ema50") * 100,
        "price_vs_ema200": div(close - F.col("ema200"), "ema200") * 100, "ema20_vs_ema50": div(F.col("ema20") - F.col("ema50"), "ema50") * 100,
        "trend": trend_sign("ema20", "ema50"), "taker_buy_ratio": taker_buy_ratio(), **candle_shape(), **cyclical_time(TIME),
        "_low14": rolling(F.min, "low", 14, w), "_high14": rolling(F.max, "high", 14, w), "_mean20": rolling(F.avg, "close", 20, w),
        "_std20": rolling(F.stddev_samp, "close", 20, w), "_std14": rolling(F.stddev_samp, "close", 14, w), "_vol20": rolling(F.avg, "volume", 20, w),
    })
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    nothing = lambda c: F.lit(0.0) if c is None else c
    pivot = (F.lag("high").over(w) + F.lag("low").over(w) + F.lag("close").over(w)) / 3
    df = df.withColumns({
        "ema20_slope": 100 * pct_change(F.col("ema20"), 3, w), "ema50_slope": 100 * pct_change(F.col("ema50"), 3, w),
        "rsi_slope": change(F.col("rsi"), 3, w), "macd_slope": change(F.col("macd"), 3, w),
        "stoch_k": 100 * (close - F.col("_low14")) / (F.col("_high14") - F.col("_low14") + EPS),
        "bb_high": F.col("_mean20") + 2 * F.col("_std20"), "bb_low": F.col("_mean20") - 2 * F.col("_std20"),
        "volume_ratio": div(volume, "_vol20"), "volatility": div("_std14", close) * 100,
        "_obv": F.sum(F.coalesce(F.signum(change(close, 1, w)) * volume, F.lit(0.0))).over(upto),
        "vwap": (F.sum(paid).over(upto) + nothing(paid_before)) / (F.sum(traded).over(upto) + nothing(traded_before) + EPS),
        "price_change": 100 * pct_change(close, 1, w), "price_change3": 100 * pct_change(close, 3, w), "price_change6": 100 * pct_change(close, 6, w),
        "momentum": change(close, 10, w), "pivot_dev": div(close - pivot, pivot) * 100,
        "_atr5": rolling(F.avg, "atr_pct", 5, w), "_adx3": rolling(F.avg, "adx", 3, w),
    })
    width = F.col("bb_high") - F.col("bb_low")
    df = df.withColumns({
        "stoch_d": rolling(F.avg, "stoch_k", 3, w), "bb_pct": (close - F.col("bb_low")) / (width + EPS), "bb_width": div(width, "_mean20") * 100,
        "volume_spike": F.coalesce(F.col("volume_ratio") > 2.0, F.lit(False)).cast("double"),
        "obv_slope": change(F.col("_obv"), 5, w) / (5 * F.col("_vol20") + EPS), "vwap_dev": div(close - F.col("vwap"), "vwap") * 100,
        **regimes("_atr5", "_adx3"),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in kept], *INPUTS)


def regimes(atr_mean: str, adx_mean: str) -> dict[str, Column]:
    """Volatility regime 2 (explosive), 0 (chop) or 1, and five directional regimes of which one is 1."""
    a, x = F.col(atr_mean), F.col(adx_mean)
    wild = F.coalesce((a > 2.0) & (x > 25), F.lit(False))
    chop = ~wild & F.coalesce((a < 0.5) | (x < 15), F.lit(False))
    strong = F.coalesce(x > 25, F.lit(False)) & ~wild & ~chop
    up, down = strong & (F.col("trend") == 1), strong & (F.col("trend") == -1)
    flags = {"volatile": wild, "chop": chop, "uptrend": up, "downtrend": down, "transitional": ~wild & ~chop & ~up & ~down}
    return {"vol_regime": F.when(wild, 2.0).when(chop, 0.0).otherwise(1.0), **{f"regime_{k}": v.cast("double") for k, v in flags.items()}}

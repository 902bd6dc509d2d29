"""The three workloads made of the operators: building the training set, backtesting, live scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tables import with_row
from tidemark.operators import backtest, features, joins, labels, market, series, signals, splits
from tidemark.sources.shared import written


def build_dataset(entry: DataFrame, hourly: DataFrame, slow: DataFrame, benchmark: str, least_bars: int = 100, leak_free: bool = False) -> DataFrame:
    """Entry bars with all features of their own and the slower timeframes, the benchmark's, and the label."""
    entry = series.min_bars(entry, least_bars)
    own = written(features.add_features(entry), "own")  # each of three as-of joins reads its left side twice, so eight times in all
    fast, late = features.add_features(hourly), features.add_features(slow)
    if leak_free:
        fast, late = joins.closing(fast, 1), joins.closing(late, 4)
    on = "close_time" if leak_free else None
    aligned = joins.align_4h(joins.align_1h(own, fast, right_on=on), late, right_on=on)
    crossed = joins.cross_asset(joins.asof_benchmark(aligned, entry.where(F.col("symbol") == benchmark)))
    return labels.make_targets(crossed)


def training_rows(ds: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """The train part of the embargoed split, balanced."""
    train = splits.embargo_split(ds).where("part = 'train'")
    return splits.undersample(train, F.concat_ws("|", "symbol", F.col(series.TIME).cast("string")), ratio, seed)


def rule_signals(df: DataFrame) -> DataFrame:
    """A signal without a model: with the trend, unless the market has run too far; surer the further from 50."""
    side = F.when((F.col("trend") == 1) & (F.col("rsi") < 65), "BUY").when((F.col("trend") == -1) & (F.col("rsi") > 35), "SELL").otherwise("NO_TRADE")
    return df.withColumns({"signal": side, "confidence": 50 + F.abs(F.col("rsi") - 50)})


def run_backtest(df: DataFrame, run_id: str, threshold: float = 52.0, slice_rows: int | None = None) -> DataFrame:
    """Equity curve of the signals that reach the threshold: exits, position cap, costs, compounding; long runs in slices."""
    fired = df.withColumn("signal", F.when(F.col("confidence") >= threshold, F.col("signal")).otherwise("NO_TRADE"))
    trades = backtest.simulate_exits(fired).withColumn("run_id", F.lit(run_id))
    return backtest.equity_curve(backtest.trade_returns(backtest.admit(trades, slice_rows=slice_rows)), slice_rows=slice_rows)


def scored_signals(entry: DataFrame, hourly: DataFrame, slow: DataFrame, benchmark: str, flows: DataFrame, mood: DataFrame) -> DataFrame:
    """Signals of every symbol's newest bar, scored and filtered, rejected ones with their reason."""
    own = signals.volume_gate(features.add_features(entry), series.SERIES)
    slow_features = signals.trend_bars(features.add_features(slow))
    latest = joins.latest_htf(rule_signals(own), features.add_features(hourly), "1h")
    late = series.latest(slow_features.select("symbol", series.TIME, "rsi", "ema20", "ema50", "up_bars", "down_bars"), ("symbol",)).drop(series.TIME)
    late = late.select("symbol", *[F.col(c).alias(f"{c}_4h") for c in ("rsi", "ema20", "ema50")], "up_bars", "down_bars")
    latest = latest.join(late, "symbol", "left").withColumn("trend_bars", F.when(F.col("signal") == "BUY", F.col("up_bars")).otherwise(F.col("down_bars")))
    return decided(latest, benchmark_now(entry.where(F.col("symbol") == benchmark)), flows, mood)


def benchmark_now(benchmark: DataFrame) -> DataFrame:
    """The benchmark's newest move, a row."""
    return series.latest(market.benchmark_momentum(benchmark), ("symbol",)).select("btc_bias", "btc_score_mod")


def decided(latest: DataFrame, bench: DataFrame, flows: DataFrame, mood: DataFrame) -> DataFrame:
    """Rows of scan inputs, from a table or a stream, with score, reasons and reason of rejection.

    ``bench``, ``flows`` and ``mood`` are tables; a stream meets them as they are.
    """
    latest = with_row(latest, bench)
    latest = latest.join(market.classify_netflow(flows).select("symbol", "flow_bias", "flow_score_mod"), "symbol", "left")
    latest = with_row(latest, market.classify_fear_greed(mood).select("fg_bias", "fg_score_mod", "fg_blocks_buy", "fg_blocks_sell"))
    return signals.filter_signals(signals.score_signals(market.with_scan_mode(latest, series.TIME)))


def ordered(filtered: DataFrame, news: DataFrame, instruments: DataFrame, balance: float, unsound: bool = False) -> DataFrame:
    """Decided rows with the scanner's quality, the news, levels, and the size of an order.

    Needs coin, ema200 and range_pct, the plain mean range in percent; ``news`` has coin and sentiment. Rows without
    sound levels are left out; with ``unsound`` they stay, with null levels, so that a symbol's newest row can be told.
    """
    state, risk = market.states_of(F.col("range_pct"))
    out = signals.apply_news(signals.quality_score(filtered), news)
    out = signals.with_levels(out.withColumns({"entry": F.col("close"), "vol_state": state, "vol_risk_mult": risk}), unsound=unsound)
    return signals.position_size(out, instruments, F.lit(balance), F.col("risk_mult") * F.col("vol_risk_mult"))


def scanned_signals(inputs: DataFrame, bench: DataFrame, flows: DataFrame, mood: DataFrame) -> DataFrame:
    """A stream's rows of inputs, decided by the rule."""
    run = F.when(F.col("signal") == "BUY", F.col("up_bars")).otherwise(F.col("down_bars"))
    return decided(rule_signals(inputs).withColumn("trend_bars", run), bench, flows, mood)

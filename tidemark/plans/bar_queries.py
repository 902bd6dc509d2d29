"""Queries on bars: building them, features, as-of joins, labels, splits, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import cyclical_time
from tidemark.operators import features, joins, labels, series, splits, summaries
from tidemark.plans.tables import (
    BENCHMARK,
    bars,
    bars_sql,
    near,
    near_sql,
    stamp,
    stamp_sql,
    ticks,
    timeframe_sql,
    weekly,
)
from tidemark.sources.bars import coarser_bars, dedupe_bars, parse_klines
from tidemark.sources.shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


PRICE_COLUMNS = ("open", "high", "low", "close", "volume", "taker_buy_base_vol")
PRICES_SQL = ", ".join(f"{near_sql(c)} AS {c}" for c in PRICE_COLUMNS)


def priced(df: DataFrame, *more) -> DataFrame:
    return df.select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in PRICE_COLUMNS], *more)


for _interval in ("15m", "1h", "4h"):
    query(f"bars_{_interval}", f"SELECT symbol, {stamp_sql('open_time')} AS open_time, {PRICES_SQL} FROM ({bars_sql(_interval)})")(
        lambda spark, sf_dir, i=_interval: priced(bars(spark, sf_dir, i))
    )


@query("bars_from_finer", f"SELECT symbol, {stamp_sql('open_time')} AS open_time, {PRICES_SQL} FROM ({bars_sql('4h')})")
def _(spark, sf_dir):
    return priced(coarser_bars(bars(spark, sf_dir), "4 hours", "4h"))


@query(
    "bars_by_user",
    f"""SELECT CAST(user_id AS VARCHAR) AS symbol, {stamp_sql("time_bucket(INTERVAL '1 hour', ts)")} AS open_time,
  {near_sql("arg_min(100 + value, (ts, value))")} AS open, {near_sql("max(100 + value)")} AS high, {near_sql("min(100 + value)")} AS low,
  {near_sql("arg_max(100 + value, (ts, value))")} AS close, count(*) AS ticks FROM events GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    from tidemark.plans.tables import table
    from tidemark.sources.bars import to_bars

    events = table(spark, sf_dir, "events")
    one = events.select(F.col("user_id").cast("string").alias("symbol"), "ts", (100 + F.col("value")).alias("price"), F.lit(1.0).alias("qty"), F.lit(True).alias("is_taker_buy"))
    return priced(to_bars(one, "1 hour", "1h"), F.col("volume").cast("long").alias("ticks")).select("symbol", "open_time", "open", "high", "low", "close", "ticks")


@query(
    "klines_parsed_and_deduped",
    f"""SELECT symbol, {stamp_sql("open_time")} AS open_time, {near_sql("close")} AS close, {near_sql("volume")} AS volume
FROM ({bars_sql()})""",
)
def _(spark, sf_dir):
    """The bars as two overlapping batches of JSON klines, parsed and deduplicated; the older batch is spoiled."""
    b = bars(spark, sf_dir).withColumn("ms", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "open_time") * 1000)
    text = lambda c: F.col(c).cast("string")
    line = lambda close: F.array(text("ms"), text("open"), text("high"), text("low"), close, text("volume"), F.lit("0"), F.lit("0"), F.lit("1"), text("taker_buy_base_vol"), F.lit("0"), F.lit("0"))
    day = F.dayofmonth("open_time")
    new = b.groupBy("symbol", "interval", day.alias("d")).agg(F.to_json(F.collect_list(line(text("close")))).alias("payload")).withColumn("batch", F.lit(0))
    old = b.groupBy("symbol", "interval", day.alias("d")).agg(F.to_json(F.collect_list(line(F.lit("n/a")))).alias("payload")).withColumn("batch", F.lit(1))
    parsed = dedupe_bars(parse_klines(old.unionByName(new).drop("d")))
    at = F.timestamp_add("SECOND", (F.unix_seconds("open_time")).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return parsed.select("symbol", stamp(at).alias("open_time"), near("close").alias("close"), near("volume").alias("volume"))


# All features of one timeframe.
_W = "OVER w"
_F = {
    **{c: c for c in ("ema9", "ema20", "ema50", "ema200", "rsi", "macd", "macd_signal", "atr", "adx", "trend", "vwap")},
    "rsi_fast": "coalesce(100 - 100 / (1 + g7 / nullif(l7, 0)), 50)", "macd_hist": "macd - macd_signal",
    "adx_pos": "100 * up / nullif(atr, 0)", "adx_neg": "100 * down / nullif(atr, 0)", "di_diff": "100 * up / nullif(atr, 0) - 100 * down / nullif(atr, 0)",
    "atr_pct": "atr / nullif(close, 0) * 100", "price_vs_ema20": "(close - ema20) / ema20 * 100", "price_vs_ema50": "(close - ema50) / ema50 * 100",
    "price_vs_ema200": "(close - ema200) / ema200 * 100", "ema20_vs_ema50": "(ema20 - ema50) / ema50 * 100",
    "ema20_slope": "100 * (ema20 / lag(ema20, 3) OVER w - 1)", "ema50_slope": "100 * (ema50 / lag(ema50, 3) OVER w - 1)", "rsi_slope": "rsi - lag(rsi, 3) OVER w", "macd_slope": "macd - lag(macd, 3) OVER w",
    "stoch_k": "stoch_k", "stoch_d": "CASE WHEN count(stoch_k) OVER w3 = 3 THEN avg(stoch_k) OVER w3 END",
    "bb_high": "m20 + 2 * s20", "bb_low": "m20 - 2 * s20", "bb_pct": "(close - (m20 - 2 * s20)) / (4 * s20 + 1e-10)", "bb_width": "4 * s20 / m20 * 100",
    "volume_ratio": "volume / nullif(v20, 0)", "volume_spike": "CASE WHEN volume / nullif(v20, 0) > 2 THEN 1.0 ELSE 0.0 END", "obv_slope": "(obv - lag(obv, 5) OVER w) / (5 * v20 + 1e-10)",
    "vwap_dev": "(close - vwap) / vwap * 100", "price_change": "100 * (close / lag(close) OVER w - 1)", "price_change3": "100 * (close / lag(close, 3) OVER w - 1)",
    "price_change6": "100 * (close / lag(close, 6) OVER w - 1)", "high_low_pct": "(high - low) / close * 100", "body_pct": "abs(close - open) / (high - low + 1e-10)", "momentum": "close - lag(close, 10) OVER w",
    "volatility": "s14 / close * 100", "pivot_dev": "(close - mid) / mid * 100", "bullish_candle": "CASE WHEN close > open AND abs(close - open) > 0.6 * (high - low + 1e-10) THEN 1.0 ELSE 0.0 END",
    "doji": "CASE WHEN abs(close - open) < 0.1 * (high - low + 1e-10) THEN 1.0 ELSE 0.0 END",
    "hammer": "CASE WHEN least(close, open) - low > 2 * abs(close - open) AND high - greatest(close, open) < abs(close - open) THEN 1.0 ELSE 0.0 END",
    "taker_buy_ratio": "least(greatest(coalesce(taker_buy_base_vol / nullif(volume, 0), 0.5), 0), 1)", "vol_regime": "regime",
    "regime_volatile": "CASE WHEN regime = 2 THEN 1.0 ELSE 0.0 END", "regime_chop": "CASE WHEN regime = 0 THEN 1.0 ELSE 0.0 END",
    "regime_uptrend": "CASE WHEN regime = 1 AND x3 > 25 AND trend = 1 THEN 1.0 ELSE 0.0 END", "regime_downtrend": "CASE WHEN regime = 1 AND x3 > 25 AND trend = -1 THEN 1.0 ELSE 0.0 END",
    "regime_transitional": "CASE WHEN regime = 1 AND NOT coalesce(x3 > 25 AND trend <> 0, false) THEN 1.0 ELSE 0.0 END",
    "hour_sin": "sin(2 * pi() * hour(open_time) / 24)", "hour_cos": "cos(2 * pi() * hour(open_time) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(open_time) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(open_time) - 1) / 7)",
}
_ROLLED = """, g AS (SELECT f.*, CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS m20, CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS s20,
  CASE WHEN count(close) OVER w14 = 14 THEN stddev_samp(close) OVER w14 END AS s14, CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END AS v20,
  CASE WHEN count(low) OVER w14 = 14 THEN 100 * (close - min(low) OVER w14) / (max(high) OVER w14 - min(low) OVER w14 + 1e-10) END AS stoch_k,
  CASE WHEN count(atr / close) OVER w5 = 5 THEN avg(100 * atr / close) OVER w5 END AS a5, CASE WHEN count(adx) OVER w3 = 3 THEN avg(adx) OVER w3 END AS x3,
  sum(close * volume) OVER wu / (sum(volume) OVER wu + 1e-10) AS vwap, sign(close - lag(close) OVER w) * volume AS flow,
  (lag(high) OVER w + lag(low) OVER w + lag(close) OVER w) / 3 AS mid
  FROM f WINDOW w AS (PARTITION BY symbol ORDER BY open_time), wu AS (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING),
  w20 AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING),
  w5 AS (PARTITION BY symbol ORDER BY open_time ROWS 4 PRECEDING), w3 AS (PARTITION BY symbol ORDER BY open_time ROWS 2 PRECEDING)),
h AS (SELECT *, sum(coalesce(flow, 0)) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS obv,
  CASE WHEN a5 > 2 AND x3 > 25 THEN 2.0 WHEN a5 < 0.5 OR x3 < 15 THEN 0.0 ELSE 1.0 END AS regime FROM g)"""


def features_sql(interval: str, names) -> str:
    made = ", ".join(f"{_F[n]} AS o_{n}" for n in names)
    filled = ", ".join(f"{near_sql(f'coalesce(last_value(o_{n} IGNORE NULLS) OVER u, 0)')} AS {n}" for n in names)
    return f"""{timeframe_sql(interval)}{_ROLLED}, o AS (SELECT symbol, open_time, {made} FROM h
  WINDOW w AS (PARTITION BY symbol ORDER BY open_time), w3 AS (PARTITION BY symbol ORDER BY open_time ROWS 2 PRECEDING))
SELECT symbol, {stamp_sql("open_time")} AS open_time, {filled} FROM o WINDOW u AS (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)"""


GROUPS = {
    "features_trend": ("15m", ("ema9", "ema20", "ema50", "ema200", "ema20_slope", "ema50_slope", "price_vs_ema20", "price_vs_ema50", "price_vs_ema200", "ema20_vs_ema50", "macd", "macd_signal", "macd_hist", "macd_slope", "trend")),
    "features_strength": ("15m", ("rsi", "rsi_fast", "rsi_slope", "stoch_k", "stoch_d", "adx", "adx_pos", "adx_neg", "di_diff", "momentum", "price_change", "price_change3", "price_change6", "pivot_dev")),
    "features_volatility": ("15m", ("atr", "atr_pct", "bb_high", "bb_low", "bb_pct", "bb_width", "volatility", "vol_regime", "regime_volatile", "regime_chop", "regime_uptrend", "regime_downtrend", "regime_transitional")),
    "features_volume": ("15m", ("volume_ratio", "volume_spike", "obv_slope", "vwap", "vwap_dev", "taker_buy_ratio")),
    "features_candle_and_time": ("15m", ("body_pct", "high_low_pct", "bullish_candle", "doji", "hammer", "hour_sin", "hour_cos", "dow_sin", "dow_cos")),
    "features_1h": ("1h", ("rsi", "adx", "trend", "ema20", "ema50", "atr", "macd_signal")),
    "features_4h": ("4h", ("rsi", "trend", "ema20", "ema50", "adx")),
}
for _name, (_interval, _columns) in GROUPS.items():
    query(_name, features_sql(_interval, _columns))(
        lambda spark, sf_dir, i=_interval, names=_columns: features.add_features(bars(spark, sf_dir, i)).select(
            "symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in names]
        )
    )


_ALL = tuple(dict.fromkeys(c for interval, columns in GROUPS.values() if interval == "15m" for c in columns))


@query("features_blocked", features_sql("15m", _ALL))
def _(spark, sf_dir):
    """All features in blocks of 200 bars, as for series too long for one task."""
    df = features.add_features(bars(spark, sf_dir), block_rows=200)
    return df.select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in _ALL])


@query(
    "time_features",
    f"""SELECT symbol, {stamp_sql("ts")} AS ts, {near_sql("sin(2 * pi() * hour(ts) / 24)")} AS hour_sin, {near_sql("cos(2 * pi() * hour(ts) / 24)")} AS hour_cos,
  {near_sql("sin(2 * pi() * (isodow(ts) - 1) / 7)")} AS dow_sin, {near_sql("cos(2 * pi() * (isodow(ts) - 1) / 7)")} AS dow_cos
FROM (SELECT event_type AS symbol, ts FROM events)""",
)
def _(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", stamp("ts").alias("ts"), *[near(c).alias(n) for n, c in cyclical_time("ts").items()])


def _with_htf(spark, sf_dir, on_close: bool = False):
    entry = bars(spark, sf_dir)
    hourly, slow = features.add_features(bars(spark, sf_dir, "1h")), features.add_features(bars(spark, sf_dir, "4h"))
    if on_close:
        hourly, slow = joins.closing(hourly, 1), joins.closing(slow, 4)
    right_on = "close_time" if on_close else None
    return joins.align_4h(joins.align_1h(entry, hourly, right_on=right_on), slow, right_on=right_on)


def _htf_sql(shift: tuple[str, str] = ("", "")) -> str:
    one = timeframe_sql("1h").replace("WITH RECURSIVE ", "", 1)
    return f"""SELECT x.symbol, {stamp_sql("x.open_time")} AS open_time, {near_sql("coalesce(h1.rsi, 50)")} AS rsi_1h, {near_sql("coalesce(h1.adx, 0)")} AS adx_1h, coalesce(h1.trend, 0.0) AS trend_1h,
  {near_sql("coalesce(h4.rsi, 50)")} AS rsi_4h, coalesce(h4.trend, 0.0) AS trend_4h
FROM ({bars_sql()}) x
ASOF LEFT JOIN (WITH RECURSIVE {one} SELECT symbol, open_time{shift[0]} AS open_time, rsi, coalesce(adx, 0) AS adx, trend FROM f) h1 ON x.symbol = h1.symbol AND x.open_time >= h1.open_time
ASOF LEFT JOIN ({timeframe_sql("4h")} SELECT symbol, open_time{shift[1]} AS open_time, rsi, trend FROM f) h4 ON x.symbol = h4.symbol AND x.open_time >= h4.open_time"""


_HTF = ("rsi_1h", "adx_1h", "trend_1h", "rsi_4h", "trend_4h")


@query("asof_slower_timeframes", _htf_sql())
def _(spark, sf_dir):
    return _with_htf(spark, sf_dir).select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in _HTF])


@query("asof_slower_timeframes_closed", _htf_sql((" + INTERVAL 1 HOUR", " + INTERVAL 4 HOUR")))
def _(spark, sf_dir):
    """The leak-free alignment: a slow bar counts from its close on."""
    return _with_htf(spark, sf_dir, True).select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in _HTF])


_BENCH_SQL = f"""WITH b AS ({bars_sql()}), x AS (
  SELECT b.*, k.close AS btc_close FROM b ASOF LEFT JOIN (SELECT open_time, close FROM b WHERE symbol = '{BENCHMARK}') k ON b.open_time >= k.open_time)"""


@query("asof_benchmark", f"{_BENCH_SQL} SELECT symbol, {stamp_sql('open_time')} AS open_time, {near_sql('close')} AS close, {near_sql('btc_close')} AS btc_close FROM x")
def _(spark, sf_dir):
    b = bars(spark, sf_dir)
    out = joins.asof_benchmark(b, b.where(F.col("symbol") == BENCHMARK))
    return out.select("symbol", stamp("open_time").alias("open_time"), near("close").alias("close"), near("btc_close").alias("btc_close"))


@query(
    "cross_asset",
    f"""{_BENCH_SQL}, r AS (SELECT *, close / lag(close) OVER w - 1 AS own, btc_close / lag(btc_close) OVER w - 1 AS ref, close / lag(close, 6) OVER w - btc_close / lag(btc_close, 6) OVER w AS ahead,
  count(btc_close) OVER (PARTITION BY symbol) AS known FROM x WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
s AS (SELECT *, count(own + ref) OVER v AS n, count(ref) OVER v AS nr, covar_samp(own, ref) OVER v AS cov, var_samp(ref) OVER v AS var,
  stddev_samp(CASE WHEN ref IS NOT NULL THEN own END) OVER v * stddev_samp(CASE WHEN own IS NOT NULL THEN ref END) OVER v AS spread
  FROM r WINDOW v AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING))
SELECT symbol, {stamp_sql("open_time")} AS open_time,
  {near_sql("CASE WHEN known > 30 THEN least(greatest(coalesce(CASE WHEN n >= 10 THEN cov / nullif(spread, 0) END, 0), -1), 1) ELSE 0 END")} AS btc_corr_20,
  {near_sql("CASE WHEN known > 30 THEN least(greatest(coalesce(CASE WHEN n >= 10 AND nr >= 10 THEN cov / nullif(var, 0) END, 1), -5), 5) ELSE 1 END")} AS btc_beta_20,
  {near_sql("CASE WHEN known > 30 THEN least(greatest(coalesce(100 * ahead, 0), -50), 50) ELSE 0 END")} AS btc_rel_strength FROM s""",
)
def _(spark, sf_dir):
    b = bars(spark, sf_dir)
    out = joins.cross_asset(joins.asof_benchmark(b, b.where(F.col("symbol") == BENCHMARK)))
    return out.select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in ("btc_corr_20", "btc_beta_20", "btc_rel_strength")])


# Labels.
_TARGET_SQL = f"""{timeframe_sql()}, t AS (SELECT f.*, count(*) OVER v AS ahead, max(high) OVER v AS hi, min(low) OVER v AS lo FROM f
  WINDOW v AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)),
l AS (SELECT symbol, open_time, 'w' || CAST((day(open_time) - 1) // 7 AS VARCHAR) AS regime, CASE WHEN lo <= close - 3.5 * atr AND hi < close + 2.5 * atr THEN 'SELL'
  WHEN hi >= close + 3.5 * atr AND lo > close - 2.5 * atr THEN 'BUY' ELSE 'NO_TRADE' END AS target FROM t WHERE ahead = 24)"""


def labelled(spark, sf_dir) -> DataFrame:
    return weekly(labels.make_targets(features.atr(bars(spark, sf_dir))))


@query("barrier_labels", f"{_TARGET_SQL} SELECT symbol, {stamp_sql('open_time')} AS open_time, target FROM l")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select("symbol", stamp("open_time").alias("open_time"), "target")


@query(
    "label_distribution",
    f"""{_TARGET_SQL}, c AS (SELECT regime, target, count(*) AS n FROM l GROUP BY GROUPING SETS ((target), (regime, target)))
SELECT regime, target, n AS rows, {near_sql("100.0 * n / sum(n) OVER (PARTITION BY regime)")} AS share FROM c""",
)
def _(spark, sf_dir):
    return summaries.label_distribution(labelled(spark, sf_dir)).withColumn("share", near("share"))


def _touch_sql(n: int, up: float, stop: float) -> str:
    return f"""{timeframe_sql()}, q AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM f),
p AS (SELECT a.symbol, a.open_time, a.adx, a.atr, count(*) AS ahead,
  min(CASE WHEN z.high >= a.close + {up} * a.atr THEN z.rn - a.rn END) AS up, min(CASE WHEN z.low <= a.close - {stop} * a.atr THEN z.rn - a.rn END) AS up_stop,
  min(CASE WHEN z.low <= a.close - {up} * a.atr THEN z.rn - a.rn END) AS down, min(CASE WHEN z.high >= a.close + {stop} * a.atr THEN z.rn - a.rn END) AS down_stop
  FROM q a JOIN q z ON a.symbol = z.symbol AND z.rn BETWEEN a.rn + 1 AND a.rn + {n} WHERE a.n >= 100 GROUP BY ALL),
hit AS (SELECT symbol, open_time, adx, atr, ahead, coalesce(up <= coalesce(up_stop, {n + 1}), false) AS buy, coalesce(down <= coalesce(down_stop, {n + 1}), false) AS sell FROM p)
SELECT q.symbol, {stamp_sql("q.open_time")} AS open_time, CASE WHEN hit.ahead = {n} AND hit.adx >= 18 AND hit.atr > 0 AND buy AND NOT sell THEN 'BUY'
  WHEN hit.ahead = {n} AND hit.adx >= 18 AND hit.atr > 0 AND sell AND NOT buy THEN 'SELL' ELSE 'NO_TRADE' END AS target
FROM q LEFT JOIN hit ON q.symbol = hit.symbol AND q.open_time = hit.open_time WHERE q.n >= 100"""


@query("first_touch_labels", _touch_sql(12, 1.5, 1.0))
def _(spark, sf_dir):
    df = labels.first_touch_targets(features.add_features(bars(spark, sf_dir)))
    return df.select("symbol", stamp("open_time").alias("open_time"), "target")


@query("first_touch_labels_far", _touch_sql(1000, 3.0, 1.2))
def _(spark, sf_dir):
    """The same within a thousand bars, by skipping blocks that touch nothing."""
    df = labels.first_touch_targets(features.add_features(bars(spark, sf_dir)), 1000, 3.0, 1.2)
    return df.select("symbol", stamp("open_time").alias("open_time"), "target")


# Segments, splits, samples, summaries.
_RANKED_SQL = f"""{_TARGET_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY open_time, symbol) - 1 AS i, count(*) OVER (PARTITION BY regime) AS n FROM l),
p AS (SELECT *, n - CAST(floor(n * 0.2) AS BIGINT) AS ts, CAST(floor(n * 0.15) AS BIGINT) AS cs FROM n),
s AS (SELECT *, CASE WHEN ts - 24 - cs - 24 <= 0 OR i < ts - 24 - cs - 24 THEN 'train' WHEN i >= ts - 24 - cs AND i < ts - 24 THEN 'calib' WHEN i >= ts THEN 'test' END AS part FROM p)"""


@query("embargo_split", f"{_RANKED_SQL} SELECT symbol, {stamp_sql('open_time')} AS open_time, regime, part FROM s WHERE part IS NOT NULL")
def _(spark, sf_dir):
    return splits.embargo_split(labelled(spark, sf_dir)).select("symbol", stamp("open_time").alias("open_time"), "regime", "part")


@query(
    "walk_forward_folds",
    f"""{_TARGET_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY open_time, symbol) - 1 AS i, count(*) OVER () AS n FROM l),
folds AS (SELECT n.*, fold, n // 5 AS size, least(24, greatest(n // 5 // 10, 1)) AS skip FROM n, range(1, 5) r(fold)),
p AS (SELECT *, CASE WHEN i < fold * size THEN 'train' WHEN i >= fold * size + skip AND i < fold * size + skip + size THEN 'test' END AS part FROM folds WHERE fold * size + skip + size <= n)
SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS rows, {stamp_sql("min(open_time)")} AS first, {stamp_sql("max(open_time)")} AS last FROM p WHERE part IS NOT NULL GROUP BY fold, part""",
)
def _(spark, sf_dir):
    folds = splits.walk_forward_folds(labelled(spark, sf_dir))
    return folds.groupBy("fold", "part").agg(F.count("*").alias("rows"), stamp(F.min("open_time")).alias("first"), stamp(F.max("open_time")).alias("last"))


@query(
    "undersample",
    f"""{_TARGET_SQL}, s AS (SELECT *, strftime(open_time, '%Y-%m-%d %H:%M:%S') AS stamp FROM l),
drawn AS (SELECT *, row_number() OVER (ORDER BY md5(symbol || stamp || '|42')) AS draw FROM s WHERE target = 'NO_TRADE')
SELECT symbol, stamp AS open_time, target FROM s WHERE target <> 'NO_TRADE' UNION ALL
SELECT symbol, stamp, target FROM drawn WHERE draw <= (SELECT CAST(floor(count(*) * 1.0) AS BIGINT) FROM s WHERE target <> 'NO_TRADE')""",
)
def _(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return splits.undersample(df, F.concat("symbol", stamp("open_time"))).select("symbol", stamp("open_time").alias("open_time"), "target")


_WINDOWS = (("w1", "2024-01-01", "2024-01-08", 400), ("w2", "2024-01-08", "2024-01-15", 50), ("w3", "2024-01-20", "2024-01-20 06:00:00", 1000))


@query(
    "tagged_segments",
    f"""WITH b AS ({bars_sql()}), w(label, s, e, candles) AS (VALUES {", ".join(f"('{a}', TIMESTAMP '{s}', TIMESTAMP '{e}', {n})" for a, s, e, n in _WINDOWS)}),
r AS (SELECT b.symbol, b.open_time, w.label, w.candles, row_number() OVER (PARTITION BY b.symbol, w.label ORDER BY b.open_time) AS n FROM b JOIN w ON b.open_time BETWEEN w.s AND w.e)
SELECT label AS segment, symbol, {stamp_sql("open_time")} AS open_time FROM r WHERE n <= candles""",
)
def _(spark, sf_dir):
    ms = lambda t: F.unix_millis(F.lit(t).cast("timestamp_ntz").cast("timestamp"))
    rows = [spark.range(1).select(F.lit(a).alias("label"), ms(s).alias("start_ms"), ms(e).alias("end_ms"), F.lit(n).alias("candles")) for a, s, e, n in _WINDOWS]
    return series.tag_segments(bars(spark, sf_dir), series.union_all(rows)).select("segment", "symbol", stamp("open_time").alias("open_time"))


@query("last_n_bars", f"SELECT symbol, {stamp_sql('open_time')} AS open_time FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM ({bars_sql()})) WHERE n <= 300")
def _(spark, sf_dir):
    return series.last_n(bars(spark, sf_dir), 300).select("symbol", stamp("open_time").alias("open_time"))


@query("latest_bar", f"SELECT symbol, {stamp_sql('max(open_time)')} AS open_time, {near_sql('arg_max(close, open_time)')} AS close FROM ({bars_sql()}) GROUP BY symbol")
def _(spark, sf_dir):
    return series.latest(bars(spark, sf_dir)).select("symbol", stamp("open_time").alias("open_time"), near("close").alias("close"))


@query("after_cutoff_with_enough_bars", f"""WITH b AS ({bars_sql()}), c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b WHERE open_time > TIMESTAMP '2024-01-20')
SELECT symbol, {stamp_sql("open_time")} AS open_time FROM c WHERE n >= 100""")
def _(spark, sf_dir):
    late = series.after_cutoff(bars(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz"))
    return series.min_bars(late, 100).select("symbol", stamp("open_time").alias("open_time"))


@query(
    "filled_features",
    f"""WITH b AS ({bars_sql()}) SELECT symbol, {stamp_sql("open_time")} AS open_time,
  {near_sql("coalesce(last_value(CASE WHEN volume > 6 THEN close END IGNORE NULLS) OVER u, 0)")} AS sparse, 0.0 AS missing
FROM b WINDOW u AS (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf_dir):
    sparse = F.when(F.col("volume") > 6, F.col("close")).when(F.col("volume") > 4, float("inf"))
    df = series.ensure_columns(bars(spark, sf_dir).withColumn("sparse", sparse), ["missing"])
    return series.fill_features(df, ["sparse", "missing"]).select("symbol", stamp("open_time").alias("open_time"), near("sparse").alias("sparse"), "missing")


@query(
    "feature_coverage",
    f"""WITH b AS (SELECT *, least(greatest(coalesce(taker_buy_base_vol / nullif(volume, 0), 0.5), 0), 1) AS r FROM ({bars_sql()}))
SELECT 'taker_buy_ratio' AS feature, {near_sql("avg(r)")} AS mean, {near_sql("stddev_samp(r)")} AS std, {near_sql("avg(CASE WHEN r = 0.5 THEN 1.0 ELSE 0 END)")} AS at_default FROM b
UNION ALL SELECT 'volume', {near_sql("avg(volume)")}, {near_sql("stddev_samp(volume)")}, {near_sql("avg(CASE WHEN volume = 1 THEN 1.0 ELSE 0 END)")} FROM b""",
)
def _(spark, sf_dir):
    from tidemark.functions.scalars import taker_buy_ratio

    df = bars(spark, sf_dir).withColumn("taker_buy_ratio", taker_buy_ratio())
    return summaries.feature_coverage(df, {"taker_buy_ratio": 0.5, "volume": 1.0}).withColumns({c: near(c) for c in ("mean", "std", "at_default")})


@query(
    "dataset_summary",
    f"SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT iv) AS intervals, string_agg(DISTINCT iv, ',' ORDER BY iv) AS interval_names FROM ("
    + " UNION ALL ".join(f"""SELECT symbol, "interval" AS iv FROM ({bars_sql(i)})""" for i in ("15m", "1h", "4h")) + ")",
)
def _(spark, sf_dir):
    return summaries.dataset_summary(series.union_all([bars(spark, sf_dir, i) for i in ("15m", "1h", "4h")]))


_CROSS = ("btc_corr_20", "btc_beta_20", "btc_rel_strength")
_TRAINING_SQL = f"""SELECT o.*, {", ".join(_HTF)}, {", ".join(_CROSS)}, regime, target FROM ({features_sql("15m", _ALL)}) o JOIN ({ORACLES["asof_slower_timeframes"]}) h USING (symbol, open_time)
JOIN ({ORACLES["cross_asset"]}) x USING (symbol, open_time) JOIN ({_RANKED_SQL},
  tr AS (SELECT symbol, {stamp_sql("open_time")} AS open_time, regime, target FROM s WHERE part = 'train'),
  dr AS (SELECT *, row_number() OVER (ORDER BY md5(symbol || '|' || open_time || '|42')) AS draw FROM tr WHERE target = 'NO_TRADE')
  SELECT * FROM tr WHERE target <> 'NO_TRADE' UNION ALL SELECT * EXCLUDE (draw) FROM dr WHERE draw <= (SELECT count(*) FROM tr WHERE target <> 'NO_TRADE')) k USING (symbol, open_time)"""


@query("build_dataset", _TRAINING_SQL)
def _(spark, sf_dir):
    """The whole training set: features, slower timeframes, benchmark, labels, split and balance."""
    from tidemark.plans.workloads import build_dataset, training_rows

    ds = build_dataset(bars(spark, sf_dir), bars(spark, sf_dir, "1h"), bars(spark, sf_dir, "4h"), BENCHMARK)
    rows = training_rows(written(weekly(ds), "dataset"))  # counted, then read
    return rows.select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in (*_ALL, *_HTF, *_CROSS)], "regime", "target")

"""Queries on signals, market states, backtests and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexicon import BEARISH, BULLISH, MAJORS
from tidemark.operators import backtest, features, joins, market, ml, series, signals, splits, summaries
from tidemark.plans.tables import BENCHMARK, bars, bars_sql, near, near_sql, stamp, stamp_sql, table, ticks, timeframe_sql, weekly, wide_ticks
from tidemark.plans.workloads import build_dataset, rule_signals, run_backtest, scored_signals
from tidemark.sources.bars import to_bars
from tidemark.sources.shared import shared_path, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register




def at():
    return stamp("open_time").alias("open_time")


AT_SQL = f"{stamp_sql('open_time')} AS open_time"

_ACTIVE = "hour(ts) >= 8 AND hour(ts) < 20"
_WEEKEND = "isodow(ts) >= 6"


def _pick(wa, wq, a, q) -> str:
    return f"CASE WHEN {_WEEKEND} AND {_ACTIVE} THEN {wa} WHEN {_WEEKEND} THEN {wq} WHEN {_ACTIVE} THEN {a} ELSE {q} END"


_MULT_SQL = near_sql(f"({_pick(0.85, 0.5, 1.0, 0.5)}) * CASE WHEN hour(ts) BETWEEN 9 AND 11 OR hour(ts) BETWEEN 13 AND 16 THEN 1.2 ELSE 1.0 END", 3)


@query(
    "scan_mode",
    f"""SELECT {_pick("'weekend_active'", "'weekend_quiet'", "'active'", "'quiet'")} AS mode, {_pick(50, 50, 45, 50)} AS min_confidence, {_pick(3, 4, 3, 3)} AS min_score, {_pick(18, 22, 15, 18)} AS min_adx,
  {_pick(15, 30, 15, 30)} AS interval_min, {_MULT_SQL} AS risk_mult, count(*) AS n
FROM events GROUP BY ALL""",
)
def _(spark, sf_dir):
    keys = ["mode", "min_confidence", "min_score", "min_adx", "interval_min", "risk_mult"]
    df = market.with_scan_mode(ticks(spark, sf_dir)).withColumn("risk_mult", near("risk_mult", 3))
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


_V = "CAST(floor(value) AS BIGINT) % 101"


@query(
    "fear_greed_states",
    f"""SELECT v AS value, CASE WHEN v >= 75 THEN 'SELL' WHEN v <= 25 THEN 'BUY' END AS fg_bias, v <= 20 AS fg_blocks_sell, v >= 70 AS fg_blocks_buy,
  CASE WHEN v < 25 THEN 'CRISIS / EXTREME FEAR' WHEN v < 45 THEN 'BEARISH / FEAR' WHEN v < 55 THEN 'NEUTRAL' WHEN v < 75 THEN 'BULLISH / GREED' ELSE 'EXTREME GREED' END AS condition,
  CASE WHEN v < 30 THEN 'BUY_ZONE' WHEN v > 75 THEN 'SELL_ZONE' ELSE 'NEUTRAL' END AS action, CASE WHEN v < 20 THEN 'EXTREME FEAR' WHEN v > 80 THEN 'EXTREME GREED' ELSE '' END AS warning,
  v > 25 AND v < 75 AS trade_ok, count(*) AS n FROM (SELECT {_V} AS v FROM events) GROUP BY ALL""",
)
def _(spark, sf_dir):
    df = market.classify_fear_greed(table(spark, sf_dir, "events").select((F.floor("value") % 101).alias("value")))
    return df.groupBy("value", "fg_bias", "fg_blocks_sell", "fg_blocks_buy", "condition", "action", "warning", "trade_ok").agg(F.count("*").alias("n"))


@query(
    "netflow_bias",
    """SELECT symbol, x AS net_inflow, CASE WHEN x > 50000000 THEN 'SELL' WHEN x < -50000000 THEN 'BUY' END AS flow_bias, CASE WHEN abs(x) > 50000000 THEN 1 ELSE 0 END AS flow_score_mod
FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, round((arg_max(value, ts) - 50) * 2000000, 2) AS x FROM events GROUP BY user_id)""",
)
def _(spark, sf_dir):
    flows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts", F.round((F.col("value") - 50) * 2e6, 2).alias("net_inflow"))
    return market.classify_netflow(flows).select("symbol", "net_inflow", "flow_bias", "flow_score_mod")


@query(
    "benchmark_momentum",
    f"""WITH c AS (SELECT symbol, open_time, 100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) - 1) AS p FROM ({bars_sql()}))
SELECT symbol, {AT_SQL}, {near_sql("p")} AS change_pct, CASE WHEN p >= 1.5 THEN 'BUY' WHEN p <= -1.5 THEN 'SELL' END AS btc_bias, CASE WHEN abs(p) >= 1.5 THEN 1 ELSE 0 END AS btc_score_mod FROM c""",
)
def _(spark, sf_dir):
    return market.benchmark_momentum(bars(spark, sf_dir)).select("symbol", at(), near("change_pct").alias("change_pct"), "btc_bias", "btc_score_mod")


@query(
    "volatility_state",
    f"""WITH d AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM ({bars_sql()}) WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
v AS (SELECT symbol, open_time, CASE WHEN count(*) OVER u = 14 THEN 100 * avg(tr) OVER u / close END AS p FROM d WINDOW u AS (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING))
SELECT symbol, {AT_SQL}, {near_sql("p")} AS range_pct, CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p > 4 THEN 'VERY_HIGH' WHEN p > 2 THEN 'HIGH' WHEN p < 0.05 THEN 'DEAD' ELSE 'NORMAL' END AS vol_state,
  CASE WHEN p > 4 THEN 0.25 WHEN p > 2 THEN 0.5 WHEN p < 0.05 THEN 0.0 ELSE 1.0 END + 0.0 AS vol_risk_mult, coalesce(p < 0.05, false) AS skip FROM v""",
)
def _(spark, sf_dir):
    df = market.volatility_state(bars(spark, sf_dir))
    return df.select("symbol", at(), near("range_pct").alias("range_pct"), "vol_state", "vol_risk_mult", "skip")


@query("volatility_states_all", None)
def _(spark, sf_dir):
    """The same over forty symbols whose prices are from wild to still, so that every state occurs."""
    df = market.volatility_state(series.with_segment(to_bars(wide_ticks(spark, sf_dir), "15 minutes", "15m")))
    return df.select("symbol", at(), near("range_pct").alias("range_pct"), "vol_state", "vol_risk_mult", "skip")


_ONE_SQL = f"""{timeframe_sql()}, s AS (SELECT *, CASE WHEN trend = 1 AND rsi < 65 THEN 'BUY' WHEN trend = -1 AND rsi > 35 THEN 'SELL' ELSE 'NO_TRADE' END AS signal, 50 + abs(rsi - 50) AS confidence FROM f)"""


def ruled(spark, sf_dir) -> DataFrame:
    return rule_signals(features.add_features(bars(spark, sf_dir)))


_STATE_SQL = "CASE CAST(volume AS BIGINT) % 4 WHEN 0 THEN 'VERY_HIGH' WHEN 1 THEN 'DEAD' WHEN 2 THEN 'UNKNOWN' ELSE 'NORMAL' END"
_LEVEL_SQL = "CASE WHEN entry < 10 THEN round_even({0}, 4) ELSE round_even({0}, 2) END"


@query(
    "signal_levels",
    f"""{_ONE_SQL}, l AS (SELECT symbol, open_time, signal, close AS entry, atr, {_STATE_SQL} AS vol_state, CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END AS side FROM s WHERE signal <> 'NO_TRADE' AND atr > 0),
x AS (SELECT *, CASE vol_state WHEN 'VERY_HIGH' THEN 1.5 WHEN 'NORMAL' THEN 1.0 ELSE 0.8 END AS stretch FROM l),
p AS (SELECT *, {_LEVEL_SQL.format("entry - side * atr * 2.5")} AS stop, {_LEVEL_SQL.format("entry + side * atr * 3.5 * stretch")} AS tp1, {_LEVEL_SQL.format("entry + side * atr * 7.5 * stretch")} AS tp2 FROM x)
SELECT symbol, {AT_SQL}, signal, vol_state, {near_sql("stop")} AS stop, {near_sql("tp1")} AS tp1, {near_sql("tp2")} AS tp2 FROM p WHERE stop > 0 AND tp1 > 0 AND tp2 > 0""",
)
def _(spark, sf_dir):
    """With the bar's volume standing for the state of the market."""
    kind = F.col("volume").cast("long") % 4
    state = F.when(kind == 0, "VERY_HIGH").when(kind == 1, "DEAD").when(kind == 2, "UNKNOWN").otherwise("NORMAL")
    df = ruled(spark, sf_dir).where("signal <> 'NO_TRADE' AND atr > 0").withColumns({"entry": F.col("close"), "vol_state": state})
    return signals.with_levels(df).select("symbol", at(), "signal", "vol_state", *[near(c).alias(c) for c in ("stop", "tp1", "tp2")])


@query(
    "prices_on_ticks",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, CASE l_partkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.05 WHEN 2 THEN 0.0 WHEN 3 THEN l_extendedprice / l_quantity * 0.6 END AS tick FROM lineitem),
u AS (SELECT *, CASE WHEN tick IS NULL OR tick <= 0 OR tick > price / 2 THEN 0.01 ELSE tick END AS use FROM p)
SELECT l_orderkey, l_linenumber, round(round_even(price / use, 0) * use, 6) + 0.0 AS price FROM u""",
)
def _(spark, sf_dir):
    price, kind = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_partkey") % 5
    tick = F.when(kind == 0, 0.5).when(kind == 1, 0.05).when(kind == 2, 0.0).when(kind == 3, price * 0.6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", near(signals.round_price(price, tick, F.lit(0.01)), 6).alias("price"))


@query(
    "effective_risks",
    """WITH e AS (SELECT (user_id % 5) / 4.0 AS m, CASE event_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1.0 END AS v, (event_id % 5 - 1) / 2.0 AS r FROM events)
SELECT m AS mode, v AS volatility, r AS ratchet, CASE WHEN r > 0 THEN greatest(m * v * r, 0.25) ELSE 0.0 END AS risk, count(*) AS n FROM e GROUP BY ALL""",
)
def _(spark, sf_dir):
    kind = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select(((F.col("user_id") % 5) / 4.0).alias("mode"), F.when(kind == 0, 0.25).when(kind == 1, 0.5).otherwise(1.0).alias("volatility"), ((F.col("event_id") % 5 - 1) / 2.0).alias("ratchet"))
    return rows.withColumn("risk", market.effective_risk(F.col("mode"), F.col("volatility"), F.col("ratchet"))).groupBy("mode", "volatility", "ratchet", "risk").agg(F.count("*").alias("n"))


@query("restored_volumes", f"SELECT symbol, {AT_SQL}, {near_sql('close')} AS close, {near_sql('CASE WHEN volume % 2 = 0 THEN volume END')} AS volume FROM ({bars_sql()})")
def _(spark, sf_dir):
    """Volumes put back from a table that lacks the odd ones."""
    b = bars(spark, sf_dir)
    return joins.restore_column(b.withColumn("volume", F.lit(-1.0)), b.where("volume % 2 = 0"), "volume").select("symbol", at(), near("close").alias("close"), near("volume").alias("volume"))


@query(
    "position_sizes",
    f"""{_ONE_SQL}, p AS (SELECT symbol, open_time, signal, confidence, close AS entry, atr, close - CASE WHEN signal = 'BUY' THEN 2.5 ELSE -2.5 END * atr AS stop FROM s WHERE signal <> 'NO_TRADE' AND atr > 0),
r AS (SELECT *, 10000 * 0.01 * CASE WHEN confidence >= 60 THEN 1.5 ELSE 1.0 END * least(greatest(0.003 / (atr / entry), 0.4), 2.0) AS risk FROM p),
q AS (SELECT *, least(risk / abs(entry - stop), 10000 * 0.05 / entry, 10 * risk / entry, 1000) AS raw FROM r)
SELECT symbol, {AT_SQL}, signal, {near_sql("risk", 3)} AS risk, {near_sql("greatest(0.01, floor(raw / 0.01) * 0.01)", 2)} AS qty FROM q""",
)
def _(spark, sf_dir):
    df = ruled(spark, sf_dir).where("signal <> 'NO_TRADE' AND atr > 0").withColumn("entry", F.col("close"))
    df = df.withColumn("stop", F.col("close") - F.when(F.col("signal") == "BUY", 2.5).otherwise(-2.5) * F.col("atr"))
    names = df.select("symbol").distinct().select("symbol", F.lit(0.01).alias("min_amount"), F.lit(1000.0).alias("max_amount"))
    sized = signals.position_size(df, names, F.lit(10_000.0), F.lit(1.0))
    return sized.select("symbol", at(), "signal", near(F.col("final_risk_mult") * 100, 3).alias("risk"), near("qty", 2).alias("qty"))


@query(
    "changed_signals",
    f"""{_ONE_SQL}, p AS (SELECT symbol, open_time, signal, lag(signal) OVER (PARTITION BY symbol ORDER BY open_time) AS b FROM s WHERE signal <> 'NO_TRADE')
SELECT symbol, {AT_SQL}, signal FROM p WHERE signal IS DISTINCT FROM b""",
)
def _(spark, sf_dir):
    return signals.dedupe_signals(ruled(spark, sf_dir).where("signal <> 'NO_TRADE'")).select("symbol", at(), "signal")


@query(
    "trend_run_lengths",
    f"""{timeframe_sql("4h")}, s AS (SELECT symbol, open_time, {", ".join(f"coalesce(lag(ema20 > ema50, {k}) OVER w, false) AS u{k}, coalesce(lag(ema20 < ema50, {k}) OVER w, false) AS d{k}" for k in range(1, 6))} FROM f WINDOW w AS (PARTITION BY symbol ORDER BY open_time))
SELECT symbol, {AT_SQL}, {", ".join("CASE " + " ".join(f"WHEN NOT {x}{k} THEN {k - 1}" for k in range(1, 6)) + f" ELSE 5 END AS {n}" for x, n in (("u", "up_bars"), ("d", "down_bars")))} FROM s""",
)
def _(spark, sf_dir):
    return signals.trend_bars(features.add_features(bars(spark, sf_dir, "4h"))).select("symbol", at(), "up_bars", "down_bars")


@query(
    "quality_scores",
    f"""{_ONE_SQL} SELECT symbol, {AT_SQL}, CASE WHEN confidence >= 75 THEN 1 ELSE 0 END + CASE WHEN coalesce(adx, 0) > 20 THEN 1 ELSE 0 END
  + CASE WHEN signal = 'BUY' AND rsi < 40 OR signal = 'SELL' AND rsi > 60 THEN 1 ELSE 0 END
  + 3 * CASE WHEN signal = 'BUY' AND ema20 > ema50 AND ema50 > ema200 OR signal = 'SELL' AND ema20 < ema50 AND ema50 < ema200 THEN 1 ELSE 0 END
  + 2 * CASE WHEN (signal = 'BUY' AND ema20 > ema50 OR signal = 'SELL' AND ema20 < ema50) AND NOT (signal = 'BUY' AND ema20 > ema50 AND ema50 > ema200 OR signal = 'SELL' AND ema20 < ema50 AND ema50 < ema200) THEN 1 ELSE 0 END AS quality
FROM s""",
)
def _(spark, sf_dir):
    """With the entry bar's own averages standing for the slower timeframes."""
    df = ruled(spark, sf_dir).withColumns({f"ema{n}_{t}": F.col(f"ema{n}") for n in (20, 50) for t in ("1h", "4h")})
    return signals.quality_score(df).select("symbol", at(), "quality")


_LATEST = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS newest FROM {0})"
_OWN, _HOUR, _SLOW = (f"({timeframe_sql(i)} SELECT * FROM f)" for i in ("15m", "1h", "4h"))
_RUNS = ", ".join(f"coalesce(lag(ema20 > ema50, {k}) OVER w, false) AS u{k}, coalesce(lag(ema20 < ema50, {k}) OVER w, false) AS d{k}" for k in range(1, 6))
_RUN = lambda x: "CASE " + " ".join(f"WHEN NOT {x}{k} THEN {k - 1}" for k in range(1, 6)) + " ELSE 5 END"
_TESTS = {
    "counter": "signal = 'SELL' AND ema20_4h > ema50_4h", "confident": "confidence >= 60", "trending": "adx > 18", "on_rsi": "signal = 'BUY' AND rsi < 65 OR signal = 'SELL' AND rsi > 35",
    "on_ema": "signal = 'BUY' AND ema20 > ema50 OR signal = 'SELL' AND ema20 < ema50", "hour": "signal = 'BUY' AND ema20_1h > ema50_1h OR signal = 'SELL' AND ema20_1h < ema50_1h",
    "slow": "signal = 'BUY' AND ema20_4h > ema50_4h AND rsi_4h > 45 OR signal = 'SELL' AND ema20_4h < ema50_4h AND rsi_4h < 55", "settled": "trend_bars >= 4",
    "surge": "vol_prev > 0 AND vol_mean_prev > 0 AND vol_prev > 1.5 * vol_mean_prev", "thin": "vol_prev > 0 AND vol_mean_prev > 0 AND vol_prev < 0.5 * vol_mean_prev",
}
_BIASES = (("btc", "benchmark"), ("flow", "netflow"), ("fg", "sentiment"))
_TEXTS = [("counter", "'4h counter-trend (-1)'"), ("confident", "printf('confidence %.0f', confidence)"), ("trending", "printf('ADX %.0f', adx)"), ("on_rsi", "'RSI on side'"), ("on_ema", "'EMA on side'"), ("hour", "'1h confirms'"), ("slow", "'4h trend aligns'"), ("settled", "'4h trend established'")]
_TEXTS += [x for k, n in _BIASES for x in ((f"{k}_bias = signal", f"'{n} aligned'"), (f"{k}_bias <> signal AND {k}_mod > 0", f"'{n} opposed'"))] + [("surge", "'volume surge'")]
_DECIDED_SQL = f"""WITH span AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS plain FROM {_OWN} WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
own AS (SELECT *, lag(volume) OVER w AS vol_prev, CASE WHEN count(volume) OVER v = 20 THEN avg(volume) OVER v END AS vol_mean_prev, CASE WHEN count(plain) OVER y = 14 THEN 100 * avg(plain) OVER y / close END AS range_pct FROM span
  WINDOW w AS (PARTITION BY symbol ORDER BY open_time), v AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING)),
late AS (SELECT symbol, open_time, rsi, ema20, ema50, {_RUN("u")} AS up, {_RUN("d")} AS down FROM (SELECT symbol, open_time, rsi, ema20, ema50, {_RUNS} FROM {_SLOW} WINDOW w AS (PARTITION BY symbol ORDER BY open_time))),
bench AS (SELECT 100 * (close / lag(close) OVER (ORDER BY open_time) - 1) AS p, open_time FROM ({bars_sql()}) WHERE symbol = '{BENCHMARK}'),
flow AS (SELECT event_type AS symbol, round((arg_max(value, ts) - 50) * 2000000, 2) AS x FROM events GROUP BY 1),
mood AS (SELECT CAST(floor(sum(value)) AS BIGINT) % 101 AS v FROM events),
j AS (SELECT o.symbol, o.open_time, o.open_time AS ts, o.close, o.atr, o.rsi, coalesce(o.adx, 0) AS adx, o.ema20, o.ema50, o.ema200, o.range_pct, o.vol_prev, o.vol_mean_prev, h.ema20 AS ema20_1h, h.ema50 AS ema50_1h, l.rsi AS rsi_4h, l.ema20 AS ema20_4h, l.ema50 AS ema50_4h, l.up, l.down,
  CASE WHEN o.trend = 1 AND o.rsi < 65 THEN 'BUY' WHEN o.trend = -1 AND o.rsi > 35 THEN 'SELL' ELSE 'NO_TRADE' END AS signal, 50 + abs(o.rsi - 50) AS confidence,
  CASE WHEN p >= 1.5 THEN 'BUY' WHEN p <= -1.5 THEN 'SELL' END AS btc_bias, CASE WHEN abs(p) >= 1.5 THEN 1 ELSE 0 END AS btc_mod,
  CASE WHEN x > 50000000 THEN 'SELL' WHEN x < -50000000 THEN 'BUY' END AS flow_bias, CASE WHEN abs(x) > 50000000 THEN 1 ELSE 0 END AS flow_mod,
  CASE WHEN v >= 75 THEN 'SELL' WHEN v <= 25 THEN 'BUY' END AS fg_bias, CASE WHEN v >= 75 OR v <= 25 THEN 1 ELSE 0 END AS fg_mod, v <= 20 AS blocks_sell, v >= 70 AS blocks_buy
  FROM {_LATEST.format("own")} o LEFT JOIN {_LATEST.format(_HOUR)} h ON o.symbol = h.symbol AND h.newest = 1 LEFT JOIN {_LATEST.format("late")} l ON o.symbol = l.symbol AND l.newest = 1
  LEFT JOIN flow ON o.symbol = flow.symbol, (SELECT p FROM bench ORDER BY open_time DESC LIMIT 1), mood WHERE o.newest = 1),
m AS (SELECT *, CASE WHEN signal = 'BUY' THEN up ELSE down END AS trend_bars, {_pick(50, 50, 45, 50)} AS min_confidence, {_pick(3, 4, 3, 3)} AS min_score, {_pick(18, 22, 15, 18)} AS min_adx, {_MULT_SQL} AS risk_mult FROM j),
t AS (SELECT *, {", ".join(f"coalesce({test}, false) AS {n}" for n, test in _TESTS.items())} FROM m),
r AS (SELECT *, {" + ".join(f"CAST({n} AS INTEGER)" for n in ("confident", "trending", "on_rsi", "on_ema", "hour", "slow", "settled", "surge"))} - CAST(counter AS INTEGER)
  + {" + ".join(f"coalesce(CASE WHEN {k}_bias = signal THEN {k}_mod WHEN {k}_bias <> signal THEN -{k}_mod END, 0)" for k, _ in _BIASES)} AS score,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in _TEXTS)}], lambda x: x IS NOT NULL), '; ') AS reasons FROM t),
z AS (SELECT *, CASE WHEN signal = 'NO_TRADE' THEN 'no trade' WHEN confidence < min_confidence THEN 'confidence'
  WHEN signal = 'BUY' AND blocks_buy OR signal = 'SELL' AND blocks_sell THEN 'sentiment' WHEN adx < min_adx THEN 'adx'
  WHEN CASE WHEN signal = 'BUY' THEN ema20_4h < ema50_4h WHEN counter THEN symbol IN ({", ".join(f"'{x}'" for x in MAJORS)}) OR rsi_4h > 65 END THEN '4h bias' WHEN trend_bars < 1 THEN '4h fresh' WHEN thin THEN 'volume'
  WHEN score < min_score THEN 'score' WHEN coalesce(NOT (close > 0) OR NOT (atr > 0), true) THEN 'price' END AS reject_reason FROM r)"""
_SCAN_SQL = f"SELECT symbol, {AT_SQL}, signal, {near_sql('confidence', 2)} AS confidence, score, reject_reason, reasons FROM z"


@query("live_scan", f"{_DECIDED_SQL} {_SCAN_SQL}")
def _(spark, sf_dir):
    """Every symbol's newest bar, scored and filtered, with reasons."""
    events = table(spark, sf_dir, "events")
    flows = events.select(F.col("event_type").alias("symbol"), "ts", F.round((F.col("value") - 50) * 2e6, 2).alias("net_inflow"))
    mood = events.agg((F.floor(F.sum("value")) % 101).alias("value"))
    out = scored_signals(bars(spark, sf_dir), bars(spark, sf_dir, "1h"), bars(spark, sf_dir, "4h"), BENCHMARK, flows, mood)
    return out.select("symbol", at(), "signal", near("confidence", 2).alias("confidence"), "score", "reject_reason", F.array_join("reasons", "; ").alias("reasons"))


def _title_sql(t: str) -> str:
    return " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in BULLISH) + " - " + " - ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in BEARISH)


def _page_sql(t: str) -> str:
    count = lambda w: f"(length({t}) - length(replace({t}, '{w}', ''))) // {len(w)}"
    return " + ".join(map(count, BULLISH)) + " - " + " - ".join(map(count, BEARISH))


_NEWS_SQL = f"""WITH n AS (SELECT source AS coin, lower(coalesce(text, '')) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents),
s AS (SELECT coin, CAST(sum({_title_sql("t")}) AS BIGINT) AS score, count(*) AS articles FROM n WHERE k <= 10 GROUP BY coin)"""


def wide_sql(sql: str) -> str:
    """The same over forty symbols, an event type and an eighth of the users each, at prices from wild to still."""
    return sql.replace("100 + value AS price", "2000 * pow(2, user_id % 8) + value AS price").replace("event_type AS symbol", "event_type || '-' || (user_id % 8) AS symbol").replace(f"'{BENCHMARK}'", f"'{BENCHMARK}-0'")


ORDERS_SQL = f"""{wide_sql(_DECIDED_SQL)}, {_NEWS_SQL.removeprefix("WITH ").replace("s AS (", "news AS (")},
q AS (SELECT z.*, coalesce(news.score, 0) AS mood, CAST(coalesce(confidence >= 75, false) AS INTEGER) + CAST(coalesce(adx > 20, false) AS INTEGER) + CAST(coalesce(signal = 'BUY' AND rsi < 40 OR signal = 'SELL' AND rsi > 60, false) AS INTEGER)
  + CAST(coalesce(signal = 'BUY' AND ema20 > ema50 AND ema50 > ema200 OR signal = 'SELL' AND ema20 < ema50 AND ema50 < ema200, false) AS INTEGER) + CAST(hour AS INTEGER)
  + CAST(coalesce(signal = 'BUY' AND ema20_4h > ema50_4h OR signal = 'SELL' AND ema20_4h < ema50_4h, false) AS INTEGER) AS quality
  FROM (SELECT * RENAME (score AS points) FROM z) z LEFT JOIN news ON news.coin = 'src' || split_part(symbol, '-', 2)),
v AS (SELECT *, signal = 'BUY' AND mood > 0 OR signal = 'SELL' AND mood < 0 AS agrees, signal = 'BUY' AND mood < 0 OR signal = 'SELL' AND mood > 0 AS opposes, close AS entry, CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END AS side,
  CASE WHEN range_pct > 4 THEN 'VERY_HIGH' WHEN range_pct > 2 THEN 'HIGH' WHEN range_pct < 0.05 THEN 'DEAD' WHEN range_pct IS NULL THEN 'UNKNOWN' ELSE 'NORMAL' END AS vol_state,
  CASE WHEN range_pct > 4 THEN 0.25 WHEN range_pct > 2 THEN 0.5 WHEN range_pct < 0.05 THEN 0.0 ELSE 1.0 END AS vol_mult FROM q),
x AS (SELECT *, CASE vol_state WHEN 'VERY_HIGH' THEN 1.5 WHEN 'DEAD' THEN 0.8 WHEN 'UNKNOWN' THEN 0.8 ELSE 1.0 END AS stretch FROM v),
y AS (SELECT *, {_LEVEL_SQL.format("entry - side * atr * 2.5")} AS stop, {_LEVEL_SQL.format("entry + side * atr * 3.5 * stretch")} AS tp1, {_LEVEL_SQL.format("entry + side * atr * 7.5 * stretch")} AS tp2,
  10000 * 0.01 * risk_mult * vol_mult * CASE WHEN confidence >= 60 THEN 1.5 ELSE 1.0 END * coalesce(least(greatest(0.003 / nullif(atr / entry, 0), 0.4), 2.0), 1.0) AS risk FROM x),
k AS (SELECT *, least(risk / nullif(abs(entry - stop), 0), 10000 * 0.05 / entry, 10 * risk / entry, 1000) AS raw FROM y WHERE stop > 0 AND tp1 > 0 AND tp2 > 0)
SELECT symbol, {AT_SQL}, signal, {near_sql("confidence", 2)} AS confidence, points + CAST(agrees AS INTEGER) AS score, reject_reason, quality, vol_state,
  CASE WHEN agrees OR opposes THEN CASE WHEN reasons = '' THEN '' ELSE reasons || '; ' END || CASE WHEN agrees THEN 'news agrees' ELSE 'news opposes: caution' END ELSE reasons END AS reasons,
  {near_sql("stop")} AS stop, {near_sql("tp1")} AS tp1, {near_sql("tp2")} AS tp2, {near_sql("CASE WHEN raw > 0 THEN greatest(0.01, floor(raw / 0.01) * 0.01) ELSE 0 END", 2)} AS qty FROM k"""


ORACLES["volatility_states_all"] = wide_sql(ORACLES["volatility_state"])

# Inputs of scoring and filtering made of order lines: every reason of rejection, every point and acceptance occur.
_MADE = {
    "id": "l_orderkey || '-' || l_linenumber", "symbol": f"CASE l_suppkey % 4 WHEN 0 THEN '{MAJORS[0]}' ELSE 'S' || l_suppkey % 4 END",
    "signal": "CASE l_partkey % 10 WHEN 0 THEN 'NO_TRADE' ELSE CASE l_partkey % 2 WHEN 0 THEN 'BUY' ELSE 'SELL' END END", "confidence": "CAST(42 + l_quantity AS DOUBLE)",
    "adx": "CAST(12 + l_suppkey % 23 AS DOUBLE)", "rsi": "CAST(20 + l_partkey % 61 AS DOUBLE)", "ema20": "CAST(100 + l_orderkey % 7 AS DOUBLE)", "ema50": "CAST(103 AS DOUBLE)",
    "ema20_1h": "CAST(100 + l_partkey % 7 AS DOUBLE)", "ema50_1h": "CAST(103 AS DOUBLE)", "ema20_4h": "CAST(100 + l_suppkey % 7 AS DOUBLE)", "ema50_4h": "CAST(103 AS DOUBLE)", "rsi_4h": "CAST(30 + l_orderkey % 41 AS DOUBLE)",
    "trend_bars": "CAST(l_orderkey % 6 AS INTEGER)", "btc_bias": "CASE l_partkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END", "btc_mod": "CASE WHEN l_partkey % 3 < 2 THEN 1 ELSE 0 END",
    "flow_bias": "CASE l_suppkey % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END", "flow_mod": "CASE WHEN l_suppkey % 5 < 2 THEN 1 ELSE 0 END",
    "fg_bias": "CASE l_orderkey % 9 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END", "fg_mod": "CASE WHEN l_orderkey % 9 < 2 THEN 1 ELSE 0 END", "blocks_buy": "l_orderkey % 9 = 1", "blocks_sell": "l_orderkey % 9 = 0",
    "vol_prev": "CAST(l_partkey % 13 AS DOUBLE)", "vol_mean_prev": "CAST(6 AS DOUBLE)", "min_confidence": "45", "min_adx": "15", "min_score": "3",
    "close": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END", "atr": "CASE WHEN l_linenumber = 6 THEN 0 ELSE l_extendedprice / 50 END",
}
_BRANCH_SQL = f"""WITH m AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _MADE.items())} FROM lineitem),
t AS {_DECIDED_SQL[_DECIDED_SQL.index("t AS (SELECT *, ") + 5 :]}
SELECT id, signal, score, reject_reason, reasons FROM z"""


@query("filter_branches", _BRANCH_SQL)
def _(spark, sf_dir):
    """Scores and filters over order lines, so that every branch of both occurs."""
    names = {"btc_mod": "btc_score_mod", "flow_mod": "flow_score_mod", "fg_mod": "fg_score_mod", "blocks_buy": "fg_blocks_buy", "blocks_sell": "fg_blocks_sell"}
    made = table(spark, sf_dir, "lineitem").select(*[F.expr(v).alias(names.get(k, k)) for k, v in _MADE.items()])
    out = signals.filter_signals(signals.score_signals(made))
    return out.select("id", "signal", "score", "reject_reason", F.array_join("reasons", "; ").alias("reasons"))


def news(spark, sf_dir) -> DataFrame:
    """Documents as titles, with their source as the coin."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("coin"), F.col("doc_id").alias("published_at"), F.coalesce("text", F.lit("")).alias("title"))
    return signals.news_sentiment(docs)


@query("news_sentiment_titles", f"{_NEWS_SQL} SELECT *, CASE WHEN score > 0 THEN 'BULLISH' WHEN score < 0 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM s")
def _(spark, sf_dir):
    return news(spark, sf_dir)


@query(
    "news_sentiment_pages",
    f"""WITH p AS (SELECT page_id, lower(coalesce(html, '')) AS t FROM pages), s AS (SELECT page_id, {_page_sql("t")} AS score FROM p)
SELECT page_id, score, CASE WHEN score > 2 THEN 'BULLISH' WHEN score < -2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM s""",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    return signals.page_sentiment(pages).select("page_id", F.col("score").cast("long").alias("score"), "sentiment")


@query(
    "news_applied",
    f"""{_NEWS_SQL}, e AS (SELECT event_id, 'src' || (user_id % 20) AS coin, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS signal FROM events)
SELECT event_id, CASE WHEN signal = 'BUY' AND score > 0 OR signal = 'SELL' AND score < 0 THEN 1 ELSE 0 END AS score,
  CASE WHEN signal = 'BUY' AND score > 0 OR signal = 'SELL' AND score < 0 THEN 'news agrees' WHEN signal = 'BUY' AND score < 0 OR signal = 'SELL' AND score > 0 THEN 'news opposes: caution' ELSE '' END AS note
FROM e LEFT JOIN s ON e.coin = s.coin""",
)
def _(spark, sf_dir):
    coin = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    asked = table(spark, sf_dir, "events").select("event_id", coin.alias("coin"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("signal"), F.lit(0).alias("score"), F.array().cast("array<string>").alias("reasons"))
    return signals.apply_news(asked, news(spark, sf_dir)).select("event_id", "score", F.array_join("reasons", ";").alias("note"))


@query(
    "tiers_and_tradeable",
    """SELECT l.symbol, coalesce(r.r_name, 'Unknown') AS tier, l.lines FROM (SELECT l_suppkey AS symbol, count(*) AS lines FROM lineitem GROUP BY 1) l
LEFT JOIN (SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0) r ON l.symbol = r.s_suppkey
WHERE l.symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count("*").alias("lines"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    active = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    tiers = s.where("s_suppkey % 3 <> 0").join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("tier"))
    return signals.with_tier(signals.tradeable(lines, active), tiers).select("symbol", "tier", "lines")


@query(
    "price_drift",
    f"""WITH b AS ({bars_sql()}), s AS (SELECT symbol, open_time, close AS entry, lead(open) OVER (PARTITION BY symbol ORDER BY open_time) AS live FROM b)
SELECT symbol, {AT_SQL}, {near_sql("coalesce(live, entry)")} AS entry FROM s WHERE live IS NULL OR 100 * abs(live - entry) / entry <= 0.5""",
)
def _(spark, sf_dir):
    """Each bar's close against the next bar's open; bars stand for symbols."""
    w = series.by_time()
    b = bars(spark, sf_dir).withColumns({"live": F.lead("open").over(w), "name": F.col("symbol"), "symbol": F.concat_ws("|", "symbol", stamp("open_time"))})
    asked = b.select("symbol", "name", "open_time", F.col("close").alias("entry"))
    kept = signals.expire_drifted(asked, b.where("live IS NOT NULL").select("symbol", F.col("live").alias("price")))
    return kept.select(F.col("name").alias("symbol"), at(), near("entry").alias("entry"))


@query(
    "book_spreads",
    """SELECT event_id, CASE WHEN e THEN 0.0 ELSE bid END AS best_bid, CASE WHEN e THEN 0.0 ELSE ask END AS best_ask, round(CASE WHEN e THEN 999 ELSE (ask - bid) / ((ask + bid) / 2) END, 6) + 0.0 AS spread_pct,
  e OR (ask - bid) / ((ask + bid) / 2) > 0.003 AS is_wide, NOT e AND (ask - bid) / ((ask + bid) / 2) <= 0.05 AS tradeable
FROM (SELECT event_id, event_id % 10 = 0 AS e, round(100 + value, 2) AS bid, round(100 + value, 2) + (user_id % 100) / 10.0 AS ask FROM events)""",
)
def _(spark, sf_dir):
    bid = F.round(100 + F.col("value"), 2)
    ask = bid + (F.col("user_id") % 100) / 10.0
    level = lambda p: F.array(F.array(p, F.lit(1.0)))
    books = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, level(bid)).otherwise(F.array().cast("array<array<double>>")).alias("bids"), level(ask).alias("asks"))
    return market.book_spread(books).select("event_id", "best_bid", "best_ask", (F.round("spread_pct", 6) + 0.0).alias("spread_pct"), "is_wide", "tradeable")


@query(
    "lots_and_ticks",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 3.0 > 0 THEN greatest(s, floor(l_quantity / 3.0 / s) * s) ELSE 0.0 END AS amount,
  CASE WHEN q - h < s THEN q ELSE h END AS first, CASE WHEN q - h < s THEN 0.0 ELSE q - h END AS second
FROM (SELECT *, l_quantity AS q, greatest(s, floor(l_quantity / 2 / s) * s) AS h FROM (SELECT *, CAST(1 + l_partkey % 4 AS DOUBLE) AS s FROM lineitem))""",
)
def _(spark, sf_dir):
    step = (1 + F.col("l_partkey") % 4).cast("double")
    first, second = signals.split_amount(F.col("l_quantity"), step)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", signals.round_amount(F.col("l_quantity") / 3.0, step).alias("amount"), first.alias("first"), second.alias("second"))


# Backtest.
_EXITS_SQL = f"""{_ONE_SQL}, x AS (SELECT *, close - CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END * 2.5 * atr AS stop, close + CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END * 3.5 * atr AS tp1,
  count(*) OVER v AS ahead, last_value(close) OVER v AS end_close, last_value(open_time) OVER v AS end_time FROM s WINDOW v AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)),
t AS (SELECT * FROM x WHERE signal <> 'NO_TRADE' AND confidence >= 52 AND ahead = 24 AND atr > 0 AND stop > 0 AND tp1 > 0),
j AS (SELECT t.symbol, t.open_time, t.rn, min(CASE WHEN CASE WHEN t.signal = 'BUY' THEN z.low <= t.stop ELSE z.high >= t.stop END THEN z.rn END) AS sl, min(CASE WHEN CASE WHEN t.signal = 'BUY' THEN z.high >= t.tp1 ELSE z.low <= t.tp1 END THEN z.rn END) AS tp
  FROM t JOIN f z ON t.symbol = z.symbol AND z.rn BETWEEN t.rn + 1 AND t.rn + 24 GROUP BY ALL),
o AS (SELECT t.symbol, t.open_time AS entry_time, t.signal, t.close AS entry, t.stop, t.tp1, CASE WHEN sl IS NOT NULL AND sl <= coalesce(tp, sl) THEN 'SL' WHEN tp IS NOT NULL THEN 'TP1' ELSE 'TIME_EXIT' END AS outcome,
  coalesce(z.open_time, t.end_time) AS exit_time, CASE WHEN sl IS NOT NULL AND sl <= coalesce(tp, sl) THEN t.stop WHEN tp IS NOT NULL THEN t.tp1 ELSE t.end_close END AS exit_price
  FROM t JOIN j ON t.symbol = j.symbol AND t.rn = j.rn LEFT JOIN f z ON z.symbol = t.symbol AND z.rn = least(coalesce(sl, tp), coalesce(tp, sl)))"""


def exits(spark, sf_dir) -> DataFrame:
    df = ruled(spark, sf_dir)
    return backtest.simulate_exits(df.withColumn("signal", F.when(F.col("confidence") >= 52, F.col("signal")).otherwise("NO_TRADE")))


@query("simulated_exits", f"{_EXITS_SQL} SELECT symbol, {stamp_sql('entry_time')} AS entry_time, {stamp_sql('exit_time')} AS exit_time, signal, outcome, {near_sql('exit_price')} AS exit_price FROM o")
def _(spark, sf_dir):
    return exits(spark, sf_dir).select("symbol", stamp("entry_time").alias("entry_time"), stamp("exit_time").alias("exit_time"), "signal", "outcome", near("exit_price").alias("exit_price"))


@query(
    "trade_returns",
    f"""{_EXITS_SQL}, r AS (SELECT *, CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END AS side, abs(entry - stop) / entry AS d FROM o),
n AS (SELECT *, least(0.01 / nullif(d, 0), 10) AS notional, entry * (1 + side * 0.0005) AS i, exit_price * (1 - side * 0.0005) AS u FROM r)
SELECT symbol, {stamp_sql("entry_time")} AS entry_time, {near_sql("notional")} AS notional, {near_sql("notional * (side * (u - i) / i - 0.001)", 6)} AS ret, {near_sql("(side * (u - i) / i - 0.001) / d")} AS r_multiple FROM n""",
)
def _(spark, sf_dir):
    df = backtest.trade_returns(exits(spark, sf_dir))
    return df.select("symbol", stamp("entry_time").alias("entry_time"), near("notional").alias("notional"), near("ret", 6).alias("ret"), near("r_multiple").alias("r_multiple"))


@query("forward_bars", f"""{_ONE_SQL} SELECT a.symbol, {stamp_sql("a.open_time")} AS open_time, CAST(z.rn - a.rn AS INTEGER) AS step, {near_sql("z.close")} AS bar_close
FROM s a JOIN f z ON a.symbol = z.symbol AND z.rn BETWEEN a.rn + 1 AND a.rn + 24 WHERE a.signal <> 'NO_TRADE' AND a.confidence >= 60""")
def _(spark, sf_dir):
    df = ruled(spark, sf_dir)
    asked = df.where("signal <> 'NO_TRADE' AND confidence >= 60").select("symbol", "interval", "segment", "open_time", "signal")
    return backtest.forward_bars(asked, bars(spark, sf_dir)).select("symbol", at(), "step", near("bar_close").alias("bar_close"))


def _curve_sql(runs: str) -> str:
    """CTEs ending in ``q``: the trades of all runs (run_id and the columns of ``o``) that the cap admits, with equity and drawdown."""
    return f"""u AS ({runs}),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY entry_time, symbol) AS turn FROM u),
g AS (SELECT run_id, turn, true AS taken, [exit_time] AS held FROM n WHERE turn = 1
  UNION ALL SELECT run_id, turn, len(open) < 10, CASE WHEN len(open) < 10 THEN list_append(open, exit_time) ELSE open END
  FROM (SELECT n.run_id, n.turn, n.exit_time, list_filter(g.held, lambda x: x > n.entry_time) AS open FROM g JOIN n ON n.run_id = g.run_id AND n.turn = g.turn + 1)),
a AS (SELECT n.*, CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END AS side, abs(entry - stop) / entry AS d FROM n JOIN g ON n.run_id = g.run_id AND n.turn = g.turn WHERE g.taken),
y AS (SELECT *, least(0.01 / nullif(d, 0), 10) AS notional, entry * (1 + side * 0.0005) AS i, exit_price * (1 - side * 0.0005) AS z FROM a),
e2 AS (SELECT *, notional * (side * (z - i) / i - 0.001) AS ret FROM y),
c AS (SELECT *, ret / (notional * d) AS r, 100000 * exp(sum(ln(1 + ret)) OVER w) AS equity FROM e2 WINDOW w AS (PARTITION BY run_id ORDER BY exit_time, entry_time, symbol ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, greatest(max(equity) OVER w, 100000) AS peak FROM c WINDOW w AS (PARTITION BY run_id ORDER BY exit_time, entry_time, symbol ROWS UNBOUNDED PRECEDING))"""


@query(
    "backtest_curve",
    f"""{_EXITS_SQL}, {_curve_sql("SELECT 'rule' AS run_id, * FROM o")}
SELECT symbol, {stamp_sql("entry_time")} AS entry_time, {stamp_sql("exit_time")} AS exit_time, outcome, {near_sql("equity", 2)} AS equity, {near_sql("(peak - equity) / peak")} AS drawdown FROM q""",
)
def _(spark, sf_dir):
    """Admitted trades with equity, peak and drawdown."""
    return _curve(run_backtest(ruled(spark, sf_dir), "rule"))


def _curve(curve: DataFrame) -> DataFrame:
    return curve.select("symbol", stamp("entry_time").alias("entry_time"), stamp("exit_time").alias("exit_time"), "outcome", near("equity", 2).alias("equity"), near("drawdown").alias("drawdown"))


@query("backtest_curve_in_slices", ORACLES["backtest_curve"])
def _(spark, sf_dir):
    """The same with a run in slices of 1,000 trades."""
    return _curve(run_backtest(ruled(spark, sf_dir), "rule", slice_rows=1000))


_FAR = 1000
_FAR_SQL = _EXITS_SQL.replace("2.5 * atr AS stop", "1.2 * atr AS stop").replace("3.5 * atr AS tp1", "3.0 * atr AS tp1").replace("24 FOLLOWING", f"{_FAR} FOLLOWING").replace("ahead = 24", f"ahead = {_FAR}").replace("t.rn + 24", f"t.rn + {_FAR}")


@query("simulated_exits_far", f"{_FAR_SQL} SELECT symbol, {stamp_sql('entry_time')} AS entry_time, {stamp_sql('exit_time')} AS exit_time, signal, outcome, {near_sql('exit_price')} AS exit_price FROM o")
def _(spark, sf_dir):
    """Exits within a thousand bars, by skipping blocks that touch nothing."""
    df = ruled(spark, sf_dir).withColumn("signal", F.when(F.col("confidence") >= 52, F.col("signal")).otherwise("NO_TRADE"))
    out = backtest.simulate_exits(df, _FAR, 1.2, 3.0)
    return out.select("symbol", stamp("entry_time").alias("entry_time"), stamp("exit_time").alias("exit_time"), "signal", "outcome", near("exit_price").alias("exit_price"))


_METRICS_SQL = f"""{_EXITS_SQL.replace("confidence >= 52", "confidence >= 50").replace("SELECT t.symbol, t.open_time AS entry_time,", "SELECT t.symbol, t.confidence, t.open_time AS entry_time,")},
{_curve_sql("SELECT 'conf-' || least AS run_id, o.* FROM o, (SELECT unnest([50, 55, 60, 65]) AS least) WHERE confidence >= least")},
s1 AS (SELECT run_id, count(*) AS trades, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret <= 0) AS losses, avg(r) AS mr, stddev_pop(r) AS sr, max((peak - equity) / peak) AS max_drawdown,
  coalesce(sum(equity * ret / (1 + ret)) FILTER (ret > 0), 0) AS won, coalesce(-sum(equity * ret / (1 + ret)) FILTER (ret <= 0), 0) AS lost,
  date_diff('second', arg_min(entry_time, (exit_time, entry_time, symbol)), max(exit_time)) / 86400.0 AS days, arg_max(equity, (exit_time, entry_time, symbol)) AS ending FROM q GROUP BY run_id),
s2 AS (SELECT *, CASE WHEN sr > 0 THEN mr / sr ELSE 0 END * sqrt(CASE WHEN days > 0 THEN trades / days * 365 ELSE 0 END) AS sharpe FROM s1)"""


@query(
    "backtest_leaderboard",
    f"""{_METRICS_SQL} SELECT run_id, CAST(row_number() OVER (ORDER BY sharpe DESC, run_id) AS INTEGER) AS place, trades, wins, losses, {near_sql("wins / trades")} AS win_rate, {near_sql("sharpe")} AS sharpe, {near_sql("max_drawdown")} AS max_drawdown,
  {near_sql("won / nullif(lost, 0)")} AS profit_factor, {near_sql("ending / 100000 - 1")} AS total_return, {near_sql("mr")} AS avg_r FROM s2""",
)
def _(spark, sf_dir):
    """Metrics of one run per threshold, best first."""
    df = ruled(spark, sf_dir)
    fired = df.withColumn("run_id", F.explode(F.array(*[F.lit(f"conf-{t}") for t in (50, 55, 60, 65)])))
    least = F.substring("run_id", 6, 2).cast("double")
    fired = fired.withColumn("signal", F.when(F.col("confidence") >= least, F.col("signal")).otherwise("NO_TRADE"))
    trades = backtest.simulate_exits(fired, by=("run_id", *series.SERIES))
    curve = backtest.equity_curve(backtest.trade_returns(backtest.admit(trades)))
    out = backtest.leaderboard(backtest.backtest_metrics(curve))
    return out.select("run_id", "place", "trades", "wins", "losses", *[near(c).alias(n) for c, n in (("win_rate", "win_rate"), ("sharpe_annualized", "sharpe"), ("max_drawdown", "max_drawdown"), ("profit_factor", "profit_factor"), ("total_return", "total_return"), ("avg_r", "avg_r"))])


# Predictions and models.
_PRED_SQL = f"""SELECT symbol, open_time, [(1 + volume % 7) / d, (1 + volume % 5) / d, (1 + volume % 3) / d] AS p, CASE CAST(taker_buy_base_vol AS BIGINT) % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'NO_TRADE' ELSE 'SELL' END AS target
  FROM (SELECT *, 3 + volume % 7 + volume % 5 + volume % 3 AS d FROM ({bars_sql()}))"""


def predictions(spark, sf_dir) -> DataFrame:
    v = F.col("volume")
    d = 3 + v % 7 + v % 5 + v % 3
    kind = F.col("taker_buy_base_vol").cast("long") % 3
    target = F.when(kind == 0, "BUY").when(kind == 1, "NO_TRADE").otherwise("SELL")
    return bars(spark, sf_dir).select("symbol", "open_time", F.array((1 + v % 7) / d, (1 + v % 5) / d, (1 + v % 3) / d).alias("probs"), target.alias("target"))


def called(pred: DataFrame) -> DataFrame:
    from tidemark.functions.scalars import best_class

    return pred.withColumn("call", F.get(F.array(*[F.lit(c) for c in summaries.CLASSES]), best_class("probs")))


_CALL_SQL = f"""WITH p AS ({_PRED_SQL}), c AS (SELECT *, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 'BUY' WHEN p[2] >= p[3] THEN 'NO_TRADE' ELSE 'SELL' END AS call, greatest(p[1], p[2], p[3]) AS best FROM p)"""


@query(
    "classification_report",
    f"""{_CALL_SQL}, k AS (SELECT unnest(['BUY', 'NO_TRADE', 'SELL']) AS class),
s AS (SELECT k.class, count(*) FILTER (target = k.class) AS support, count(*) FILTER (call = k.class) AS called, count(*) FILTER (target = k.class AND call = k.class) AS hits FROM c, k GROUP BY k.class),
r AS (SELECT *, coalesce(hits / nullif(called, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM s)
SELECT class, support, called, {near_sql("pr")} AS precision, {near_sql("re")} AS recall, {near_sql("coalesce(2 * pr * re / nullif(pr + re, 0), 0)")} AS f1, {near_sql("sum(hits) OVER () / sum(support) OVER ()")} AS accuracy FROM r""",
)
def _(spark, sf_dir):
    out = summaries.classification_report(called(predictions(spark, sf_dir)))
    return out.select("class", "support", "called", *[near(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "threshold_sweep",
    f"""{_CALL_SQL}, g AS (SELECT CAST(unnest([0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]) AS DOUBLE) AS threshold),
a AS (SELECT threshold, target, CASE WHEN call <> 'NO_TRADE' AND best < threshold THEN 'NO_TRADE' ELSE call END AS call FROM c, g),
s AS (SELECT threshold, count(*) FILTER (call = 'BUY') AS cb, count(*) FILTER (call = 'SELL') AS cs, count(*) FILTER (target = 'BUY') AS tb, count(*) FILTER (target = 'SELL') AS ts,
  count(*) FILTER (call = 'BUY' AND target = 'BUY') AS hb, count(*) FILTER (call = 'SELL' AND target = 'SELL') AS hs FROM a GROUP BY threshold),
r AS (SELECT threshold, cb + cs AS signals, coalesce(hb / nullif(cb, 0), 0) AS pb, coalesce(hs / nullif(cs, 0), 0) AS ps, (coalesce(hb / nullif(tb, 0), 0) + coalesce(hs / nullif(ts, 0), 0)) / 2 AS rec FROM s),
v AS (SELECT *, CASE WHEN pb * 3.5 - (1 - pb) * 2.5 <= 0 OR ps * 3.5 - (1 - ps) * 2.5 <= 0 THEN 0 ELSE (pb * 3.5 - (1 - pb) * 2.5 + ps * 3.5 - (1 - ps) * 2.5) * rec * sqrt(greatest(signals, 1)) END AS score FROM r)
SELECT threshold, signals, {near_sql("pb")} AS precision_buy, {near_sql("ps")} AS precision_sell, {near_sql("rec")} AS avg_recall, {near_sql("signals * (pb + ps) / 2 * 200 - signals * (1 - (pb + ps) / 2) * 100", 2)} AS pnl, {near_sql("score")} AS score,
  coalesce(score > 0 AND signals > 20 AND row_number() OVER (ORDER BY CASE WHEN score > 0 AND signals > 20 THEN score END DESC NULLS LAST, threshold) = 1, false) AS best FROM v""",
)
def _(spark, sf_dir):
    out = summaries.threshold_sweep(predictions(spark, sf_dir))
    return out.select("threshold", "signals", *[near(c).alias(c) for c in ("precision_buy", "precision_sell", "avg_recall")], near("pnl", 2).alias("pnl"), near("score").alias("score"), "best")


@query(
    "meta_threshold_sweep",
    f"""{_CALL_SQL}, m AS (SELECT best AS p, CASE WHEN call = target THEN 1.0 ELSE 0.0 END AS y FROM c WHERE call <> 'NO_TRADE'), g AS (SELECT CAST(unnest([0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]) AS DOUBLE) AS threshold),
s AS (SELECT threshold, count(*) AS selected, avg(y) AS hit_rate FROM m, g WHERE p >= threshold GROUP BY threshold)
SELECT threshold, selected, {near_sql("hit_rate")} AS hit_rate, {near_sql("hit_rate * sqrt(selected)")} AS score,
  hit_rate > 0 AND row_number() OVER (ORDER BY hit_rate * sqrt(selected) DESC, threshold) = 1 AS best FROM s WHERE selected >= 20""",
)
def _(spark, sf_dir):
    meta = summaries.meta_labels(called(predictions(spark, sf_dir))).withColumn("p", F.array_max("probs"))
    return summaries.meta_threshold_sweep(meta).select("threshold", "selected", near("hit_rate").alias("hit_rate"), near("score").alias("score"), "best")


@query("base_rate", f"{_CALL_SQL} SELECT count(*) AS calls, CAST(count(*) FILTER (call = target) AS BIGINT) AS correct, {near_sql('avg(CASE WHEN call = target THEN 1.0 ELSE 0 END)')} AS base_rate FROM c WHERE call <> 'NO_TRADE'")
def _(spark, sf_dir):
    return summaries.base_rate(summaries.meta_labels(called(predictions(spark, sf_dir)))).withColumn("base_rate", near("base_rate"))


@query("walk_forward_accuracy")
def _(spark, sf_dir):
    """Accuracy of a forest trained on each fold's past, on all features."""
    ds, names = _dataset(spark, sf_dir)
    return ml.walk_forward(ds, names)


def _dataset(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The training set by week, written as the models read it again and again, and the names of all its features."""
    ds = weekly(build_dataset(*(bars(spark, sf_dir, i) for i in ("15m", "1h", "4h")), BENCHMARK))
    left_out = {*bars(spark, sf_dir).columns, "btc_close"}
    return written(ds, "dataset"), [c for c, kind in ds.dtypes if kind == "double" and c not in left_out]


@query("ensemble_predictions")
def _(spark, sf_dir):
    """Test rows of the split, scored by the calibrated ensemble."""
    ds, names = _dataset(spark, sf_dir)
    return ml.train_and_score(ds, names).select("symbol", at(), "target", "call", near("confidence").alias("confidence"))


@query("feature_importances")
def _(spark, sf_dir):
    """The most important features, with two forced ones first."""
    ds, names = _dataset(spark, sf_dir)
    return ml.importance_scan(ds, names, ("rsi", "adx"))


@query("sigmoid_calibrated_calls")
def _(spark, sf_dir):
    """Test rows by an ensemble with sigmoid calibration."""
    ds, names = _dataset(spark, sf_dir)
    parted = splits.embargo_split(ds)
    model = ml.calibrate(ml.train_ensemble(parted.where("part = 'train'"), names), parted.where("part = 'calib'"), "sigmoid")
    return ml.score(model, parted.where("part = 'test'")).select("symbol", at(), "target", "call", near("confidence").alias("confidence"))


@query("pipeline_scores")
def _(spark, sf_dir):
    """Test rows by a forest in a pipeline, as a saved model would score them."""
    ds, names = _dataset(spark, sf_dir)
    rows = splits.embargo_split(ml.prepared(ds, names).drop("features"))
    model = ml.forest_pipeline(names).fit(rows.where("part = 'train'"))
    return ml.score_pipeline(model, rows.where("part = 'test'")).select("symbol", at(), "target", F.transform("probs", lambda p: near(p)).alias("probs"))


@query("meta_filtered_calls")
def _(spark, sf_dir):
    """Calls that a model of the calls, trained on the calibration rows, believes in."""
    ds, names = _dataset(spark, sf_dir)
    parted = splits.embargo_split(ml.prepared(ds, names).drop("features", "label", "weight"))
    model = ml.train_ensemble(parted.where("part = 'train'"), names)
    meta = ml.train_meta(ml.score(model, parted.where("part = 'calib'")), [*names, "confidence"])
    kept = ml.meta_filter(ml.score(model, parted.where("part = 'test'")), meta, [*names, "confidence"], 0.35, 0.4)
    return kept.select("symbol", at(), "target", "call", near("confidence").alias("confidence"), near("meta_p").alias("meta_p"))


@query("bundle_scores")
def _(spark, sf_dir):
    """Bars after a bundle's training time, scored by the bundle as saved and loaded, and whether the model itself says the same."""
    ds, names = _dataset(spark, sf_dir)
    parted = splits.embargo_split(ds)
    cutoff = ds.agg(F.percentile_approx("open_time", 0.8).alias("t")).first()["t"]
    past = parted.where(F.col("open_time") <= F.lit(cutoff))
    model = ml.calibrate(ml.train_ensemble(past.where("part = 'train'"), names), past.where("part = 'calib'"))
    path = shared_path(spark, "bundle")
    ml.save_bundle(spark, ml.Bundle(model, 0.55, cutoff.isoformat()), path)
    loaded = ml.load_bundle(spark, path)
    unseen = series.after_cutoff(ds, F.lit(loaded.trained_at).cast(ds.schema["open_time"].dataType))
    keys = ["symbol", "open_time"]
    direct = ml.score(model, unseen).select(*keys, F.col("call").alias("_call"), F.col("probs").alias("_probs"))
    out = ml.score(loaded.model, unseen).join(direct, keys)
    apart = F.aggregate(F.zip_with("probs", "_probs", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return out.select("symbol", at(), "call", near("confidence").alias("confidence"), (F.col("confidence") >= loaded.threshold).alias("fires"), ((F.col("call") == F.col("_call")) & (apart < 1e-9)).alias("same"))


@query("external_scores")
def _(spark, sf_dir):
    """Test rows by a linear model from outside of Spark, and how far it is from the one it was taken from."""
    ds, names = _dataset(spark, sf_dir)
    parted = splits.embargo_split(ds)
    rows, test = ml.prepared(parted.where("part = 'train'"), names), parted.where("part = 'test'")
    linear = ml.LogisticRegression(weightCol="weight", family="multinomial", maxIter=20).fit(rows)
    inside = linear.transform(ml.prepared(test, names)).select("symbol", "open_time", ml.vector_to_array("probability").alias("_probs"))
    out = ml.score_external(test, names, ml.Softmax.of(linear)).join(inside, ["symbol", "open_time"])
    apart = F.aggregate(F.zip_with("probs", "_probs", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return out.select("symbol", at(), "target", "call", near("confidence").alias("confidence"), (apart < 1e-9).alias("same"))


@query(
    "latest_with_slower",
    f"""SELECT a.symbol, {stamp_sql("a.open_time")} AS open_time, {near_sql("a.close")} AS close, {near_sql("h.rsi")} AS rsi_1h, {near_sql("h.ema20")} AS ema20_1h
FROM {_LATEST.format(_OWN)} a LEFT JOIN {_LATEST.format(_HOUR)} h ON a.symbol = h.symbol AND h.newest = 1 WHERE a.newest = 1""",
)
def _(spark, sf_dir):
    out = joins.latest_htf(features.add_features(bars(spark, sf_dir)), features.add_features(bars(spark, sf_dir, "1h")), "1h")
    return out.select("symbol", at(), near("close").alias("close"), near("rsi_1h").alias("rsi_1h"), near("ema20_1h").alias("ema20_1h"))

"""The test tables in the shapes that the operators take, and the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import with_segment
from tidemark.sources.bars import to_bars

BENCHMARK = "click"
INTERVALS = {"15m": "15 minutes", "1h": "1 hour", "4h": "4 hours"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = (1 + F.col("user_id") % 10).cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", (100 + F.col("value")).alias("price"), qty.alias("qty"), (F.col("user_id") % 2 == 0).alias("is_taker_buy"))


def wide_ticks(spark, sf_dir) -> DataFrame:
    """Ticks of forty symbols, an event type and an eighth of the users each, at prices from wild to still."""
    group = F.concat_ws("-", "event_type", (F.col("user_id") % 8).cast("string"))
    rows = table(spark, sf_dir, "events").select(group.alias("symbol"), "ts", "value", "user_id")
    return rows.select("symbol", "ts", (2000 * F.pow(F.lit(2.0), F.col("user_id") % 8) + F.col("value")).alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("qty"), (F.col("user_id") % 2 == 0).alias("is_taker_buy"), "value")


def bars(spark: SparkSession, sf_dir: str, interval: str = "15m") -> DataFrame:
    return with_segment(to_bars(ticks(spark, sf_dir), INTERVALS[interval], interval))


def weekly(df: DataFrame) -> DataFrame:
    """Bars with the week of January as their regime."""
    return df.withColumn("regime", F.concat(F.lit("w"), F.floor((F.dayofmonth("open_time") - 1) / 7).cast("string")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of trades made of order lines."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    reason = F.when(F.col("l_returnflag") == "A", "TP2 hit").when(F.col("l_returnflag") == "N", "SL hit").otherwise("Ghost — PnL unrecoverable")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"), F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("signal"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"),
        F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("pnl"), F.col("o_orderdate").alias("opened_at"),
        F.greatest("l_shipdate", "o_orderdate").alias("closed_at"), reason.alias("close_reason"),
    )


def stamp(c: Column | str) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def near(c: Column | str, digits: int = 4) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# The same in SQL.
TICKS_SQL = "SELECT event_type AS symbol, ts, 100 + value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS qty, user_id % 2 = 0 AS is_taker_buy FROM events"


def bars_sql(interval: str = "15m") -> str:
    return f"""SELECT symbol, '{interval}' AS "interval", 'all' AS segment, time_bucket(INTERVAL '{INTERVALS[interval]}', ts) AS open_time,
  arg_min(price, (ts, price)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, price)) AS close, sum(qty) AS volume,
  sum(CASE WHEN is_taker_buy THEN qty ELSE 0 END) AS taker_buy_base_vol FROM ({TICKS_SQL}) GROUP BY 1, 2, 3, 4"""


LEDGER_SQL = """SELECT l_orderkey || '-' || l_linenumber AS trade_id, 'S' || (l_suppkey % 20) AS symbol,
  CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS signal, l_extendedprice / l_quantity AS entry, l_quantity AS qty,
  l_extendedprice * (0.05 - l_discount) AS pnl, o_orderdate AS opened_at, greatest(l_shipdate, o_orderdate) AS closed_at,
  CASE l_returnflag WHEN 'A' THEN 'TP2 hit' WHEN 'N' THEN 'SL hit' ELSE 'Ghost — PnL unrecoverable' END AS close_reason
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def near_sql(c: str, digits: int = 4) -> str:
    return f"round({c}, {digits}) + 0.0"


def averages_sql(source: str) -> str:
    """CTEs ending in ``e``: the bars of ``source`` with every exponential average, by recursion over their numbers."""
    step = lambda prev, x, a: f"coalesce(e.{prev} + {a} * ({x} - e.{prev}), {x}) AS {prev}"
    span = lambda n: f"CAST(2.0 AS DOUBLE) / {n + 1}"
    com = lambda n: f"CAST(1.0 AS DOUBLE) / {n + 1}"
    level = [("ema9", "close", span(9)), ("ema12", "close", span(12)), ("ema20", "close", span(20)), ("ema26", "close", span(26)), ("ema50", "close", span(50)), ("ema200", "close", span(200))]
    level += [("g14", "gain", com(13)), ("l14", "loss", com(13)), ("g7", "gain", com(6)), ("l7", "loss", com(6)), ("atr", "tr", span(14)), ("up", "dm_up", span(14)), ("down", "dm_down", span(14))]
    first = ", ".join(f"{x} AS {n}" for n, x, _ in level)
    later = ", ".join(step(n, f"m.{x}", a) for n, x, a in level)
    dx = "100 * abs(up / nullif(atr, 0) * 100 - down / nullif(atr, 0) * 100) / (up / nullif(atr, 0) * 100 + down / nullif(atr, 0) * 100 + 1e-10)"
    names = ", ".join(n for n, _, _ in level)
    return f"""b AS ({source}),
d AS (SELECT *, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
k AS (SELECT *, greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr,
  CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS gain, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS loss,
  CASE WHEN h1 IS NOT NULL AND greatest(high - h1, 0) > greatest(l1 - low, 0) THEN greatest(high - h1, 0) ELSE 0 END AS dm_up FROM d),
m AS MATERIALIZED (SELECT *, CASE WHEN l1 IS NOT NULL AND greatest(l1 - low, 0) > dm_up THEN greatest(l1 - low, 0) ELSE 0 END AS dm_down FROM k),
e AS (
  SELECT symbol, rn, {names}, ema12 - ema26 AS macd, ema12 - ema26 AS macd_signal, dx, dx AS adx FROM (SELECT *, {dx} AS dx FROM (SELECT symbol, rn, {first} FROM m WHERE rn = 1))
  UNION ALL
  SELECT symbol, rn, {names}, macd, s + {span(9)} * (macd - s), dx, coalesce(x + {span(14)} * (dx - x), dx) FROM (
    SELECT *, ema12 - ema26 AS macd, {dx} AS dx FROM (
      SELECT m.symbol, m.rn, e.macd_signal AS s, e.adx AS x, {later} FROM e JOIN m ON m.symbol = e.symbol AND m.rn = e.rn + 1)))"""


TIMEFRAME_SQL = """
f AS (SELECT m.symbol, m.open_time, m.rn, m.open, m.high, m.low, m.close, m.volume, m.taker_buy_base_vol, e.* EXCLUDE (symbol, rn),
  coalesce(100 - 100 / (1 + g14 / nullif(l14, 0)), 50) AS rsi, CASE WHEN ema20 > ema50 THEN 1.0 WHEN ema20 < ema50 THEN -1.0 ELSE 0.0 END AS trend
  FROM m JOIN e ON m.symbol = e.symbol AND m.rn = e.rn)"""


def timeframe_sql(interval: str = "15m") -> str:
    """WITH clause ending in ``f``: bars with averages, rsi and trend."""
    return f"WITH RECURSIVE {averages_sql(bars_sql(interval))}, {TIMEFRAME_SQL}"

"""Queries on the ledger: reports, gates, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_stale
from tidemark.operators import ledger as book
from tidemark.operators.series import recent
from tidemark.plans.tables import LEDGER_SQL, ledger, near, near_sql, stamp, stamp_sql, table, ticks
from tidemark.sources import ledger as ledgers
from tidemark.sources.shared import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_MEASURES = ("win_rate", "total_pnl", "avg_win", "avg_loss", "profit_factor")
_MEASURES_SQL = f"""count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, {near_sql("avg(CASE WHEN pnl > 0 THEN 100.0 ELSE 0 END)", 2)} AS win_rate,
  {near_sql("sum(pnl)", 1)} AS total_pnl, {near_sql("coalesce(avg(pnl) FILTER (pnl > 0), 0)", 2)} AS avg_win, {near_sql("coalesce(avg(pnl) FILTER (pnl <= 0), 0)", 2)} AS avg_loss,
  {near_sql("coalesce(abs(sum(pnl) FILTER (pnl > 0) / nullif(sum(pnl) FILTER (pnl <= 0), 0)), 0)", 2)} AS profit_factor"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: near(c, 1 if c == "total_pnl" else 2) for c in _MEASURES})


@query("performance", f"SELECT {_MEASURES_SQL} FROM ({LEDGER_SQL})")
def _(spark, sf_dir):
    return rounded(book.performance(ledger(spark, sf_dir)))


@query("performance_by_symbol_and_day", f"SELECT symbol, strftime(day, '%Y-%m-%d') AS day, {_MEASURES_SQL} FROM (SELECT *, CAST(closed_at AS DATE) AS day FROM ({LEDGER_SQL})) GROUP BY GROUPING SETS ((symbol), (day))")
def _(spark, sf_dir):
    return rounded(book.performance_by(ledger(spark, sf_dir))).withColumn("day", F.date_format("day", "yyyy-MM-dd")).drop("grouping")


@query(
    "daily_status",
    f"""SELECT strftime(CAST(opened_at AS DATE), '%Y-%m-%d') AS day, count(*) AS signals, count(*) FILTER (signal = 'BUY') AS buys, count(*) FILTER (signal = 'SELL') AS sells,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_trades FROM ({LEDGER_SQL}) GROUP BY 1""",
)
def _(spark, sf_dir):
    trades = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "O").alias("closed"))
    out = book.daily_status(ledger(spark, sf_dir).select(F.col("opened_at").alias("generated_at"), "signal"), trades)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_GHOST = "close_reason = 'Ghost — PnL unrecoverable'"


@query(
    "reliability",
    f"""WITH r AS (SELECT symbol, count(*) FILTER (NOT {_GHOST} AND pnl > 0) AS wins, count(*) FILTER (NOT {_GHOST} AND pnl <= 0) AS losses, count(*) FILTER ({_GHOST}) AS ghosts FROM ({LEDGER_SQL}) GROUP BY symbol)
SELECT *, ghosts >= 3 AND ghosts > 2 * wins AS unreliable FROM r""",
)
def _(spark, sf_dir):
    return book.reliability(ledger(spark, sf_dir))


@query(
    "drawdown_ratchet",
    f"""WITH d AS (SELECT CAST(closed_at AS DATE) AS day, sum(pnl) AS pnl FROM ({LEDGER_SQL}) WHERE NOT contains(close_reason, 'Ghost') GROUP BY 1), p AS (SELECT *, pnl / 100000.0 * 100 AS pct FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, {near_sql("pct")} AS pct, CASE WHEN pct <= -5 THEN 0.0 WHEN pct <= -2 THEN 0.5 ELSE 1.0 END + 0.0 AS ratchet, pct < -5 AS advisory FROM p""",
)
def _(spark, sf_dir):
    out = book.drawdown_ratchet(ledger(spark, sf_dir), 100_000.0)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), near("pct").alias("pct"), "ratchet", "advisory")


@query("daily_trade_count", f"SELECT strftime(CAST(opened_at AS DATE), '%Y-%m-%d') AS day, count(*) AS trades, count(*) >= 20 AS full FROM ({LEDGER_SQL}) WHERE NOT {_GHOST} GROUP BY 1")
def _(spark, sf_dir):
    return book.daily_trade_count(ledger(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("fill_vwap", f"SELECT l_orderkey AS order_id, {near_sql('sum(l_extendedprice) / sum(l_quantity) + 0.00001', 1)} AS price, sum(l_quantity) AS amount FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("amount"))
    return book.fill_vwap(fills).select("order_id", near(F.col("price") + 0.00001, 1).alias("price"), "amount")


@query(
    "equity_snapshot",
    f"""SELECT (SELECT {near_sql("sum(round(s_acctbal, 2))", 2)} FROM supplier WHERE s_acctbal > 0) AS equity, {near_sql("sum(l_extendedprice * (0.05 - l_discount))", 2)} AS unrealised, count(*) AS open_positions
FROM lineitem WHERE l_quantity % 5 <> 0""",
)
def _(spark, sf_dir):
    assets = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("equity_usd"))
    held = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 5).alias("size"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("floating_profit_loss_usd"))
    out = book.equity_snapshot(assets, held)
    return out.select(near("equity", 2).alias("equity"), near("unrealised", 2).alias("unrealised"), "open_positions")


_ASKED = "SELECT l_orderkey || '-' || l_linenumber AS id, 'S' || (l_suppkey % 20) AS symbol, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS signal, l_shipdate + INTERVAL 12 HOUR AS ts FROM lineitem WHERE true"


def asked(spark, sf_dir, only: str = "true", hours: int = 12) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(only)
    return lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("signal"), (F.col("l_shipdate") + F.expr(f"INTERVAL {hours} HOURS")).alias("ts"))


def _steps(key: str) -> str:
    return f"""SELECT k, ts, sum(step) OVER (PARTITION BY k ORDER BY ts) AS n FROM (SELECT k, ts, sum(step) AS step FROM (
    SELECT {key} AS k, opened_at AS ts, 1 AS step FROM l UNION ALL SELECT {key}, closed_at, -1 FROM l) GROUP BY k, ts)"""


def _exposure_sql(held: str, asked_: str) -> str:
    sector = "'sec' || (CAST(substr(symbol, 2) AS INTEGER) % 4) AS sector"
    return f"""WITH l AS (SELECT *, {sector} FROM ({held})), a AS (SELECT *, {sector} FROM ({asked_})),
x AS ({_steps("'all'")}), y AS ({_steps("signal")}), z AS ({_steps("sector")}), v AS ({_steps("symbol")})
SELECT id, CAST(coalesce(x.n, 0) AS BIGINT) AS open_all, CAST(coalesce(y.n, 0) AS BIGINT) AS open_side, CAST(coalesce(z.n, 0) AS BIGINT) AS open_sector, CAST(coalesce(v.n, 0) AS BIGINT) AS open_symbol,
  coalesce(x.n, 0) < 10 AND coalesce(y.n, 0) < 3 AND coalesce(z.n, 0) < 2 AND coalesce(v.n, 0) < 1 AS allowed
FROM a ASOF LEFT JOIN x ON a.ts >= x.ts ASOF LEFT JOIN y ON a.signal = y.k AND a.ts >= y.ts ASOF LEFT JOIN z ON a.sector = z.k AND a.ts >= z.ts ASOF LEFT JOIN v ON a.symbol = v.k AND a.ts >= v.ts"""


def _exposed(signals: DataFrame, trades: DataFrame) -> DataFrame:
    sectors = trades.select("symbol").distinct().withColumn("sector", F.concat(F.lit("sec"), (F.substring("symbol", 2, 9).cast("int") % 4).cast("string")))
    return book.open_exposure(signals, trades, sectors).select("id", "open_all", "open_side", "open_sector", "open_symbol", "allowed")


@query("open_exposure", _exposure_sql(LEDGER_SQL, _ASKED))
def _(spark, sf_dir):
    return _exposed(asked(spark, sf_dir), ledger(spark, sf_dir))


_BRIEF = {
    "symbol": "'S' || CAST(l_suppkey % 20 AS {0})", "signal": "CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END",
    "opened": "l_partkey % 24", "hours": "CASE WHEN l_partkey % 50 = 0 THEN 400 ELSE 1 + l_suppkey % 7 END",
}
_BRIEF_SQL = f"""SELECT {_BRIEF["symbol"].format("VARCHAR")} AS symbol, {_BRIEF["signal"]} AS signal, l_shipdate + to_hours(CAST({_BRIEF["opened"]} AS INTEGER)) AS opened_at,
  l_shipdate + to_hours(CAST({_BRIEF["opened"]} + {_BRIEF["hours"]} AS INTEGER)) AS closed_at FROM lineitem WHERE l_linenumber = 1"""


@query("open_exposure_at_the_caps", _exposure_sql(_BRIEF_SQL, _ASKED))
def _(spark, sf_dir):
    """Trades of some hours, and a few of weeks, so that each cap decides now and then."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    at = lambda hours: f"CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(0, {hours})"
    trades = lines.select(F.expr(_BRIEF["symbol"].format("STRING")).alias("symbol"), F.expr(_BRIEF["signal"]).alias("signal"), F.expr(at(f"CAST({_BRIEF['opened']} AS INT)")).alias("opened_at"), F.expr(at(f"CAST({_BRIEF['opened']} + {_BRIEF['hours']} AS INT)")).alias("closed_at"))
    return _exposed(asked(spark, sf_dir), trades)


@query(
    "ledger_appended_in_batches",
    f"""SELECT o_orderkey AS trade_id, o_custkey % 20 AS symbol, {near_sql("CASE WHEN month(o_orderdate) % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END", 2)} AS pnl,
  CASE WHEN month(o_orderdate) % 3 = 0 THEN 'corrected' ELSE 'first' END AS state FROM orders""",
)
def _(spark, sf_dir):
    """Orders as trades, appended in three batches, each twice, and a batch of corrections: every trade once, as last told."""
    path = shared_path(spark, "ledger")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_custkey") % 20).alias("symbol"), F.col("o_totalprice").alias("pnl"), F.lit("first").alias("state"), F.month("o_orderdate").alias("m"))
    for k in (0, 1, 2, 0, 1, 2):
        ledgers.append_batch(rows.where(F.col("m") % 3 == k).drop("m"), path, f"a{k}")
    fixed = rows.where(F.col("m") % 3 == 0).withColumns({"pnl": F.col("pnl") + 1, "state": F.lit("corrected")}).drop("m")
    for _ in range(2):
        ledgers.append_batch(fixed, path, "b0")
    return ledgers.read_batches(spark, path, ["trade_id"]).select("trade_id", "symbol", near("pnl", 2).alias("pnl"), "state")


@query(
    "signals_off_cooldown",
    f"""WITH c AS (SELECT symbol, closed_at AS ts, max(CASE WHEN close_reason <> 'TP2 hit' THEN 1 ELSE 0 END) AS lost FROM ({LEDGER_SQL}) WHERE pnl < 0 OR close_reason IN ('Ghost — PnL unrecoverable', 'TP2 hit') GROUP BY ALL),
a AS ({_ASKED.replace("12 HOUR", "1 HOUR")})
SELECT id, a.symbol, signal FROM a ASOF LEFT JOIN c ON a.symbol = c.symbol AND a.ts >= c.ts WHERE NOT coalesce(c.lost = 1 AND date_diff('second', c.ts, a.ts) / 3600.0 < 2, false)""",
)
def _(spark, sf_dir):
    """All signals against the ledger as it is."""
    return book.drop_on_cooldown(asked(spark, sf_dir, hours=1), ledger(spark, sf_dir)).select("id", "symbol", "signal")


_OPEN_SQL = "SELECT l_suppkey, 'S' || l_suppkey || 'USDT' AS symbol, CASE WHEN l_suppkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS signal, max(l_extendedprice / l_quantity) AS entry, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey"


def open_trades(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").groupBy("l_suppkey").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"), F.sum("l_quantity").alias("qty"))
    side = F.when(F.col("l_suppkey") % 2 == 0, "BUY").otherwise("SELL")
    return rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("USDT")).alias("symbol"), side.alias("signal"), "entry", "qty", F.lit(False).alias("closed"), (F.col("entry") * F.when(side == "BUY", 1.1).otherwise(0.9)).alias("tp1"), (F.col("entry") * F.when(side == "BUY", 1.2).otherwise(0.8)).alias("tp2"))


def positions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.format_string("S%d_USDC-PERPETUAL", "s_suppkey").alias("instrument_name"), F.lit(1.0).alias("size"))


@query("ghosts_and_orphans", f"""SELECT 'ghost' AS kind, symbol FROM ({_OPEN_SQL}) WHERE symbol NOT IN (SELECT 'S' || s_suppkey || 'USDT' FROM supplier WHERE s_suppkey % 2 = 0)
UNION ALL SELECT 'orphan', 'S' || s_suppkey || 'USDT' FROM supplier WHERE s_suppkey % 2 = 0 AND 'S' || s_suppkey || 'USDT' NOT IN (SELECT symbol FROM ({_OPEN_SQL}))""")
def _(spark, sf_dir):
    trades, held = open_trades(spark, sf_dir), positions(spark, sf_dir)
    lost = book.ghosts(trades, held).select(F.lit("ghost").alias("kind"), "symbol")
    return lost.unionByName(book.orphans(trades, held).select(F.lit("orphan").alias("kind"), "symbol"))


@query(
    "reconciled",
    f"""WITH f AS (SELECT 'S' || l_suppkey || 'USDT' AS symbol, CASE WHEN l_linestatus = 'O' THEN 'sell' ELSE 'buy' END AS direction, arg_max(round(l_extendedprice / l_quantity, 2), (l_shipdate, l_orderkey, l_linenumber)) AS p FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ALL),
j AS (SELECT t.*, p FROM ({_OPEN_SQL}) t LEFT JOIN f ON t.symbol = f.symbol AND f.direction = CASE WHEN signal = 'BUY' THEN 'sell' ELSE 'buy' END)
SELECT symbol, {near_sql("coalesce(p, entry)")} AS close_price, {near_sql("coalesce(CASE WHEN signal = 'BUY' THEN p - entry ELSE entry - p END * qty, 0)", 2)} AS pnl,
  CASE WHEN p IS NULL THEN 'Ghost — PnL unrecoverable' WHEN signal = 'BUY' AND p >= entry * 1.2 * 0.998 OR signal = 'SELL' AND p <= entry * 0.8 * 1.002 THEN 'TP2 hit'
  WHEN signal = 'BUY' AND p >= entry * 1.1 * 0.998 OR signal = 'SELL' AND p <= entry * 0.9 * 1.002 THEN 'TP1 hit' ELSE 'SL hit' END AS close_reason FROM j""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 5 <> 0")
    order = F.struct("l_orderkey", "l_linenumber")
    fills = lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("USDT")).alias("symbol"), F.when(F.col("l_linestatus") == "O", "sell").otherwise("buy").alias("direction"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), F.col("l_shipdate").alias("ts"), order.alias("order_id"))
    out = book.reconcile(open_trades(spark, sf_dir), fills)
    return out.select("symbol", near("close_price").alias("close_price"), near("pnl", 2).alias("pnl"), "close_reason")


@query(
    "marked_to_market",
    f"""WITH p AS (SELECT 'S' || s_suppkey || 'USDT' AS symbol, abs(s_acctbal) / 5 + 100 AS live FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT t.symbol, {near_sql("coalesce(CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END * (live - entry) * qty, 0)", 2)} AS unrealised, {near_sql("coalesce(100 * CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END * (live - entry) / entry, 0)")} AS pnl_pct,
  {near_sql("coalesce(least(greatest(100 * abs(live - entry) / abs(entry * CASE WHEN signal = 'BUY' THEN 1.2 ELSE 0.8 END - entry), 0), 100), 0)")} AS progress FROM ({_OPEN_SQL}) t LEFT JOIN p ON t.symbol = p.symbol""",
)
def _(spark, sf_dir):
    prices = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("USDT")).alias("symbol"), (F.abs("s_acctbal") / 5 + 100).alias("price"))
    out = book.mark_to_market(open_trades(spark, sf_dir), prices)
    return out.select("symbol", near("unrealised", 2).alias("unrealised"), near("pnl_pct").alias("pnl_pct"), near("progress").alias("progress"))


@query(
    "funding",
    f"""WITH r AS (SELECT 'S' || s_suppkey || 'USDT' AS symbol, (s_suppkey % 7 - 3) / 2000.0 AS rate FROM supplier), j AS (SELECT t.*, r.rate FROM ({_OPEN_SQL}) t LEFT JOIN r ON t.symbol = r.symbol),
g AS (SELECT *, signal = 'BUY' AND rate > 0 OR signal = 'SELL' AND rate < 0 AS pays, abs(rate) * 100 AS pct FROM j)
SELECT symbol, CASE WHEN pays AND pct >= 0.10 THEN 'skip' ELSE 'warn' END AS funding, {near_sql("pct * 24 / 8")} AS drag_pct FROM g WHERE pays AND pct >= 0.05""",
)
def _(spark, sf_dir):
    """Trades opened a day ago."""
    rates = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("USDT")).alias("symbol"), ((F.col("s_suppkey") % 7 - 3) / 2000.0).alias("rate"))
    trades = open_trades(spark, sf_dir).withColumn("opened_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return book.funding_drag(trades, rates, F.lit("2024-01-02").cast("timestamp_ntz")).select("symbol", "funding", near("drag_pct").alias("drag_pct"))


@query("recent_trades", f"SELECT trade_id, symbol, {stamp_sql('closed_at')} AS closed_at FROM (SELECT *, row_number() OVER (ORDER BY closed_at DESC, trade_id DESC) AS k FROM ({LEDGER_SQL})) WHERE k <= 100")
def _(spark, sf_dir):
    """The last hundred; equal times by the trade's name."""
    out = recent(ledger(spark, sf_dir), 100, "closed_at", "trade_id")
    return out.select("trade_id", "symbol", stamp("closed_at").alias("closed_at"))


@query(
    "stale_trades",
    f"""SELECT symbol, date_diff('second', opened_at, TIMESTAMP '1996-01-01') / 3600.0 > 48 AS stale, count(*) AS trades FROM ({LEDGER_SQL}) GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Trades older than two days at the start of 1996."""
    stale = is_stale("opened_at", F.lit("1996-01-01").cast("timestamp_ntz"))
    return ledger(spark, sf_dir).select("symbol", stale.alias("stale")).groupBy("symbol", "stale").agg(F.count("*").alias("trades"))


@query("open_trades_json", """SELECT symbol, signal, round(entry, 4) + 0.0 AS entry, qty FROM (%s)""" % _OPEN_SQL)
def _(spark, sf_dir):
    """Trades through one JSON map per side and back."""
    from tidemark.sources.ledger import parse_open_trades

    trades = open_trades(spark, sf_dir).withColumn("side", F.col("signal"))
    maps = trades.groupBy("side").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("symbol", "signal", "entry", "qty"))))).alias("value"))
    return parse_open_trades(maps.select("value")).select("symbol", "signal", near("entry").alias("entry"), "qty")

"""Queries through Structured Streaming, over the files of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, series
from tidemark.plans.signal_queries import ORDERS_SQL, news, ruled
from tidemark.plans.tables import BENCHMARK, INTERVALS, TIMEFRAME_SQL, averages_sql, bars, bars_sql, near, near_sql, stamp, stamp_sql, table, ticks, timeframe_sql, wide_ticks
from tidemark.plans.workloads import benchmark_now, ordered, rule_signals, scanned_signals
from tidemark.sources.bars import to_bars
from tidemark.sources.shared import shared_path
from tidemark.streaming import jobs
from tidemark.streaming.scan import scan_inputs

SLICES, FILES = 4, 2  # of a stream, and in each of its slices

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def file_stream(spark: SparkSession, df: DataFrame, name: str, time: str, end: DataFrame | None = None) -> DataFrame:
    """A table as a stream of files: slices of time, written one after the other and read a slice per micro-batch; then the row ``end``, if given."""
    path = shared_path(spark, name)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [k / SLICES for k in range(1, SLICES)], 10_000).alias("c")).first()["c"] or []
    slice_ = sum(((at > c).cast("int") for c in cuts), F.lit(0))
    for k in range(SLICES):
        df.where(slice_ == k).repartition(FILES).write.mode("append").parquet(path)
    if end is not None:
        end.repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The stream run to its end into files, read back."""
    path = shared_path(spark, name)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_bars",
    f"""SELECT symbol, {stamp_sql("open_time")} AS open_time, {near_sql("open")} AS open, {near_sql("high")} AS high, {near_sql("low")} AS low, {near_sql("close")} AS close, {near_sql("volume")} AS volume
FROM ({bars_sql("1h")}) WHERE open_time + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
)
def _(spark, sf_dir):
    """Hourly bars as a stream, of all hours that the watermark has closed: the same as in a batch."""
    source = ticks(spark, sf_dir)
    out = finished(spark, jobs.stream_bars(file_stream(spark, source, "ticks", "ts"), "1 hour", "2 hours"), "stream-bars")
    return out.select("symbol", stamp("open_time").alias("open_time"), *[near(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


_RECENT_SQL = f"SELECT * EXCLUDE (newest) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS newest FROM ({bars_sql()})) WHERE newest <= 300"
_RULE_SQL = "CASE WHEN trend = 1 AND rsi < 65 THEN 'BUY' WHEN trend = -1 AND rsi > 35 THEN 'SELL' ELSE 'NO_TRADE' END"


@query(
    "stream_scan",
    f"""WITH RECURSIVE {averages_sql(_RECENT_SQL)}, {TIMEFRAME_SQL}, s AS (SELECT *, {_RULE_SQL} AS signal FROM f)
SELECT symbol, {stamp_sql("open_time")} AS open_time, signal, {near_sql("50 + abs(rsi - 50)", 2)} AS confidence, CAST({SLICES} AS BIGINT) AS scans FROM s WHERE signal <> 'NO_TRADE'""",
)
def _(spark, sf_dir):
    """Scans of the last 300 bars of each symbol that a micro-batch touches, with how many batches found each signal."""
    history, path = bars(spark, sf_dir), shared_path(spark, "scan")

    def scan(recent: DataFrame) -> DataFrame:
        return rule_signals(features.add_features(recent)).where("signal <> 'NO_TRADE'")

    def sink(found: DataFrame, batch_id: int) -> None:
        """A folder per batch: a batch that runs again replaces what it wrote."""
        rows = found.select("symbol", stamp("open_time").alias("open_time"), "signal", near("confidence", 2).alias("confidence"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    each = jobs.run_scan(lambda touched: history.join(touched, "symbol", "left_semi"), scan, sink)
    stream = file_stream(spark, ticks(spark, sf_dir), "scan-ticks", "ts")
    stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start().awaitTermination()
    return spark.read.parquet(path).groupBy("symbol", "open_time", "signal", "confidence").agg(F.count_distinct("batch").alias("scans"))


@query(
    "stream_signal_gate",
    f"""{timeframe_sql()}, s AS (SELECT symbol, open_time AS moment, rsi < 35 AS lost, {_RULE_SQL} AS signal FROM f),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY moment) AS turn FROM s WHERE signal <> 'NO_TRADE'),
g AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS turn, '' AS last, TIMESTAMP '1970-01-01' AS blocked, DATE '1970-01-01' AS day, 0 AS taken, '' AS reason FROM n
  UNION ALL SELECT symbol, turn, CASE WHEN reason = 'ok' THEN signal ELSE last END, CASE WHEN lost THEN moment + INTERVAL 2 HOUR ELSE blocked END, CAST(moment AS DATE), taken + CASE WHEN reason = 'ok' THEN 1 ELSE 0 END, reason
  FROM (SELECT *, CASE WHEN lost THEN 'lost' WHEN signal = last THEN 'same' WHEN moment < blocked THEN 'cooldown' WHEN taken >= 20 THEN 'cap' ELSE 'ok' END AS reason
    FROM (SELECT n.*, g.last, g.blocked, CASE WHEN g.day = CAST(n.moment AS DATE) THEN g.taken ELSE 0 END AS taken FROM g JOIN n ON n.symbol = g.symbol AND n.turn = g.turn + 1)))
SELECT n.symbol, n.signal, {stamp_sql("n.moment")} AS "at", reason = 'ok' AS allowed, CASE WHEN reason = 'ok' THEN '' ELSE reason END AS reason FROM g JOIN n ON n.symbol = g.symbol AND n.turn = g.turn WHERE reason <> 'lost'""",
)
def _(spark, sf_dir):
    """The rule's signals through the gate: new ones, off cooldown, under the day's cap. The stream's end moves the watermark past the last."""
    found = ruled(spark, sf_dir).where("signal <> 'NO_TRADE'")
    rows = found.select("symbol", "signal", F.col("open_time").cast("timestamp").alias("at"), (F.col("rsi") < 35).alias("lost"))
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("symbol", "signal")]
    end = rows.agg((F.max("at") + F.expr("INTERVAL 2 HOURS")).alias("at")).select(*nothing, "at", F.lit(False).alias("lost")).where("at IS NOT NULL")
    out = finished(spark, jobs.signal_gate(file_stream(spark, rows, "gate", "at", end)), "gated")
    return out.select("symbol", "signal", stamp("at").alias("at"), "allowed", F.coalesce("reason", F.lit("")).alias("reason"))


@query("stream_live_scan", ORDERS_SQL)
def _(spark, sf_dir):
    """The last scan of each symbol from a stream of bars: filters, score, news, levels and size, with nothing read twice.

    A symbol whose last scan has no sound levels has no row; an older scan does not stand in for it.
    """
    seen = wide_ticks(spark, sf_dir)
    bars_ = {i: to_bars(seen, every, i) for i, every in INTERVALS.items()}
    closed = series.union_all([b.withColumn("closed_at", F.col("open_time") + F.expr(f"INTERVAL {INTERVALS[i]}")) for i, b in bars_.items()])
    events = seen.withColumn("net_inflow", F.round((F.col("value") - 50) * 2e6, 2))
    bench = benchmark_now(series.with_segment(bars_["15m"]).where(F.col("symbol") == f"{BENCHMARK}-0"))
    mood = events.agg((F.floor(F.sum("value")) % 101).alias("value"))
    names = seen.select("symbol").distinct().select("symbol", F.lit(0.01).alias("min_amount"), F.lit(1000.0).alias("max_amount"))
    inputs = scan_inputs(file_stream(spark, closed, "scan-bars", "closed_at")).withColumn("coin", F.concat(F.lit("src"), F.substring_index("symbol", "-", -1)))
    made = ordered(scanned_signals(inputs, bench, events.select("symbol", "ts", "net_inflow"), mood), news(spark, sf_dir), names, 10_000.0, unsound=True)
    shown = ["symbol", "bars", "open_time", "signal", "confidence", "score", "reject_reason", "quality", "vol_state", "reasons", "stop", "tp1", "tp2", "qty"]
    last = finished(spark, made.select(*shown), "scanned").groupBy("symbol").agg(F.max_by(F.struct(*shown[2:]), "bars").alias("r")).select("symbol", "r.*").where("stop IS NOT NULL")
    near_ = {c: near(c, 2 if c in ("confidence", "qty") else 4) for c in ("confidence", "stop", "tp1", "tp2", "qty")}
    return last.withColumns({"open_time": stamp("open_time"), "reasons": F.array_join("reasons", "; "), **near_})


_TURN_SQL = "row_number() OVER (PARTITION BY symbol ORDER BY moment, signal, lost)"
_TICK_GATE_SQL = f"""WITH RECURSIVE s AS (SELECT event_type AS symbol, ts AS moment, value > 160 AS lost, CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS signal FROM events),
n AS MATERIALIZED (SELECT *, {_TURN_SQL} AS turn FROM s WHERE moment < (SELECT date_trunc('millisecond', max(moment) - INTERVAL 3 HOUR) FROM s)),
g AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS turn, '' AS last, TIMESTAMP '1970-01-01' AS blocked, DATE '1970-01-01' AS day, 0 AS taken, '' AS reason FROM n
  UNION ALL SELECT symbol, turn, CASE WHEN reason = 'ok' THEN signal ELSE last END, CASE WHEN lost THEN moment + INTERVAL 2 HOUR ELSE blocked END, CAST(moment AS DATE), taken + CASE WHEN reason = 'ok' THEN 1 ELSE 0 END, reason
  FROM (SELECT *, CASE WHEN lost THEN 'lost' WHEN signal = last THEN 'same' WHEN moment < blocked THEN 'cooldown' WHEN taken >= 20 THEN 'cap' ELSE 'ok' END AS reason
    FROM (SELECT n.*, g.last, g.blocked, CASE WHEN g.day = CAST(n.moment AS DATE) THEN g.taken ELSE 0 END AS taken FROM g JOIN n ON n.symbol = g.symbol AND n.turn = g.turn + 1)))
SELECT n.symbol, n.signal, {stamp_sql("n.moment")} AS "at", reason = 'ok' AS allowed, CASE WHEN reason = 'ok' THEN '' ELSE reason END AS reason FROM g JOIN n ON n.symbol = g.symbol AND n.turn = g.turn WHERE reason <> 'lost'"""


@query("stream_signal_gate_shuffled", _TICK_GATE_SQL)
def _(spark, sf_dir):
    """Every tick as a signal, arriving up to two hours out of order: judged in order of time, days over their cap among them."""
    events = table(spark, sf_dir, "events")
    late = F.timestamp_add("SECOND", F.pmod(F.xxhash64("event_id"), F.lit(7200)).cast("int"), F.col("ts"))
    side = F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL")
    rows = events.select(F.col("event_type").alias("symbol"), side.alias("signal"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") > 160).alias("lost"), late.alias("arrived"))
    out = finished(spark, jobs.signal_gate(file_stream(spark, rows, "ticks-gate", "arrived"), watermark="3 hours"), "ticks-gated")
    return out.select("symbol", "signal", stamp("at").alias("at"), "allowed", F.coalesce("reason", F.lit("")).alias("reason"))


_LIFE_SQL = f"""WITH RECURSIVE t AS (SELECT symbol || '-' || {stamp_sql("open_time")} AS trade_id, symbol, CASE WHEN day(open_time) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE -1 END AS side, close AS entry, open_time + INTERVAL 4 HOUR AS opened FROM ({bars_sql("4h")}) WHERE hour(open_time) = 4),
c AS (SELECT *, entry * (1 - 0.05 * side) AS stop, entry * (1 + 0.04 * side) AS tp1, entry * (1 + 0.1 * side) AS tp2 FROM t),
n AS MATERIALIZED (SELECT trade_id, e.ts, 100 + e.value AS price, row_number() OVER (PARTITION BY trade_id ORDER BY e.ts, e.value) AS turn FROM c JOIN events e ON e.event_type = c.symbol AND e.ts > c.opened AND e.ts <= c.opened + INTERVAL 72 HOUR),
r AS (SELECT trade_id, CAST(0 AS BIGINT) AS turn, CAST(2 AS DOUBLE) AS held, stop, false AS hit, CAST(NULL AS DOUBLE) AS part, CAST(NULL AS VARCHAR) AS ending, TIMESTAMP '1970-01-01' AS ts, CAST(0 AS DOUBLE) AS price FROM c
  UNION ALL SELECT trade_id, turn, held, stop, hit, part, CASE WHEN mae THEN 'MAE' WHEN side * (price - tp2) >= 0 THEN 'TP2' WHEN side * (price - stop) <= 0 THEN CASE WHEN abs(price - entry) < 0.002 * entry THEN 'BREAK-EVEN' ELSE 'STOPPED OUT' END WHEN date_diff('microsecond', opened, ts) > 48 * 3600000000 THEN 'TIME' END, ts, price
  FROM (SELECT * REPLACE (CASE WHEN NOT mae AND hit AND abs(stop - entry) < 0.001 * entry AND side * (price - (entry + tp2) / 2) >= 0 THEN tp1 ELSE stop END AS stop)
  FROM (SELECT * REPLACE (held - coalesce(part, 0) AS held, CASE WHEN part IS NOT NULL THEN entry ELSE stop END AS stop, hit OR part IS NOT NULL AS hit)
  FROM (SELECT *, CASE WHEN NOT mae AND NOT hit AND side * (price - tp1) >= 0 THEN least(CAST(1 AS DOUBLE), held) END AS part
  FROM (SELECT n.trade_id, n.turn, r.held, r.stop, r.hit, c.side, c.entry, c.tp1, c.tp2, c.opened, n.ts, n.price, c.side * (n.price - c.entry) * r.held < -150 AS mae FROM r JOIN n ON n.trade_id = r.trade_id AND n.turn = r.turn + 1 JOIN c ON c.trade_id = r.trade_id WHERE r.ending IS NULL)))))
SELECT trade_id, symbol, {stamp_sql("ts")} AS "at", event, {near_sql("price")} AS price, qty, {near_sql("side * (price - entry) * qty")} AS pnl
FROM (SELECT r.trade_id, symbol, ts, 'TP1' AS event, price, part AS qty, side, entry FROM r JOIN c ON r.trade_id = c.trade_id WHERE part IS NOT NULL
  UNION ALL SELECT r.trade_id, symbol, ts, ending, price, held, side, entry FROM r JOIN c ON r.trade_id = c.trade_id WHERE ending IS NOT NULL)"""


def _daily_trades(spark, sf_dir) -> DataFrame:
    """One trade per symbol and day."""
    day = bars(spark, sf_dir, "4h")
    side = F.when(F.dayofmonth("open_time") % 2 == 0, 1.0).otherwise(-1.0)
    return day.where(F.hour("open_time") == 4).select(
        F.concat_ws("-", "symbol", stamp("open_time")).alias("trade_id"), "symbol", F.when(side > 0, "BUY").otherwise("SELL").alias("signal"), F.col("close").alias("entry"),
        (F.col("close") * (1 - 0.05 * side)).alias("stop"), (F.col("close") * (1 + 0.04 * side)).alias("tp1"), (F.col("close") * (1 + 0.1 * side)).alias("tp2"),
        F.lit(2.0).alias("qty"), F.lit(1.0).alias("qty_tp1"), F.lit(50.0).alias("risk_usd"), (F.col("open_time") + F.expr("INTERVAL 4 HOURS")).alias("opened_at"),
    )


@query("trade_lifecycle", _LIFE_SQL)
def _(spark, sf_dir):
    """The trades over all later ticks of three days."""
    out = jobs.trade_lifecycle(_daily_trades(spark, sf_dir), ticks(spark, sf_dir).select("symbol", "ts", "price"))
    return out.select("trade_id", "symbol", stamp("at").alias("at"), "event", near("price").alias("price"), "qty", near("pnl").alias("pnl"))


_LATE_LIFE_SQL = _LIFE_SQL.replace("INTERVAL 72 HOUR),", "INTERVAL 72 HOUR AND e.ts < (SELECT date_trunc('millisecond', max(ts) - INTERVAL 3 HOUR) FROM events)),")


@query("stream_trade_lifecycle", _LATE_LIFE_SQL)
def _(spark, sf_dir):
    """The same with the ticks as a stream of several micro-batches, up to two hours out of order, up to the watermark."""
    events = table(spark, sf_dir, "events")
    late = F.timestamp_add("SECOND", F.pmod(F.xxhash64("event_id"), F.lit(7200)).cast("int"), F.col("ts"))
    ticks_ = events.select(F.col("event_type").alias("symbol"), "ts", (100 + F.col("value")).alias("price"), late.alias("arrived"))
    out = finished(spark, jobs.stream_lifecycle(_daily_trades(spark, sf_dir), file_stream(spark, ticks_, "life-ticks", "arrived"), watermark="3 hours"), "life")
    return out.select("trade_id", "symbol", stamp("at").alias("at"), "event", near("price").alias("price"), "qty", near("pnl").alias("pnl"))


_ENDINGS_SQL = (
    _LIFE_SQL.replace("close AS entry", "100 + round((close - 100) / 20) AS entry, hour(open_time) = 16 AS wide")
    .replace("WHERE hour(open_time) = 4)", "WHERE hour(open_time) IN (4, 16))")
    .replace("entry * (1 - 0.05 * side)", "entry * (1 - CASE WHEN wide THEN 0.99 ELSE 0.05 END * side)")
    .replace("entry * (1 + 0.04 * side)", "entry * (1 + CASE WHEN wide THEN 9 ELSE 0.04 END * side)")
    .replace("entry * (1 + 0.1 * side)", "entry * (1 + CASE WHEN wide THEN 9.5 ELSE 0.1 END * side)")
    .replace("100 + e.value AS price", "100 + round(e.value / 20) AS price")
)


@query("trade_lifecycle_endings", _ENDINGS_SQL)
def _(spark, sf_dir):
    """Trades over prices of few steps, half of them with levels out of reach: they also end at the entry and by age."""
    step = lambda c: 100 + F.round(c / 20)
    day = bars(spark, sf_dir, "4h").where(F.hour("open_time").isin(4, 16)).withColumns({"entry": step(F.col("close") - 100), "wide": F.hour("open_time") == 16})
    side = F.when(F.dayofmonth("open_time") % 2 == 0, 1.0).otherwise(-1.0)
    level = lambda wide, near_, sign: F.col("entry") * (1 + sign * F.when(F.col("wide"), wide).otherwise(near_) * side)
    trades = day.select(
        F.concat_ws("-", "symbol", stamp("open_time")).alias("trade_id"), "symbol", F.when(side > 0, "BUY").otherwise("SELL").alias("signal"), "entry",
        level(0.99, 0.05, -1).alias("stop"), level(9.0, 0.04, 1).alias("tp1"), level(9.5, 0.1, 1).alias("tp2"),
        F.lit(2.0).alias("qty"), F.lit(1.0).alias("qty_tp1"), F.lit(50.0).alias("risk_usd"), (F.col("open_time") + F.expr("INTERVAL 4 HOURS")).alias("opened_at"),
    )
    prices = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", step(F.col("value")).alias("price"))
    out = jobs.trade_lifecycle(trades, prices)
    return out.select("trade_id", "symbol", stamp("at").alias("at"), "event", near("price").alias("price"), "qty", near("pnl").alias("pnl"))


@query("bars_of_stream_ticks", f"SELECT symbol, count(*) AS bars FROM ({bars_sql('4h')}) GROUP BY symbol")
def _(spark, sf_dir):
    return to_bars(ticks(spark, sf_dir), "4 hours").groupBy("symbol").agg(F.count("*").alias("bars"))

"""Reports on a ledger of trades, its reconciliation, and the gates that it feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_hours, base_asset, clip, div
from tidemark.functions.tables import with_row
from tidemark.operators.joins import carry_forward

GHOST = "Ghost — PnL unrecoverable"
RECOVERED = "RECOVERED"


def real(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.coalesce(F.col("signal") != RECOVERED, F.lit(True)))


def _day() -> Column:
    return F.coalesce("closed_at", "opened_at").cast("date")


def _measures() -> list[Column]:
    pnl = F.coalesce("pnl", F.lit(0.0))
    won = pnl > 0
    gain, lost = F.sum(F.when(won, pnl)), F.sum(F.when(~won, pnl))
    return [
        F.count("*").alias("trades"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.coalesce(F.avg(won.cast("double")) * 100, F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum(pnl), F.lit(0.0)).alias("total_pnl"), F.coalesce(F.avg(F.when(won, pnl)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(~won, pnl)), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.abs(div(F.coalesce(gain, F.lit(0.0)), lost)), F.lit(0.0)).alias("profit_factor"),
    ]


def performance(ledger: DataFrame) -> DataFrame:
    return real(ledger).agg(*_measures())


def performance_by(ledger: DataFrame, keys: Sequence[str] = ("symbol", "day")) -> DataFrame:
    """The measures by each key on its own, in one pass; keys other than the row's are null."""
    df = real(ledger).withColumn("day", _day())
    out = df.groupingSets([[k] for k in keys], *keys).agg(*_measures(), F.grouping_id(*keys).alias("grouping"))
    return out


def daily_status(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """Signals of each day by side, and the trades open now."""
    days = signals.groupBy(F.col("generated_at").cast("date").alias("day")).agg(
        F.count("*").alias("signals"), F.count_if(F.col("signal") == "BUY").alias("buys"), F.count_if(F.col("signal") == "SELL").alias("sells")
    )
    still = trades.agg(F.count_if(~F.coalesce("closed", F.lit(False))).alias("open_trades"))
    return with_row(days, still)


def _ghost() -> Column:
    return F.coalesce(F.col("close_reason") == GHOST, F.lit(False))


def reliability(ledger: DataFrame, strikes: int = 3) -> DataFrame:
    """Wins, losses and ghosts of each symbol; unreliable with many ghosts and few wins."""
    pnl = F.coalesce("pnl", F.lit(0.0))
    out = ledger.groupBy("symbol").agg(F.count_if(~_ghost() & (pnl > 0)).alias("wins"), F.count_if(~_ghost() & (pnl <= 0)).alias("losses"), F.count_if(_ghost()).alias("ghosts"))
    return out.withColumn("unreliable", (F.col("ghosts") >= strikes) & (F.col("ghosts") > 2 * F.col("wins")))


def drawdown_ratchet(ledger: DataFrame, balance: float) -> DataFrame:
    """By day: result in percent of the balance, the risk multiple it leaves, and whether a loss warning is due."""
    ghost = F.coalesce(F.contains("close_reason", F.lit("Ghost")), F.lit(False))
    out = ledger.where(~ghost).groupBy(_day().alias("day")).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))
    pct = F.col("pnl") / balance * 100
    if balance <= 0:
        return out.withColumns({"pct": F.lit(None).cast("double"), "ratchet": F.lit(1.0), "advisory": F.lit(False)})
    return out.withColumns({"pct": pct, "ratchet": F.when(pct <= -5, 0.0).when(pct <= -2, 0.5).otherwise(1.0), "advisory": pct < -5})


def daily_trade_count(ledger: DataFrame, cap: int = 20) -> DataFrame:
    out = ledger.where(~_ghost()).groupBy(F.col("opened_at").cast("date").alias("day")).agg(F.count("*").alias("trades"))
    return out.withColumn("full", F.col("trades") >= cap)


def fill_vwap(fills: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Average price of each order's fills."""
    out = fills.groupBy("order_id").agg(F.sum(F.col("price") * F.col("amount")).alias("_cost"), F.sum("amount").alias("amount"))
    price = F.bround(div("_cost", "amount"), 8)
    return out.withColumn("price", price if fallback is None else F.coalesce(price, fallback)).drop("_cost")


def equity_snapshot(assets: DataFrame, positions: DataFrame) -> DataFrame:
    """Sum of positive asset equities, of unrealised results, and number of open positions."""
    money = assets.where("equity_usd > 0").agg(F.coalesce(F.sum(F.bround("equity_usd", 2)), F.lit(0.0)).alias("equity"))
    held = positions.where("size <> 0").agg(F.coalesce(F.sum("floating_profit_loss_usd"), F.lit(0.0)).alias("unrealised"), F.count("*").alias("open_positions"))
    return with_row(money, held)


def open_exposure(signals: DataFrame, trades: DataFrame, sectors: DataFrame, direction_cap: int = 3, sector_cap: int = 2, open_cap: int = 10) -> DataFrame:
    """For each signal (symbol, signal, ts): how many trades are open then, in all, on its side, in its sector
    and in its symbol, and whether the caps allow it.

    A trade is +1 when it opens and -1 when it closes. What the caps see of a trade or signal is its symbol, side and
    time, so steps are added up, and signals made one, by these before anything else is dealt out; each is then a row per cap it
    counts for. The events of a day are summed per day first, days are accumulated over a small table, and the running
    sums inside a day start from there: no pair of a signal and a trade is made, and no group holds more than a day.
    A last aggregate brings the caps of a point together again, and signals take the answer of their point.
    """
    sectors = sectors.select("symbol", "sector")
    point = [F.col("symbol"), F.col("signal").alias("side")]
    opened = trades.select(*point, F.col("opened_at").alias("ts"), F.lit(1).cast("long").alias("step"))
    closed = trades.where("closed_at IS NOT NULL").select(*point, F.col("closed_at").alias("ts"), F.lit(-1).cast("long").alias("step"))
    steps = opened.unionByName(closed).groupBy("symbol", "side", "ts").agg(F.sum("step").alias("step"))
    asked = signals.select(*point, "ts").distinct().select("*", F.lit(0).cast("long").alias("step"), F.struct("symbol", "side", "ts").alias("row"))
    rows = steps.unionByName(asked, allowMissingColumns=True).join(sectors, "symbol", "left")
    caps = (("open_all", F.lit("")), ("open_side", F.col("side")), ("open_sector", F.col("sector")), ("open_symbol", F.col("symbol")))
    keys = F.array(*[F.struct(F.lit(n).alias("cap"), k.alias("key")) for n, k in caps])
    rows = rows.withColumn("k", F.explode(keys)).select("k.*", "ts", "step", "row", F.col("ts").cast("date").alias("day"))
    rows = rows.where("key IS NOT NULL OR row IS NOT NULL")  # a signal without a sector is still answered
    daily = rows.groupBy("cap", "key", "day").agg(F.sum("step").alias("sum"))
    earlier = Window.partitionBy("cap", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(F.col("cap").alias("_cap"), F.col("key").alias("_key"), F.col("day").alias("_day"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    # All events up to and at the time count, as a trade is open from its opening and no longer at its close.
    inside = Window.partitionBy("cap", "key", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = (F.col("cap") == F.col("_cap")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("day") == F.col("_day"))
    counted = rows.withColumn("in", F.sum("step").over(inside)).where("row IS NOT NULL").join(daily, same)
    held = F.when(F.col("key").isNotNull(), F.col("base") + F.col("in")).otherwise(0)
    answers = counted.groupBy("row").agg(*[F.max(F.when(F.col("cap") == n, held)).alias(n) for n, _ in caps])
    answers = answers.select(*[F.col(f"row.{c}").alias(f"_{c}") for c in ("symbol", "side", "ts")], *[n for n, _ in caps])
    met = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("signal").eqNullSafe(F.col("_side")) & F.col("ts").eqNullSafe(F.col("_ts"))
    out = signals.join(answers, met).drop("_symbol", "_side", "_ts")
    allowed = (F.col("open_all") < open_cap) & (F.col("open_side") < direction_cap) & (F.col("open_sector") < sector_cap) & (F.col("open_symbol") < 1)
    return out.withColumn("allowed", allowed)


def drop_on_cooldown(signals: DataFrame, ledger: DataFrame, hours: float = 2.0) -> DataFrame:
    """Signals (symbol, ts, ...) whose symbol's last decisive close is not a loss or ghost within ``hours``.

    A full win clears the block. Of closes at one time a loss or ghost counts last. Signals and closes are sorted by
    symbol and day, and a day begins with the last close of the days before it.
    """
    lost = (F.coalesce("pnl", F.lit(0.0)) < 0) | _ghost()
    cleared = F.coalesce(F.col("close_reason") == "TP2 hit", F.lit(False))
    closes = ledger.where(F.col("closed_at").isNotNull() & (lost | cleared)).select("symbol", F.col("closed_at").alias("ts"), (lost & ~cleared).alias("_lost"))
    closes = closes.select("symbol", "ts", F.struct("ts", "_lost").alias("_last"), F.lit(0).alias("_side"))
    row = F.struct(*signals.columns)
    both = closes.unionByName(signals.select("symbol", "ts", row.alias("_row"), F.lit(1).alias("_side")), allowMissingColumns=True)
    out = carry_forward(both, "_last", ("symbol",), ("ts", "_side", "_last"), F.date_trunc("day", "ts")).where("_side = 1")
    blocked = F.col("_last._lost") & (age_hours("_last.ts", "ts") < hours)
    return out.where(~F.coalesce(blocked, F.lit(False))).select("_row.*")


def position_symbols(positions: DataFrame) -> DataFrame:
    return positions.where("size <> 0").withColumn("symbol", base_asset("instrument_name"))


def ghosts(open_trades: DataFrame, positions: DataFrame) -> DataFrame:
    """Trades that the ledger holds open without a live position."""
    return open_trades.where(~F.coalesce("closed", F.lit(False))).join(position_symbols(positions).select("symbol"), "symbol", "left_anti")


def orphans(open_trades: DataFrame, positions: DataFrame) -> DataFrame:
    """Live positions without an open trade."""
    return position_symbols(positions).join(open_trades.where(~F.coalesce("closed", F.lit(False))).select("symbol"), "symbol", "left_anti")


def reconcile(trades: DataFrame, fills: DataFrame) -> DataFrame:
    """Ghost trades closed at their symbol's last fill of the opposite direction, with result and reason.

    Without such a fill the result is 0 and the trade is an unrecoverable ghost.
    """
    last = fills.groupBy("symbol", "direction").agg(F.max_by("price", F.struct("ts", "order_id")).alias("close_price"))
    buy = F.col("signal") == "BUY"
    df = trades.drop("close_price", "pnl", "close_reason").withColumn("direction", F.when(buy, "sell").otherwise("buy")).join(last, ["symbol", "direction"], "left")
    p = F.col("close_price")
    found = F.coalesce((p > 0) & (F.col("qty") > 0), F.lit(False))
    past = lambda level: F.when(buy, p >= F.col(level) * 0.998).otherwise(p <= F.col(level) * 1.002)
    reason = F.when(~found, GHOST).when(past("tp2"), "TP2 hit").when(past("tp1"), "TP1 hit").otherwise("SL hit")
    pnl = F.when(found, F.bround(F.when(buy, p - F.col("entry")).otherwise(F.col("entry") - p) * F.col("qty"), 4)).otherwise(0.0)
    return df.withColumns({"close_reason": reason, "pnl": pnl, "close_price": F.when(found, p).otherwise(F.col("entry"))}).drop("direction")


def mark_to_market(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Open trades with live price, unrealised result, result in percent and progress to the second target."""
    df = trades.where(~F.coalesce("closed", F.lit(False))).join(prices.select("symbol", F.col("price").alias("live_price")), "symbol", "left")
    side = F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    gap = F.col("live_price") - F.col("entry")
    known = (F.col("live_price") > 0) & (F.col("entry") > 0)
    progress = clip(100 * div(F.abs(gap), F.abs(F.col("tp2") - F.col("entry"))), 0.0, 100.0)
    zero = lambda c: F.coalesce(F.when(known, c), F.lit(0.0))
    return df.withColumns({"unrealised": zero(F.bround(side * gap * F.col("qty"), 4)), "pnl_pct": zero(100 * side * gap / F.col("entry")), "progress": zero(F.when(F.col("tp2") > 0, progress))})


def funding_gate(signals: DataFrame, rates: DataFrame, warn_pct: float = 0.05, skip_pct: float = 0.10) -> DataFrame:
    """Signals with ``funding``: skip, warn or ok, by the rate that their side would pay."""
    df = signals.join(rates.select("symbol", "rate"), "symbol", "left")
    pays = ((F.col("signal") == "BUY") & (F.col("rate") > 0)) | ((F.col("signal") == "SELL") & (F.col("rate") < 0))
    pct = F.abs("rate") * 100
    return df.withColumn("funding", F.when(pays & (pct >= skip_pct), "skip").when(pays & (pct >= warn_pct), "warn").otherwise("ok"))


def funding_drag(trades: DataFrame, rates: DataFrame, now: Column, warn_pct: float = 0.05, skip_pct: float = 0.10) -> DataFrame:
    """Open trades that pay funding worth a warning, with what it has cost since they opened."""
    df = funding_gate(trades.where(~F.coalesce("closed", F.lit(False))), rates, warn_pct, skip_pct).where("funding <> 'ok'")
    df = df.withColumn("age_h", age_hours("opened_at", now))
    return df.withColumn("drag_pct", F.abs("rate") * 100 * F.col("age_h") / 8)

"""Exits, position cap, costs, compounding and metrics of simulated trades."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div
from tidemark.operators.labels import ARRAY_BARS, first_hit, first_touches
from tidemark.operators.series import SERIES, TIME, by_time, union_all
from tidemark.operators.stretches import carried, in_blocks, numbered
from tidemark.sources.shared import written

FEE, SLIPPAGE, RISK, LEVERAGE, START = 0.0005, 0.0005, 0.01, 10.0, 100_000.0
STOP_ATR, TP1_ATR = 2.5, 3.5


def forward_bars(signals: DataFrame, bars: DataFrame, n: int = 24, by: Sequence[str] = SERIES) -> DataFrame:
    """Each signal with its next n bars, by bar number. Signals are few next to bars, and n is small."""
    w = by_time(by)
    numbered = bars.withColumn("seq", F.row_number().over(w))
    at = signals.join(numbered.select(*by, TIME, F.col("seq").alias("_at")), [*by, TIME])
    steps = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("seq", F.col("_at") + F.col("step")).drop("_at")
    later = numbered.select(*by, "seq", F.col(TIME).alias("bar_time"), *[F.col(c).alias(f"bar_{c}") for c in ("high", "low", "close")])
    return steps.join(later, [*by, "seq"]).drop("seq")


def simulate_exits(bars: DataFrame, n: int = 24, stop: float = STOP_ATR, target: float = TP1_ATR, by: Sequence[str] = SERIES) -> DataFrame:
    """Trades of the bars that carry a signal (BUY or SELL): first touch of stop or target in n bars, else a
    time exit at the close of bar n. On a tie in one bar the stop comes first.

    Up to ``ARRAY_BARS`` bars come from a window, so signals are joined with nothing; longer horizons skip by blocks. A
    series' last n bars give no trade.
    """
    side = F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    buy = F.col("signal") == "BUY"
    priced = {"entry": F.col("close"), "stop": F.col("close") - side * stop * F.col("atr"), "tp1": F.col("close") + side * target * F.col("atr")}
    fired = (F.col("signal") != "NO_TRADE") & (F.col("atr") > 0)
    if n > ARRAY_BARS:
        df = _far_exits(bars, n, fired, priced, by)
    else:
        path = F.collect_list(F.struct(F.col(TIME).alias("t"), "high", "low", "close")).over(by_time(by).rowsBetween(1, n))
        df = bars.withColumn("_path", path).where(fired & (F.size("_path") == n)).withColumns(priced)
        lost = first_hit(F.col("_path"), lambda b: F.when(buy, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop")))
        won = first_hit(F.col("_path"), lambda b: F.when(buy, b["high"] >= F.col("tp1")).otherwise(b["low"] <= F.col("tp1")))
        df = df.withColumns({"_lost": F.coalesce(lost, F.lit(n + 1)), "_won": F.coalesce(won, F.lit(n + 1))})
        df = df.withColumn("_bar", F.get("_path", F.least("_lost", "_won", F.lit(n)).cast("int") - 1))
    stopped, reached = (F.col("_lost") <= n) & (F.col("_lost") <= F.col("_won")), F.col("_won") <= n
    return df.where("stop > 0 AND tp1 > 0").select(
        *by, "signal", "confidence", F.col(TIME).alias("entry_time"), F.col("_bar.t").alias("exit_time"), "entry", "stop", "tp1",
        F.when(stopped, "SL").when(reached, "TP1").otherwise("TIME_EXIT").alias("outcome"),
        F.when(stopped, F.col("stop")).when(reached, F.col("tp1")).otherwise(F.col("_bar.close")).alias("exit_price"),
    )


def _far_exits(bars: DataFrame, n: int, fired: Column, priced: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """Signals with the bars until their stop and target, and the bar that ends them."""
    rows = numbered(bars, by, [TIME]).withColumnRenamed("row_no", "_row")
    points = rows.where(fired & (F.col("_row") + n < F.col("rows_in"))).withColumns(priced)
    buy = F.col("signal") == "BUY"
    low, high = F.lit(float("-inf")), F.lit(float("inf"))  # levels that nothing touches
    levels = {
        "_low_stop": ("low", F.when(buy, F.col("stop")).otherwise(low)), "_high_stop": ("high", F.when(buy, high).otherwise(F.col("stop"))),
        "_high_goal": ("high", F.when(buy, F.col("tp1")).otherwise(high)), "_low_goal": ("low", F.when(buy, low).otherwise(F.col("tp1"))),
    }
    df = first_touches(points, rows, n, levels, by)
    df = df.withColumns({"_lost": F.coalesce("_low_stop", "_high_stop", F.lit(n + 1)), "_won": F.coalesce("_high_goal", "_low_goal", F.lit(n + 1))})
    df = df.withColumn("_end", F.col("_row") + F.least("_lost", "_won", F.lit(n)))
    ends = rows.select(*by, F.col("_row").alias("_end"), F.struct(F.col(TIME).alias("t"), "close").alias("_bar"))
    return df.join(ends, [*by, "_end"])


ENTERED = ("entry_time", "symbol")
EXITED = ("exit_time", "entry_time", "symbol")


def admit(trades: DataFrame, most: int = 10, by: Sequence[str] = ("run_id",), slice_rows: int | None = None) -> DataFrame:
    """In order of entry, trades while fewer than ``most`` admitted ones are still open.

    Admission depends on earlier admissions, so it is an ordered fold in each run. With ``slice_rows`` a run is cut
    wherever none of its candidates is open, which makes the parts independent; a part of more rows is folded a
    slice at a time, with the at most ``most`` exits that are still open carried from slice to slice.
    """
    if slice_rows:
        return _admit_in_slices(trades, most, by, slice_rows)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(ENTERED), kind="stable")
        return group[_taken(group["entry_time"], group["exit_time"], [], most)]

    return trades.groupBy(*by).applyInPandas(fold, trades.schema)


def _taken(starts, ends, open_until: list, most: int) -> list[bool]:
    """Which trades are admitted; ``open_until``, a heap of exits, is what is open before and after them."""
    taken = []
    for start, end in zip(starts, ends):
        while open_until and open_until[0] <= start:
            heapq.heappop(open_until)
        taken.append(len(open_until) < most)
        if taken[-1]:
            heapq.heappush(open_until, end)
    return taken


def _admit_in_slices(trades: DataFrame, most: int, by: Sequence[str], slice_rows: int) -> DataFrame:
    """Parts by a running maximum of exits and a running count of cuts, both carried from block to block."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = written(in_blocks(trades, slice_rows, by, *ENTERED).withColumns({"_in": micros("entry_time"), "_out": micros("exit_time")}), "trades")
    w = Window.partitionBy(*by, "_block").orderBy("_row")
    earlier, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = carried(rows, {"_held": F.max("_out")}, F.max, by)
    rows = rows.withColumn("_cut", F.coalesce(F.greatest("_held", F.max("_out").over(earlier)) <= F.col("_in"), F.lit(True)).cast("long"))
    rows = carried(rows, {"_cuts": F.sum("_cut")}, F.sum, by).withColumn("_part", F.coalesce("_cuts", F.lit(0)) + F.sum("_cut").over(upto))
    firsts = rows.groupBy(*by, "_part").agg(F.min("_block").alias("_first"))
    rows = written(rows.join(firsts, [*by, "_part"]).withColumn("_step", F.col("_block") - F.col("_first")).drop("_held", "_cut", "_cuts", "_first"), "parts")
    part = (*by, "_part")
    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in part)
    folded = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _taken boolean, _until array<long>"

    def fold(key: tuple, group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", kind="stable")
        heap = sorted(int(x) for x in state["_until"].iloc[0]) if len(state) else []
        group["_taken"] = _taken(group["_in"].tolist(), group["_out"].tolist(), heap, most)
        group["_until"] = pd.Series([*[None] * (len(group) - 1), heap] if len(group) else [], group.index, dtype=object)
        return group

    last = rows.agg(F.max("_step")).first()[0]
    state, done = trades.sparkSession.createDataFrame([], f"{keyed}, _until array<long>"), []
    for step in range((last or 0) + 1):  # one, but for parts of more than a slice
        now = rows.where(F.col("_step") == step)
        out = written(now.groupBy(*part).cogroup(state.groupBy(*part)).applyInPandas(fold, folded), "slice")
        state = out.where("_until IS NOT NULL").select(*part, "_until")
        done.append(out.where("_taken").select(*trades.columns))
    return union_all(done)


def trade_returns(trades: DataFrame, fee: float = FEE, slippage: float = SLIPPAGE, risk: float = RISK, leverage: float = LEVERAGE) -> DataFrame:
    """Notional over equity, return on equity after slippage and fees, and multiple of the risk taken."""
    side = F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    fill_in, fill_out = F.col("entry") * (1 + side * slippage), F.col("exit_price") * (1 - side * slippage)
    distance = F.abs(F.col("entry") - F.col("stop")) / F.col("entry")
    wanted = F.coalesce(div(F.lit(risk), distance), F.lit(0.0))
    df = trades.withColumns({"notional": F.least(wanted, F.lit(leverage)), "capped": wanted > leverage, "_risk": distance})
    df = df.withColumn("ret", F.col("notional") * (side * (fill_out - fill_in) / fill_in - 2 * fee))
    return df.withColumn("r_multiple", F.coalesce(div("ret", F.col("notional") * F.col("_risk")), F.lit(0.0))).drop("_risk")


def equity_curve(trades: DataFrame, start: float = START, by: Sequence[str] = ("run_id",), slice_rows: int | None = None) -> DataFrame:
    """Equity, peak and drawdown in order of exit. Returns do not depend on equity, so it is a running product,
    as the exponential of a running sum; a loss of everything stays a loss of everything. With ``slice_rows`` sums and
    peaks run in slices of a run, onto what the slices before have come to."""
    growth = F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)
    lost = (F.col("ret") <= -1).cast("int")
    df = trades.withColumns({"_before": F.lit(0.0), "_ruined": F.lit(0), "_peak": F.lit(start)})
    key = list(by)
    if slice_rows:
        df = written(in_blocks(trades, slice_rows, by, *EXITED), "returns")
        df = carried(df, {"_before": F.sum(growth), "_ruined": F.max(lost)}, lambda n: F.sum(n) if n == "_before" else F.max(n), by)
        key.append("_block")
    w = Window.partitionBy(*key).orderBy(*EXITED).rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.greatest(F.max(lost).over(w), F.col("_ruined")) > 0
    df = df.withColumn("equity", F.when(ruined, 0.0).otherwise(start * F.exp(F.sum(growth).over(w) + F.coalesce("_before", F.lit(0.0)))))
    if slice_rows:
        df = carried(df, {"_peak": F.max("equity")}, F.max, by)
    df = df.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(start), F.col("_peak"))).drop("_before", "_ruined", "_peak", "_block", "_row")
    return df.withColumns({"drawdown": (F.col("peak") - F.col("equity")) / F.col("peak"), "pnl": F.col("equity") * div("ret", 1 + F.col("ret"))})


def backtest_metrics(curve: DataFrame, signals: int | None = None, start: float = START, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run. ``profit_factor`` is null with ``no_losses`` where nothing was lost."""
    won = F.col("pnl") > 0
    spread = F.timestamp_diff("SECOND", F.min_by("entry_time", F.struct("exit_time", "entry_time", "symbol")), F.max("exit_time")) / 86_400
    out = curve.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.count_if("capped").alias("leverage_capped"),
        F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("gross_win"), F.coalesce(F.sum(F.when(~won, -F.col("pnl"))), F.lit(0.0)).alias("gross_loss"),
        F.avg("r_multiple").alias("avg_r"), F.stddev_pop("r_multiple").alias("std_r"), F.max("drawdown").alias("max_drawdown"),
        F.max_by("equity", F.struct("exit_time", "entry_time", "symbol")).alias("ending_equity"), spread.alias("days"),
    )
    per_year = F.when(F.col("days") > 0, F.col("trades") / F.col("days") * 365).otherwise(0.0)
    sharpe = F.when(F.col("std_r") > 0, F.col("avg_r") / F.col("std_r")).otherwise(0.0)
    out = out.withColumns({
        "win_rate": F.col("wins") / F.col("trades"), "profit_factor": div("gross_win", "gross_loss"), "no_losses": (F.col("gross_loss") == 0) & (F.col("gross_win") > 0),
        "sharpe_per_trade": sharpe, "sharpe_annualized": sharpe * F.sqrt(per_year), "trades_per_year": per_year, "total_return": F.col("ending_equity") / start - 1,
    })
    return out if signals is None else out.withColumns({"signals": F.lit(signals), "skipped": F.lit(signals) - F.col("trades")})


def leaderboard(runs: DataFrame, n: int = 15) -> DataFrame:
    """The n best runs by annualised Sharpe ratio, those without one last."""
    best = runs.withColumn("_key", F.coalesce("sharpe_annualized", F.lit(-999.0))).orderBy(F.desc("_key"), "run_id").limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_key"), "run_id"))).drop("_key")

"""As-of joins by one union and a window by stretch of time, and the cross-asset features built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip
from tidemark.operators.series import SERIES, TIME, by_time, latest, pct_change, rolling
from tidemark.operators.stretches import carried
from tidemark.sources.shared import written


def carry_forward(both: DataFrame, value: str, by: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """``value`` with its last one that is not null, in ``order``, of each ``by`` group.

    ``bucket`` must not fall along the order. Rows are sorted in their bucket only; what a bucket starts with comes
    from the earlier buckets' last values, a row each. So a group that holds most rows is spread over tasks.
    """
    both = both.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    out = carried(both, {"_before": last}, lambda n: F.last(n, ignorenulls=True), by, "_bucket")
    return out.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_before"))).drop("_before", "_bucket")


def asof_join(
    left: DataFrame, right: DataFrame, cols: dict[str, str], by: Sequence[str], defaults: dict[str, float] | None = None,
    on: str = TIME, right_on: str | None = None, least_rows: int = 0, every: str = "day",
) -> DataFrame:
    """``left`` with the values of the last right row at or before its time, in the same ``by`` group.

    ``cols`` maps right columns to new names. Both sides are put together and the last right struct is carried
    forward: no row is ever paired with more than one. Rows are sorted by group and stretch of time (``every``, a unit of
    ``date_trunc``), and each stretch begins with the last right row of the stretches before it. Of right rows at one
    time, the largest values win. A group with fewer than ``least_rows`` right rows counts as having none.
    ``right_on`` may name the close time of a right bar, which keeps the future out.
    """
    new = list(cols.values())
    left = left.drop(*new)
    value = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    r = right.where(F.col(right_on or on).isNotNull())
    if least_rows:
        many = right.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows)
        r = r.join(many.select(*by), list(by), "left_semi")
    r = r.select(*by, F.col(right_on or on).alias("_t"), value.alias("_v"), F.lit(0).alias("_side"))
    row = F.struct(*left.columns)
    both = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), row.alias("_row")).unionByName(r, allowMissingColumns=True)
    # Right rows of a time come before left rows of that time.
    out = carry_forward(both, "_v", by, ("_t", "_side", "_v"), F.date_trunc(every, "_t")).where("_side = 1")
    filled = [F.coalesce(f"_v.{n}", F.lit((defaults or {}).get(n))).alias(n) if n in (defaults or {}) else F.col(f"_v.{n}").alias(n) for n in new]
    return out.select("_row.*", *filled)


def align_1h(bars: DataFrame, hourly: DataFrame, by: Sequence[str] = ("symbol", "segment"), right_on: str | None = None) -> DataFrame:
    cols = {"rsi": "rsi_1h", "adx": "adx_1h", "trend": "trend_1h"}
    return asof_join(bars, _made_once(hourly, cols, by, right_on), cols, by, {"rsi_1h": 50.0, "adx_1h": 0.0, "trend_1h": 0.0}, right_on=right_on, least_rows=5)


def align_4h(bars: DataFrame, slow: DataFrame, by: Sequence[str] = ("symbol", "segment"), right_on: str | None = None) -> DataFrame:
    cols = {"rsi": "rsi_4h", "trend": "trend_4h"}
    return asof_join(bars, _made_once(slow, cols, by, right_on), cols, by, {"rsi_4h": 50.0, "trend_4h": 0.0}, right_on=right_on, least_rows=5)


def _made_once(slow: DataFrame, cols: dict[str, str], by: Sequence[str], right_on: str | None) -> DataFrame:
    """The few columns that a join reads of a slower timeframe, written: it reads them three times."""
    return written(slow.select(*by, right_on or TIME, *cols), "slower")


def closing(bars: DataFrame, hours: int) -> DataFrame:
    """Bars with their close time, for joins that must not see an unfinished bar."""
    return bars.withColumn("close_time", F.col(TIME) + F.expr(f"INTERVAL {hours} HOURS"))


def asof_benchmark(bars: DataFrame, benchmark: DataFrame, name: str = "btc_close", every: str = "hour") -> DataFrame:
    """The benchmark's last close at or before each bar of every symbol of its segment.

    All symbols meet the benchmark's rows once, by segment and stretch of time.
    """
    return asof_join(bars, benchmark, {"close": name}, ("segment",), every=every)


def cross_asset(bars: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Correlation and beta to the benchmark over 20 returns (10 at least), and 6-bar relative strength.

    A series with at most 30 benchmark closes gets the defaults 0, 1 and 0.
    """
    w = by_time(by)
    whole = Window.partitionBy(*by)
    bars = bars.withColumns({"_own": pct_change(F.col("close"), 1, w), "_ref": pct_change(F.col("btc_close"), 1, w)})
    both = F.col("_own").isNotNull() & F.col("_ref").isNotNull()
    bars = bars.withColumns({"_x": F.when(both, F.col("_own")), "_y": F.when(both, F.col("_ref"))})
    frame = w.rowsBetween(-19, 0)
    enough = F.count("_x").over(frame) >= 10
    covariance = F.covar_samp("_x", "_y").over(frame)
    spread = F.stddev_samp("_x").over(frame) * F.stddev_samp("_y").over(frame)
    beta = F.try_divide(covariance, rolling(F.var_samp, "_ref", 20, w, 10))
    ahead = 100 * (pct_change(F.col("close"), 6, w) - pct_change(F.col("btc_close"), 6, w))
    known = F.count("btc_close").over(whole) > 30
    pick = lambda c, default, bound: F.when(known, clip(F.coalesce(c, F.lit(default)), -bound, bound)).otherwise(default)
    return bars.withColumns({
        "btc_corr_20": pick(F.when(enough, F.try_divide(covariance, spread)), 0.0, 1.0),
        "btc_beta_20": pick(F.when(enough, beta), 1.0, 5.0), "btc_rel_strength": pick(ahead, 0.0, 50.0),
    }).drop("_own", "_ref", "_x", "_y")


def restore_column(df: DataFrame, source: DataFrame, column: str, keys: Sequence[str] = (*SERIES, TIME)) -> DataFrame:
    """A column put back from another table by key and time."""
    return df.drop(column).join(source.select(*keys, column), list(keys), "left")


def latest_htf(entry: DataFrame, slower: DataFrame, suffix: str, cols: Sequence[str] = ("rsi", "adx", "trend", "ema20", "ema50")) -> DataFrame:
    """The newest entry row of each symbol with the newest row of a slower timeframe."""
    slow = latest(slower.select("symbol", TIME, *cols), ("symbol",)).drop(TIME)
    return latest(entry, ("symbol",)).join(slow.select("symbol", *[F.col(c).alias(f"{c}_{suffix}") for c in cols]), "symbol", "left")

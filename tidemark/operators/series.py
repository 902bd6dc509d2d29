"""Windows over bar series: one specification for all, so that Spark shuffles and sorts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("symbol", "interval", "segment")
TIME = "open_time"


def by_time(by: Sequence[str] = SERIES, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time)


def rolling(how, c: Column | str, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Aggregate of the last n rows, missing unless ``least`` (n by default) of them have a value."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) >= (least or n), how(c).over(frame))


def change(c: Column, n: int, w: WindowSpec) -> Column:
    return c - F.lag(c, n).over(w)


def pct_change(c: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(c, F.lag(c, n).over(w)) - 1


def with_segment(bars: DataFrame, segment: str = "all") -> DataFrame:
    return bars if "segment" in bars.columns else bars.withColumn("segment", F.lit(segment))


def min_bars(bars: DataFrame, n: int, by: Sequence[str] = SERIES) -> DataFrame:
    """Only series of at least n bars."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= n).drop("_n")


def finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))


def fill_features(df: DataFrame, cols: Sequence[str], by: Sequence[str] = SERIES, default: float = 0.0) -> DataFrame:
    """Infinite and NaN become missing, then the last value of the series, then the default."""
    upto = by_time(by).rowsBetween(Window.unboundedPreceding, 0)

    return df.withColumns({c: F.coalesce(F.last(finite(c), ignorenulls=True).over(upto), F.lit(default)) for c in cols})


def ensure_columns(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.lit(default) for c in cols if c not in df.columns})


def last_n(bars: DataFrame, n: int, by: Sequence[str] = ("symbol", "interval")) -> DataFrame:
    newest = Window.partitionBy(*by).orderBy(F.desc(TIME))
    return bars.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def latest(bars: DataFrame, by: Sequence[str] = ("symbol", "interval")) -> DataFrame:
    """The newest row of each series, by an aggregate rather than a sort."""
    rest = [c for c in bars.columns if c not in by]
    row = F.max_by(F.struct(*rest), TIME).alias("r")
    return bars.groupBy(*by).agg(row).select(*by, "r.*")


def after_cutoff(bars: DataFrame, trained_at: Column) -> DataFrame:
    return bars.where(F.col(TIME) > trained_at)


def tag_segments(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars inside named windows (label, start_ms, end_ms, candles): the first ``candles`` of each symbol.

    Bars and windows meet on the days of the windows.
    """
    ms = F.unix_millis(F.col(TIME).cast("timestamp"))
    day = lambda c: F.floor(F.col(c) / 86_400_000)
    days = windows.withColumn("_day", F.explode(F.sequence(day("start_ms"), day("end_ms"))))
    dated = bars.drop("segment").withColumn("_ms", ms).withColumn("_day", day("_ms"))
    inside = dated.join(days, "_day").where("_ms >= start_ms AND _ms <= end_ms").drop("_day", "_ms")
    first = Window.partitionBy("symbol", "interval", "label").orderBy(TIME)
    ranked = inside.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= F.col("candles"))
    return ranked.withColumnRenamed("label", "segment").drop("_n", "start_ms", "end_ms", "candles")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def recent(df: DataFrame, n: int, time: str, *then: str) -> DataFrame:
    """The newest n rows of the table, newest first; equal times by ``then``, descending."""
    return df.orderBy(F.desc(time), *map(F.desc, then)).limit(n)

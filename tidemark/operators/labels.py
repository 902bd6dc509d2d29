"""Labels from what prices do next."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import SERIES, TIME, by_time, min_bars
from tidemark.operators.stretches import numbered

STOP_ATR, TARGET_ATR = 2.5, 3.5


def make_targets(bars: DataFrame, n: int = 24, target: float = TARGET_ATR, stop: float = STOP_ATR, by: Sequence[str] = SERIES, trim: bool = True) -> DataFrame:
    """BUY if the target is touched and the stop never is in the next n bars, SELL mirrored, else NO_TRADE.

    ``trim`` drops the last n bars of a series, whose future is cut off.
    """
    ahead = by_time(by).rowsBetween(1, n)
    full = F.count("close").over(ahead) == n
    high, low = F.when(full, F.max("high").over(ahead)), F.when(full, F.min("low").over(ahead))
    c, a = F.col("close"), F.col("atr")
    sell = (low <= c - target * a) & (high < c + stop * a)
    buy = (high >= c + target * a) & (low > c - stop * a)
    out = bars.withColumn("target", F.when(sell, "SELL").when(buy, "BUY").otherwise("NO_TRADE"))
    return out.withColumn("_full", F.count(F.lit(1)).over(ahead) == n).where("_full").drop("_full") if trim else out


def first_hit(path: Column, test) -> Column:
    """Place, from 1, of the first bar of an array that meets the test; null if none does."""
    at = F.array_position(F.transform(path, test), F.lit(True))
    return F.when(at > 0, at)


ARRAY_BARS = 64  # horizons up to here carry their bars in an array; longer ones skip by blocks


def _touching(side: str, level: Column, name: str = ""):
    """Whether a bar's high (or low), in the field of that name, touches a level."""
    return lambda b: b[name or side] >= level if side == "high" else b[name or side] <= level


def first_touches(points: DataFrame, bars: DataFrame, n: int, levels: dict[str, tuple[str, Column]], by: Sequence[str] = SERIES) -> DataFrame:
    """``points`` with, for each level, the number of bars until it is first touched, from 1; null if n bars do not.

    ``points`` and ``bars`` have ``_row``, the bar's number in its series. A level is ("high", c), touched by a high of c or more, or
    ("low", c). Bars are gathered in blocks of about the root of n; a point looks at its own block's bars,
    then at the highest high and lowest low of the blocks ahead, and then at the bars of the one block that can touch first.
    """
    size = max(2, math.isqrt(n))
    numbered = bars.select(*by, F.floor(F.col("_row") / size).cast("long").alias("_b"), F.struct("_row", "high", "low").alias("_bar"))
    blocks = numbered.groupBy(*by, "_b").agg(F.array_sort(F.collect_list("_bar")).alias("_bars"), F.max("_bar.high").alias("_hi"), F.min("_bar.low").alias("_lo"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(1, -(-n // size))
    blocks = blocks.withColumn("_ahead", F.collect_list(F.struct("_b", "_hi", "_lo")).over(ahead))

    def first(at: Column, side: str, level: Column) -> Column:
        inside = lambda b: (b["_row"] > F.col("_row")) & (b["_row"] <= F.col("_row") + n)
        touching = _touching(side, level)
        hit = F.filter(at, lambda b: inside(b) & touching(b))
        return F.get(hit, F.lit(0))["_row"] - F.col("_row")

    keyed = points.withColumn("_b", F.floor(F.col("_row") / size).cast("long")).join(blocks.drop("_hi", "_lo"), [*by, "_b"])
    keyed = keyed.withColumns({f"_level_{k}": level for k, (_, level) in levels.items()})
    far = []
    for k, (side, _) in levels.items():
        level = F.col(f"_level_{k}")
        bound = "_hi" if side == "high" else "_lo"
        block = F.get(F.filter("_ahead", _touching(side, level, bound)), F.lit(0))["_b"]
        keyed = keyed.withColumn(k, first(F.col("_bars"), side, level))
        far.append(F.struct(F.lit(k).alias("name"), F.lit(side).alias("side"), level.alias("level"), F.when(F.col(k).isNull(), block).alias("block")))
    keyed = keyed.withColumn("_far", F.array(*far)).drop("_bars", "_ahead", "_b", *[f"_level_{k}" for k in levels])
    asked = keyed.select(*by, "_row", F.explode("_far").alias("f")).where("f.block IS NOT NULL").select(*by, "_row", "f.*")
    asked = asked.withColumnRenamed("block", "_b").join(blocks.select(*by, "_b", "_bars"), [*by, "_b"])
    hit = F.when(F.col("side") == "high", first(F.col("_bars"), "high", F.col("level"))).otherwise(first(F.col("_bars"), "low", F.col("level")))
    found = asked.select(*by, "_row", "name", hit.alias("at")).groupBy(*by, "_row").agg(*[F.max(F.when(F.col("name") == k, F.col("at"))).alias(f"_at_{k}") for k in levels])
    out = keyed.drop("_far").join(found, [*by, "_row"], "left")
    return out.withColumns({k: F.coalesce(k, f"_at_{k}") for k in levels}).drop(*[f"_at_{k}" for k in levels])


def first_touch_targets(
    bars: DataFrame, n: int = 12, target: float = 1.5, stop: float = 1.0, least_adx: float = 18.0, least_bars: int = 100, by: Sequence[str] = SERIES
) -> DataFrame:
    """BUY or SELL if only that direction's target is touched, no later than its stop, within n bars.

    Needs a trend (ADX) and a positive ATR; series of fewer than ``least_bars`` bars are left out.
    """
    c, a = F.col("close"), F.col("atr")
    levels = {"_up": ("high", c + target * a), "_up_stop": ("low", c - stop * a), "_down": ("low", c - target * a), "_down_stop": ("high", c + stop * a)}
    if n > ARRAY_BARS:
        rows = numbered(bars, by, [TIME]).withColumnRenamed("row_no", "_row").where(F.col("rows_in") >= least_bars)
        df = first_touches(rows, rows, n, levels, by).withColumn("_full", F.col("_row") + n < F.col("rows_in")).drop("_row", "rows_in")
    else:
        path = F.collect_list(F.struct("high", "low")).over(by_time(by).rowsBetween(1, n))
        df = min_bars(bars.withColumn("_path", path), least_bars, by)
        hits = {k: first_hit(F.col("_path"), _touching(*level)) for k, level in levels.items()}
        df = df.withColumns({**hits, "_full": F.size("_path") == n}).drop("_path")
    up, up_stop, down, down_stop = (F.coalesce(k, F.lit(n + 1)) for k in levels)
    buy, sell = (up <= n) & (up <= up_stop), (down <= n) & (down <= down_stop)
    ready = (F.col("adx") >= least_adx) & (a > 0) & F.col("_full")
    label = F.when(ready & buy & ~sell, "BUY").when(ready & sell & ~buy, "SELL").otherwise("NO_TRADE")
    return df.withColumn("target", label).drop("_full", *levels)

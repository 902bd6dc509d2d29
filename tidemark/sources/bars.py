"""Reading, building and writing bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.schemas import BARS

PRICES = ("open", "high", "low", "close", "volume")


def parse_klines(raw: DataFrame, strict: bool = False) -> DataFrame:
    """(symbol, interval, batch, payload) to typed bars; a payload is a JSON array of 12-element arrays.

    Numbers that do not parse become null; with ``strict`` they raise.
    """
    rows = raw.withColumn("k", F.explode(F.from_json("payload", "array<array<string>>")))
    number = (lambda i: F.get("k", F.lit(i)).cast("double")) if strict else (lambda i: F.get("k", F.lit(i)).try_cast("double"))
    time = F.timestamp_millis(F.get("k", F.lit(0)).try_cast("long"))
    prices = [number(i + 1).alias(name) for i, name in enumerate(PRICES)]
    return rows.select("symbol", "interval", "batch", time.alias("open_time"), *prices, number(9).alias("taker_buy_base_vol"))


def dedupe_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, interval, open_time): that of the newest batch, which has the least number."""
    newest = Window.partitionBy("symbol", "interval", "open_time").orderBy("batch")
    return bars.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def to_bars(ticks: DataFrame, every: str, interval: str | None = None) -> DataFrame:
    """Tumbling bars of ticks (symbol, ts, price, qty, is_taker_buy), batch or stream.

    Partial aggregation runs before the shuffle, so a hot symbol costs a row per window and task. Ticks of one time
    go by price.
    """
    turn = F.struct("ts", "price")
    bars = ticks.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", turn).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", turn).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.when(F.col("is_taker_buy"), F.col("qty")).otherwise(0.0)).alias("taker_buy_base_vol"),
    )
    return bars.select("symbol", F.lit(interval or every).alias("interval"), F.col("w.start").alias("open_time"), *PRICES, "taker_buy_base_vol")


def coarser_bars(bars: DataFrame, every: str, interval: str | None = None) -> DataFrame:
    """Bars of a longer interval from finer ones."""
    out = bars.groupBy("symbol", F.window("open_time", every).alias("w")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"), F.sum("taker_buy_base_vol").alias("taker_buy_base_vol"),
    )
    return out.select("symbol", F.lit(interval or every).alias("interval"), F.col("w.start").alias("open_time"), *PRICES, "taker_buy_base_vol")


def read_bars(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(BARS)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by interval, so that a reader of one interval prunes the others."""
    bars.write.mode(mode).partitionBy("interval").parquet(path)

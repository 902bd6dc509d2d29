"""Reading and appending trades, ledgers, signals and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import LEDGER, open_trades_type


def read_open_trades(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map symbol -> trade, one row per trade."""
    text = spark.read.option("wholetext", True).text(path)
    return parse_open_trades(text)


def parse_open_trades(text: DataFrame) -> DataFrame:
    trades = text.select(F.explode(F.from_json("value", open_trades_type())).alias("key", "t"))
    return trades.select(F.coalesce("t.symbol", "key").alias("symbol"), *[F.col(f"t.{c}") for c in trades.schema["t"].dataType.names if c != "symbol"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of closed or partial records; times with an offset or Z become timestamps."""
    rows = spark.read.schema(LEDGER).option("multiLine", True).json(path)
    return rows.withColumns({c: F.try_to_timestamp(c) for c in ("opened_at", "closed_at")})


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Plain append: a repeated call appends again. ``append_batch`` does not."""
    df.write.mode("append").format(form).save(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Rows of a named batch, a folder each; writing a batch again replaces what it wrote, so a retry changes nothing."""
    df.drop("batch").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """All batches; of rows with equal keys the one of the newest batch, which has the greatest name."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("batch", F.col("batch").cast("string"))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *rest)).alias("r")).select(*keys, "r.*")


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)

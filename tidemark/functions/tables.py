"""Small helpers on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row."""
    key = F.lit(1).alias("_one")
    return df.select("*", key).join(F.broadcast(one.limit(1).select("*", key)), "_one").drop("_one")

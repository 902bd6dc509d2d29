"""Series too long for one task: numbered, cut into blocks, with the rows before a block and the values carried into it.

Nothing here sorts or holds a whole series. Rows go to buckets of about equal depth by the quantiles of their
times, are ranked inside their bucket, and the buckets' counts are added up; so a day, an hour or a symbol that
holds most rows is spread like any other. Blocks are cut from the row numbers and therefore exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import SERIES, TIME

BUCKET_ROWS = 250_000
QUANTILES = 1_000  # bounds of a group at most; beyond, buckets hold a thousandth of their group
HIDDEN = ("_block", "_row", "_halo")


def equal_depth(df: DataFrame, by: Sequence[str], time: str = TIME, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_bucket``, which does not fall along ``time``: about ``rows`` rows of a group each.

    Bounds come from the quantiles of the groups of more than ``rows`` rows, so there are fewer bounds than one for
    ``rows`` rows of the table; other groups are one bucket. Rows of one time share a bucket.
    """
    steps = [k / QUANTILES for k in range(1, QUANTILES)]
    stats = df.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(time, steps, 20 * QUANTILES).alias("_q"))
    every = F.greatest(F.lit(1), F.floor(QUANTILES * F.lit(rows) / F.col("_n")).cast("int"))
    bounds = F.array_sort(F.array_distinct(F.filter("_q", lambda _, i: (i + 1) % F.col("_every") == 0)))
    bounds = stats.where(F.col("_n") > rows).withColumn("_every", every).select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], bounds.alias("_bounds"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    joined = df.join(bounds, same, "left") if by else df.join(F.broadcast(bounds), how="left")  # without groups, one row
    below = F.size(F.filter("_bounds", lambda b: b <= F.col(time)))
    return joined.withColumn("_bucket", F.when(F.col("_bounds").isNull(), 0).otherwise(below)).drop("_bounds", *[f"_by{k}" for k in range(len(by))])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], time: str = TIME, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``row_no`` (from 0) and ``rows_in`` of each ``by`` group in ``order``, of which ``time`` is the first."""
    df = equal_depth(df, by, time, rows)
    counts = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_first": F.coalesce(F.sum("_count").over(before), F.lit(0)), "rows_in": F.sum("_count").over(Window.partitionBy(*by))})
    counts = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate([*by, "_bucket"])], "_first", "rows_in")
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate([*by, "_bucket"])]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1)
    return ranked.join(counts, same).withColumn("row_no", F.col("_first") + F.col("_rank")).drop("_bucket", "_first", "_rank", *[f"_by{k}" for k in range(len(by) + 1)])


def in_blocks(df: DataFrame, block_rows: int, by: Sequence[str] = SERIES, time: str = TIME, *then: str) -> DataFrame:
    """``df`` with ``_row``, its number in its series by time and ``then``, and ``_block``, ``block_rows`` rows each but for the last."""
    rows = numbered(df, by, [time, *then], time, max(block_rows, BUCKET_ROWS)).drop("rows_in").withColumnRenamed("row_no", "_row")
    return rows.withColumn("_block", F.floor(F.col("_row") / block_rows).cast("long"))


def with_halo(df: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """Each block's last ``rows`` rows also in the next block, where ``_halo`` is true; frames of that reach are then whole."""
    if rows > block_rows:
        raise ValueError("a halo must not be longer than a block")
    last = F.col("_row") % block_rows >= block_rows - rows
    here, there = F.struct(F.col("_block").alias("b"), F.lit(False).alias("h")), F.struct((F.col("_block") + 1).alias("b"), F.lit(True).alias("h"))
    copies = df.withColumn("_to", F.explode(F.when(last, F.array(here, there)).otherwise(F.array(here))))
    return copies.withColumns({"_block": F.col("_to.b"), "_halo": F.col("_to.h")}).drop("_to")


def carried(df: DataFrame, of_block: dict[str, Column], over: Callable[[str], Column], by: Sequence[str] = SERIES, block: str = "_block") -> DataFrame:
    """``df`` with, for each name, ``over`` (an aggregate) of the earlier blocks' values; null in a series' first block.

    Blocks are one row each; only these are gathered by series.
    """
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, block).agg(*[c.alias(n) for n, c in of_block.items()])
    keys = [*by, block]
    sums = sums.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(keys)], *[over(n).over(before).alias(n) for n in of_block])
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(keys)]
    return df.join(sums, same, "left").drop(*[f"_by{k}" for k in range(len(keys))])

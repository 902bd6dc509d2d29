"""Embargoed chronological splits, walk-forward folds and exact undersampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import TIME
from tidemark.operators.stretches import BUCKET_ROWS, numbered

TEST_SHARE, CALIB_SHARE, EMBARGO = 0.20, 0.15, 24


def embargo_split(
    ds: DataFrame, by: Sequence[str] = ("regime",), test: float = TEST_SHARE, calib: float = CALIB_SHARE, gap: int = EMBARGO,
    order: Sequence[str] = (TIME, "symbol"), unit: str = "rows", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rows with ``part``: train, calib or test, in time order in each group; rows in the two gaps are left out.

    A group too small for both gaps is all train. ``unit`` 'bars' counts the sizes in distinct times instead of
    rows, so that the gap spans the same time for any number of symbols.
    """
    if unit == "bars":
        times = numbered(ds.select(*by, TIME).distinct(), by, [TIME], rows=bucket_rows)
        ranked = ds.join(times, [*by, TIME])
    else:
        ranked = numbered(ds, by, order, order[0], bucket_rows)
    n = F.col("rows_in")
    test_start = n - F.floor(n * test)
    calib_end = test_start - gap
    calib_start = calib_end - F.floor(n * calib)
    train_end = calib_start - gap
    i = F.col("row_no")
    part = F.when((train_end <= 0) | (i < train_end), "train").when((i >= calib_start) & (i < calib_end), "calib").when(i >= test_start, "test")
    return ranked.withColumn("part", part).where("part IS NOT NULL").drop("row_no", "rows_in")


def walk_forward_folds(ds: DataFrame, k: int = 5, gap: int = EMBARGO, order: Sequence[str] = (TIME, "symbol"), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows of k - 1 folds: train on the first blocks, test on the next after an embargo. Rows repeat by fold."""
    ranked = numbered(ds.withColumn("_all", F.lit(1)), ["_all"], order, order[0], bucket_rows).drop("_all")
    size = F.floor(F.col("rows_in") / k)
    skip = F.least(F.lit(gap), F.greatest(F.floor(size / 10), F.lit(1)))
    fold = ranked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
    train_end = F.col("fold") * size
    test_start = train_end + skip
    inside = test_start + size <= F.col("rows_in")
    i = F.col("row_no")
    part = F.when(i < train_end, "train").when((i >= test_start) & (i < test_start + size), "test")
    return fold.withColumn("part", F.when(inside, part)).where("part IS NOT NULL").drop("row_no", "rows_in")


def undersample(ds: DataFrame, key: Column, ratio: float = 1.0, seed: int = 42, majority: str = "NO_TRADE") -> DataFrame:
    """All signals, and exactly ratio times as many rows of the majority, those least in a keyed hash.

    The rows are counted by the first digits of their hash; whole buckets below the limit stay, and only the bucket
    that the limit falls into is sorted, a 65,536th of the majority.
    """
    counts = ds.groupBy((F.col("target") == majority).alias("major")).count().collect()
    sizes = {r["major"]: r["count"] for r in counts}
    keep = int(sizes.get(False, 0) * ratio)
    if sizes.get(True, 0) <= keep:
        return ds
    draw = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    major = ds.where(F.col("target") == majority).withColumn("_draw", draw).withColumn("_bucket", F.substring("_draw", 1, 4))
    upto = F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    row = major.groupBy("_bucket").count().withColumn("upto", upto).where(F.col("upto") > keep).orderBy("_bucket").first()
    below = major.where(F.col("_bucket") < row["_bucket"])
    edge = major.where(F.col("_bucket") == row["_bucket"]).orderBy("_draw", *ds.columns).limit(keep - (row["upto"] - row["count"]))
    return ds.where(F.col("target") != majority).unionByName(below.unionByName(edge).drop("_draw", "_bucket"))

"""Summaries of datasets, and scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import best_class, div

CLASSES = ("BUY", "NO_TRADE", "SELL")
GRID = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
META_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def label_distribution(ds: DataFrame, by: str = "regime") -> DataFrame:
    """Rows and share of each target, in all (null) and by segment, in one pass."""
    out = ds.groupingSets([["target"], [by, "target"]], by, "target").agg(F.count("*").alias("rows"))
    return out.withColumn("share", 100 * F.col("rows") / F.sum("rows").over(Window.partitionBy(by)))


def feature_coverage(ds: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Mean, deviation and share at the default of each feature, one row per feature."""
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.avg((F.col(c) == d).cast("double")).alias("at_default")) for c, d in defaults.items()]
    return ds.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("f")).select("f.*")


def dataset_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("interval").alias("intervals"),
        F.array_join(F.array_sort(F.collect_set("interval")), ",").alias("interval_names"),
    )


def classification_report(pred: DataFrame, label: str = "target", called: str = "call") -> DataFrame:
    """Precision, recall, F1 and support of each class, and the accuracy; 0 where nothing was called or true."""
    cells = pred.groupBy(F.col(label).alias("l"), F.col(called).alias("c")).count()
    each = cells.select(F.explode(F.array(F.struct(F.col("l").alias("class"), F.lit("true").alias("as")), F.struct(F.col("c").alias("class"), F.lit("called").alias("as")))).alias("x"), "count", (F.col("l") == F.col("c")).alias("hit")).select("x.*", "count", "hit")
    sums = each.groupBy("class").agg(*[F.coalesce(F.sum(F.when(t, F.col("count"))), F.lit(0)).alias(n) for n, t in (("support", F.col("as") == "true"), ("called", F.col("as") == "called"), ("hits", (F.col("as") == "true") & F.col("hit")))])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sums.withColumns({"precision": zero(div("hits", "called")), "recall": zero(div("hits", "support"))})
    out = out.withColumn("f1", zero(div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    every = Window.partitionBy()
    return out.withColumn("accuracy", F.sum("hits").over(every) / F.sum("support").over(every)).drop("hits")


def _grid(pred: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Each row once per threshold; the grid is a literal of a few numbers."""
    return pred.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))


def threshold_sweep(pred: DataFrame, grid: Sequence[float] = GRID, target: float = 3.5, stop: float = 2.5, least: int = 20) -> DataFrame:
    """Precision, recall, signals, result proxy and score of each threshold of (target, probs in class order).

    A direction is called only if its probability reaches the threshold. ``best`` marks the first best score
    above zero with more than ``least`` signals.
    """
    rows = pred.select("target", best_class("probs").alias("b"), F.array_max("probs").alias("p"))
    rows = _grid(rows, grid)
    call = F.when((F.col("b") != 1) & (F.col("p") < F.col("threshold")), 1).otherwise(F.col("b"))
    rows = rows.withColumns({"call": call, "t": F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("target")) - 1})
    is_ = lambda c, k: F.col(c) == k
    sums = rows.groupBy("threshold").agg(
        *[F.count_if(is_("call", k)).alias(f"called_{n}") for k, n in ((0, "buy"), (2, "sell"))], *[F.count_if(is_("t", k)).alias(f"true_{n}") for k, n in ((0, "buy"), (2, "sell"))],
        *[F.count_if(is_("t", k) & is_("call", k)).alias(f"hits_{n}") for k, n in ((0, "buy"), (2, "sell"))],
    )
    zero = lambda a, b: F.coalesce(div(a, b), F.lit(0.0))
    out = sums.withColumns({f"precision_{n}": zero(f"hits_{n}", f"called_{n}") for n in ("buy", "sell")})
    recall = (zero("hits_buy", "true_buy") + zero("hits_sell", "true_sell")) / 2
    n = F.col("called_buy") + F.col("called_sell")
    mean = (F.col("precision_buy") + F.col("precision_sell")) / 2
    value = lambda p: F.col(p) * target - (1 - F.col(p)) * stop
    buy, sell = value("precision_buy"), value("precision_sell")
    score = F.when((buy <= 0) | (sell <= 0), 0.0).otherwise((buy + sell) * recall * F.sqrt(F.greatest(n, F.lit(1))))
    out = out.withColumns({"signals": n, "avg_recall": recall, "pnl": n * mean * 200 - n * (1 - mean) * 100, "score": score})
    return _with_best(out.select("threshold", "signals", "precision_buy", "precision_sell", "avg_recall", "pnl", "score"), F.col("signals") > least)


def _with_best(scores: DataFrame, eligible: Column) -> DataFrame:
    """Marks the row of the largest positive score, the first threshold of equals; a row per threshold."""
    key = F.when(eligible & (F.col("score") > 0), F.struct("score", -F.col("threshold")))
    return scores.withColumn("best", F.coalesce(key == F.max(key).over(Window.partitionBy()), F.lit(False)))


def best_threshold(sweep: DataFrame, default: float) -> float:
    row = sweep.where("best").select("threshold").first()
    return row["threshold"] if row else default


def meta_threshold_sweep(pred: DataFrame, grid: Sequence[float] = META_GRID, least: int = 20) -> DataFrame:
    """Calls kept and their hit rate at each threshold of (p, meta_label)."""
    kept = _grid(pred, grid).where("p >= threshold").groupBy("threshold").agg(F.count("*").alias("selected"), F.avg("meta_label").alias("hit_rate"))
    kept = kept.where(F.col("selected") >= least).withColumn("score", F.col("hit_rate") * F.sqrt("selected"))
    return _with_best(kept, F.lit(True))


def meta_labels(pred: DataFrame, call: str = "call") -> DataFrame:
    """Directional calls, 1 where the call is the target."""
    return pred.where(F.col(call) != "NO_TRADE").withColumn("meta_label", (F.col(call) == F.col("target")).cast("int"))


def base_rate(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count("*").alias("calls"), F.sum("meta_label").alias("correct"), F.avg("meta_label").alias("base_rate"))


def walk_forward_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("folds"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def select_features(importances: DataFrame, essential: Sequence[str], k: int = 35) -> DataFrame:
    """The k most important features, the essential ones first of all."""
    forced = F.col("feature").isin(*essential)
    return importances.withColumn("forced", forced).orderBy(F.desc("forced"), F.desc("importance"), "feature").limit(k)

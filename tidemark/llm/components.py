"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _turned(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return _turned(links.join(least, "a").select("b", F.col("m")).unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``links`` (a, b, of any ordered type) to (node, root), root being the least node reached.

    A node without a link has no row. Each round is written to the shared folder, so a lost executor
    costs a round at most. The steps aggregate before they join; the links of one hub meet its least node in one
    task of the join, as a stream of rows of two numbers.
    """
    now = stored(_turned(links), "links")
    seen = None
    for _ in range(most_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == (row["n"], row["h"]) or not row["n"]:
            break
        seen = (row["n"], row["h"])
        now = stored(_small_star(_large_star(now)), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

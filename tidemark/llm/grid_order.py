"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). Vectors are projected on
the leading principal directions of a bounded sample; projections never lengthen distances. The vectors are
sorted by their grid cells of width eps on these directions, first direction first, and numbered in that order;
so many numbers in a row are a sequence interval, however the rows lie in partitions. Intervals form a tree, each
with the box of its projections. The join starts with the root and itself and goes down a level at a time: two
intervals whose boxes are further apart than eps cannot hold a link, and nothing below them is looked at. The
pairs of lowest intervals that are left meet in tasks, where the recursion goes on until boxes part them or few
vectors are left, whose cosines are computed in double precision.

How much the boxes part depends on the vectors: intervals of clusters are parted at once, those of vectors that
fill all directions alike are not, and then every pair of intervals is compared.

Equal vectors are one before the join, with their number, so a group of copies of any size costs one row. The
join returns counts of links by vector and links that span the groups, never the links themselves.

Vectors that are null, zero, of another length than most, or hold null or non-finite components link with
nothing: n_links 0, their own component, kept. A null vec_id is kept in a component of its own (null). Repeated
vec_ids with usable vectors are rows of their own, and count as others to each other. An empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import stored, table
from tidemark.llm.vectors import matrix, sample, usable

SLACK = 1e-9
BLOCK_ROWS = 8192  # of an interval that a task takes
FAN = 8  # intervals of a level in one of the level above
PARTS = 8  # at least so many ranges sort the rows


@dataclass(frozen=True)
class Grid:
    """Principal directions, longest spread first, and the width of a cell."""

    mean: np.ndarray
    directions: np.ndarray
    eps: float
    cosine: float

    def project(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.directions.T

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.floor(projected / self.eps).astype(np.int32)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def from_bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def fit(rows: DataFrame, cosine: float = 0.95, sampled: int = 10_000, directions: int = 12) -> Grid:
    """Principal directions of at most ``sampled`` vectors."""
    points = sample(rows, sampled)
    if not len(points):
        return Grid(np.zeros(1), np.zeros((1, 1)), 1.0, cosine)
    unit = unit_vectors(points)
    mean = unit.mean(0)
    _, vectors = np.linalg.eigh((unit - mean).T @ (unit - mean))
    return Grid(mean, vectors[:, ::-1][:, :directions].T.copy(), float(np.sqrt(max(0.0, 2 - 2 * cosine))), cosine)


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Least distance of two boxes (low, high)."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(np.sqrt((gap * gap).sum()))


class Join:
    """Recursive join of two sequence intervals, or of one with itself."""

    LEAF = 256

    def __init__(self, unit: np.ndarray, projected: np.ndarray, copies: np.ndarray, grid: Grid):
        self.unit, self.projected, self.copies, self.grid = unit, projected, copies.astype(np.float64), grid
        self.links = np.zeros(len(unit), np.int64)
        self.parent = np.arange(len(unit))
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.compared = self.parted = 0  # pairs of vectors

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            part = self.projected[a:b]
            self.boxes[a, b] = (part.min(0), part.max(0))
        return self.boxes[a, b]

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def roots(self, a: int, b: int) -> np.ndarray:
        out = self.parent[a:b]
        while not np.array_equal(up := self.parent[out], out):
            out = up
        self.parent[a:b] = out
        return out.copy()

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """All pairs of rows a..b with rows c..d; equal intervals give each pair once."""
        if a == b or c == d:
            return
        if apart(self.box(a, b), self.box(c, d)) > self.grid.eps + SLACK:
            self.parted += (b - a) * (d - c)
        elif b - a <= self.LEAF and d - c <= self.LEAF:
            self.compared += (b - a) * (d - c)
            self._leaf(a, b, c, d)
        elif (a, b) == (c, d):
            m = (a + b) // 2
            self.join(a, m, a, m)
            self.join(a, m, m, b)
            self.join(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d)
            self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m)
            self.join(a, b, m, d)

    def _leaf(self, a: int, b: int, c: int, d: int) -> None:
        hit = self.unit[a:b] @ self.unit[c:d].T >= self.grid.cosine
        if (a, b) == (c, d):
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        counted = hit.astype(np.float64)
        self.links[a:b] += (counted @ self.copies[c:d]).astype(np.int64)
        if (a, b) != (c, d):
            self.links[c:d] += (self.copies[a:b] @ counted).astype(np.int64)
        ours, theirs = self.roots(a, b), self.roots(c, d)
        new = hit & (ours[:, None] != theirs[None, :])
        for i in np.flatnonzero(new.any(1)).tolist():
            root = self.find(int(ours[i]))
            for other in np.unique(theirs[new[i]]).tolist():
                other = self.find(other)
                if other != root:
                    self.parent[other] = root


def sequence(rows: DataFrame, grid: Grid, block_rows: int) -> DataFrame:
    """Rows (id, unit, copies, seq, block): unit vectors as bytes, numbered in grid order; blocks of ``block_rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(grid)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = unit_vectors(matrix(batch["v"]))
                cells = shared.value.cells(shared.value.project(unit))
                yield pd.DataFrame({"id": batch["id"], "unit": [u.tobytes() for u in unit], "copies": batch["copies"], "cells": list(cells)})

    celled = rows.mapInPandas(cells, "id long, unit binary, copies long, cells array<int>")
    parts = max(1, -(-rows.count() // (8 * block_rows)))
    ranged = celled.repartitionByRange(max(parts, PARTS), "cells", "id").sortWithinPartitions("cells", "id")
    ordered = stored(ranged.drop("cells").withColumn("at", F.monotonically_increasing_id()), "grid-order")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", first.alias("first"))
    numbered = ordered.withColumn("part", part).join(starts, "part")
    seq = F.col("first") + F.col("at") - F.shiftleft("part", 33)
    return numbered.select("id", "unit", "copies", seq.alias("seq"), F.floor(seq / block_rows).cast("long").alias("block"))


def boxes(placed: DataFrame, grid: Grid) -> DataFrame:
    """(block, low, high): the box of each block's projections."""
    shared = placed.sparkSession.sparkContext.broadcast(grid)

    def box(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = shared.value
        for batch in batches:
            if len(batch):
                projected = grid.project(from_bytes(batch["unit"]))
                for block, at in batch.reset_index(drop=True).groupby("block").indices.items():
                    yield pd.DataFrame({"block": block, "d": range(len(grid.directions)), "low": projected[at].min(0), "high": projected[at].max(0)})

    sides = placed.select("block", "unit").mapInPandas(box, "block long, d int, low double, high double")
    return _in_order(sides)


def _in_order(sides: DataFrame) -> DataFrame:
    """(block, d, low, high), many rows a block and d, to (block, low, high) with arrays."""
    sides = sides.groupBy("block", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", c))), lambda s: s[c])
    return sides.groupBy("block").agg(ordered("low").alias("low"), ordered("high").alias("high"))


def parents(level: DataFrame) -> DataFrame:
    """The boxes of the next level up of the tree of intervals."""
    sides = level.select(F.floor(F.col("block") / FAN).cast("long").alias("block"), F.posexplode(F.arrays_zip("low", "high")).alias("d", "side"))
    return _in_order(sides.select("block", "d", "side.low", "side.high"))


def near_pairs(level: DataFrame, blocks: int, grid: Grid) -> DataFrame:
    """(left, right), left <= right, of the blocks whose boxes, and those of all above them, are within eps.

    Goes down the tree of intervals a level at a time; a level's pairs come from those kept on the one above.
    """
    levels = [stored(level, "boxes")]
    while blocks > FAN:
        levels.append(stored(parents(levels[-1]), "boxes"))
        blocks = -(-blocks // FAN)
    spark = level.sparkSession
    children = lambda c: F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)
    pairs = spark.createDataFrame([(0, 0)], "left long, right long")
    for boxes_ in reversed(levels):
        pairs = pairs.withColumn("left", F.explode(children("left"))).withColumn("right", F.explode(children("right"))).where("left <= right")
        a = boxes_.select(F.col("block").alias("left"), F.col("low").alias("l1"), F.col("high").alias("h1"))
        b = boxes_.select(F.col("block").alias("right"), F.col("low").alias("l2"), F.col("high").alias("h2"))
        gap = lambda x, y: F.greatest(F.lit(0.0), x - y)
        gaps = F.zip_with(F.zip_with("l1", "h2", gap), F.zip_with("l2", "h1", gap), lambda x, y: F.greatest(x, y))
        distance = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
        kept = pairs.join(a, "left").join(b, "right").where(distance <= (grid.eps + SLACK) ** 2)
        pairs = stored(kept.select("left", "right"), "block-pairs")
    return pairs


def epsilon_join(rows: DataFrame, grid: Grid, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, v, copies), ids distinct: (id, other, links), links by id, and spanning links where other is set."""
    placed = stored(sequence(rows, grid, block_rows), "blocks")
    shared = rows.sparkSession.sparkContext.broadcast(grid)
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    pairs = near_pairs(boxes(placed, grid), blocks, grid)
    ends = pairs.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    groups = min(max(1, pairs.count()), 8192)

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        grid = shared.value
        part = part.sort_values("seq", kind="stable")
        unit = from_bytes(part["unit"])
        work = Join(unit, grid.project(unit), part["copies"].to_numpy(np.int64), grid)
        n, m = len(part), int((part["block"] == key[0]).sum())
        if m == n:
            work.join(0, n, 0, n)
        else:
            work.join(0, m, m, n)
        ids = part["id"].to_numpy()
        root = ids[work.roots(0, n)]
        counted = pd.DataFrame({"id": ids, "other": pd.array([pd.NA] * n, "Int64"), "links": work.links})
        spans = pd.DataFrame({"id": ids, "other": pd.array(root, "Int64"), "links": 0})
        return pd.concat([counted[work.links > 0], spans[ids != root]])

    met = ends.join(placed, "block").repartition(groups, "left", "right")
    return met.groupBy("left", "right").applyInPandas(join, "id long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    rows = usable(vectors)
    distinct = stored(rows.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "distinct")
    # Equal vectors of one id are one row here too; ``key`` tells different vectors of one id apart.
    distinct = distinct.withColumn("key", F.monotonically_increasing_id())
    found = stored(epsilon_join(distinct.select(F.col("key").alias("id"), "v", "copies"), fit(rows, cosine), block_rows), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "key")
    root = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = distinct.join(links, "key", "left").join(root.withColumnRenamed("node", "key"), "key", "left")
    classes = classes.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("v", "n_links", "component_id")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # A vector that takes no part has no class. The join is on equality of whole vectors.
    joined = every.join(classes.withColumn("linked", F.lit(True)), "v", "left")
    taken = F.col("linked").isNotNull() & F.col("vec_id").isNotNull()
    joined = joined.select("vec_id", F.when(taken, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(taken, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9(spark, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.95 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_grid_order_join": op9}
ORACLES = {
    "op9_grid_order_join": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE v IS NOT NULL AND list_dot_product(v, v) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.95 * a.norm * b.norm),
r AS (SELECT a AS vec_id, a AS least FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.vec_id WHERE r.least < l.b),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT vec_id, min(least) AS least FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) AS kept
FROM v LEFT JOIN d ON d.a = v.vec_id LEFT JOIN c ON c.vec_id = v.vec_id"""
}

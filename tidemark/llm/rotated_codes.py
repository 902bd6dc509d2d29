"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is the nearest of a few centroids plus a residual. The unit residual is rotated at random and only
the signs are kept, packed to a bit per dimension, with two correction scalars: the residual's length, and
the inner product of the unit residual with its code. From these the inner product with a query is estimated
without bias, with an error bound that holds with high probability. In every block of codes that a query visits,
the vectors of the best estimates are compared exactly first; their k-th best inner product, or the query's floor
where that is higher, then decides by the bounds which others are compared. A block returns its k best.

A query goes first to the cells nearest to it, and to more until they hold enough vectors; the k-th best that these
return is its floor. Then it goes to the other cells, but for those where even a residual of the cell's greatest
length, at an angle that random directions hardly ever have, would stay below the floor. The centroids are fitted on a
bounded sample, which serves for nothing else; every vector is coded. The number of cells follows the number of vectors,
up to one for eight sampled vectors; beyond that the cells have more blocks.
Cells are cut into blocks of bounded size, so a cell of a third of all vectors is many groups. Of equal vectors
in a block only the smallest ids can be among a query's nearest, so the others are not compared.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
neither as query nor as candidate. Repeated ids stay candidates, each row of its own, but a query leaves out
all rows of its own id. Each row of a repeated query id is a query with its own k results. Ties go to the smaller
id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, table
from tidemark.llm.vectors import matrix, sample_with_ids, usable

CODED = "id long, v array<double>, cell int, bits binary, length double, agreement double"
ROUTED = "query_row long, query_id long, v array<double>, floor double, cell int"
FOUND = "query_row long, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    """Centroids, the rotation, and the widths of the search."""

    centroids: np.ndarray
    rotation: np.ndarray
    nearest_cells: int = 8
    angle: float = 5.0
    width: float = 2.5
    k: int = 20

    def near(self, queries: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Whether each query (row) goes to each cell first: the nearest cells, and more until they hold enough vectors."""
        toward = queries @ self.centroids.T
        out = np.zeros(toward.shape, bool)
        for nearness in (toward, 2 * toward - (self.centroids**2).sum(1)):
            order = np.argsort(-nearness, axis=1, kind="stable")
            size = held[order]
            early = (np.cumsum(size > 0, axis=1) <= self.nearest_cells) | (np.cumsum(size, axis=1) - size <= 4 * self.k)
            add = np.zeros_like(out)
            np.put_along_axis(add, order, early, 1)
            out |= add
        return out & (held > 0)

    def reached(self, queries: np.ndarray, floor: np.ndarray, held: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Whether each other cell may hold what reaches the query's floor, by the cell's longest residual."""
        norm = np.sqrt((queries**2).sum(1))[:, None]
        most = queries @ self.centroids.T + norm * longest * min(1.0, self.angle / np.sqrt(queries.shape[1]))
        return (most >= floor[:, None]) & ~self.near(queries, held) & (held > 0)

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, packed signs, residual length, and inner product of unit residual and code."""
        gap = (self.centroids**2).sum(1) - 2 * vectors @ self.centroids.T
        cell = gap.argmin(1)
        residual = vectors - self.centroids[cell]
        length = np.sqrt((residual**2).sum(1))
        rotated = residual @ self.rotation.T
        signs = rotated >= 0
        agreement = np.abs(rotated).sum(1) / (np.sqrt(vectors.shape[1]) * np.where(length > 0, length, 1))
        return cell, np.packbits(signs, axis=1), length, np.where(length > 0, agreement, 1.0)

    def bounds(self, queries: np.ndarray, cell: int, bits: np.ndarray, length: np.ndarray, agreement: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors) and the half-widths of their bounds."""
        d = queries.shape[1]
        signs = np.unpackbits(bits, axis=1)[:, :d].astype(np.float64) * 2 - 1
        turned = queries @ self.rotation.T
        estimate = (turned @ signs.T) * (length / (agreement * np.sqrt(d))) + (queries @ self.centroids[cell])[:, None]
        spread = length * np.sqrt(np.maximum(1 - agreement**2, 0)) / (agreement * np.sqrt(max(d - 1, 1)))
        return estimate, self.width * np.sqrt((queries**2).sum(1))[:, None] * spread + 1e-9


def fit(rows: DataFrame, sampled: int = 20_000, rows_per_cell: int = 4096, sampled_per_cell: int = 8, seed: int = 3) -> Index:
    """k-means on at most ``sampled`` vectors, with a cell for so many rows; the rotation is a random orthogonal matrix."""
    random = np.random.default_rng(seed)
    _, points = sample_with_ids(rows, sampled)
    d = points.shape[1] if len(points) else 1
    count = max(1, min(len(points) // sampled_per_cell, rows.count() // rows_per_cell))
    centroids = points[random.choice(len(points), count, replace=False)] if len(points) else np.zeros((1, d))
    for _ in range(12 if len(points) else 0):
        near = ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)
        size = np.bincount(near, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return Index(centroids, np.linalg.qr(random.normal(size=(d, d)))[0])


def encode(rows: DataFrame, index: Index) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            if len(batch):
                cell, bits, length, agreement = shared.value.code(matrix(batch["v"]))
                yield batch.assign(cell=cell, bits=[b.tobytes() for b in bits], length=length, agreement=agreement)

    return rows.mapInPandas(run, CODED)


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products that come out alike whatever other vectors are beside one."""
    return (vectors * query).sum(1)


def _nearest(index: Index, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The k best of a block for each query, of those compared exactly: the best estimates, then all in reach."""
    block = block.sort_values("id", kind="stable")
    vectors = matrix(block["v"])
    same = pd.Series([v.tobytes() for v in vectors])
    alike = pd.DataFrame({"v": same.to_numpy(), "id": block["id"].to_numpy()})
    own = alike.groupby(["v", "id"])["id"].transform("size").groupby(alike["v"]).transform("max")  # a query leaves out so many
    keep = (same.groupby(same).cumcount() < index.k + own).to_numpy()
    block, vectors = block[keep], vectors[keep]
    ids = block["id"].to_numpy()
    bits = np.frombuffer(b"".join(block["bits"]), np.uint8).reshape(len(block), -1)
    first = min(2 * index.k, len(ids))
    out = []
    for a in range(0, len(queries), 128):
        some = queries.iloc[a : a + 128]
        q, own, row = matrix(some["v"]), some["query_id"].to_numpy(), some["query_row"].to_numpy()
        estimate, half = index.bounds(q, int(block["cell"].iloc[0]), bits, block["length"].to_numpy(), block["agreement"].to_numpy())
        mine = own[:, None] == ids[None, :]
        estimate[mine] = -np.inf
        best_first = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
        floor = some["floor"].to_numpy()
        for i in range(len(some)):
            known = best_first[i]
            known = known[~mine[i, known]]
            exact = vectors[known] @ q[i]
            threshold = floor[i]
            if len(known) >= index.k:
                threshold = max(threshold, np.partition(exact, len(exact) - index.k)[len(exact) - index.k] - 1e-9)
            reach = estimate[i] + half[i] >= threshold
            if len(known) < index.k:
                reach[:] = True
            reach[mine[i]] = False
            reach[known] = True
            at = np.flatnonzero(reach)
            exact = vectors[at] @ q[i]
            at, exact = at[exact >= floor[i]], exact[exact >= floor[i]]
            best = at[np.lexsort((ids[at], -exact))[: index.k]]
            out.append(pd.DataFrame({"query_row": row[i], "query_id": own[i], "vec_id": ids[best], "score": inner(vectors[best], q[i])}))
    return pd.concat(out) if out else pd.DataFrame(columns=["query_row", "query_id", "vec_id", "score"])


def search(rows: DataFrame, index: Index, is_query: Column, block_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """The k nearest of each query row among all rows (id, v): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    coded = stored(encode(rows, index), "codes")
    held, longest = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("length").alias("length")).collect():  # a row per centroid
        held[r["cell"]], longest[r["cell"]] = r["n"], r["length"]
    blocks = spark.createDataFrame([(c, -(-int(n) // block_rows)) for c, n in enumerate(held)], "cell int, blocks int")
    shared = spark.sparkContext.broadcast((index, held, longest))

    def to_cells(first: bool):
        def route(batches):
            index, held, longest = shared.value
            for batch in batches:
                if len(batch):
                    vectors = matrix(batch["v"])
                    query, cell = np.nonzero(index.near(vectors, held) if first else index.reached(vectors, batch["floor"].to_numpy(), held, longest))
                    yield batch.iloc[query].assign(cell=cell)

        return route

    def find(_key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame(columns=["query_row", "query_id", "vec_id", "score"])
        return _nearest(shared.value[0], queries, block)

    def answered(routed: DataFrame) -> DataFrame:
        """What the blocks of the cells return, a row per query and vector."""
        queries = routed.join(F.broadcast(blocks), "cell")
        laps = queries.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / query_rows).cast("int").alias("laps"))
        plan = blocks.join(laps, "cell")  # a row per centroid
        queries = queries.join(F.broadcast(laps), "cell").withColumn("lap", F.pmod(F.xxhash64("query_row"), F.col("laps")).cast("int"))
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        data = coded.join(F.broadcast(plan), "cell").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int"))
        data = data.withColumn("lap", F.explode(F.sequence(F.lit(0), F.col("laps") - 1)))
        key = ["cell", "block", "lap"]
        total = plan.agg(F.sum(F.col("blocks") * F.col("laps")).alias("n")).first()["n"] or 1
        groups = min(max(int(total), 1), 4096)
        left = queries.select(*key, "query_row", "query_id", "v", "floor").repartition(groups, *key).groupBy(*key)
        right = data.select(*key, "id", "v", "bits", "length", "agreement").repartition(groups, *key).groupBy(*key)
        return left.cogroup(right).applyInPandas(find, FOUND)

    asked = coded.where(is_query).select(F.monotonically_increasing_id().alias("query_row"), F.col("id").alias("query_id"), "v", F.lit(float("-inf")).alias("floor"))
    asked = stored(asked, "asked")
    first = stored(answered(stored(asked.mapInPandas(to_cells(True), ROUTED), "routes")), "first")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    top = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= index.k)
    floors = top.where(F.col("rank") == index.k).select("query_row", (F.col("score") - 1e-9).alias("reached"))
    again = asked.join(floors, "query_row", "left").select("query_row", "query_id", "v", F.coalesce("reached", "floor").alias("floor"))
    rest = answered(stored(again.mapInPandas(to_cells(False), ROUTED), "routes"))
    found = top.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= index.k)
    return found.select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every vec_id divisible by 20, against all rows."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, fit(rows), F.col("id") % 20 == 0)


QUERIES = {"op5_rotated_code_search": op5}

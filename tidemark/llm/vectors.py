"""What the vector operators share: which vectors take part, and a bounded sample to fit an index on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of the vectors with finite components, not all zero, and an id; v is array<double>.

    Vectors of another length than the most frequent (the shorter on a tie) take no part.
    """
    v = F.col(column).cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.exists("v", lambda x: x != 0)).where(finite)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most n vectors, least in a hash of their id: a bounded sample that does not depend on order."""
    return sample_with_ids(rows, n)[1]


def sample_with_ids(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("id", "v").collect()
    ids = np.array([r["id"] for r in got], dtype=np.int64)
    return ids, np.array([r["v"] for r in got], dtype=np.float64).reshape(len(got), -1) if got else np.empty((0, 1))


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))

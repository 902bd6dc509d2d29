"""The folder that all executors share, and other small helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a new local one where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_volume(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the column, for sizing the number of groups that a job deals its rows to."""
    row = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(volume: int, each: int = 16 << 20, most: int = 20_000) -> int:
    """Partitions of about ``each`` bytes; beyond ``most`` they grow instead, so that files and tasks stay countable."""
    return max(1, -(-volume // max(each, volume // most)))


def open_filesystem(uri: str):
    """pyarrow's file system and path of a URI, so that tasks reach any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)

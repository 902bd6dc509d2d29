"""Mixing sources to target weights by Pfair scheduling of blocks.

A source of weight w (of a sum of 1) owes its block j no earlier than slot floor(j / w) (release) and no later than
slot ceil((j + 1) / w) (deadline), both from the exact weight. In each slot the released block of the earliest
deadline goes next, which keeps every source less than one block from its share at every slot while it has blocks.
The schedule is worked out for the blocks there are, a stretch at a time, and a document finds its slot by a join
with it. When a source has no blocks left its slots stay empty and no block of the others comes before its release.

Documents are placed in their source by a hash; the number within a source comes from counts of hash buckets
and ranks inside them, so a source of a third of all rows is spread over tasks. Every document is placed.

The driver names at most ``named`` sources, the largest; the others share hash groups with their joint weight, and
a group's slots are dealt to its members by a schedule of their own, from their own weights, in a task. A member is
thus less than one block from its share of the group's slots, and less than two from its share of all. The driver
holds a number for each block of a group, and a stretch of the schedule.

A null source is a source. Weights default to the square root of a source's characters; ``weights`` (source,
weight) overrides them; a weight below a 2^32nd of the largest counts as that, and the sources it lacks or gives no positive, finite weight come after all others, in equal shares.
Ties in hash go by doc_id, then by text length; repeated rows are documents of their own; null text
counts as empty. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import new_path, parts_for, stored, table, text_volume

BROADCAST_BLOCKS = 250_000
LEAST_SHARE = 2.0**-32  # of the largest weight; slots of less would not fit 64 bits


@dataclass(frozen=True)
class Mix:
    block_docs: int = 64
    slots: int = 1 << 20  # blocks of the schedule that the driver writes at a time
    most_blocks: int = 1 << 24  # of all sources; a block is larger where the documents would make more
    named: int = 16_384
    rest_groups: int = 256
    bucket_docs: int = 50_000


def whole(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the (floating-point, positive) weights."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    common = max((d for _, d in ratios), default=1)  # all are powers of two
    return [n * (common // d) for n, d in ratios]


def schedule(weights: Sequence[int], blocks: Sequence[int | np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) in order of slot; ``blocks`` has each source's number of blocks, or the blocks it has."""
    total = sum(weights)
    blocks = [range(b) if isinstance(b, int) else b for b in blocks]
    upcoming: list[tuple[int, int, int]] = []
    ready: list[tuple[int, int, int]] = []

    def announce(i: int, at: int) -> None:
        if at < len(blocks[i]):
            heapq.heappush(upcoming, (int(blocks[i][at]) * total // weights[i], i, at))

    for i in range(len(weights)):
        announce(i, 0)
    slot = 0
    while upcoming or ready:
        if not ready:
            slot = max(slot, upcoming[0][0])
        while upcoming and upcoming[0][0] <= slot:
            _, i, at = heapq.heappop(upcoming)
            j = int(blocks[i][at])
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
            announce(i, at + 1)
        deadline, i, j = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block is late; the shares exceed the slots")
        yield i, j, slot
        slot += 1


def period(slots_of: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, its block within the period, slot) of one period; sources have whole numbers of slots."""
    names = sorted(slots_of)
    counts = [slots_of[n] for n in names]
    return [(names[i], j, slot) for i, j, slot in schedule(counts, counts)]


def whole_slots(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Weights rounded to whole slots of a period, for a table of one ``period``; ``placed`` does not round."""
    total = sum(weights.values()) or 1.0
    return {k: max(1, round(slots * w / total)) for k, w in weights.items()}


def scheduled(volume: DataFrame, mix: Mix) -> DataFrame:
    """entity, block, slot of every block; ``volume`` has entity, weight, blocks, and the phase (0, then 1)."""
    spark = volume.sparkSession
    named = volume.orderBy("phase", F.desc("weight"), "entity").limit(mix.named).select("phase", "entity", "weight", "blocks").collect()
    known = spark.createDataFrame([(r["entity"],) for r in named], "entity string")
    group = F.concat(F.lit("~"), F.pmod(F.xxhash64("entity"), F.lit(mix.rest_groups)).cast("string"))
    rest = volume.join(F.broadcast(known), "entity", "left_anti").withColumn("group", group)

    def deal(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("entity")
        rows = list(schedule(whole(members["weight"]), [int(b) for b in members["blocks"]]))
        of, block, turn = np.array(rows, np.int64).T
        return pd.DataFrame({"phase": key[0], "group": key[1], "entity": members["entity"].to_numpy()[of], "block": block, "turn": turn})

    inner = stored(rest.groupBy("phase", "group").applyInPandas(deal, "phase int, group string, entity string, block long, turn long"), "groups")
    joint = rest.groupBy("phase", "group").agg(F.sum("weight").alias("weight")).collect()  # a row per group
    turns: dict[tuple[int, str], np.ndarray] = {}
    if joint:
        used = inner.select("phase", "group", "turn").toPandas()  # a number for each block of a group
        turns = {k: np.sort(g.to_numpy()) for k, g in used.groupby(["phase", "group"])["turn"]}
    path, begin = new_path(spark, "schedule"), 0
    kind = pa.schema([("phase", pa.int32()), ("entity", pa.string()), ("block", pa.int64()), ("slot", pa.int64())])
    for phase in (0, 1):
        some = [(r["entity"], r["weight"], int(r["blocks"])) for r in named if r["phase"] == phase]
        some += sorted((r["group"], r["weight"], turns[phase, r["group"]]) for r in joint if r["phase"] == phase)
        if not some:
            continue
        names, weights, blocks = (list(x) for x in zip(*some))
        rows, last = schedule(whole(weights), blocks), begin
        while part := list(islice(rows, mix.slots)):
            of, block, slot = zip(*part)
            last = begin + slot[-1] + 1
            columns = [[phase] * len(part), [names[i] for i in of], block, [begin + s for s in slot]]
            spark.createDataFrame(pa.table(columns, schema=kind)).write.mode("append").parquet(path)
        begin = last
    top = spark.read.schema("phase int, entity string, block long, slot long").parquet(path)
    if not joint:
        return top.select("entity", "block", "slot")
    ours = top.where(~F.col("entity").startswith("~")).select("entity", "block", "slot")
    theirs = top.where(F.col("entity").startswith("~")).select("phase", F.col("entity").alias("group"), F.col("block").alias("turn"), "slot")
    return ours.unionByName(inner.join(theirs, ["phase", "group", "turn"]).select("entity", "block", "slot"))


def placed(documents: DataFrame, weights: DataFrame | None = None, mix: Mix = Mix(), keep: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, source, entity, block, slot, place of every document; (slot, place) is the mixed order.

    ``row`` numbers the rows by partition and place, so the input must read alike each time.
    """
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    size = F.coalesce(F.length("text"), F.lit(0))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", source.alias("entity"), size.alias("size"), *keep)
    volume = rows.groupBy("entity").agg(F.sum("size").alias("chars"), F.count("*").alias("docs"))
    if weights is None:
        volume = volume.withColumn("weight", F.sqrt(F.greatest("chars", F.lit(1))))
    else:
        named = weights.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("entity"), F.col("weight").cast("double").alias("weight"))
        volume = volume.join(named, "entity", "left")
    weighed = F.coalesce((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.lit(False))  # NaN is above infinity
    volume = volume.withColumn("phase", F.when(weighed, 0).otherwise(1)).withColumn("weight", F.when(weighed, F.col("weight")).otherwise(1.0))
    volume = stored(volume, "volume")
    whole_ = volume.agg(F.sum("docs").alias("docs"), F.count("*").alias("sources"), F.max(F.when(F.col("phase") == 0, F.col("weight"))).alias("top")).first()
    if whole_["top"]:
        volume = volume.withColumn("weight", F.when(F.col("phase") == 0, F.greatest("weight", F.lit(whole_["top"] * LEAST_SHARE))).otherwise(F.col("weight")))
    block_docs = max(mix.block_docs, -(-(whole_["docs"] or 0) // mix.most_blocks))
    volume = volume.withColumn("blocks", F.ceil(F.col("docs") / block_docs))
    if not whole_["docs"]:
        return rows.select("row", "doc_id", "source", "entity", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "place")], *keep)
    slots = scheduled(volume, mix)
    slots = F.broadcast(slots) if whole_["docs"] / block_docs + whole_["sources"] <= BROADCAST_BLOCKS else slots.hint("merge")

    buckets = max(1, -(-whole_["docs"] // mix.bucket_docs))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", "row")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("entity", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("entity", "bucket").orderBy("h", "doc_id", "size", "row")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["entity", "bucket"])
    number = F.col("first") + F.col("rank")
    rows = rows.withColumn("block", F.floor(number / block_docs).cast("long")).withColumn("place", (number % block_docs).cast("long"))
    rows = rows.join(slots, ["entity", "block"])
    return rows.select("row", "doc_id", "source", "entity", "block", "slot", "place", *keep)


def in_mixed_order(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``documents`` with its columns, dealt and sorted by the mixed order."""
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    order = stored(placed(documents, mix=mix).select("row", "slot", "place"), "order")
    numbered = documents.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row"))
    return numbered.join(order, "row").repartitionByRange(parts_for(text_volume(documents)), "slot", "place").sortWithinPartitions("slot", "place").select("doc.*")


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix by the square roots of the sources' sizes."""
    return placed(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op4_pfair_mixing": op4}

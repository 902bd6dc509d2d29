"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

The genes are whole bins. Documents are dealt at random to shards of bounded size; a shard is one
packing problem, worked on by several islands, each a Spark group with a population of its own that
starts from best-fit-decreasing and perturbed packings. Crossover takes well-filled bins of one parent
whole, removes from the other parent every bin that holds one of their documents, lets the displaced
documents take the place of one or two smaller ones where they fill a bin better, and best-fits the rest.
After an epoch each island sends its best packings to the next island of the shard, and a second epoch
follows. A packing is never worse than best-fit decreasing of its shard; an island stops as soon as it
has as few bins as the lengths allow, or some generations have saved none. The bins that the best packing of a shard leaves badly filled are
dissolved, and their documents go through the same steps in new shards, until one shard holds the rest.

Documents in an order that matters (``ordered``) are dealt to shards as consecutive ranges of it. A sequence
bears the least key of its pieces, so that with ordered keys ``sequence_id`` rises with its first document.

Nothing whole is held anywhere: a group has the lengths of at most a few thousand pieces.

Equal lengths go by key. A null or empty text is the end id alone; a null doc_id is kept; repeated rows are
documents of their own; no documents give no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import END_ID, default_vocabulary, encoder
from tidemark.llm.shared import stored, table

CAPACITY = 1024
PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECE_BITS = 21  # of a key made of a document's position and the piece in it
NEAR_DOCS = 1024  # so many positions go to one shard together
STATE = "shard long, island int, bins long, fitness double, packing binary"


@dataclass(frozen=True)
class Evolution:
    """Parameters of the islands; the defaults are the production values."""

    shard_items: int = 4096
    islands: int = 2
    population: int = 4
    generations: int = 12
    patience: int = 2  # generations of an epoch without a bin less
    migrants: int = 1
    mutated_share: float = 0.02
    injected_share: float = 0.05
    exchanged: int = 400  # most displaced items that are tried in exchange for others
    good_fill: float = 0.98
    seed: int = 17


def positioned(documents: DataFrame) -> DataFrame:
    """doc_id, text and position: the place of the row in the files of ``documents``, by file name and row.

    Spark reads files in another order than they were written, so the order of reading says nothing. What
    does not come from files is written first.
    """
    try:
        rows = documents.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return positioned(stored(documents.select("doc_id", "text"), "ordered"))
    ends = sorted(rows.groupBy("file").agg((F.max("at") + 1).alias("n")).collect())  # a row per file
    if not ends:
        return documents.select("doc_id", "text", F.lit(0).cast("long").alias("position"))
    starts = np.cumsum([0, *(r["n"] for r in ends)]).tolist()
    first = documents.sparkSession.createDataFrame([(r["file"], s) for r, s in zip(ends, starts)], "file string, first long")
    return rows.join(F.broadcast(first), "file").select("doc_id", "text", (F.col("first") + F.col("at")).alias("position"))


def cut_documents(documents: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, ordered: bool = False, added: bool = False) -> DataFrame:
    """Pieces of every document: whole up to ``capacity`` ids, else pieces of exactly that, the first shorter.

    Null text counts as empty and gives the end id alone. Repeated rows and doc_ids stay apart by
    ``key``, which numbers the pieces by partition and place; extra columns are not read. ``ordered``
    makes the keys follow the documents' order in their files instead; ``added`` takes added tokens in a
    text as the library does by default.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        encode = encoder(vocabulary, added).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            docs, texts = batch["doc_id"].array, batch["text"].fillna("").tolist()
            at_doc = batch["position"].tolist() if ordered else None
            for a in range(0, len(texts), 1024):
                rows = []
                for k, (doc, ids) in enumerate(zip(docs[a : a + 1024], encode(texts[a : a + 1024])), a):
                    if ordered:
                        key = at_doc[k] << PIECE_BITS
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for piece in range(-(-n // capacity)):
                        length = n - capacity * ((n - 1) // capacity) if piece == 0 else capacity
                        rows.append((key, doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                        at += length
                        key += 1
                out = pd.DataFrame(rows, columns=["key", "doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return (positioned(documents) if ordered else documents.select("doc_id", "text")).mapInPandas(cut, PIECES)


def best_fit(items: list[int], lengths: list[int], free: list[int], assigned: np.ndarray, capacity: int) -> None:
    """Put each item into the open bin that it fills best, else a new one; ``free`` is room by bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for bin_, room in enumerate(free):
        if room > 0:
            by_room[room].append(bin_)
            rooms |= 1 << room
    for i in items:
        need = lengths[i]
        at = rooms >> need
        if at:
            room = need + (at & -at).bit_length() - 1
            stack = by_room[room]
            bin_ = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, bin_ = capacity, len(free)
            free.append(capacity)
        room -= need
        free[bin_] = room
        assigned[i] = bin_
        if room:
            by_room[room].append(bin_)
            rooms |= 1 << room


def compact(assigned: np.ndarray) -> np.ndarray:
    return np.unique(assigned, return_inverse=True)[1].astype(np.int32)


def quality(assigned: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Number of bins, and the mean squared fill that prefers full bins beside nearly empty ones."""
    fill = np.bincount(assigned, weights=lengths) / capacity
    return len(fill), float(np.mean(fill * fill)) if len(fill) else 1.0


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: for every k, items over half a bin take one each, and those of k or more fill what is beside them."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    items, room = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    alone = items[-1] - items[half + 1]
    beside = items[capacity - k + 1] - items[half + 1]  # over half a bin, with room for k
    left = beside * capacity - (room[capacity - k + 1] - room[half + 1])
    small = room[half + 1] - room[k]
    return int((alone + np.maximum(0, -(-(small - left) // capacity))).max())


class Island:
    """A population of packings of one shard; items come longest first."""

    def __init__(self, lengths: np.ndarray, capacity: int, setup: Evolution, seed: int):
        self.lengths, self.capacity, self.setup = lengths, capacity, setup
        self.list = lengths.tolist()
        self.random = np.random.default_rng(seed)
        self.floor = fewest_bins(lengths, capacity)
        self.packings: list[np.ndarray] = []

    def first(self) -> None:
        for k in range(self.setup.population):
            noise = self.random.normal(0, 0.04 * k, len(self.list))
            order = np.argsort(-self.lengths * (1 + noise), kind="stable").tolist()
            assigned = np.zeros(len(self.list), np.int32)
            best_fit(order, self.list, [], assigned, self.capacity)
            self.packings.append(assigned)
            if k == 0 and self.done():
                break

    def rank(self, assigned: np.ndarray) -> tuple[int, float]:
        bins, fitness = quality(assigned, self.lengths, self.capacity)
        return bins, -fitness

    def done(self) -> bool:
        return min(self.rank(p)[0] for p in self.packings) <= self.floor

    def refill(self, assigned: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """The loose items into the bins of the others: in exchange for smaller ones first, then by best fit."""
        out = assigned.copy()
        fixed = ~loose
        names, out[fixed] = np.unique(assigned[fixed], return_inverse=True)
        free = (self.capacity - np.bincount(out[fixed], weights=self.lengths[fixed], minlength=len(names))).astype(int).tolist()
        pool = np.flatnonzero(loose).tolist()
        if 0 < len(pool) <= self.setup.exchanged:
            pool = self.exchange(out, fixed, free, pool)
        best_fit(sorted(pool), self.list, free, out, self.capacity)
        return out

    def exchange(self, out: np.ndarray, fixed: np.ndarray, free: list[int], pool: list[int]) -> list[int]:
        """Displaced items, one or two, take the place of one or two of a bin that they fill better."""
        members: list[list[int]] = [[] for _ in free]
        for i in np.flatnonzero(fixed).tolist():
            members[out[i]].append(i)
        reach = self.sums(pool)
        for b in self.random.permutation(len(free)).tolist():
            room, own = free[b], members[b]
            if not room or len(own) > 12:
                continue
            best, gain = None, 0
            for x, i in enumerate(own):
                for j in [None, *own[x + 1 :]]:
                    gone = self.list[i] + (0 if j is None else self.list[j])
                    total = (reach & ((2 << (gone + room)) - 1)).bit_length() - 1
                    if total - gone > gain:
                        best, gain = (i, j, total), total - gone
            come = self.summing(pool, best[2]) if best else None
            if come is None:
                continue
            leave = [i for i in best[:2] if i is not None]
            members[b] = [m for m in own if m not in leave] + come
            out[come] = b
            free[b] = room - gain
            pool = [m for m in pool if m not in come] + leave
            reach = self.sums(pool)
        return pool

    def sums(self, pool: list[int]) -> int:
        """The lengths of one and two items of the pool, as the bits of a number (a single item's double among them)."""
        one = 0
        for i in pool:
            one |= 1 << self.list[i]
        two = one
        for i in pool:
            two |= one << self.list[i]
        return two & ((2 << self.capacity) - 1)

    def summing(self, pool: list[int], total: int) -> list[int] | None:
        """One or two items of the pool with that sum."""
        at: dict[int, int] = {}
        for i in pool:
            if self.list[i] == total:
                return [i]
            if total - self.list[i] in at:
                return [at[total - self.list[i]], i]
            at[self.list[i]] = i
        return None

    def cross(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """``other`` with a random half of ``one``'s well-filled bins put in whole."""
        fill = np.bincount(one, weights=self.lengths)
        good = (fill >= np.quantile(fill, 0.5)) & (self.random.random(len(fill)) < self.setup.injected_share)
        injected = good[one]
        hit = np.zeros(other.max() + 1, bool)
        hit[other[injected]] = True
        displaced = hit[other] & ~injected
        mixed = np.where(injected, one + other.max() + 1, other)
        return self.refill(mixed, displaced)

    def mutate(self, assigned: np.ndarray) -> np.ndarray:
        """Dissolve a few bins, badly filled ones first."""
        fill = np.bincount(assigned, weights=self.lengths)
        n = max(2, int(len(fill) * self.setup.mutated_share))
        worst = np.argsort(fill + self.random.random(len(fill)) * self.capacity * 0.1, kind="stable")[:n]
        return self.refill(assigned, np.isin(assigned, worst))

    def evolve(self) -> None:
        idle = 0
        for _ in range(self.setup.generations):
            if self.done() or len(self.packings) < 2 or idle == self.setup.patience:
                break
            least = min(self.rank(p)[0] for p in self.packings)
            ranked = sorted(self.packings, key=self.rank)
            a, b = self.random.choice(len(ranked), 2, replace=False)
            children = [self.cross(ranked[min(a, b)], ranked[max(a, b)]), self.mutate(ranked[0])]
            self.packings = sorted(ranked + children, key=self.rank)[: self.setup.population]
            idle = 0 if self.rank(self.packings[0])[0] < least else idle + 1
        self.packings.sort(key=self.rank)


def _sorted(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["length", "key"], ascending=[False, True], kind="stable")


def _state(shard: int, island: int, packings: list[np.ndarray], lengths: np.ndarray, capacity: int) -> pd.DataFrame:
    rows = []
    for p in packings:
        p = compact(p)
        bins, fitness = quality(p, lengths, capacity)
        rows.append((shard, island, bins, fitness, p.astype("<i4").tobytes()))
    return pd.DataFrame(rows, columns=["shard", "island", "bins", "fitness", "packing"])


def in_ranges(items: DataFrame, shard_items: int) -> DataFrame:
    """(key, length, shard): shards as consecutive ranges of the keys, cut between stretches of positions."""
    stretch = F.shiftright("key", PIECE_BITS + NEAR_DOCS.bit_length() - 1)
    items = items.select("key", "length", stretch.alias("stretch"))
    counts = items.groupBy("stretch").agg(F.count("*").alias("n"))  # a row per 1,024 documents
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = counts.select("stretch", F.floor(before / shard_items).cast("long").alias("shard"))
    return items.join(shards, "stretch").select("key", "length", "shard")


def pack_shards(items: DataFrame, rounds_of: int, capacity: int, setup: Evolution, ordered: bool = False) -> DataFrame:
    """One round: items (key, length) of ``rounds_of`` shards to (key, length, first, place, fill); first is the bin's least key."""
    groups = max(1, min(rounds_of * setup.islands, 8192))
    by_hash: Column = F.pmod(F.xxhash64("key"), F.lit(rounds_of))
    dealt = in_ranges(items, setup.shard_items) if ordered else items.select("key", "length", by_hash.alias("shard"))
    islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(setup.islands - 1))))
    islands = islands.repartition(groups, "shard", "island")

    def start(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = _sorted(group)["length"].to_numpy()
        island = Island(lengths, capacity, setup, setup.seed + int(key[0]) * 31 + int(key[1]))
        island.first()
        island.evolve()
        keep = _state(key[0], key[1], island.packings, lengths, capacity)
        elite = _state(key[0], (key[1] + 1) % setup.islands, island.packings[: setup.migrants], lengths, capacity)
        return pd.concat([keep, elite])

    def settle(key: tuple, group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        lengths = _sorted(group)["length"].to_numpy()
        island = Island(lengths, capacity, setup, setup.seed + 1_000_003 + int(key[0]) * 31 + int(key[1]))
        island.packings = [np.frombuffer(p, "<i4") for p in state.sort_values(["bins", "fitness", "packing"])["packing"]]
        island.evolve()
        return _state(key[0], key[1], island.packings[:1], lengths, capacity)

    def expand(key: tuple, group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        best = state.sort_values(["bins", "fitness", "island"], ascending=[True, False, True]).iloc[0]
        out = _sorted(group)
        out["bin"] = np.frombuffer(best["packing"], "<i4").astype(np.int64)
        out["place"] = out.groupby("bin")["length"].cumsum() - out["length"]
        out["fill"] = out.groupby("bin")["length"].transform("sum")
        out["first"] = out.groupby("bin")["key"].transform("min")
        return out[["key", "length", "first", "place", "fill"]]

    grown = islands.groupBy("shard", "island").applyInPandas(start, STATE)
    both = islands.groupBy("shard", "island").cogroup(grown.groupBy("shard", "island")).applyInPandas(settle, STATE)
    by_shard = dealt.repartition(groups, "shard").groupBy("shard")
    return by_shard.cogroup(both.groupBy("shard")).applyInPandas(expand, "key long, length long, first long, place long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, setup: Evolution = Evolution(), ordered: bool = False) -> DataFrame:
    """Sequences of at most ``capacity`` ids for all pieces (the columns of ``PIECES``).

    A piece of full length is a sequence of its own. No pieces give no rows. ``ordered`` needs keys that
    follow an order, from ``cut_documents``.
    """
    whole = pieces.where(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity).select("key", "length")
    placed, n = whole, items.count()
    while n:
        shards = -(-n // setup.shard_items)
        packed = pack_shards(items, shards, capacity, setup, ordered)
        if shards > 1:
            packed = stored(packed, "packed")
            loose = packed.where(F.col("fill") < setup.good_fill * capacity).select("key", "length")
            left = loose.count()
            if left < n:
                packed, items, n = packed.where(F.col("fill") >= setup.good_fill * capacity), loose, left
            else:
                n = 0
        else:
            n = 0
        placed = placed.unionByName(packed.select("key", F.col("first").alias("sequence_id"), F.col("place").alias("offset")))
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(documents: DataFrame, vocabulary: str | None = None, ordered: bool = False, added: bool = False) -> DataFrame:
    """Encode, cut and pack all documents; the pieces are written once, so that each text is encoded once."""
    return pack(stored(cut_documents(documents, vocabulary or default_vocabulary(), ordered=ordered, added=added), "pieces"), ordered=ordered)


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 1024 ids as the islands find."""
    return pack_documents(table(spark, sf_dir, "documents"), added=True)


QUERIES = {"op7_best_fit_packing": op7}

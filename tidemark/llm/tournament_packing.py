"""First-fit-decreasing packing with a tournament tree of bin rooms, in randomised groups of documents.

A document's ids are cut at every full sequence; what is left of it, less than a sequence, stays whole if it can. The
rests are dealt by a hash to groups of bounded size, each packed on its own: longest first, each into the first
bin with room. The rooms are the leaves of a tournament tree, every inner node the larger of its two, so the first
bin with room is one walk down the tree and a placement one walk up.

A bin that ends with more than ``slack`` ids of padding is taken apart. Its rests are cut into lengths that are powers
of two, largest first, and these go through the same tree: into the room left in the kept bins, then into new ones,
which they fill without a gap. The pieces of a group's last bin become sequences whose lengths are powers of two, as such
sequences are not padded. So each group pads its kept bins by at most ``slack`` each, whatever the lengths are.

Pieces carry the checksum of their ids and those of their possible cuts, which depend on the length alone; ids
themselves are never moved. A null or empty text is the end id alone; null and repeated doc_ids are documents of their
own; equal lengths go by key; no documents give no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import default_vocabulary, encoder
from tidemark.llm.shared import stored, table

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 8192  # rests of a group, on average
SLACK = 8
PIECES = "key long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, cut_crc32 array<long>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut_documents(documents: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Full sequences of each document and its rest, the last piece; ``key`` numbers them by partition and place.

    ``cut_crc32`` of a rest holds the checksums of its cuts into powers of two.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        encode = encoder(vocabulary, added).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            docs, texts = batch["doc_id"].array, batch["text"].fillna("").tolist()
            for a in range(0, len(texts), 1024):
                rows = []
                for doc, ids in zip(docs[a : a + 1024], encode(texts[a : a + 1024])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        length, cuts, at = len(piece) // 4, None, 0
                        if length < capacity:
                            cuts = []
                            for size in powers_of_two(length):
                                cuts.append(zlib.crc32(piece[4 * at : 4 * (at + size)]))
                                at += size
                        rows.append((key, doc, start, length, n, zlib.crc32(piece), cuts))
                        key += 1
                out = pd.DataFrame(rows, columns=["key", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "cut_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return documents.select("doc_id", "text").mapInPandas(cut, PIECES)


class Tournament:
    """Bins in order of their opening; the winner of each match is the one with more room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity
        self.opened = 0

    def place(self, need: int) -> int:
        """Puts ``need`` into the first bin with room for it; returns the bin."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bin_ = node - self.leaves
        self.opened = max(self.opened, bin_ + 1)
        self.set(bin_, room[node] - need)
        return bin_

    def set(self, bin_: int, left: int) -> None:
        room, node = self.room, bin_ + self.leaves
        room[node] = left
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2

    def left(self, bin_: int) -> int:
        return self.room[bin_ + self.leaves]


def first_fit_decreasing(lengths: list[int], capacity: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """Lengths, longest first, to rows (item, cut or -1, place in the item, length, sequence), in order of placement."""
    tree = Tournament(len(lengths), capacity)
    bins = [tree.place(n) for n in lengths]
    padded = lambda left: 0 if (used := capacity - left) & (used - 1) == 0 else left
    apart = {b for b in range(tree.opened) if padded(tree.left(b)) > slack}
    rows = [(i, -1, 0, n, b) for i, (n, b) in enumerate(zip(lengths, bins)) if b not in apart]
    cuts = []
    for i, b in enumerate(bins):
        if b in apart:
            at = 0
            for k, size in enumerate(powers_of_two(lengths[i])):
                cuts.append((size, i, k, at))
                at += size
    if not cuts:
        return rows
    cuts.sort(key=lambda c: (-c[0], c[1]))
    new = Tournament(tree.opened + sum(c[0] for c in cuts) // capacity + 1, capacity)
    for b in range(tree.opened):
        new.set(b, 0 if b in apart or not padded(tree.left(b)) else tree.left(b))
    new.opened = tree.opened
    for size, i, k, at in cuts:
        rows.append((i, k, at, size, new.place(size)))
    last = new.opened - 1
    if last >= tree.opened and (used := capacity - new.left(last)) < capacity:
        sizes, filled = powers_of_two(used), 0
        for r, row in enumerate(rows):  # sizes fall, so no piece reaches over the end of a power
            if row[4] == last:
                k = int(np.searchsorted(np.cumsum(sizes), filled, side="right"))
                rows[r] = (*row[:4], last + k)
                filled += row[3]
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, slack: int = SLACK, seed: int = 12) -> DataFrame:
    """Sequences of at most ``capacity`` ids for pieces with the columns of ``PIECES``, stored ones.

    Sequence numbers of full pieces are even and come from the key, those of groups are odd.
    """
    whole = pieces.where(F.col("length") == capacity)
    rests = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_pieces))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "key"], ascending=[False, True], kind="stable")
        rows = first_fit_decreasing(group["length"].tolist(), capacity, slack)
        out = pd.DataFrame(rows, columns=["item", "cut", "at", "size", "bin"])
        of = group.iloc[out["item"].to_numpy()].reset_index(drop=True)
        crc = of["ids_crc32"].tolist()
        for r, (cut, each) in enumerate(zip(out["cut"], of["cut_crc32"])):
            if cut >= 0:
                crc[r] = int(each[cut])
        return pd.DataFrame({
            "doc_id": of["doc_id"].astype("Int64"), "start": of["start"] + out["at"], "length": out["size"], "ids_crc32": crc, "doc_tokens": of["doc_tokens"],
            "sequence_id": ((int(key[0]) << 32) + out["bin"]) * 2 + 1, "offset": out.groupby("bin")["size"].cumsum() - out["size"],
        })

    dealt = rests.withColumn("group", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups))).repartition(min(groups, 8192), "group")
    packed = dealt.groupBy("group").applyInPandas(run, PACKED)
    full = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def pack_documents(documents: DataFrame, vocabulary: str | None = None, added: bool = False, **setup) -> DataFrame:
    """Encode, cut and pack all documents; the pieces are written once, so that each text is encoded once."""
    return pack(stored(cut_documents(documents, vocabulary or default_vocabulary(), added=added), "rests"), **setup)


def op12(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), added=True)


QUERIES = {"op12_tournament_packing": op12}

"""N-gram Jaccard self-join by prefix trees.

1. A map task makes the shingle set of every text and numbers the distinct sets of a bounded chunk of
   texts, so copies inside a chunk count once. Shingles go to buckets by their hash, packed as arrays; a
   shingle that many sets of a chunk share goes as one entry, so no bucket gets a row per document of a
   common passage.
2. A bucket counts in how many sets each shingle is, and sends those of two or more back to their chunks.
   There a set stays a candidate only if enough of its shingles are shared for any partner. Its shingles
   are in the global order (frequency, hash), and the first of them, its prefix, must hold one that a
   partner's prefix holds too.
3. All sets with a prefix shingle in common meet at one set, the hub (the least of them), so a set goes
   to as many blocks as it has hubs, which are few, and no pair is ever emitted.
4. A block stores its sets in a trie, common shingles first. A walk over the trie carries the overlaps of
   the path with all sets of the block, shared by everything below; a set drops out of a subtree when
   even the remaining lengths cannot lift its overlap far enough, and pairs that are already connected
   are not looked at. The block returns links that span its groups.
5. Blocks of many sets are dealt to parts. Parts are joined on their own, then on representatives of
   what was found connected; at last every set outside the largest component of its hub meets every
   part, so that all pairs have been compared or are connected.

A chunk sends a bucket one row if it has shingles of it, so there are never more rows than shingles. Sets are
compared by 46 bits of each shingle's hash: two different shingles of a pair of texts of 1,000 words agree there
with a chance of 1 in 10^8, and then change an overlap by one. A text without words, null or empty, has an empty set
and links with nothing. Equal texts, and texts of equal sets, link. Rows with a null doc_id take part; the
component id of a group is its least non-null doc_id. Repeated doc_ids stay separate rows. Extra columns are
not read. An empty table gives no rows. The input must be a table or another source whose partitions read the
same rows in the same order when a task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import stored, table, text_volume
from tidemark.llm.shingle_sets import sets_of_batch

CHUNK_TOKENS, CHUNK_SETS = 2_000_000, 40_000
BUCKET_TEXT = 8_000_000
BLOCK_SETS, BLOCK_TOKENS = 1024, 1_500_000
KEY_BITS, COMMON_IN_CHUNK, COMMON = 46, 16, 0xFFFF
PACKED = "kind int, bucket int, chunk long, body binary"
SETS = "kind int, doc_id long, n int, name binary, m int, prefix array<long>, tokens binary"
_NAME = np.dtype([("name", "S16"), ("n", "<u4")])


def least_shared(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers byte by byte, highest first: their high bytes hardly change, so shuffles compress them."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def _from_planes(body: bytes, n: int, width: int, offset: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(body, np.uint8, width * n, offset).reshape(width, n).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def _width(bucket_bits: int) -> int:
    return -(-(KEY_BITS - bucket_bits) // 8)


class Chunk:
    """The distinct sets of a stretch of one partition."""

    def __init__(self, number: int, bucket_bits: int):
        self.number, self.bits = number, bucket_bits
        self.names: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.of: list[int] = []
        self.tokens = 0

    def add(self, doc: int | None, one: np.ndarray) -> None:
        import xxhash

        name = xxhash.xxh3_128_digest(one.tobytes())
        at = self.names.get(name)
        if at is None:
            at = self.names[name] = len(self.sizes)
            self.sizes.append(len(one))
            self.sets.append(one)
            self.tokens += len(one)
        self.docs.append(doc)
        self.of.append(at)

    def full(self) -> bool:
        return self.tokens >= CHUNK_TOKENS or len(self.sizes) >= CHUNK_SETS or len(self.docs) >= 4 * CHUNK_SETS

    def rows(self) -> Iterator[tuple[int, int, int, bytes]]:
        """kind 0: names and sizes, and the documents; kind 1: a bucket's entries; kind 2: sets of common shingles."""
        home = self.number % (1 << self.bits)
        names = np.empty(len(self.sizes), _NAME)
        names["name"], names["n"] = list(self.names), self.sizes
        known = np.array([d is not None for d in self.docs], bool)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        head = np.array([len(names), len(docs)], "<u4").tobytes()
        yield 0, home, self.number, head + names.tobytes() + docs.tobytes() + known.tobytes() + np.array(self.of, "<u4").tobytes()
        if not self.tokens:
            return
        keys = np.concatenate(self.sets)
        self.sets.clear()  # the arrays of a chunk are large: none is held longer than it is needed
        keys >>= np.uint64(64 - KEY_BITS)
        which = np.repeat(np.arange(len(self.sizes), dtype="<u2"), self.sizes)
        order = np.argsort(keys, kind="stable")
        keys, which = keys[order], which[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        common = count >= COMMON_IN_CHUNK
        if common.any():
            inside = np.repeat(common, count)
            body = np.array([int(common.sum()), int(inside.sum())], "<u4").tobytes()
            yield 2, home, self.number, body + keys[first[common]].tobytes() + count[common].astype("<u4").tobytes() + which[inside].tobytes()
            keep = ~inside
            keep[first[common]] = True
            which = which.copy()
            which[first[common]] = COMMON
            weights = np.ones(len(keys), "<u4")
            weights[first[common]] = count[common]
            keys, which, weights = keys[keep], which[keep], weights[keep]
            del inside, keep
        else:
            weights = np.ones(len(keys), "<u4")
        del first, count, common
        low = KEY_BITS - self.bits
        cut = np.searchsorted(keys, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(low))
        rest = np.uint64((1 << low) - 1)
        for b in range(1 << self.bits):
            s, e = int(cut[b]), int(cut[b + 1])
            if e > s:
                heavy = np.flatnonzero(which[s:e] == COMMON)
                yield 1, b, self.number, np.array([e - s], "<u4").tobytes() + _planes(keys[s:e] & rest, _width(self.bits)) + which[s:e].tobytes() + weights[s:e][heavy].tobytes()


def deal_sets(documents: DataFrame, bucket_bits: int, words: int) -> DataFrame:
    """Step 1: packed rows of ``PACKED``."""

    def deal(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
        number = TaskContext.get().partitionId() << 24

        def out(chunk: Chunk):
            for part in _some(chunk.rows(), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*part), schema)], schema=schema)

        chunk = Chunk(number, bucket_bits)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for row, one in sets_of_batch(batch.column(1), words):
                chunk.add(docs[row], one)
                if chunk.full():
                    yield from out(chunk)
                    number += 1
                    chunk = Chunk(number, bucket_bits)
        if chunk.docs:
            yield from out(chunk)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(deal, PACKED)


def _some(rows: Iterator, n: int) -> Iterator[list]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def count_shared(packed: DataFrame, bucket_bits: int) -> DataFrame:
    """Step 2, in the buckets: entries of shingles in two sets or more, with the number of sets."""
    low, wide = KEY_BITS - bucket_bits, _width(bucket_bits)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        passed = rows[rows["kind"] != 1]
        rows = rows[rows["kind"] == 1]
        if rows.empty:
            return passed
        keys, which, weights, sizes = [], [], [], []
        for body in rows["body"]:
            n = int(np.frombuffer(body, "<u4", 1)[0])
            one = np.frombuffer(body, "<u2", n, 4 + wide * n)
            weight = np.ones(n, np.uint32)
            weight[one == COMMON] = np.frombuffer(body, "<u4", -1, 4 + (wide + 2) * n)
            keys.append(_from_planes(body, n, wide, 4))
            which.append(one)
            weights.append(weight)
            sizes.append(n)
        keys, which, weights = np.concatenate(keys), np.concatenate(which), np.concatenate(weights)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        length = np.diff(np.append(first, len(ranked)))
        total = np.add.reduceat(weights[order].astype(np.int64), first)
        df = np.empty(len(keys), np.int64)
        df[order] = np.repeat(total, length)
        out, at = [], 0
        for chunk, n in zip(rows["chunk"], sizes):
            here = at + np.flatnonzero(df[at : at + n] > 1)
            at += n
            if len(here):
                full = keys[here] + np.uint64(int(key[0]) << low)
                body = np.array([len(here)], "<u4").tobytes() + _planes(full, 6) + which[here].tobytes() + np.minimum(df[here], 65_535).astype("<u2").tobytes()
                out.append((1, int(key[0]), chunk, body))
        return pd.concat([passed, pd.DataFrame(out, columns=["kind", "bucket", "chunk", "body"])])

    return packed.groupBy("bucket").applyInPandas(count, PACKED)


def gather_sets(counted: DataFrame, percent: int) -> DataFrame:
    """Step 2, in the chunks: a row per document (kind 0) and per candidate set (kind 1)."""
    columns = ["kind", "doc_id", "n", "name", "m", "prefix", "tokens"]

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        body = rows.loc[rows["kind"] == 0, "body"].iloc[0]
        sets, docs = np.frombuffer(body, "<u4", 2).tolist()
        names = np.frombuffer(body, _NAME, sets, 8)
        at = 8 + names.nbytes
        ids = np.frombuffer(body, "<i8", docs, at)
        known = np.frombuffer(body, bool, docs, at + 8 * docs)
        of = np.frombuffer(body, "<u4", docs, at + 9 * docs)
        label = [names["name"][i].ljust(16, b"\0") for i in range(sets)]
        sizes = names["n"].astype(np.int64)
        every = pd.DataFrame({"kind": 0, "doc_id": pd.array(ids, "Int64"), "n": sizes[of], "name": [label[i] for i in of], "m": 0, "prefix": None, "tokens": None})
        every.loc[~known, "doc_id"] = pd.NA

        keys, which, df = [], [], []
        for b in rows.loc[rows["kind"] == 1, "body"]:
            n = int(np.frombuffer(b, "<u4", 1)[0])
            keys.append(_from_planes(b, n, 6, 4))
            which.append(np.frombuffer(b, "<u2", n, 4 + 6 * n))
            df.append(np.frombuffer(b, "<u2", n, 4 + 8 * n))
        if not keys:
            return every[columns]
        keys, which, df = np.concatenate(keys), np.concatenate(which), np.concatenate(df)
        common = which == COMMON
        if common.any():
            b = rows.loc[rows["kind"] == 2, "body"].iloc[0]
            n, entries = np.frombuffer(b, "<u4", 2).tolist()
            name = np.frombuffer(b, "<u8", n, 8)
            count = np.frombuffer(b, "<u4", n, 8 + 8 * n).astype(np.int64)
            inside = np.frombuffer(b, "<u2", entries, 8 + 12 * n)
            order = np.argsort(keys[common], kind="stable")
            at = np.searchsorted(keys[common][order], name)
            keys = np.concatenate([keys[~common], np.repeat(name, count)])
            which = np.concatenate([which[~common], inside])
            df = np.concatenate([df[~common], np.repeat(df[common][order][at], count)])
        m = np.bincount(which, minlength=sets)
        need = least_shared(sizes, percent)
        alive = (m >= need) & (sizes > 0)
        held = alive[which]
        keys, which, df = keys[held], which[held], df[held]
        order = np.lexsort((keys, df, which))
        keys, which = keys[order].astype("<i8"), which[order]
        ends = np.searchsorted(which, np.arange(sets), side="right")
        out = []
        for i in np.flatnonzero(alive).tolist():
            mine = keys[ends[i] - m[i] : ends[i]]
            out.append((1, None, int(sizes[i]), label[i], int(m[i]), mine[: m[i] - need[i] + 1], mine.tobytes()))
        sets_ = pd.DataFrame(out, columns=columns)
        sets_["doc_id"] = pd.array([pd.NA] * len(out), "Int64")
        return pd.concat([every[columns], sets_]) if out else every[columns]

    return counted.groupBy("chunk").applyInPandas(gather, SETS)


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected in the block, beyond what ``label`` already joins.

    x and y link when 100 * overlap >= percent * union, that is
    (100 + percent) * overlap >= percent * (|x| + |y|).
    """
    n = len(sets)
    label = np.arange(n) if label is None else label.copy()
    links: list[tuple[int, int]] = []
    if n < 2:
        return links
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, count = np.unique(joined, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    rank, shared = rank[token], count[token] > 1
    rank, owner = rank[shared], owner[shared]
    by_set = np.lexsort((rank, owner))
    path = np.split(rank[by_set], np.cumsum(np.bincount(owner, minlength=n))[:-1])
    by_rank = np.lexsort((owner, rank))
    posting = owner[by_rank]
    width = int(rank.max()) + 1 if len(rank) else 0
    begin = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=width))])

    def overlap(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set of the block has."""
        if not len(tokens):
            return np.zeros(n, np.int64)
        if len(tokens) == tokens[-1] - tokens[0] + 1:
            return np.bincount(posting[begin[tokens[0]] : begin[tokens[-1] + 1]], minlength=n)
        return np.bincount(np.concatenate([posting[begin[t] : begin[t + 1]] for t in tokens.tolist()]), minlength=n)

    length = np.array([len(p) for p in path])
    leaves = sorted(range(n), key=lambda i: path[i].astype(">u4").tobytes())
    shared_depth = []
    for a, b in zip(leaves, leaves[1:]):
        k = min(length[a], length[b])
        differs = np.flatnonzero(path[a][:k] != path[b][:k])
        shared_depth.append(int(differs[0]) if len(differs) else int(k))
    shared_depth.append(0)

    def reach(depth: int, have: np.ndarray, first: int) -> np.ndarray:
        """Sets that can still link with a set below a node, by the remaining lengths."""
        last = first
        while shared_depth[last] >= depth and last + 1 < n:
            last += 1
        below = leaves[first : last + 1]
        most = have + np.minimum(length - have, int(length[below].max()) - depth)
        return (100 + percent) * most >= percent * (sizes + int(sizes[below].min()))

    nodes = [(0, np.zeros(n, np.int64), np.ones(n, bool))]
    for at, i in enumerate(leaves):
        while nodes[-1][0] > (shared_depth[at - 1] if at else 0):
            nodes.pop()
        depth, have, alive = nodes[-1]
        if shared_depth[at] > depth and alive.any():
            below = have + overlap(path[i][depth : shared_depth[at]])
            nodes.append((shared_depth[at], below, alive & reach(shared_depth[at], below, at)))
            depth, have, alive = nodes[-1]
        alive = alive & (label != label[i])
        alive &= (100 + percent) * np.minimum(length, length[i]) >= percent * (sizes + sizes[i])
        if not alive.any():
            continue
        have = have + overlap(path[i][depth:])
        for j in np.flatnonzero(alive & ((100 + percent) * have >= percent * (sizes + sizes[i]))).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def join_blocks(blocks: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Trie join in each block of (keys, name, n, tokens, comp): links (a, b) between names."""

    def join(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("name").sort_values("name")
        names = rows["name"].tolist()
        label = pd.factorize(rows["comp"])[0]
        sets = [np.frombuffer(t, "<i8") for t in rows["tokens"]]
        found = trie_links(sets, rows["n"].to_numpy(np.int64), percent, label)
        return pd.DataFrame([(names[i], names[j]) for i, j in found], columns=["a", "b"])

    return blocks.groupBy(*keys).applyInPandas(join, "a long, b long")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Steps 3 to 5 on candidate sets (name, a number; n, m, prefix, tokens): links that span the groups."""
    light = sets.select("name", F.explode("prefix").alias("t"))
    hubs = light.groupBy("t").agg(F.min("name").alias("hub"), F.count("*").alias("size")).where("size > 1").select("t", "hub")
    member = stored(light.join(hubs, "t").select("hub", "name").distinct(), "members")
    weighed = member.join(sets.select("name", "m"), "name")
    size = weighed.groupBy("hub").agg(F.count("*").alias("members"), F.sum("m").alias("tokens")).where("members > 1")
    parts = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    size = size.select("hub", parts.alias("parts"))
    part = F.pmod(F.xxhash64("name", F.lit(11)), F.col("parts")).cast("int").alias("part")
    member = stored(member.join(size, "hub").select("hub", "name", "parts", part), "members")
    body = sets.select("name", "n", "tokens")
    links = stored(join_blocks(member.join(body, "name").withColumn("comp", F.col("name")), ["hub", "part"], percent), "links")

    wide = member.where("parts > 1")
    if wide.isEmpty():
        return links
    found = _labelled(wide, links)
    heads = found.groupBy("hub", "part", "comp").agg(F.min("name").alias("name"), F.count("*").alias("size"))
    best = Window.partitionBy("hub").orderBy(F.desc("size"), "name")
    heads = heads.withColumn("k", F.row_number().over(best)).where(F.col("k") <= BLOCK_SETS)
    more = stored(join_blocks(heads.join(body, "name"), ["hub"], percent), "links")
    links = links.unionByName(more)

    found = stored(_labelled(wide, links), "found")
    main = found.groupBy("hub", "comp").agg(F.count("*").alias("size")).groupBy("hub").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    outside = found.join(main, "hub").where("comp <> main").select("hub", "name", "parts", "comp")
    rounds = outside.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("rounds"))
    if rounds.isEmpty():
        return links
    lap = F.pmod(F.xxhash64("name", F.lit(13)), F.col("rounds")).cast("int")
    guest = outside.join(rounds, "hub").select("hub", "name", "comp", lap.alias("lap"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    host = found.join(rounds, "hub").select("hub", "name", "comp", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("lap"), "part")
    last = join_blocks(host.unionByName(guest).join(body, "name"), ["hub", "part", "lap"], percent)
    return links.unionByName(stored(last, "links"))


def _labelled(member: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their component so far."""
    of = components(links).select(F.col("node").alias("name"), "root")
    return member.join(of, "name", "left").select("hub", "name", "parts", "part", F.coalesce("root", "name").alias("comp"))


def jaccard_components(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents (doc_id, text)."""
    bits = min(30, max(6, (text_volume(documents) // BUCKET_TEXT).bit_length()))
    packed = deal_sets(documents, bits, words)
    both = stored(gather_sets(count_shared(packed, bits), percent), "sets")
    docs = both.where("kind = 0").select("doc_id", "n", "name")
    sets = both.where("kind = 1").select("name", "n", "m", "prefix", "tokens").dropDuplicates(["name"])
    sets = stored(sets.withColumn("number", F.monotonically_increasing_id()), "candidates")
    names = sets.select("name", "number")
    root = components(class_links(sets.drop("name").withColumnRenamed("number", "name"), percent))
    root = names.join(root, F.col("number") == F.col("node")).select("name", F.col("root").cast("string").cast("binary").alias("root"))
    classes = docs.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("first")).join(root, "name", "left")
    classes = classes.withColumn("root", F.coalesce("root", "name"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "root").select("name", "component_id")
    joined = docs.join(classes, "name", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_first(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """``documents`` with one row of each group: that of least doc_id, a null being last, then the first in the table.

    Rows are told apart by their place in the table, so repeated and null doc_ids do no harm. Texts without
    words are groups of their own and stay.
    """
    taken = {c.lower() for c in documents.columns}
    row = next(f"row{k}" for k in range(len(taken) + 1) if f"row{k}" not in taken)
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    light = numbered.select(row, "doc_id")
    grouped = jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"), percent, words)
    grouped = grouped.select(F.col("doc_id").alias(row), "component_id").join(light, row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = grouped.groupBy("component_id").agg(F.min_by(row, order).alias(row)).select(row)
    return numbered.join(first, row, "left_semi").select(*documents.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_jaccard_join": op8}
ORACLES = {
    "op8_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
h AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM h a JOIN h b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT a AS doc_id, a AS least FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.doc_id WHERE r.least < l.b)
SELECT n.doc_id, n.n AS n_shingles, coalesce(min(r.least), n.doc_id) AS component_id FROM n LEFT JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n"""
}

"""Runs of repeated words: stretches of smallest period q and at least four periods that no neighbour extends.

A run of period q is a pair of equal stretches q words apart, followed by different words and preceded by different
words: a maximal pair. So the texts' suffixes are sorted (prefix doubling over the words of many texts at once), the
common prefixes of neighbours make a tree of intervals, and the tree is walked from the bottom up with each
interval's places in lists by the word before them. Where two children meet, their places differ in the word after;
places of different lists differ in the word before. A meeting pair p words apart with l words in common is a run
exactly if l is at least three times p, and nothing has to be extended. Of several distances that show the same stretch the
least is its period.

Lists are merged smaller into larger. A place looks at each other list of the larger child, or at each distance up to
l / 3, whichever are fewer, so a merge stays below the root of the text's length per place. A text without two equal
stretches of five words has no run and is not sorted.

Each text is a row and needs no other; texts of any length are worked on whole. A null or empty text has no words and no
run. Repeated rows and null doc_ids are kept. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import table

LEAST_LENGTH, LEAST_PERIODS = 6, 4
SEED = 5  # words that a run of six words or more has twice
BLOCK_WORDS = 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts of the joined word numbers may hold the same ``SEED`` words twice; never misses one."""
    n, texts = len(words), len(ends)
    found = np.zeros(texts, bool)
    if n < SEED + 1:
        return found
    mix = np.zeros(n - SEED + 1, np.uint64)
    for k in range(SEED):
        mix = (mix ^ words[k : n - SEED + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    text = np.repeat(np.arange(texts), np.diff(ends, prepend=0))[: len(mix)]
    inside = np.arange(len(mix)) + SEED <= ends[text]
    key = np.sort((text[inside].astype(np.uint64) << np.uint64(36)) | (mix[inside] >> np.uint64(28)))
    found[(key[1:][key[1:] == key[:-1]] >> np.uint64(36)).astype(np.int64)] = True
    return found


def sorted_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the suffixes from there, and how many symbols each shares with the one before it.

    Texts must have symbols of their own, and the longest repeated stretch ends before its text does.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = starts[np.cumsum(first) - 1]
    ranks, width = [rank.copy()], 1
    slots = np.flatnonzero(~(first & np.r_[first[1:], True]))  # of suffixes that are not yet told apart
    while len(slots):
        at = order[slots]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        first = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[at] = slots[np.flatnonzero(first)][np.cumsum(first) - 1]
        slots = slots[~(first & np.r_[first[1:], True])]
        ranks.append(rank)
        width *= 2
    shared = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (ranks[level][np.minimum(i, n - 1)] == ranks[level][np.minimum(j, n - 1)])
        step = np.where(same, 1 << level, 0)
        shared[1:] += step
        i, j = i + step, j + step
    return order, shared


Lists = dict[int, list[int]]


class Pairs:
    """The maximal pairs that are runs, from the bottom of the tree up."""

    def __init__(self, before: list[int]):
        self.before = before  # the word before each place
        self.period: dict[tuple[int, int], int] = {}

    def report(self, x: int, y: int, common: int) -> None:
        start, p = min(x, y), abs(x - y)
        length = common + p
        if length >= max(LEAST_LENGTH, LEAST_PERIODS * p):
            self.period[start, length] = min(p, self.period.get((start, length), p))

    def meet(self, large: Lists, small: Lists, common: int) -> None:
        """All pairs of places of two children with different words before them, near enough to be a run."""
        reach = common // (LEAST_PERIODS - 1)
        for word, places in small.items():
            if reach < len(large):
                for x in places:
                    for y in (*range(x - reach, x), *range(x + 1, x + reach + 1)):
                        other = self.before[y] if 0 <= y < len(self.before) else word
                        if other != word and other in large:
                            held = large[other]
                            k = bisect_left(held, y)
                            if k < len(held) and held[k] == y:
                                self.report(x, y, common)
                continue
            for other, held in large.items():
                if other != word:
                    for x in places:
                        k = bisect_left(held, x - reach)
                        while k < len(held) and held[k] <= x + reach:
                            self.report(x, held[k], common)
                            k += 1

    def merged(self, one: tuple[int, Lists], two: tuple[int, Lists], common: int) -> tuple[int, Lists]:
        (n, large), (m, small) = (one, two) if one[0] >= two[0] else (two, one)
        self.meet(large, small, common)
        for word, places in small.items():
            held = large.get(word)
            if held is None:
                large[word] = places
            elif len(places) < 8:
                for x in places:
                    insort(held, x)
            else:
                held.extend(places)
                held.sort()
        return n + m, large

    def walk(self, places: list[int], shared: list[int], least: int = SEED) -> None:
        """Places in suffix order; ``shared`` with the one before. Intervals of fewer than ``least`` words are left out."""
        stack: list[tuple[int, tuple[int, Lists]]] = []
        for k, x in enumerate(places):
            after = shared[k + 1] if k + 1 < len(shared) else 0
            if after < least and not stack:
                continue
            done = (1, {self.before[x]: [x]})
            while stack and stack[-1][0] > after:
                common, rest = stack.pop()
                done = self.merged(rest, done, common)
            if after < least:
                stack.clear()
            elif stack and stack[-1][0] == after:
                stack[-1] = (after, self.merged(stack[-1][1], done, after))
            else:
                stack.append((after, done))


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text of word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    hits = np.flatnonzero(repeats(np.concatenate(texts), np.cumsum(sizes))).tolist()
    if not hits:
        return out
    words = np.concatenate([texts[t] for t in hits])
    ends = np.cumsum(sizes[hits])
    starts = ends - sizes[hits]
    text = np.repeat(np.arange(len(hits)), sizes[hits])
    symbols = text * (int(words.max()) + 1) + words
    order, shared = sorted_suffixes(symbols)
    before = np.r_[-1, words[:-1]]
    before[starts] = -1
    pairs = Pairs(before.tolist())
    pairs.walk(order.tolist(), shared.tolist())
    for (start, length), p in sorted(pairs.period.items(), key=lambda r: (r[0][0], r[1])):
        t = int(text[start])
        out[hits[t]].append((start - int(starts[t]), length, p))
    return out


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document its number of words, its runs by start and period, and its text without repeated periods.

    The collapsed text drops what lies in a run after its first period; words are joined by one space. Words are
    what stands between ASCII white space.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, texts = batch["doc_id"].astype("Int64").array, batch[text].tolist()
            a = 0
            while a < len(texts):
                number: dict[bytes, int] = {}
                words, ids, size, b = [], [], 0, a
                while b < len(texts) and (b == a or size < BLOCK_WORDS):
                    w = (texts[b] or "").encode().split()
                    words.append(w)
                    ids.append(np.array([number.setdefault(x, len(number)) for x in w], np.int64))
                    size += len(w)
                    b += 1
                rows = []
                for doc, w, runs in zip(docs[a:b], words, runs_of(ids)):
                    kept = w
                    if runs:
                        drop = np.zeros(len(w), bool)
                        for start, length, p in runs:
                            drop[start + p : start + length] = True
                        kept = [w[k] for k in np.flatnonzero(~drop).tolist()]
                    found = [{"start": s, "length": n, "period": p} for s, n, p in runs]
                    rows.append((doc, len(w), found, b" ".join(kept).decode()))
                out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
                a = b

    return docs.select("doc_id", text).mapInPandas(find, RUNS)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the tails that the contract of op13 repeats: word a+(i-a)%p in place of each word i from a on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    listed = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, _words(F.col("text"))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    cyclic = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), n), " ")
    dealt = listed.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return dealt.select("doc_id", F.when(F.col("a").isNotNull(), cyclic).otherwise(F.col("text")).alias("text"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    less = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]  # noqa: E731  below 0: x has more periods
    order = lambda x, y: F.coalesce(
        F.nullif(F.signum(less(x, y)), F.lit(0.0)), F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"])
    ).cast("int")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    first = found.withColumn("best", F.get("runs", F.lit(0))).withColumn(
        "best", F.aggregate("runs", F.col("best"), lambda top, r: F.when(order(r, top) < 0, r).otherwise(top))
    )
    return first.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them with repeated tails."""
    return digests(find_runs(repeated_tails(table(spark, sf_dir, "documents"))))


QUERIES = {"op13_periodic_runs": op13}

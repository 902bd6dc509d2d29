"""Phrase collocations from weighted automata of word n-grams.

0. Scan. The words' counts are added up in buckets of their hashes. A phrase that holds a word of a bucket below ``least`` is
   too rare to be a candidate or part of one, so such words end a piece from there on; a bucket that rare words share lets them
   pass, which costs room only. Windows sampled by the way give the bounds of the ranges, and the words that shards name by a number.
1. Shards. A task numbers the words of its texts and sorts, for each word, the words from there to the end of its piece,
   five at most. Every phrase is the beginning of such a window, so an automaton of sorted windows counts all phrases of one to
   five words in the weights of its states. A shard has a bounded number of words, however long its texts are.
2. Union by prefix range. Ranges of windows hold about equally many each, so that a word or pair that starts a
   large share of all windows is divided too. Shards are cut at the ranges' bounds as they are made, no whole one is kept, and added up, over several
   rounds where there are more than ``fan`` ranges, each round into ``fan`` times finer ranges. Phrases that reach over a bound lie on
   the first or last path of their range; only these are added up across ranges.
3. Composition. The phrases counted often enough are far fewer; each range asks for the parts of its own, every part
   once, in one automaton for each range that holds some. There it is composed with the range's automaton, which gives the
   counts. A question also says the highest count of the longer phrases it comes from, which shows the phrases that are
   covered by one as frequent.

A null text has no words; a null lang is ``und``; repeated rows count again. Counts and products are exact. No documents give
no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.count_automaton import NONE_KNOWN, Automaton, Known, Phrases, counted, numbered, summed
from tidemark.llm.shared import stored, table

# A-Z in lower case, a tab as a space, and the marks that end a piece as a byte that UTF-8 does not have.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * 10)
BREAK = b"\xff"
SCAN = "lang string, number long, f long, window binary"  # a bucket and its count, or a sample's number and window
CUT = "lang string, range long, shard long, automaton binary"
COUNTS = "lang string, range long, phrase binary, f long, edge boolean"
ASKED = "lang string, range long, source long, automaton binary"
CANDIDATES = "lang string, phrase string, a long, l long, r long, n long, score long"
SAMPLES = 1 << 17  # most sampled windows that the ranges' bounds are chosen from; they decide the balance of tasks only
BUCKET_BITS = 25  # of a word's hash; a bit for each bucket goes to all tasks, 4 MB in all
HELD = 1 << 18  # words that a task counts before it passes the counts on

Bounds = dict[str, list[tuple[bytes, ...]]]


@dataclass(frozen=True)
class Setup:
    """Parameters; the defaults are the production values."""

    longest: int = 5
    least: int = 100
    cover: int = 100  # per cent of a phrase's count from which a longer phrase replaces it
    shard_words: int = 1 << 19
    range_windows: int = 1 << 20
    fan: int = 256

    @property
    def every(self) -> int:
        """The tokens from one sampled window to the next."""
        return max(1, self.range_windows >> 9)


def bucket(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode())) >> (32 - BUCKET_BITS)


class Numbers(dict):
    """Words by number in order of appearance; a break is 0, and so are words of buckets that occur too rarely."""

    def __init__(self, lang: str, often: bytes):
        super().__init__({BREAK: 0})
        self.lang, self.often, self.words = lang, often, []

    def __missing__(self, word: bytes) -> int:
        at = bucket(self.lang, word)
        if self.often[at >> 3] >> (at & 7) & 1:
            self.words.append(word)
            self[word] = n = len(self.words)
        else:
            self[word] = n = 0
        return n


def tokens_of(text: bytes) -> list[bytes]:
    """Words and breaks, one at the end too."""
    tokens = text.translate(FOLD).replace(BREAK, b" \xff ").split()
    tokens.append(BREAK)
    return tokens


def windows(x: np.ndarray, starts: int, longest: int) -> np.ndarray:
    """The words from each of the first ``starts`` places on, none after a break."""
    padded = np.r_[x, np.zeros(longest, x.dtype)]
    rows = np.stack([padded[k : k + starts] for k in range(longest)], axis=1)
    for k in range(1, longest):
        rows[rows[:, k - 1] == 0, k] = 0
    return rows[rows[:, 0] > 0]


class Shard:
    """Texts of one lang, up to a number of words."""

    def __init__(self, lang: str, often: bytes, setup: Setup):
        self.lang, self.often, self.setup = lang, often, setup
        self.number, self.parts, self.size = Numbers(lang, often), [], 0

    def add(self, tokens: list[bytes]) -> Iterator[Phrases]:
        """Takes a text's tokens; a text too long is divided, its windows reaching into the next part."""
        at, step, reach = 0, self.setup.shard_words, self.setup.longest - 1
        while at < len(tokens):
            room = min(step - self.size, len(tokens) - at)
            x = np.fromiter(map(self.number.__getitem__, tokens[at : at + room + reach]), np.int32)
            self.parts.append((x, room))
            self.size += room
            at += room
            if self.size >= step:
                yield self.end()

    def end(self) -> Phrases:
        """The windows; the shard is empty again."""
        names = self.number.words
        words = sorted(names)
        place = {w: k for k, w in enumerate(words, 1)}
        rank = np.array([0, *(place[w] for w in names)], np.int32)
        rows = np.concatenate([windows(rank[x], n, self.setup.longest) for x, n in self.parts])
        self.number, self.parts, self.size = Numbers(self.lang, self.often), [], 0
        return Phrases(words, *counted(rows, np.ones(len(rows), np.int64), len(words)))


@dataclass
class Seen:
    """What a task has counted of one lang since it last passed counts on, and the tokens before its next sample."""

    left: int
    counts: Counter[bytes] = field(default_factory=Counter)


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def scan(documents: DataFrame, setup: Setup) -> DataFrame:
    """Counts of the words' buckets, several of a bucket, and a window for each of some places."""
    every = setup.every

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        number, since = task << 32, 0
        langs: dict[str, Seen] = {}
        rows: list[tuple] = []

        def made() -> pd.DataFrame:
            for lang, seen in langs.items():
                seen.counts.pop(BREAK, None)
                rows.extend((lang, bucket(lang, word), f, None) for word, f in seen.counts.items())
                seen.counts.clear()
            out = pd.DataFrame(rows, columns=["lang", "number", "f", "window"])
            rows.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch["lang"].tolist(), batch["text"].tolist()):
                if text:
                    tokens = tokens_of(text)
                    # Tasks are alike, so each takes its sample at places of its own; else all bounds would lie together.
                    seen = langs.get(lang) or langs.setdefault(lang, Seen(zlib.crc32(f"{task} {lang}".encode()) % every))
                    seen.counts.update(tokens)
                    for at in range(seen.left, len(tokens), every):
                        window = tokens[at : at + setup.longest]
                        window = window[: window.index(BREAK)] if BREAK in window else window
                        if window:
                            rows.append((lang, number, 0, b" ".join(window)))
                            number += 1
                    seen.left = (seen.left - len(tokens)) % every
                    since += len(tokens)
                    if since > HELD:
                        since = 0
                        if len(rows) + sum(len(x.counts) for x in langs.values()) > HELD:
                            yield made()
        yield made()

    return texts_of(documents).mapInPandas(run, SCAN)


def often_of(scanned: DataFrame, setup: Setup) -> bytes:
    """A bit for each bucket that occurs ``least`` times."""
    held = scanned.where("window IS NULL").groupBy("number").agg(F.sum("f").alias("f")).where(F.col("f") >= setup.least).select(F.col("number") + 1)
    held = held.toDF("number").groupBy(F.bitmap_bucket_number("number").alias("part"))
    out = bytearray(1 << (BUCKET_BITS - 3))
    for r in held.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")).collect():
        out[(r["part"] - 1) * len(r["bits"]) : r["part"] * len(r["bits"])] = r["bits"]
    return bytes(out)


def bounds_of(scanned: DataFrame, totals: DataFrame, often: bytes, setup: Setup) -> tuple[Bounds, dict[str, Known]]:
    """By lang, the first window of each range but the first; and the words met in the samples.

    Only langs that fill more than one range have bounds, so what comes to the driver follows the number of ranges.
    """
    large = totals.where(F.col("n") > setup.range_windows).select("lang")
    count = large.count()
    if not count:
        return {}, {}
    samples = scanned.where("window IS NOT NULL").join(F.broadcast(large) if count < 1000 else large, "lang", "left_semi")
    thin = max(1, -(-samples.count() // SAMPLES))
    by_lang: dict[str, list[tuple[bytes, ...]]] = {}
    numbers: dict[str, Numbers] = {}
    for r in samples.where(F.pmod(F.xxhash64("number"), F.lit(thin)) == 0).select("lang", "window").collect():
        number = numbers.setdefault(r["lang"], Numbers(r["lang"], often))
        words = bytes(r["window"]).split(b" ")
        window = tuple(words[: [*map(number.__getitem__, words), 0].index(0)])
        if window:
            by_lang.setdefault(r["lang"], []).append(window)
    out = {}
    for lang, got in by_lang.items():
        got.sort()
        ranges = -(-len(got) * thin * setup.every // setup.range_windows)
        out[lang] = sorted({got[len(got) * k // ranges] for k in range(1, ranges)})
    return out, {lang: Known(sorted(number.words)) for lang, number in numbers.items()}


def pieces_of(phrases: Phrases, bounds: list[tuple[bytes, ...]], width: int) -> Iterator[tuple[int, Phrases]]:
    """(range // width, the part of the phrases in it) for the ranges that have some."""
    at = [0, *(phrases.first_not_below(b) for b in bounds[width - 1 :: width]), len(phrases.rows)]
    for k, (a, b) in enumerate(zip(at, at[1:])):
        if a < b:
            yield k, phrases.part(a, b)


def _cut(lang: str, shard: int, phrases: Phrases, bounds: Bounds, width: int, known: Known) -> pd.DataFrame:
    rows = [(lang, k, shard, Automaton.of(p).to_bytes(known)) for k, p in pieces_of(phrases, bounds.get(lang, []), width)]
    return pd.DataFrame(rows, columns=["lang", "range", "shard", "automaton"])


def _read(automata, known: Known) -> list[Phrases]:
    return [Automaton.from_bytes(a, known).phrases() for a in automata]


def count_ranges(documents: DataFrame, often: bytes, bounds: Bounds, known: dict[str, Known], setup: Setup) -> DataFrame:
    """Phrases by range: those that occur ``least`` times, and with ``edge`` those that may occur in other ranges too."""
    width, most = 1, 1 + max(map(len, bounds.values()), default=0)
    while width * setup.fan < most:
        width *= setup.fan
    held = documents.sparkSession.sparkContext.broadcast((often, known))

    def known_of(lang: str) -> Known:
        return held.value[1].get(lang, NONE_KNOWN)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        open_: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].tolist(), batch["text"].tolist()):
                if text:
                    one = open_.get(lang) or open_.setdefault(lang, Shard(lang, held.value[0], setup))
                    for phrases in one.add(tokens_of(text)):
                        yield _cut(lang, shard, phrases, bounds, first, known_of(lang))
                        shard += 1
        for lang, one in open_.items():
            if one.size:
                yield _cut(lang, shard, one.end(), bounds, first, known_of(lang))
                shard += 1

    def finer(step: int):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            of = known_of(key[0])
            return _cut(key[0], int(group["shard"].min()), summed(_read(group["automaton"], of)), bounds, step, of)

        return run

    def union(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        phrases = summed(_read(group["automaton"], known_of(key[0])))
        rows, weight = Automaton.of(phrases).states()
        edge = np.zeros(len(rows), bool)
        if bounds.get(key[0]):
            for end in (phrases.rows[0], phrases.rows[-1]):
                edge |= ((rows == end) | (rows == 0)).all(axis=1)
        kept = np.flatnonzero(edge | (weight >= setup.least))
        named = Phrases(phrases.words, rows[kept], weight[kept]).named()
        return pd.DataFrame({"lang": key[0], "range": key[1], "phrase": named, "f": weight[kept], "edge": edge[kept]})

    first = width
    parts = texts_of(documents).mapInPandas(cut, CUT)
    while width > 1:
        batch = F.pmod(F.xxhash64("shard"), F.lit(width)).alias("batch")
        parts = parts.groupBy("lang", "range", batch).applyInPandas(finer(width // setup.fan), CUT)
        width //= setup.fan
    return parts.groupBy("lang", "range").applyInPandas(union, COUNTS)


def frequent_phrases(documents: DataFrame, setup: Setup = Setup()) -> tuple[DataFrame, DataFrame, Bounds]:
    """(lang, range, phrase, f) of all phrases with f of ``least`` or more, (lang, n), and the ranges' bounds."""
    scanned = stored(scan(documents, setup), "scanned")
    totals = scanned.groupBy("lang").agg(F.sum("f").alias("n"))
    often = often_of(scanned, setup)
    bounds, known = bounds_of(scanned, totals, often, setup)
    counts = stored(count_ranges(documents, often, bounds, known, setup), "counts")

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["range"] = [_range(bounds, lang, bytes(p)) for lang, p in zip(batch["lang"], batch["phrase"])]
            yield batch[["lang", "range", "phrase", "f"]]

    over = counts.where("edge").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= setup.least)
    over = over.mapInPandas(routed, "lang string, range long, phrase binary, f long")
    frequent = counts.where("not edge").select("lang", "range", "phrase", "f").unionByName(over)
    return stored(frequent, "frequent"), totals, bounds


def _range(bounds: Bounds, lang: str, phrase: bytes) -> int:
    of = bounds.get(lang)
    return bisect_right(of, tuple(phrase.split(b" "))) if of else 0


def _parts(phrase: bytes) -> list[tuple[bytes, bytes]]:
    """(first words, rest) for each cut, the shortest beginning first."""
    words = phrase.split(b" ")
    return [(b" ".join(words[:k]), b" ".join(words[k:])) for k in range(1, len(words))]


def collocations(documents: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """Per lang the frequent phrases of two words or more that no longer phrase covers, scored at their weakest cut."""
    frequent, totals, bounds = frequent_phrases(documents, setup)
    longest, cover = setup.longest, setup.cover

    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asked: dict[int, dict[bytes, int]] = {}
        for phrase, f in zip(group["phrase"], group["f"]):
            cuts = _parts(bytes(phrase))
            for k, pair in enumerate(cuts):
                for side, part in enumerate(pair):
                    to = asked.setdefault(_range(bounds, key[0], part), {})
                    inside = k == (0 if side else len(cuts) - 1)  # one word shorter
                    to[part] = max(to.get(part, 0), int(f) if inside else 0)
        rows = [(key[0], to, key[1], Automaton.of(numbered(q, [f + 1 for f in q.values()], longest)).to_bytes()) for to, q in asked.items()]
        return pd.DataFrame(rows, columns=["lang", "range", "source", "automaton"])

    def answer(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        phrases = numbered(map(bytes, held["phrase"]), held["f"], longest)
        rows, covered = [], {}
        for source, automaton in zip(asked["source"], asked["automaton"]):
            question = Automaton.from_bytes(automaton)
            f = question.compose(phrases, phrases.counts)
            parts = question.phrases()
            rows.append((key[0], source, 0, Automaton.of(Phrases(parts.words, parts.rows, f)).to_bytes()))
            for part, own, longer in zip(parts.named(), f.tolist(), (parts.counts - 1).tolist()):
                if 100 * longer >= cover * own:
                    covered[part] = 1
        if covered:
            rows.append((key[0], key[1], 1, Automaton.of(numbered(covered, covered.values(), longest)).to_bytes()))
        return pd.DataFrame(rows, columns=["lang", "range", "source", "automaton"])

    def score(key: tuple, held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        count: dict[bytes, int] = {}
        covered: set[bytes] = set()
        for kind, automaton in zip(answers["source"], answers["automaton"]):
            got = Automaton.from_bytes(automaton).phrases()
            if kind:
                covered.update(got.named())
            else:
                count.update(zip(got.named(), got.counts.tolist()))
        rows = []
        for phrase, a, n in zip(map(bytes, held["phrase"]), held["f"].tolist(), held["n"].tolist()):
            if b" " in phrase and phrase not in covered:
                cuts = [(1000 * a * n // (count[x] * count[y]), count[x], count[y]) for x, y in _parts(phrase)]
                s, l_, r = min(cuts, key=lambda c: c[0])
                rows.append((key[0], phrase.decode(), a, l_, r, n, s))
        return pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "n", "score"])

    by = ("lang", "range")
    asked = frequent.groupBy(*by).applyInPandas(ask, ASKED)
    answers = frequent.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answer, ASKED)
    return frequent.join(totals, "lang").groupBy(*by).cogroup(answers.groupBy(*by)).applyInPandas(score, CANDIDATES)


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each lang's first ``most`` by score, then count, then phrase in byte order."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each lang."""
    return best(collocations(table(spark, sf_dir, "documents")))


QUERIES = {"op11_phrase_automata": op11}

ORACLES = {
    "op11_phrase_automata": r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM texts),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, c.c, l.f AS l, r.f AS r, t.n,
    (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, c.c), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, c.c + 1, c.k), ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), s, s + m - 1), ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT s.* FROM weakest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.f IS NULL OR 100 * o.f < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
}

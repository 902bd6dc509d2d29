"""Phrase counts and collocations from automata against brute force."""

import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from tidemark.llm import collocations as c
from tidemark.llm.count_automaton import Automaton, Known, numbered, summed
from tidemark.llm.shared import shared_dir, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, cover=100, most=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(a, longer.get(p[i : i + k], 0))
        rows = []
        for p, a in often.items():
            if 100 * longer.get(p, 0) >= cover * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, count[p[:k]], count[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], k, *r[1:]) for k, r in enumerate(rows[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(10))
def test_automata_keep_union_and_compose_counts(seed):
    rng = np.random.default_rng(seed)
    words = [b"a", b"a\x01", b"b", "é".encode(), b"of", b"~"]

    def some():
        return Counter(b" ".join(rng.choice(words, rng.integers(1, 6)).tolist()) for _ in range(rng.integers(1, 200)))

    one, two = some(), some()
    a, b = (Automaton.from_bytes(Automaton.of(numbered(x, x.values(), 5)).to_bytes()).phrases() for x in (one, two))
    assert dict(zip(a.named(), a.counts.tolist())) == one
    assert a.named() == sorted(one, key=lambda p: p.split(b" "))
    both = summed([a, b])
    assert dict(zip(both.named(), both.counts.tolist())) == one + two
    rows, weight = Automaton.of(a).states()
    starts = Counter()
    for p, f in one.items():
        p = p.split(b" ")
        starts.update({tuple(p[:k]): f for k in range(1, len(p) + 1)})
    assert sorted(weight.tolist()) == sorted(starts.values())
    assert dict(zip(b.named(), Automaton.of(b).compose(a, a.counts).tolist())) == {p: one.get(p, 0) for p in two}
    for bound in both.named():
        key = tuple(bound.split(b" "))
        assert a.first_not_below(key) == sum(tuple(p.split(b" ")) < key for p in one)


SMALL = c.Setup(least=3, shard_words=60, range_windows=60, fan=2)


@pytest.mark.parametrize("setup", [SMALL, c.Setup(least=3), c.Setup(least=3, shard_words=30, range_windows=60, fan=3)])
def test_collocations_equal_brute_force(spark, setup):
    rng = np.random.default_rng(5)
    common = ["the", "of", "The", "a", "new", "york", "é", "x\x1f", "\x01"]
    texts = []
    for _ in range(30):
        p = rng.dirichlet(np.ones(len(common)))
        words = rng.choice(common, rng.integers(0, 40), p=p).tolist()
        words[3:3] = ["New", "York", "City", "marathon", "of", "1999"][: rng.integers(0, 7)]
        texts.append("".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n"], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])) for w in words))
    rows = [(None if k % 7 == 0 else "de" if k % 3 else "en", t) for k, t in enumerate(texts)] + [("en", None), ("xx", ""), ("de", texts[4]), ("de", "na " * 500)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, range int").repartition(3)
    assert rows_of(c.best(c.collocations(docs, setup))) == brute(rows, setup.least)
    assert rows_of(c.best(c.collocations(docs, setup), 2)) == brute(rows, setup.least, most=2)


def test_collocations_of_no_documents(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert not c.best(c.collocations(docs)).count()
    assert not c.best(c.collocations(spark.createDataFrame([("en", None)], "lang string, text string"))).count()


def test_collocations_of_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert rows_of(c.op11(spark, sf)) == brute(rows, 100)
    assert rows_of(c.best(c.collocations(docs, c.Setup(range_windows=2000, fan=4)))) == brute(rows, 100)


def test_no_shard_is_kept_whole(spark):
    """Next to the text only what is counted often stays in the shared folder; nothing of rare words is cut out for the ranges."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(400)])
    texts = [" ".join(words[rng.integers(0, 400, 4000)]) for _ in range(30)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    shared = Path(urlparse(shared_dir(spark)).path)
    before = set(shared.rglob("*.parquet"))
    got = rows_of(c.best(c.collocations(docs, c.Setup(least=250, range_windows=20_000))))
    assert got == brute([("en", t) for t in texts], 250)
    assert sum(p.stat().st_size for p in set(shared.rglob("*.parquet")) - before if p.is_file()) < 0.2 * sum(map(len, texts))


def test_rare_words_end_a_piece_and_known_words_are_named_by_place(spark):
    docs = spark.createDataFrame([("en", "a b rare c a b"), ("en", "a b")], "lang string, text string")
    setup = c.Setup(least=3)
    often = c.often_of(c.scan(docs, setup), setup)
    shard = c.Shard("en", often, setup)
    assert not list(shard.add(c.tokens_of(b"a b rare c a b")))
    phrases = shard.end()
    assert dict(zip(phrases.named(), phrases.counts.tolist())) == {b"a b": 2, b"b": 2}
    known = Known([b"a", b"z"])
    data = Automaton.of(phrases).to_bytes(known)
    again = Automaton.from_bytes(data, known).phrases()
    assert again.named() == phrases.named() and again.counts.tolist() == phrases.counts.tolist()

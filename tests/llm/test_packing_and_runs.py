"""Tournament packing and periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic_runs, tournament_packing
from tidemark.llm.bytebpe import default_vocabulary
from tidemark.llm.shared import table

SF = "/root/testdata/sf0.001"


def first_fit(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        b = next((k for k, room in enumerate(bins) if room >= n), len(bins))
        if b == len(bins):
            bins.append(capacity)
        bins[b] -= n
        out.append(b)
    return out


def padding(sequences, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sequences)


@pytest.mark.parametrize("seed", range(8))
def test_tournament_places_as_first_fit_does(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 2048, 300).tolist(), reverse=True)
    tree = tournament_packing.Tournament(len(lengths), 2048)
    assert [tree.place(n) for n in lengths] == first_fit(lengths, 2048)


@pytest.mark.parametrize("lengths", [[1100] * 500, [1] * 9, [2047], [683] * 301, list(range(2047, 0, -1)), [1365, 700, 3], []])
def test_groups_pad_little_whatever_the_lengths(lengths):
    rows = tournament_packing.first_fit_decreasing(lengths, 2048, 8)
    of, fill = {i: [] for i in range(len(lengths))}, {}
    for item, _, at, size, b in rows:
        of[item].append((at, size))
        fill[b] = fill.get(b, 0) + size
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(of[i]):
            assert start == at
            at += size
        assert at == n
    assert max(fill.values(), default=0) <= 2048
    assert padding(fill.values(), 2048) <= 8 * len(fill)


def test_tournament_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    got = tournament_packing.op12(spark, SF).toPandas()
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    pieces = {d: g.sort_values("start") for d, g in got.groupby("doc_id")}
    assert set(pieces) == set(docs["doc_id"])
    for doc, text in zip(docs["doc_id"], docs["text"]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in pieces[doc].itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fills = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()]
        fills.append(int(g["length"].sum()))
    assert max(fills) <= 2048
    assert padding(fills, 2048) <= 0.005 * sum(fills)


def test_tournament_packing_of_odd_rows(spark, documents, tmp_path):
    docs = documents([(1, None, "a"), (1, "", None), (None, "one two", "a"), (7, "word " * 9000, "b"), (7, "word " * 9000, "b")], tmp_path / "docs")
    got = tournament_packing.pack_documents(docs, group_pieces=2).toPandas()
    assert got["doc_id"].isna().sum() >= 1 and (got["length"] <= 2048).all()
    totals = got.groupby("doc_id", dropna=False)["length"].sum().to_dict()
    each = got[got["doc_id"] == 7]["doc_tokens"].iloc[0]
    assert totals[1] == 2 and totals[7] == 2 * each
    assert not tournament_packing.pack_documents(docs.where("doc_id > 99")).count()


def brute_runs(words):
    w, found = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.array([], int), {}
    for p in range(1, len(w) // 4 + 1):
        change = np.flatnonzero(np.diff(np.r_[False, w[:-p] == w[p:], False].astype(int)))
        for i, j in zip(change[::2].tolist(), change[1::2].tolist()):
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def planted(rng, n):
    words = rng.integers(0, rng.choice([1, 2, 3, 50]), n).tolist()
    for _ in range(rng.integers(0, 4)):
        p, k = int(rng.integers(1, 7)), int(rng.integers(2, 7))
        at = int(rng.integers(0, max(1, n - 1)))
        words[at:at] = rng.integers(0, 4, p).tolist() * k
    return words


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [planted(rng, int(rng.integers(0, 80))) for _ in range(40)]
    got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts])
    assert got == [brute_runs(t) for t in texts]


def test_long_texts_of_few_words_and_of_many_lines_with_own_starts():
    same = np.zeros(30_000, np.int64)
    line = np.array([1, 2, 3, 4, 5, 6, 7])
    lines = np.concatenate([np.r_[100 + k, line] for k in range(3000)])
    halves = np.r_[np.tile(np.arange(5000), 2), np.tile(np.arange(9000, 9400), 5)]
    assert periodic_runs.runs_of([same, lines, halves]) == [[(0, 30_000, 1)], [], [(10_000, 2000, 400)]]


def expected(doc, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *first, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_periodic_runs_of_the_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in periodic_runs.op13(spark, SF).collect()]
    key = lambda r: (r[0], repr(r))
    assert sorted(got, key=key) == sorted((expected(*d) for d in docs), key=key)
    assert sum(r[1] for r in got) > 10


def test_periodic_runs_of_odd_rows(spark, documents, tmp_path):
    texts = [None, "", " \t\n", "a " * 6, "x\x1fy " * 7, "é b é b é b é b c", "a a a a a", "la " * 20_000, "la " * 20_000]
    docs = documents([(k // 2, t, None) for k, t in enumerate(texts)] + [(None, "so so so so so so so", "s")], tmp_path / "docs")
    got = [tuple(r) for r in periodic_runs.digests(periodic_runs.find_runs(periodic_runs.repeated_tails(docs))).collect()]
    want = [expected(k // 2, t) for k, t in enumerate(texts)] + [expected(None, "so so so so so so so")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.find_runs(docs.where("doc_id > 99")).count() == 0

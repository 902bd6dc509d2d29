"""WARC archives and the vector operators against brute force."""

import gzip
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import grid_order, rotated_codes, shared, vectors, warc

PAGE = "page_id long, url string, html string, captured long, url_key string, digest int"


@pytest.fixture
def pages(spark, tmp_path):
    same = "<html>" + "x" * 200
    rows = [(i, f"http://www.h{i % 4}.Example.org:80/p/{i % 7}?q#f", f"<p>{i}</p>" * (i % 60)) for i in range(60)]
    rows += [(70, "https://a.b/", same), (65, "https://a.b/", same), (65, "https://a.b/", same), (80, None, same), (None, "x y\r\nz", same), (90, "u", None), (91, "u", ""), (92, "u", "é漢" * 40), (93, "u", "\r\n\r\n" * 40)]
    spark.createDataFrame([(*r, 1_704_067_200 + (r[0] or 0) % 9, "k", 1) for r in rows], PAGE).coalesce(3).write.parquet(str(tmp_path / "pages"))
    return spark.read.parquet(str(tmp_path / "pages"))


def test_archives_round_trip_in_global_order(pages, tmp_path):
    got = warc.archive_and_merge(pages, str(tmp_path / "warc")).toPandas().sort_values(["history_part", "history_place"])
    rows = pages.collect()
    assert len(got) == len(rows)
    order = list(zip(got["url_key"], got["captured"]))
    assert order == sorted(order)
    want = sorted((-1 if r["page_id"] is None else r["page_id"], len((r["html"] or "").encode()), hashlib.sha256((r["html"] or "").encode()).hexdigest()) for r in rows)
    assert sorted((int(p) if p == p and p is not None else -1, b, d) for p, b, d in zip(got["page_id"].astype("float"), got["payload_bytes"], got["payload_digest"])) == want
    dup = got[got["payload_bytes"] == 206]
    assert sorted(dup["record_type"]) == ["response"] + ["revisit"] * 4
    assert dup[dup["record_type"] == "response"]["page_id"].tolist() == [65] and set(dup[dup["record_type"] == "revisit"]["refers_to"]) == {65}
    assert (got[got["payload_bytes"] < 100]["record_type"] == "response").all()
    for f in (tmp_path / "warc").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archive_and_merge(pages.limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_any_page_id_and_time_and_ranges_of_any_size(spark, tmp_path, range_rows):
    rows = [(10**12, "a.b/", "x" * 150, 10**15), (-(2**63), "a.b/", "x" * 150, -(10**15)), (2**63 - 1, "c.d/", "y", None)] + [(i, f"h{i % 3}.e/", "z" * i, i % 5) for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string, captured long").write.parquet(str(tmp_path / "pages"))
    manifest = shared.stored(warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "warc")), "m")
    got = warc.merge_runs(shared.stored(warc.read_archives(manifest), "runs"), range_rows).toPandas().sort_values(["history_part", "history_place"])
    assert sorted(zip(got["page_id"], got["captured"])) == sorted((r[0], r[3] or 0) for r in rows)
    order = list(zip(got["url_key"], got["captured"], got["page_id"]))
    assert order == sorted(order)
    by_id = got.set_index("page_id")
    assert by_id.loc[10**12, "record_type"] == "revisit" and by_id.loc[10**12, "refers_to"] == -(2**63)


def test_url_keys(spark):
    df = spark.createDataFrame([("http://www.Ex.org:80/A?b#c",), ("https://u@sub.ex.org:8080",), (None,), ("ex.org/x",)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["org,ex)/a?b", "org,ex,sub:8080)/", ")/", "org,ex)/x"]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), j) for j in range(rng.randrange(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.fixture
def table(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 9] + rng.normal(size=16) * 0.05).tolist()) for i in range(80)] + [(2000 + i, base[3].tolist()) for i in range(60)]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [None] * 16), (3003, [float("nan")] * 16), (3004, [float("inf")] * 16), (3005, [1.0, 2.0]), (3020, []), (None, base[5].tolist()), (3006, (base[3] * 1e150).tolist())]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, id string, key string")
    df.coalesce(3).write.parquet(str(tmp_path / "vectors"))
    return spark.read.parquet(str(tmp_path / "vectors")), np.array([i for i, _ in rows] + [3006]), np.array([v for _, v in rows] + [odd[-1][1]])


def test_search_finds_the_nearest(table):
    df, ids, v = table
    keep = ids != 3006
    ids, v = ids[keep], v[keep]
    rows = vectors.usable(df.where("vec_id IS NULL OR vec_id <> 3006"))
    assert rows.count() == len(ids)
    got = rotated_codes.search(rows, rotated_codes.fit(rows, rows_per_cell=40), F.col("id") % 20 == 0, block_rows=50, query_rows=7).toPandas()
    hits = 0
    queries = ids[ids % 20 == 0]
    assert set(got["query_id"]) == set(queries)
    for q in queries:
        score = v @ v[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        np.testing.assert_allclose(mine["score"], [score[ids == i][0] for i in mine["vec_id"]], rtol=1e-12)
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits >= 0.9 * 20 * len(queries)


def test_each_row_of_a_repeated_query_id_finds_k_others(spark):
    rng = np.random.default_rng(4)
    v, ids = rng.normal(size=(400, 8)), np.arange(400)
    v, ids = np.vstack([v, v[[20, 20, 40]], -v[60:61], np.tile(v[80], (30, 1)), np.tile(v[80], (22, 1))]), np.concatenate([ids, [20, 20, 40], [60], np.full(30, 80), np.arange(1001, 1023)])
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    rows = vectors.usable(df)
    got = rotated_codes.search(rows, rotated_codes.fit(rows, rows_per_cell=1000), F.col("id") % 20 == 0).toPandas()
    for q in (0, 20, 40, 60, 80):
        mine, want = got[got["query_id"] == q], []
        for x in v[ids == q]:
            score = np.where(ids == q, -np.inf, v @ x)
            want += [(k + 1, int(ids[b]), round(score[b], 9)) for k, b in enumerate(np.lexsort((ids, -score))[:20])]
        assert sorted((r.rank, r.vec_id, round(r.score, 9)) for r in mine.itertuples()) == sorted(want)


def test_recall_with_many_more_cells_than_are_always_visited(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 24))[rng.integers(0, 150, 12_000)] + 0.5 * rng.normal(size=(12_000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = vectors.usable(df)
    index = rotated_codes.fit(rows, rows_per_cell=80)
    assert len(index.centroids) == 150
    got = rotated_codes.search(rows, index, F.col("id") % 200 == 0).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(g["vec_id"]))
    assert hits >= 0.97 * 20 * 60


def test_every_query_finds_k_beyond_the_sample(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = vectors.usable(df)
    for sampled in (500, 20_000):  # a twelfth of the table, and all of it
        got = rotated_codes.search(rows, rotated_codes.fit(rows, sampled=sampled, rows_per_cell=400), F.col("id") % 60 == 0, block_rows=300).toPandas()
        assert (got.groupby("query_id")["rank"].max() == 20).all() and got["query_id"].nunique() == 100
        hits = 0
        for q, g in got.groupby("query_id"):
            score = v @ v[q]
            score[q] = -np.inf
            hits += len(set(np.argsort(-score)[:20]) & set(g["vec_id"]))
        assert hits >= 0.95 * 20 * 100


def test_answers_come_by_way_of_the_codes():
    """With bounds of no width only the vectors of the best estimates are compared, so other codes give other answers."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 32))
    index = rotated_codes.Index(np.zeros((1, 32)), np.linalg.qr(rng.normal(size=(32, 32)))[0], width=0.0)
    cell, bits, length, agreement = index.code(v)
    block = pd.DataFrame({"id": np.arange(3000), "v": list(v), "bits": [b.tobytes() for b in bits], "cell": cell, "length": length, "agreement": agreement})
    asked = pd.DataFrame({"query_row": np.arange(50), "query_id": np.arange(50), "v": list(v[:50]), "floor": -np.inf})
    right = rotated_codes._nearest(index, asked, block)
    wrong = rotated_codes._nearest(index, asked, block.assign(bits=block["bits"].sample(frac=1, random_state=1).to_numpy()))

    def recall(found):
        best = {q: set(np.argsort(-np.where(np.arange(3000) == q, -np.inf, v @ v[q]))[:20].tolist()) for q in range(50)}
        return np.mean([len(best[q] & set(g["vec_id"])) / 20 for q, g in found.groupby("query_id")])

    assert recall(right) > 0.75 and recall(wrong) < 0.6


def test_search_with_few_rows_returns_all_others(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = vectors.usable(df)
    got = rotated_codes.search(rows, rotated_codes.fit(rows), F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    none = vectors.usable(df.limit(0))
    assert rotated_codes.search(none, rotated_codes.fit(none), F.col("id") % 20 == 0).count() == 0


def test_the_tree_of_intervals_keeps_near_blocks_and_parts_clusters(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16)) * np.r_[np.full(4, 3.0), np.full(12, 0.05)]
    v = centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "id long, v array<double>, copies long")
    grid = grid_order.fit(df)
    placed = shared.stored(grid_order.sequence(df, grid, 25), "placed").toPandas()
    assert sorted(placed["seq"]) == list(range(3000)) and (placed["seq"] // 25 == placed["block"]).all()
    unit = grid_order.unit_vectors(v)[placed["id"]]
    order = np.argsort(placed["seq"].to_numpy())
    cells = [tuple(c) for c in grid.cells(grid.project(unit))[order]]
    assert cells == sorted(cells)
    level = grid_order.boxes(spark.createDataFrame(placed), grid)
    boxes = {r["block"]: (np.array(r["low"]), np.array(r["high"])) for r in level.collect()}
    want = {(a, b) for a in boxes for b in boxes if a <= b and grid_order.apart(boxes[a], boxes[b]) <= grid.eps}
    got = {(r["left"], r["right"]) for r in grid_order.near_pairs(level, 120, grid).collect()}
    assert got == want and len(got) < 0.6 * 120 * 121 / 2
    work = grid_order.Join(unit[order], grid.project(unit[order]), np.ones(3000, np.int64), grid)
    work.join(0, 3000, 0, 3000)
    assert work.parted > 0 and (work.links == (unit[order] @ unit[order].T >= 0.95).sum(1) - 1).all()


@pytest.mark.parametrize("block", [48, 4096])
def test_links_equal_brute_force(table, block):
    df, ids, v = table
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in grid_order.near_duplicates(df, block_rows=block).collect()}
    assert len(got) == df.count()
    for i, d, c in zip(ids, hit.sum(1), label):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (d, c, i == c)
    for i in (3000, 3001, 3002, 3003, 3004, 3005, 3020):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert grid_order.near_duplicates(df.limit(0)).count() == 0

"""Vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import components, descent, nndescent, regions, voronoi

SCHEMA = "vec_id long, embedding array<float>, rank int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers[rng.integers(0, 12, 500)] + 0.2 * rng.normal(size=(500, 16)), rng.normal(size=(300, 16))]).astype(np.float32)
    x[7:15] = x[6]  # equal vectors
    return [(int(i), v.tolist(), 1) for i, v in enumerate(x)]


def awkward():
    return [(9001, None, 1), (9050, [], 1), (9100, [float("nan")] * 16, 1), (9150, [None] + [1.0] * 15, 1), (9200, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (9250, [1.0, 2.0], 1), (9251, [1.0, 2.0], 1)]


def test_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(voronoi, "UNIT_ROWS", 64)
    df = spark.createDataFrame(rows + awkward(), SCHEMA)
    got = {}
    for r in voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.floor(256 * np.array([v for _, v, _ in rows], np.float64))
    want = {}
    for q in range(0, len(x), 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
        want[q] = [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    want[9250] = [(1, 9251, 5 * 256 * 256)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert voronoi.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def by_force(rows, own, k=5):
    """Scores of the best vector pairs of ids, from plain integers."""
    whole = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows]
    best = {}
    for i, v in whole:
        for q, u in whole:
            if q == own and i != own:
                s = sum(a * b for a, b in zip(u, v, strict=True))
                best[i] = max(best.get(i, s), s)
    return [(r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]


@pytest.mark.parametrize("seed", range(3))
def test_top_k_of_repeated_rows_and_shared_ids(spark, seed):
    """A row repeated six times near a query, one in another cell, and ids that have several vectors."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(160, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, (x[7] * 0 + x[0] * 1.01).tolist())] * 6 + [(9, x[9].tolist())] * 6 + [(50, x[51].tolist()), (11, x[100].tolist())] + [(11, (x[0] * 0.9).tolist())] * 3
    got = {}
    for r in voronoi.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {q: by_force(rows, q) for q in (0, 50, 100, 150)}


def test_nearest(spark, rows):
    df = spark.createDataFrame([*rows, *awkward(), (9300, [0.0] * 16, 1)], SCHEMA)
    got = {}
    for r in nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([v for _, v, _ in rows], np.float64)
    hits = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 21)) and q not in {i for _, i, _ in own}
        assert np.allclose([v for *_, v in own], [s[i] for _, i, _ in own]) and [v for *_, v in own] == sorted((v for *_, v in own), reverse=True)
        hits.append(len(best & {i for _, i, _ in own}) / 20)
    assert np.mean(hits) >= 0.9
    assert set(got) - set(range(0, len(x), 20)) == set()
    assert nndescent.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_trees_of_several_stages_and_copied_buckets(spark, rows, monkeypatch):
    """Every stage of a tree deals all rows on, into nodes about as large; a bucket that many ask of gives the same answers."""
    monkeypatch.setattr(nndescent, "LEVELS", 2)
    monkeypatch.setattr(nndescent, "LOCAL_ROWS", 16)
    monkeypatch.setattr(nndescent, "LEAF", 8)
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, v array<double>")
    most = float(max(np.linalg.norm(v) for _, v, _ in rows))
    for limit in (nndescent.BROADCAST_BYTES, 0):
        monkeypatch.setattr(nndescent, "BROADCAST_BYTES", limit)
        got = nndescent._leaves(df, 16, len(rows), 1, most).select("bucket", "vec_id").collect()
        assert sorted(r.vec_id for r in got) == sorted(i for i, *_ in rows)
        sizes = np.bincount([r.bucket for r in got])
        assert sizes.max() <= 40 and (sizes > 0).sum() > 30
    monkeypatch.undo()
    x = np.array([v for _, v, _ in rows], np.float64)
    parts = list(nndescent._halves(np.concatenate([x, np.zeros((900, 16))]), np.random.default_rng(1)))
    assert sorted(np.concatenate(parts)) == list(range(len(x) + 900)) and max(map(len, parts)) <= nndescent.LEAF
    state, n_buckets = nndescent.build(df, 16, len(rows), most)
    asked = df.where("vec_id % 40 = 0").selectExpr("vec_id as query_id", "v as q", "array(vec_id) as entry")
    plain = nndescent.search(state, 16, n_buckets, asked, 20).collect()
    monkeypatch.setattr(nndescent, "HOT_ASKS", 3)
    assert sorted(map(tuple, nndescent.search(state, 16, n_buckets, asked, 20).collect())) == sorted(map(tuple, plain))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (None, 1), (2, 1), *[(100, k) for k in range(101, 140)], (139, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 6: 6, **{k: 6 for k in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_graph_and_walk_go_on_until_they_settle(spark, rows, monkeypatch):
    x = nndescent._entry(1, np.zeros(2), np.array([1, 2, 3]))
    nndescent._stepped(x, np.array([1, 2, 3]), np.array([3.0, 2.0, 1.0]), np.array([[2, 3], [1, 3], [9, -1]]), beam=3, opened=1)
    assert x["want"].tolist() == [9] and x["opened"].all()
    vectors = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, v array<double>")
    v = np.array([v for _, v, _ in rows], np.float64)
    most = float(np.sqrt((v**2).sum(1)).max())
    state, n_buckets = nndescent.build(vectors, 16, len(rows), most)
    asked = vectors.where("vec_id = 0").selectExpr("vec_id as query_id", "v as q", "array(vec_id) as entry")
    want = [int(i) for i in np.argsort(-(v @ v[0]), kind="stable") if i != 0][:20]
    got = [r.vec_id for r in nndescent.search(state, 16, n_buckets, asked, 20, opened=4).orderBy("rank").collect()]
    assert len(set(got) & set(want)) >= 18
    turns = iter([len(rows) * nndescent.K] * 14 + [1])
    monkeypatch.setattr(nndescent, "_round", lambda state, *_: (state, next(turns)))
    nndescent.build(vectors, 16, len(rows), most)
    assert next(turns, None) is None


def test_links_that_the_bound_cut_stay_new(spark):
    """All 200 vectors point at one hub, which meets a bounded number of them in a round, others in the next."""
    n, k = 200, 2
    ids = np.arange(n)
    v = np.random.default_rng(2).normal(size=(n, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    node = np.stack((np.where(ids == 0, 1, 0), np.where(ids < 2, 2, 1)), 1)
    score = np.where(node == 0, 2.0, 1.5).astype(np.float32)  # nothing is better than these links: only flags change
    state = spark.createDataFrame([(0, bytes(nndescent._save([ids, v, node, score, np.full((n, k), 3, np.uint8)])))], "bucket int, blob binary")
    left = []
    for turn in range(4):
        state, changed = nndescent._round(state, 4, 1, k, 1.0, turn)
        assert changed == 0
        new = nndescent._load(state.first().blob)[4]
        left.append(int(((new[:, 0] & 2) > 0)[1:].sum()))
    most = nndescent.REVERSE + k
    assert left[0] >= n - 1 - most and all(0 < a - b <= most for a, b in zip(left, left[1:]))


def neighbours(spark, rows, k=20):
    got = {}
    for r in nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_ties_of_many_equal_vectors_and_what_lies_beyond_them(spark):
    """60 equal vectors are more than a vector has links: the smallest ids win, and longer vectors beside them are still met."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(140, 6))
    x[40:100] = x[40]
    x[100:105] = x[40] * 1.5 + 0.01 * rng.normal(size=(5, 6))
    got = neighbours(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for q in range(0, 140, 20):
        s = np.round(x @ x[q], 9)
        assert [i for _, i, _ in got[q]] == [int(i) for i in np.lexsort((np.arange(140), -s)) if i != q][:20]


def test_regions_and_their_parts_keep_recall_in_few_jobs(spark, monkeypatch):
    """Vectors without any clusters and of unequal norms, in many regions of which the large ones are dealt to parts."""
    for name, value in {"REGION_ROWS": 100, "LARGEST": 110, "FITTED": 300}.items():
        monkeypatch.setattr(regions, name, value)
    x = np.random.default_rng(8).normal(size=(1000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = df.selectExpr("xxhash64(embedding) as h", "embedding as v", "array(vec_id) as ids")
    asks = index.where("ids[0] % 20 = 0").selectExpr("h", "v", "ids[0] as rep")
    norm = np.linalg.norm(x, axis=1)
    space = regions.Space(12, float(norm.max()), False, 20)
    fit = regions.fitted(index, asks, space, len(x))
    assert len(fit.parts) == 10 and fit.parts.max() > 1 and 1 < fit.asked <= 10
    dealt = regions._dealt(index, asks, space, fit).select("region", "kind", F.col("ids")[0].alias("id")).collect()
    assert sorted(r.id for r in dealt if r.kind == 0) == list(range(1000))
    spark.sparkContext.setJobGroup("nearest", "")
    got = neighbours(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest")) < 30
    spark.sparkContext.setJobGroup("other", "")
    hits = []
    for q in range(0, 1000, 20):
        best = [int(i) for i in np.argsort(-(x @ x[q])) if i != q][:20]
        assert [r for r, *_ in got[q]] == list(range(1, 21)) and np.allclose([s for *_, s in got[q]], [x[i] @ x[q] for _, i, _ in got[q]])
        hits.append(len(set(best) & {i for _, i, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_descent_and_walks_in_memory():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = descent.graph(x)
    assert (links != np.arange(3000)[:, None]).all()
    q, own = x[::30], np.arange(0, 3000, 30)
    beam = descent.fitting_beam(x, links, q, own, 20, 24)
    met = descent.walk(x, links, q, own, beam)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert (met[:, 0] == own).all() and np.mean([np.isin(b, m).mean() for b, m in zip(best, met, strict=True)]) >= descent.REACH
    assert all(len(set(m[m >= 0].tolist())) == (m >= 0).sum() for m in met)
    for n in (1, 2, 30):  # all rows, if fewer than the beam
        small = descent.walk(x[:n], descent.graph(x[:n]), x[:2], np.array([0, -1]), 48)
        assert np.sort(small, axis=1).tolist() == [list(range(n))] * 2

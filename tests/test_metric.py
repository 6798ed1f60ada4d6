"""Pruned tiles give the answers of all pairs and form few of them."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.functions import ranking
from tessella.operators import blocks, graph, metric


def clustered(spark, n=1500, dims=6, clusters=12, seed=0, equal=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 20
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims))
    x[:equal] = x[0]
    rows = [(f"p{i:05d}", v.tolist(), float(i % 7)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "ref string, x array<double>, payload double")


def formed(tiles, pairs):
    n = int((tiles.ranges.size > 0).sum())
    return pairs.count() / (n * n)


@pytest.mark.parametrize("equal,k", [(0, 5), (500, 3), (1500, 2)])
def test_nearest_points_equal_brute_force(spark, equal, k):
    x, df = clustered(spark, equal=equal)
    got = blocks.nearest_points(df.select(df.ref.alias("id"), "x"), df, k, tile=64, skip_self=True).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    want = {(f"p{i:05d}", r + 1): f"p{j:05d}" for i in range(len(x)) for r, j in enumerate(order[i])}
    assert {(r.id, r["rank"]): r.ref for r in got} == want
    assert max(abs(r.distance - d[int(r.id[1:]), int(r.ref[1:])]) for r in got) < 1e-9
    assert all(r.payload == int(r.ref[1:]) % 7 for r in got)


def test_few_tile_pairs_are_formed(spark):
    _, df = clustered(spark, 3000)
    points = df.selectExpr("ref AS key", "x")
    tiles = metric.tiles_of(points, metric.pivots_of(points), 64)
    assert tiles.ranges.size.sum() == 3000 and tiles.ranges.size.max() < 200
    assert formed(tiles, metric.pairs_near(tiles, metric.reach_of(tiles, tiles, 5, True))) < 1 / 3
    assert formed(tiles, metric.pairs_within(tiles, 1.0)) < 1 / 3


def test_other_points_few_points_and_none(spark):
    x, refs = clustered(spark, 300)
    points = spark.createDataFrame([("a", x[3].tolist()), ("b", (x[5] + 100).tolist())], "id string, x array<double>")
    got = {(r.id, r["rank"]): r.ref for r in blocks.nearest_points(points, refs, 2, tile=16).collect()}
    for name, v in (("a", x[3]), ("b", x[5] + 100)):
        near = np.argsort(((x - v) ** 2).sum(1))[:2]
        assert [got[name, 1], got[name, 2]] == [f"p{i:05d}" for i in near]
    assert blocks.nearest_points(points, refs.limit(3), 20, tile=2).count() == 6
    assert blocks.nearest_points(points.limit(0), refs, 2).count() == 0
    assert blocks.nearest_points(points, refs.limit(0), 2).count() == 0


def profiles(spark, n=400, days=40, gaps=0, seed=1, noise=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(10, days))
    rows = []
    for i in range(n):
        v = base[i % 10] + noise * rng.normal(size=days)
        keep = np.ones(days, bool)
        if i < gaps:
            keep[rng.integers(0, days, 5)] = False
        if i == gaps:
            v[:] = 1.5  # no variance
        rows.append(("*", f"t{i:04d}", np.flatnonzero(keep).tolist(), v[keep].tolist()))
    return rows, spark.createDataFrame(rows, "grp string, ticker string, pos array<int>, val array<double>")


def correlations(rows):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            at = sorted(set(a[2]) & set(b[2]))
            u = np.array([dict(zip(a[2], a[3]))[p] for p in at])
            v = np.array([dict(zip(b[2], b[3]))[p] for p in at])
            u, v = u - u.mean(), v - v.mean()
            if u.any() and v.any():
                out[b[1], a[1]] = float(u @ v / math.sqrt((u @ u) * (v @ v)))
    return out


@pytest.mark.parametrize("gaps", [0, 60])
def test_correlated_pairs_equal_brute_force(spark, gaps):
    rows, df = profiles(spark, 150, gaps=gaps)
    want = correlations(rows)
    got = {(r.a, r.b): r.similarity for r in blocks.similar_pairs(df, 10, 0.8, 0.95, tile=16).collect()}
    assert got.keys() == {p for p, c in want.items() if 0.8 <= c < 0.95} and got
    assert max(abs(got[p] - want[p]) for p in got) < 1e-9
    near = blocks.nearest(df, 4, 10, 0.1, degree_at=0.5, tile=16).collect()
    both = {**want, **{(b, a): c for (a, b), c in want.items()}}
    for t in {r[1] for r in rows}:
        mine = sorted(((-c, b) for (a, b), c in both.items() if a == t and c > 0.1))[:4]
        found = sorted((-r.similarity, r.neighbor) for r in near if r.ticker == t and r.neighbor)
        assert [b for _, b in found[:4]] == [b for _, b in mine]
        assert sum(r.n for r in near if r.ticker == t and r.neighbor is None) == sum(c >= 0.5 for (a, _), c in both.items() if a == t)


def test_few_pairs_of_complete_profiles_are_formed(spark):
    _, df = profiles(spark, 1200, noise=0.15)
    own, pairs = blocks.tile_pairs(df, 32, blocks.radius_of(0.8))
    n = own.select("tile").distinct().count()
    assert own.count() == 1200 and pairs.count() < n * (n + 1) / 2 / 3
    _, near = blocks.tile_pairs(df, 32, blocks.radius_of(0.0), 3)
    assert near.count() < n * (n + 1) / 2 / 3


def test_spans_of_many_tiles_bound_the_copies_and_lose_nothing(spark):
    rows, df = profiles(spark, 150, gaps=150)
    sent = blocks._met_spans(df, 4, blocks.radius_of(0.8)).where("ticker IS NOT NULL").groupBy("ticker").count().agg({"count": "max"}).first()[0]
    assert sent <= blocks.SPANS + 1  # a copy per tile before: 38
    want = correlations(rows)
    got = {(r.a, r.b): r.similarity for r in blocks.similar_pairs(df, 10, 0.8, 0.95, tile=4).collect()}
    assert got.keys() == {p for p, c in want.items() if 0.8 <= c < 0.95} and got
    near = blocks.nearest(df, 2, 10, 0.8, hi=0.95, tile=4).collect()
    both = {**want, **{(b, a): c for (a, b), c in want.items()}}
    for t in {r[1] for r in rows}:
        mine = sorted((-c, b) for (a, b), c in both.items() if a == t and 0.8 <= c < 0.95)[:2]
        assert [b for _, b in sorted((-r.similarity, r.neighbor) for r in near if r.ticker == t)[:2]] == [b for _, b in mine]


def test_spectral_of_a_long_path_in_few_rounds(spark, monkeypatch):
    """Values within 1e-3 of each other; plain products need thousands of rounds."""
    n, seen = 80, []
    real = graph.stage

    def counted(df, *a):
        seen.append(df)
        assert len(seen) <= 60
        return real(df, *a)

    monkeypatch.setattr(graph, "stage", counted)
    rows = [(f"t{i:04d}", f"t{j:04d}", 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    got = sorted(graph.spectral(spark.createDataFrame(rows, "ticker string, neighbor string, weight double"), 3, 1e-6).collect())
    a = np.zeros((n, n))
    for x, y, w in rows:
        a[int(x[1:]), int(y[1:])] = w
    d = a.sum(1) ** -0.5
    vectors = np.linalg.eigh(d[:, None] * a * d)[1][:, ::-1]
    for k, c in enumerate(("graph_x", "graph_y", "graph_z"), 1):
        assert abs(np.corrcoef([r[c] for r in got], vectors[:, k])[0, 1]) > 0.999
    assert max(got[0].residual_x, got[0].residual_y, got[0].residual_z) <= 1e-6


def test_points_list_their_best_once_and_equal_sets_are_searched_once(spark, monkeypatch):
    x, refs = clustered(spark, 300, clusters=3)
    seen, real = [], blocks.nearest_points
    monkeypatch.setattr(blocks, "nearest_points", lambda *a, **o: seen.append(a) or real(*a, **o))
    test = refs.select(F.col("ref").alias("id"), "x", F.lit(0.5).alias("p"))
    one = graph.knn_adjust(test, refs, 5, same=True).select("id", "consensus", "confidence").collect()
    assert len(seen) == 1
    two = graph.knn_adjust(test, refs, 5, skip_self=True).select("id", "consensus", "confidence").collect()
    assert sorted(one) == sorted(two) and len(one) == 300
    found, first = [], ranking.first_rows
    monkeypatch.setattr(ranking, "first_rows", lambda df, *a: found.append(df) or first(df, *a))
    got = real(refs.select(F.col("ref").alias("id"), "x"), refs, 5, tile=8, skip_self=True).collect()
    assert found[0].groupBy("id").count().agg(F.max("count")).first()[0] <= 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(300, np.inf))
    assert {(r.id, r.ref) for r in got} == {(f"p{i:05d}", f"p{j:05d}") for i in range(300) for j in np.argsort(d[i])[:5]}


def test_spectral_of_a_small_graph_in_one_task_equals_the_joins(spark, monkeypatch):
    seen, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, *a: seen.append(df) or real(df, *a))
    rows = [(f"t{i:03d}", f"t{i + 1:03d}", 1.0 + i / 20) for i in range(40)]
    rows += [(b, a, w) for a, b, w in rows]
    edges = spark.createDataFrame(rows, "ticker string, neighbor string, weight double")
    one = sorted(graph.spectral(edges, guard=6).collect())
    assert len(seen) == 1  # a job and a write per few products before
    monkeypatch.setattr(graph, "CELLS", 0)
    many = sorted(graph.spectral(edges, guard=6).collect())
    assert len(seen) > 4 and [r.ticker for r in one] == [r.ticker for r in many]
    for x, y in zip(one, many):
        assert all(abs(x[c] - y[c]) < 1e-5 for c in ("graph_x", "graph_y", "graph_z", "residual_x"))
    assert graph.spectral(edges.limit(0)).count() == 0


def test_spectral_task_products_span_chunks():
    """A ring of more rows than one chunk of a product."""
    n = 20_000
    i = np.arange(n)
    near, w = np.stack([(i - 1) % n, (i + 1) % n], axis=1).ravel(), np.full(2 * n, 0.25)
    v = np.random.default_rng(0).normal(size=(n, 8))
    v[:, 0] = 1
    q, r = graph._spectral_here(v, 2 * i, near, w, 3, 1e-3)
    assert r.max() <= 1e-3 and np.allclose(q.T @ q, np.eye(4), atol=1e-8)
    m = q / 2 + (q[(i - 1) % n] + q[(i + 1) % n]) / 4
    assert np.linalg.norm(m - q * (q * m).sum(0), axis=0).max() <= 2e-3


def test_spectral_of_many_parts_ends():
    """The value 1 once a part: more often than the subspace has vectors."""
    n = 4000
    i = np.arange(n)
    near = (i[:, None] // 8 * 8 + (i[:, None] + np.arange(1, 8)) % 8).ravel()
    v = np.random.default_rng(0).normal(size=(n, 16))
    q, r = graph._spectral_here(v, 7 * i, near, np.full(7 * n, 1 / 14), 3, 1e-4)
    assert r.max() <= 1e-4 and np.allclose(q.T @ q, np.eye(4), atol=1e-8)


@pytest.mark.parametrize("form", ["pearson", "standardized"])
def test_only_pairs_of_enough_dates_are_summed(form, monkeypatch):
    rng = np.random.default_rng(6)
    days = np.arange(300)
    frames = []
    for t in range(2):
        pos = [np.sort(rng.choice(days, 60, replace=False)) for _ in range(50)]
        if t:
            pos[:2] = frames[0]["pos"][:2]  # the same dates
        frames.append(blocks.pd.DataFrame({"ticker": [f"{t}{i}" for i in range(50)], "pos": pos, "val": [rng.normal(size=60) for _ in pos]}))
    a, b = (blocks._prepared(f, days, form, True) for f in frames)
    monkeypatch.setattr(blocks, "FEW", 0)
    n, whole = blocks._scores(a, b, form, 40)
    monkeypatch.undo()
    summed, real = [], blocks._pearson
    monkeypatch.setattr(blocks, "_pearson", lambda *s: summed.append(s[0].size) or real(*s))
    m, few = blocks._scores(a, b, form, 40)
    assert (n == m).all() and (n >= 40).sum() >= 2 and sum(summed) <= (n >= 40).sum()  # all 2,500 before
    assert np.allclose(few[n >= 40], whole[n >= 40], atol=1e-12) and np.isnan(few[n < 40]).all()

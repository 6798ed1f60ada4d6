"""Sliding windows against windows computed anew, axes and states."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import temporal as tp


def test_sliding_sums_equal_fresh_ones():
    rng = np.random.default_rng(0)
    m = (rng.random((5, 200)) < 0.8).astype(float)
    x = rng.normal(size=(5, 200)) * m
    x[4] = 2.5 * m[4]  # no variance
    windows = [(max(0, e - 60), e) for e in [*range(61, 150, 3), 190, 200]]
    for (a, b), (n, c) in zip(windows, tp.sliding_moments((x[:3], m[:3]), (x, m), windows)):
        for i in range(3):
            for j in range(5):
                at = (m[i, a:b] > 0) & (m[j, a:b] > 0)
                assert n[i, j] == at.sum()
                if j == 4:
                    assert np.isnan(c[i, j])
                else:
                    assert c[i, j] == pytest.approx(np.corrcoef(x[i, a:b][at], x[j, a:b][at])[0, 1], abs=1e-9)


def panel(spark, n=14, days=60, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(3, days))
    rows = []
    for i in range(n):
        r = base[i % 3] + 0.5 * rng.normal(size=days)
        rows += [(f"t{i:02d}", datetime.date(2000, 1, 1) + datetime.timedelta(days=d), float(r[d]), float(rng.normal()) if d % 7 else None) for d in range(days) if rng.random() < 0.9]
    return rows, spark.createDataFrame(rows, "ticker string, date date, ret_1d double, ret_20d double")


@pytest.mark.parametrize("tile,chunk", [(128, 64), (4, 5)])
def test_graph_of_every_date_equals_brute_force(spark, tile, chunk):
    rows, df = panel(spark)
    dates = sorted({r[1] for r in rows})
    frames = dates[-20:]
    got = tp.temporal_graph(df, spark.createDataFrame([(d,) for d in frames], "date date"), 30, 3, 12, degree_at=0.5, tile=tile, chunk=chunk).collect()
    held = {(t, d): (r, c) for t, d, r, c in rows}
    names = sorted({r[0] for r in rows})
    assert len(got) == sum((t, d) in held for t in names for d in frames)
    for g in got:
        k = dates.index(g.date)
        window = dates[max(0, k - 29) : k + 1]
        c = {}
        for t in names:
            both = [d for d in window if (t, d) in held and (g.ticker, d) in held]
            if t != g.ticker and len(both) >= 12:
                v = np.corrcoef([held[g.ticker, d][0] for d in both], [held[t, d][0] for d in both])[0, 1]
                if v > 0:
                    c[t] = v
        assert g.graph_degree == sum(v >= 0.5 for v in c.values())
        best = [(v, held[t, g.date][1]) for t, v in sorted(c.items(), key=lambda e: (-e[1], e[0]))[:3] if held.get((t, g.date), (0, None))[1] is not None]
        assert g.graph_similarity_mean == pytest.approx(np.mean([v for v, _ in best]) if best else 0.0, abs=1e-9)
        if best:
            assert g.neighbor_ret_20d == pytest.approx(sum(v * r for v, r in best) / sum(v for v, _ in best))
        else:
            assert g.neighbor_ret_20d is None


def test_rows_list_their_best_once_whatever_the_tiles(spark, monkeypatch):
    _, df = panel(spark)
    frames = df.select("date").distinct().orderBy(F.desc("date")).limit(5)
    found, real = [], tp.stage
    monkeypatch.setattr(tp, "stage", lambda d, *a: found.append(real(d, *a)) or found[-1])
    tp.temporal_graph(df, frames, 30, 3, 12, degree_at=0.5, tile=2)
    listed = next(d for d in found if "neighbor" in d.columns).where("neighbor IS NOT NULL")
    assert 0 < listed.groupBy("i", "ticker").count().agg(F.max("count")).first()[0] <= 3


def test_axes_and_the_best_of_several_starts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) @ np.diag([3, 2, 1, 0.1])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double, d double")
    axes = tp.principal_axes(df, ["a", "b", "c", "d"])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert axes.variances == pytest.approx(values) and axes.residuals.max() < 1e-12
    rows, cost = tp.latent_states(df, 4, starts=3, cols=("a", "b", "c"))
    assert len(cost) == 3
    total = rows.agg(F.sum("state_distance2")).first()[0]
    assert total <= min(cost.values()) * (1 + 1e-6)
    flat = tp.robust_columns(spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (2, 1.0), (2, 1.0), (2, 1.0), (2, 9.0)], "date int, v double"), ["v"])
    assert sorted((r.date, r.z_v) for r in flat.collect())[:3] == [(1, 0.0)] * 3 and max(r.z_v for r in flat.collect()) == pytest.approx(2.0, abs=0.5)


def test_only_pairs_with_a_moving_position_are_correlated_again(monkeypatch):
    rng = np.random.default_rng(3)
    m = (rng.random((60, 150)) < 0.2).astype(float)
    x = rng.normal(size=m.shape) * m
    cells, real = [], tp._correlation
    monkeypatch.setattr(tp, "_correlation", lambda *s: cells.append(s[0].size) or real(*s))
    windows = [(f, f + 110) for f in range(40)]
    got = [(n.copy(), c.copy()) for n, c in tp.sliding_moments((x, m), (x, m), windows)]
    assert sum(cells) < 60 * 60 * 40 / 5  # all pairs of all windows before
    for (a, b), (n, c) in zip(windows, got):
        for i, j in ((0, 1), (5, 40), (17, 59)):
            at = (m[i, a:b] > 0) & (m[j, a:b] > 0)
            assert n[i, j] == at.sum()
            if at.sum() > 2:
                assert c[i, j] == pytest.approx(np.corrcoef(x[i, a:b][at], x[j, a:b][at])[0, 1], abs=1e-9)


def test_best_of_rows_over_many_tiles_equal_a_sort():
    from tessella.operators import blocks

    rng = np.random.default_rng(4)
    sim = np.round(rng.normal(size=(30, 200)), 1)  # many ties
    sim[rng.random(sim.shape) < 0.3] = np.nan
    sim[3] = np.nan
    top = blocks._Top(30, 4)
    for at in range(0, 200, 25):
        top.add(sim[:, at : at + 25], np.arange(at, at + 25))
    for i in range(30):
        want = sorted((-s, j) for j, s in enumerate(sim[i]) if s == s)[:4]
        assert sorted((-s, j) for r, j, s in zip(top.row, top.name, top.sim) if r == i) == want

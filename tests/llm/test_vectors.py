"""Top-k search and whitening against numpy on whole matrices."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import maxscore, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, score int, row int, n long, key string"


def vectors(n=400, dims=12, seed=3):
    """Clustered vectors with ties, repeated vectors and rows, nulls and values that are not finite."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    held = [(centres[k % 5] * 0.2 + rng.normal(size=dims) * 0.1).tolist() for k in range(n)]
    held[: n // 3] = [held[0]] * (n // 3)
    rows = [(k, v) for k, v in enumerate(held)]
    rows += [(n, None), (n + 1, [None] * dims), (n + 2, [math.nan] + held[0][1:]), (n + 3, [math.inf] + held[0][1:]), (n + 4, [-math.inf] * dims)]
    return [(*r, 1, 2, "x", 3, 4, 5, "k") for r in rows]


def whole(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(256 * float(np.float32(c))) for c in v]


def brute(rows, k, every):
    some = [(r[0], x) for r in rows if r[0] is not None and (x := whole(r[1])) is not None]
    out = []
    for q, x in {(i, tuple(x)) for i, x in some if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in some if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,block,shard_bytes", [(5, 1000, 1 << 21), (3, 7, 2000), (1, 100, 1)])
def test_top_k(spark, k, block, shard_bytes):
    rows = vectors()
    # repeated rows, an identifier with two vectors, other lengths, no identifier
    rows += [rows[40], rows[150], (60, rows[7][1], *rows[0][2:]), (450, [0.5, -0.25], *rows[0][2:]), (460, [0.1] * 20, *rows[0][2:]), (470, [], *rows[0][2:])]
    rows += [(None, rows[5][1], *rows[0][2:])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = maxscore.top_k(df, F.col("vec_id") % 10 == 0, k, block=block, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, 10)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1, 1, "", 1, 1, 1, ""), (50, [0.5, 0.5], 1, 1, "", 1, 1, 1, ""), (51, [-1.0, 3.0], 1, 1, "", 1, 1, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, maxscore.top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows, 5, 50)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert maxscore.top_k(df.where("vec_id = 51"), F.col("vec_id") % 50 == 0).count() == 0


def test_probes_are_rare():
    """Once thresholds are known, most pairs end with the essential terms."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(64, 3000)) / 8).astype(np.int64)
    x[:, 1500:1600] = x[:, :100] // 2 + x[:, 200:300] // 4  # neighbours of the queries
    best = maxscore.Best(np.arange(100), x[:, :100].T.copy(), 1)
    first, second = np.s_[:, :1600], np.s_[:, 1600:]
    for part, ids in ((first, np.arange(1600)), (second, np.arange(1600, 3000))):
        probed = maxscore.search(x[part], ids, x[part].min(axis=1), x[part].max(axis=1), best)
    scores = x.T @ x[:, :100]
    np.fill_diagonal(scores, -(10**9))
    assert best.doc.tolist() == scores.argmax(axis=0).tolist()
    assert 0 < probed < 100 * 1400 / 4


def spectrum(values, seed=2):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 90, 40), np.r_[1e6, 1e3, 1, 1e-3, 0], np.r_[np.linspace(1, 9, 20), 50 + 1e-7 * np.arange(9)], np.r_[np.full(7, 3.0), 1, 2], 5 + 1e-10 * np.arange(12), np.zeros(3), np.array([2.0])])
def test_eigenvectors_in_double_precision(values):
    a = spectrum(np.asarray(values, float)) if len(values) > 1 else np.diag(values)
    found, x = whitening.eigen(a)
    assert (np.diff(found.astype(float)) <= 0).all()
    assert np.abs(np.sort(found) - np.linalg.eigvalsh(a)).max() <= 1e-13 * max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-16
    assert np.abs(a.astype(np.longdouble) @ x - x * found).max() <= 1e-16 * np.abs(a).max()


def test_single_precision_alone_is_not_enough():
    a = spectrum(np.linspace(1, 90, 40))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    assert np.abs(a @ x - x * np.diag(x.T @ a @ x)).max() > 1e-10 * np.abs(a).max()
    _, better, steps = whitening.refine(a, x, 1e-13, 1e-7)
    assert steps <= 6 and np.abs(a @ better - better * np.diag(better.T @ a @ better)).max() < 1e-13 * np.abs(a).max()


def test_whitening(spark):
    rows = vectors() + [(7, None, 1, 1, "", 1, 1, 1, ""), (None, vectors()[200][1], 1, 1, "", 1, 1, 1, ""), (900, [0.5] * 3, 1, 1, "", 1, 1, 1, ""), (901, [], 1, 1, "", 1, 1, 1, "")]
    rows += [rows[300], rows[300]]
    some = [(r[0], x) for r in rows if (x := whole(r[1])) is not None and len(x) == 12]
    fit = np.unique(np.array([x for _, x in some]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = fit - sums / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == 4 * len(some)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    sign = None
    for i, x in some:
        x = np.array(x)
        want = (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4])
        mine = by_row[i, int(((n * x - sums) ** 2).sum())]
        mine = np.array([mine[c][0].whitened for c in (1, 2, 3, 4)])
        sign = np.sign(mine * want) if sign is None else sign
        assert np.abs(mine - sign * want).max() < 1e-9
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-12)


def test_whitening_without_variance(spark):
    one = [(k, [0.25, -0.5], 1, 1, "", 1, 1, 1, "") for k in range(3)]
    got = whitening.whiten(spark.createDataFrame(one, SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 6
    line = [(k, [k / 256, 2 * k / 256, 0.0], 1, 1, "", 1, 1, 1, "") for k in range(5)]
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and {r.explained for r in got if r.component == 1} == {1.0}
    assert sorted(r.deviation for r in got if r.component == 1) == [0, 125, 125, 500, 500]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = [(k, [1e6 * k, 1.0], 1, 1, "", 1, 1, 1, "") for k in range(3)] + [(9, [1e30, 1.0], 1, 1, "", 1, 1, 1, "")]
    got = whitening.whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and {r.deviation for r in got} == {0, (3 * 256 * 10**6) ** 2}

"""Merged pools are those of one pass over everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.isotonic import interpolate, isotonic_pools


def whole(points):
    """max-min formula on distinct values."""
    x = sorted({p for p, _ in points})
    s = np.array([sum(y for p, y in points if p == v) for v in x], float)
    w = np.array([sum(p == v for p, _ in points) for v in x], float)
    cs, cw = np.r_[0, np.cumsum(s)], np.r_[0, np.cumsum(w)]
    out = [max(min((cs[k + 1] - cs[j]) / (cw[k + 1] - cw[j]) for k in range(i, len(x))) for j in range(i + 1)) for i in range(len(x))]
    return x, out


@pytest.mark.parametrize("slope,rows", [(1.0, 7), (0.0, 7), (-1.0, 5), (3.0, 1000), (0.4, 3)])
def test_pools_of_parts_equal_the_formula(spark, slope, rows):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 120).round(2)
    points = [(float(a), float(b)) for a, b in zip(x, slope * x + rng.normal(0, 0.3, 120))]
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None)], "p double, y double").repartition(4)
    pools = sorted(map(tuple, isotonic_pools(df, "p", "y", rows).collect()))
    xs, want = whole(points)
    assert [p[1] for p in pools] == sorted(p[1] for p in pools) and sum(p[3] for p in pools) == len(points)
    got = {v: next(p[2] for p in pools if p[0] <= v <= p[1]) for v in xs}
    assert [got[v] for v in xs] == pytest.approx(want)
    ask = [-1.0, 0.0, 0.333, 0.5, 0.777, 2.0]
    line = interpolate(spark.createDataFrame([(a,) for a in [*ask, None]], "q double"), spark.createDataFrame(pools, "lo double, hi double, value double, w double"), "q", "iso")
    found = {r.q: r.iso for r in line.collect()}
    assert found.pop(None) is None and [found[a] for a in ask] == pytest.approx(np.interp(ask, xs, want).tolist())


def test_no_rows(spark):
    df = spark.createDataFrame([], "p double, y double")
    assert isotonic_pools(df, "p", "y").count() == 0


def test_lines_between_pools_cost_one_step_a_row(spark):
    pools = spark.createDataFrame([(0.1, 0.2, 1.0, 1.0), (0.4, 0.4, 2.0, 1.0)], "lo double, hi double, value double, w double")
    line = interpolate(spark.range(9).select((F.col("id") / 10).alias("q")), pools, "q", "iso")
    # a frame from a row to the last one is summed up anew for every row
    assert "unboundedfollowing" not in line._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.iso for r in line.orderBy("q").collect()] == pytest.approx([1, 1, 1, 1.5, 2, 2, 2, 2, 2])

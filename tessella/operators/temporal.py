"""Graphs, axes and states that move from date to date."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import clip
from tessella.functions.ranking import first_rows, quantiles
from tessella.operators import blocks
from tessella.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN, SPANS, WIDE = 8192, 24, 65_536  # most tickers of a row span; spans to cut into while they are smaller; most tickers of a column span
FRESH = 64  # frames until the sums of a window are taken anew, so that rounding cannot build up


# ---- per-date correlation graph ----------------------------------------------------------


def sliding_moments(a: tuple, b: tuple, windows: Sequence[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(common dates, correlation) of all rows of ``a`` with all rows of ``b`` in every window.

    ``a`` and ``b``: (values, mask) over the same positions, 0 where absent; windows are rising
    (start, end) positions.  Six sums per pair describe a window; from one window to the next the
    positions that enter are added and those that leave are subtracted.  The arrays are the same
    ones for every window, changed where a pair has a common position that enters or leaves."""
    for n, c, _ in _slid(a, b, windows):
        yield n, c


def _correlation(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    known = (vx > 1e-10 * n * sxx) & (vy > 1e-10 * n * syy) & (n > 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(known, (n * sxy - sx * sy) / np.sqrt(np.where(known, vx * vy, 1.0)), np.nan)
    return np.clip(c, -1.0, 1.0)


def _slid(a: tuple, b: tuple, windows: Sequence[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """As :func:`sliding_moments`, with the places (in the flat arrays) of the pairs that changed
    since the window before; None for all pairs.

    A position reaches only the pairs that both have it, and only their correlations are new."""
    (xa, ma), (xb, mb) = a, b
    width = len(xb)
    sums, n, c, at = None, None, None, (0, 0)
    for k, (start, end) in enumerate(windows):
        moved = [] if start >= at[1] else [(p, 1.0) for p in range(at[1], end)] + [(p, -1.0) for p in range(at[0], start)]
        moved = [(np.flatnonzero(ma[:, p]), np.flatnonzero(mb[:, p]), p, sign) for p, sign in moved]
        # all products anew where that is about as cheap
        many = sum(len(i) * len(j) for i, j, _, _ in moved) * 8 > ma.shape[0] * width * (end - start)
        if k % FRESH == 0 or start >= at[1] or many:
            u, m, v, w = (x[:, start:end] for x in (xa, ma, xb, mb))
            n, sx, sxx = np.split(np.concatenate([m, u, u * u]) @ w.T, 3)
            sy, sxy = np.split(np.concatenate([m, u]) @ v.T, 2)
            sums = [n, sx, sy, sxx, m @ (v * v).T, sxy]
            c, places = _correlation(*sums), None
            sums = [s.reshape(-1) for s in sums]
        else:
            places = []
            for i, j, p, sign in moved:
                u, v = xa[i, p], xb[j, p]
                place = (i[:, None] * width + j).ravel()
                x, y = np.repeat(u, len(j)), np.tile(v, len(i))
                for s, change in zip(sums, (1.0, x, y, x * x, y * y, x * y)):
                    s[place] += sign * change
                places.append(place)
            places = np.concatenate(places) if places else np.zeros(0, int)
            c.reshape(-1)[places] = _correlation(*(s[places] for s in sums))
        yield n, c, places
        at = (start, end)


def temporal_graph(df: DataFrame, frames: DataFrame, lookback: int, k: int, min_periods: int | None = None, value: str = "ret_1d",
                   carried: str = "ret_20d", degree_at: float = 0.35, tile: int = 256, chunk: int = 64) -> DataFrame:
    """The rows of ``df`` on the dates of ``frames`` with columns of that date's correlation graph.

    A date's graph correlates ``value`` of all tickers over the ``lookback`` calendar dates that end
    there; negative and unknown correlations count as none.  ``graph_degree``: partners at or above
    ``degree_at``; ``graph_similarity_mean``: mean correlation of the best ``k`` partners with
    ``carried`` on that date (0 without); ``neighbor_<carried>`` its correlation-weighted mean, and
    ``neighbor_divergence`` that less the ticker's own.

    ``df`` is unique on (ticker, date).  A task group compares a span of tiles with a wide span of
    tiles over a chunk of frames: it slides along the dates of one pair of tiles at a time and keeps
    the best ``k`` of every row and frame, so that a profile goes to ``SPANS`` groups or a few more
    and a row lists its best once for ``WIDE`` tickers, not once a tile."""
    least = max(20, lookback // 2) if min_periods is None else min_periods
    days = stage(df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date"))))
    of = stage(days.join(frames.select("date").distinct(), "date").withColumn("c", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / chunk).cast("int")))
    ends = {r.c: sorted(r.ends) for r in of.groupBy("c").agg(F.collect_list("i").alias("ends")).collect()}  # calendar-sized
    spans = of.groupBy("c").agg(F.greatest(F.min("i") - (lookback - 1), F.lit(1)).alias("lo"), F.max("i").alias("hi"))
    spans = spans.select(F.col("c").cast("string").alias("grp"), F.explode(F.sequence("lo", "hi")).alias("i"))
    seen = df.where(F.col(value).isNotNull()).join(days, "date").select("ticker", "i", F.col(value).cast("double").alias("v"))
    points = seen.join(spans, "i").groupBy("grp", "ticker").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    rows = points.select("grp", "ticker", F.transform("p", lambda x: x["i"]).alias("pos"), F.transform("p", lambda x: x["v"]).alias("val"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts), ignore_index=True)
        stops = ends[int(pdf["grp"].iloc[0])]
        first = max(1, stops[0] - lookback + 1)
        positions = np.arange(first, stops[-1] + 1)
        windows = [(max(1, e - lookback + 1) - first, e - first + 1) for e in stops]

        def dense(part):
            x, m = blocks._dense(part, positions)
            return (x - x.sum(1, keepdims=True) / np.maximum(m.sum(1, keepdims=True), 1.0)) * m, m

        across = pdf[pdf["across"]]
        names = np.sort(across["ticker"].to_numpy())
        own = [(part["ticker"].to_numpy(), dense(part)) for _, part in pdf[~pdf["across"]].groupby("tile")]
        best = [[blocks._Top(len(na), k) for _ in stops] for na, _ in own]
        strong = [np.zeros((len(stops), len(na)), int) for na, _ in own]
        for _, part in across.groupby("tile"):
            nb, b = part["ticker"].to_numpy(), dense(part)
            at = np.searchsorted(names, nb)
            for (na, a), tops, counts in zip(own, best, strong):
                other = na[:, None] != nb[None, :]
                for f, (n, c, changed) in enumerate(_slid(a, b, windows)):
                    with np.errstate(invalid="ignore"):
                        if changed is None:
                            fits = np.where((n >= least) & other & (c > 0), c, np.nan)
                        else:
                            n, c = n.reshape(-1)[changed], c.reshape(-1)[changed]
                            fits.reshape(-1)[changed] = np.where((n >= least) & other.reshape(-1)[changed] & (c > 0), c, np.nan)
                        counts[f] += np.count_nonzero(fits >= degree_at, axis=1)
                    tops[f].add(fits, at)
        for (na, _), tops, counts in zip(own, best, strong):
            yield pd.DataFrame({"i": np.repeat(stops, len(na)), "ticker": np.tile(na, len(stops)), "neighbor": None, "similarity": np.nan, "n": counts.ravel()})
            for end, t in zip(stops, tops):
                yield pd.DataFrame({"i": end, "ticker": na[t.row], "neighbor": names[t.name], "similarity": t.sim, "n": 0})

    tiles = max(1, -(-seen.select("ticker").distinct().count() // tile))
    width, wide = max(1, min(SPAN // tile, -(-tiles // SPANS))), WIDE // tile
    spans = lambda w: F.sequence(F.lit(0), F.lit((tiles - 1) // w))
    rows = rows.withColumn("tile", blocks._tile_of(F.col("ticker"), F.lit(tiles)))
    mine, theirs = (F.floor(F.col("tile") / w).cast("int") for w in (width, wide))
    place = lambda s, t, across: F.struct(s.alias("s"), t.alias("t"), F.lit(across).alias("across"))
    spread = rows.withColumn("_p", F.explode(F.concat(F.transform(spans(wide), lambda t: place(mine, t, False)), F.transform(spans(width), lambda s: place(s, theirs, True)))))
    spread = spread.select("grp", "ticker", "pos", "val", "tile", "_p.*")
    found = stage(spread.groupBy("grp", "s", "t").applyInPandas(work, "i int, ticker string, neighbor string, similarity double, n long"))
    degree = found.where(F.col("neighbor").isNull()).groupBy("i", "ticker").agg(F.sum("n").alias("graph_degree"))
    best = first_rows(found.where(F.col("neighbor").isNotNull()), ["i", "ticker"], [F.desc("similarity"), F.asc("neighbor")], k)
    at = df.join(of.select("date", "i"), "date")
    theirs = at.where(F.col(carried).isNotNull()).select("i", F.col("ticker").alias("neighbor"), F.col(carried).alias("_c"))
    means = best.join(theirs, ["i", "neighbor"]).groupBy("i", "ticker").agg(
        F.avg("similarity").alias("graph_similarity_mean"),
        (F.sum(F.col("similarity") * F.col("_c")) / F.sum("similarity")).alias(f"neighbor_{carried}"))
    out = at.join(degree, ["i", "ticker"], "left").join(means, ["i", "ticker"], "left")
    return out.withColumns({
        "graph_degree": F.coalesce("graph_degree", F.lit(0)),
        "graph_similarity_mean": F.coalesce("graph_similarity_mean", F.lit(0.0)),
        "neighbor_divergence": F.col(f"neighbor_{carried}") - F.col(carried)}).drop("i")


# ---- axes and states ---------------------------------------------------------------------


def robust_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("date",), bound: float = 4.0) -> DataFrame:
    """``z_<c>``: distance from the group's median in robust deviations, cut at ``bound``.

    The deviation is 1.4826 times the median absolute deviation, the sample deviation where that
    vanishes, and nothing (a z of 0) where both do; nulls become 0.  All columns go through the
    exact quantiles together, as (group, column) pairs."""
    by = list(by)
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("e")
    long = stage(df.select(*by, entry).select(*by, "e.*").where(F.col("v").isNotNull()))
    keys = [*by, "metric"]
    mid = stage(quantiles(long, keys, "v", {"median": 0.5}))
    away = stage(long.join(mid, keys).select(*keys, F.abs(F.col("v") - F.col("median")).alias("away")))
    scale = quantiles(away, keys, "away", {"mad": 0.5}).join(long.groupBy(*keys).agg(F.stddev_samp("v").alias("sd")), keys).join(mid, keys)
    robust = 1.4826 * F.col("mad")
    scale = scale.withColumn("scale", F.when(robust >= 1e-9, robust).when(F.col("sd") >= 1e-9, F.col("sd")))
    wide = scale.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("median", "scale")))).alias("_s"))  # one entry per column
    out = df.join(wide, by, "left")
    z = {f"z_{c}": F.coalesce(clip((F.col(c) - F.col("_s")[c]["median"]) / F.col("_s")[c]["scale"], -bound, bound), F.lit(0.0)) for c in cols}
    return out.withColumns(z).drop("_s")


class Axes(NamedTuple):
    """Principal axes (columns), their variances, residuals and the means of the columns."""

    vectors: np.ndarray
    variances: np.ndarray
    residuals: np.ndarray
    means: np.ndarray
    explained: np.ndarray


def principal_axes(df: DataFrame, cols: Sequence[str], dims: int = 3) -> Axes:
    """From the co-moments of ``cols``: one pass of partial aggregates, a small matrix on the driver.

    The largest entry of an axis is positive.  A residual is ``|C v - variance v|``."""
    m = len(cols)
    mean = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([v or 0.0 for v in mean], float)
    x = [F.col(c) - float(mean[i]) for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((m, m))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (row[f"s{i}_{j}"] or 0.0) / max(1, row["n"] - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:dims], vectors[:, ::-1][:, :dims]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])] < 0, -1.0, 1.0)
    residuals = np.sqrt(((cov @ vectors - vectors * values) ** 2).sum(0))
    total = np.trace(cov)
    return Axes(vectors, values, residuals, mean, values / total if total > 0 else np.zeros(len(values)))


LATENT = ("latent_x", "latent_y", "latent_z")


def latent_axes(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, Axes]:
    """Adds ``latent_x``, ``latent_y``, ``latent_z``: per-date robust columns on their principal axes."""
    z = stage(robust_columns(df, cols))
    names = [f"z_{c}" for c in cols]
    axes = principal_axes(z, names)
    dot = lambda k: sum((F.col(n) * float(axes.vectors[i, k]) for i, n in enumerate(names)), F.lit(-float(axes.means @ axes.vectors[:, k])))
    return z.withColumns({n: dot(k) for k, n in enumerate(LATENT)}).drop(*names), axes


def latent_states(df: DataFrame, clusters: int, starts: int = 5, seed: int = 7, cols: Sequence[str] = LATENT) -> tuple[DataFrame, dict[int, float]]:
    """Adds ``state_cluster`` of the best of several K-means starts; (rows, sum of squares per start).

    States are numbered by their centre's first coordinate, so equal clusterings get equal numbers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = stage(df.select(array_to_vector(F.array(*cols)).alias("v")))
    fits = {s: KMeans(k=clusters, seed=seed + s, featuresCol="v", maxIter=50, tol=1e-6).fit(points) for s in range(starts)}
    cost = {s: float(m.summary.trainingCost) for s, m in fits.items()}
    best = fits[min(cost, key=lambda s: (cost[s], s))]
    centres = sorted([float(v) for v in c] for c in best.clusterCenters())
    away = lambda c: sum(((F.col(n) - v) * (F.col(n) - v) for n, v in zip(cols, c)), F.lit(0.0))
    d = F.array(*[away(c) for c in centres])
    return df.withColumn("_d", d).withColumns({
        "state_cluster": F.array_position("_d", F.array_min("_d")).cast("int") - 1, "state_distance2": F.array_min("_d")}).drop("_d"), cost

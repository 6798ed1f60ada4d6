"""Tiles of points in Euclidean space, and the pairs of tiles that can hold an answer.

A few pivots are chosen far apart.  A point belongs to the cell of its nearest pivot, and a cell is
cut into rings of equal numbers by that distance; crowded rings (equal points) are split by a hash,
so a tile is bounded whatever the data.  Every tile keeps the smallest and largest distance of its
points to every pivot.  By the triangle inequality a point at distance ``d_j`` of pivot ``j`` is at
least ``max(low_j - d_j, d_j - high_j)`` away from everything in a tile: pairs of tiles beyond the
reach of a question are never formed, and what is left is compared exactly.  The pivots come from
a bounded sample; a poor choice costs pairs, never answers.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS, SAMPLE, RINGS = 24, 2048, 64
MOST_TILES = 16_384  # their summaries go to all tasks; more points make larger tiles
SLACK = 1e-6  # rounding of distances between unit vectors


class Ranges(NamedTuple):
    """Of every tile the range of the distances to every pivot, and the size."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray


class Tiles(NamedTuple):
    """(key, x, d, tile) of every point, d its distances to the pivots, and the ranges of the tiles."""

    rows: DataFrame
    ranges: Ranges


def pivots_of(points: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Points of a sample (the ``sample`` smallest hashes), each farthest from those before it."""
    some = points.select("key", "x").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    if not some:
        return np.zeros((0, 0))
    x = np.stack([np.asarray(r.x, float) for r in some])
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


def _distances(x: pd.Series, pivots: np.ndarray) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in x])
    return np.stack([np.sqrt(((m - p) ** 2).sum(1)) for p in pivots], axis=1)


def tiles_of(points: DataFrame, pivots: np.ndarray, tile: int) -> Tiles:
    """Tiles of about ``tile`` points from (key, x)."""
    none = Ranges(np.zeros((0, len(pivots))), np.zeros((0, len(pivots))), np.zeros(0, int))
    if not len(pivots):
        rows = points.select("key", "x", F.lit(None).cast("array<double>").alias("d"), F.lit(0).alias("tile"))
        return Tiles(rows, none)

    def measure(parts):
        for pdf in parts:
            if len(pdf):
                d = _distances(pdf["x"], pivots)
                yield pdf.assign(d=list(d), cell=d.argmin(1).astype("int32"), r=d.min(1))

    seen = stage(points.select("key", "x").mapInPandas(measure, "key string, x array<double>, d array<double>, cell int, r double"))
    cells = seen.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", [k / RINGS for k in range(1, RINGS)]).alias("cuts")).collect()
    if not cells:
        return Tiles(seen.select("key", "x", "d", F.lit(0).alias("tile")), none)
    tile = max(tile, -(-sum(c.n for c in cells) // MOST_TILES))
    cuts = {}
    for c in cells:
        rings = min(RINGS, -(-c.n // tile))
        cuts[c.cell] = np.unique([c.cuts[k * RINGS // rings - 1] for k in range(1, rings)])

    def ring(parts):
        for pdf in parts:
            at = np.zeros(len(pdf), "int32")
            for c, edges in cuts.items():
                mine = (pdf["cell"] == c).to_numpy()
                at[mine] = c * RINGS + np.searchsorted(edges, pdf["r"].to_numpy()[mine], side="left")
            yield pdf.assign(ring=at)[["key", "x", "d", "ring"]]

    dealt = seen.mapInPandas(ring, "key string, x array<double>, d array<double>, ring int")
    counts = {r.ring: -(-r["count"] // tile) for r in dealt.groupBy("ring").count().collect()}
    first = dict(zip(sorted(counts), np.cumsum([0, *(counts[r] for r in sorted(counts))]).tolist()))
    offset = F.create_map(*[F.lit(v) for r, o in first.items() for v in (r, o)])
    parts = F.create_map(*[F.lit(v) for r, n in counts.items() for v in (r, n)])
    rows = stage(dealt.select("key", "x", "d", (offset[F.col("ring")] + F.pmod(F.xxhash64("key"), parts[F.col("ring")])).cast("int").alias("tile")))
    ranges = [f(F.get("d", F.lit(j))).alias(f"{n}{j}") for j in range(len(pivots)) for n, f in (("a", F.min), ("b", F.max))]
    found = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *ranges)
    found = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns)
    total = sum(counts.values())
    low, high, size = np.full((total, len(pivots)), np.inf), np.full((total, len(pivots)), -np.inf), np.zeros(total, int)
    at = found["tile"].to_numpy()
    low[at], high[at] = found[[f"a{j}" for j in range(len(pivots))]].to_numpy(), found[[f"b{j}" for j in range(len(pivots))]].to_numpy()
    size[at] = found["n"].to_numpy()
    return Tiles(rows, Ranges(low, high, size))


def least_distance(low: np.ndarray, high: np.ndarray, tiles: Ranges) -> np.ndarray:
    """Lower bounds of the distances between boxes (of one point each, or of tiles) and tiles."""
    out = np.zeros((len(low), len(tiles.low)))
    for j in range(low.shape[1]):
        np.maximum(out, tiles.low[:, j] - high[:, j, None], out=out)
        np.maximum(out, low[:, j, None] - tiles.high[:, j], out=out)
    return np.where(tiles.size > 0, out, np.inf)


def pairs_within(tiles: Tiles, radius: float) -> DataFrame:
    """(lo, hi): the pairs of tiles, lo <= hi, between which points may be within ``radius``."""
    spark, tiles = tiles.rows.sparkSession, tiles.ranges
    ids = np.flatnonzero(tiles.size > 0)

    def run(parts):
        for pdf in parts:
            pdf = pdf[np.isin(pdf["id"], ids)]
            for at in range(0, len(pdf), 64):
                own = pdf["id"].to_numpy()[at : at + 64]
                i, t = np.nonzero(least_distance(tiles.low[own], tiles.high[own], tiles) <= radius + SLACK)
                keep = own[i] <= t
                yield pd.DataFrame({"lo": own[i][keep].astype("int32"), "hi": t[keep].astype("int32")})

    return spark.range(len(tiles.size)).mapInPandas(run, "lo int, hi int")


def homes(points: Ranges, refs: Ranges, k: int) -> np.ndarray:
    """For every tile of points the tile of at least ``k`` references whose middle is nearest."""
    out = np.zeros(len(points.low), int)
    enough = np.flatnonzero(refs.size >= min(k, refs.size.max(initial=0)))
    middle = (refs.low[enough] + refs.high[enough]) / 2
    for s in np.flatnonzero(points.size > 0):
        own = (points.low[s] + points.high[s]) / 2
        out[s] = enough[np.abs(middle - own).max(1).argmin()]
    return out


def pairs_near(refs: Tiles, reach: DataFrame) -> DataFrame:
    """(pt, rt): the pairs of tiles in which a point may have a reference within its own reach.

    ``reach``: (key, tile, d, reach) of every point."""
    ranges = refs.ranges

    def run(parts):
        for pdf in parts:
            found = []
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                d = np.stack([np.asarray(v, float) for v in some["d"]])
                i, t = np.nonzero(least_distance(d, d, ranges) <= some["reach"].to_numpy()[:, None] + SLACK)
                found.append(np.unique(np.stack([some["tile"].to_numpy()[i], t], axis=1), axis=0))
            if found:
                both = np.unique(np.concatenate(found), axis=0)
                yield pd.DataFrame({"pt": both[:, 0].astype("int32"), "rt": both[:, 1].astype("int32")})

    return reach.select("tile", "d", "reach").mapInPandas(run, "pt int, rt int").distinct()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, from differences (no cancellation), in chunks of bounded size."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = ((a[at : at + step, None, :] - b[None, :, :]) ** 2).sum(2)
    return out


def reach_of(points: Tiles, refs: Tiles, k: int, skip_self: bool) -> DataFrame:
    """(key, tile, d, reach): distance of the k-th reference in the home tile; no answer is farther."""
    home = homes(points.ranges, refs.ranges, k + skip_self)
    of = points.rows.sparkSession.createDataFrame([(int(s), int(home[s])) for s in np.flatnonzero(points.ranges.size > 0)], "tile int, home int")
    p = points.rows.join(of, "tile").select("home", "tile", "key", "x", "d", F.lit(0).alias("side"))
    # references go to every tile of points that calls theirs home
    r = refs.rows.withColumnRenamed("tile", "home").join(of, "home").select("home", "tile", "key", "x", F.lit(None).cast("array<double>").alias("d"), F.lit(1).alias("side"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        reach = np.full(len(a), np.inf)
        if len(a) and len(b):
            d2 = squared(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()))
            if skip_self:
                d2[a["key"].to_numpy()[:, None] == b["key"].to_numpy()[None, :]] = np.inf
            if d2.shape[1] >= k:
                reach = np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1])
        return pd.DataFrame({"key": a["key"].to_numpy(), "tile": a["tile"].to_numpy().astype("int32"), "d": a["d"].to_list(), "reach": reach})

    return p.unionByName(r).groupBy("home", "tile").applyInPandas(work, "key string, tile int, d array<double>, reach double")

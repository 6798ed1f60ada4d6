"""Isotonic regression from mergeable pools.

Pool-adjacent-violators runs on range partitions first; a partition's solution is a list of pools
of rising mean.  A pool is final when nothing to its left has a higher mean and nothing to its
right a lower one: it can merge with neither side, and it cuts the line there.  What lies between
two cuts is a run of its own; in every round the parts of a run are merged in pairs, so the number
of rounds is logarithmic in the partitions, and a task holds the open pools of two parts.  The
driver sees the first and last mean of every part."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ranking import order_bucket
from tessella.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 100_000  # distinct values of one part
_POOL = "block int, lo double, hi double, s double, w double"


def pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pools of rows (lo, hi, s, w) in order of ``lo``: neighbours merge while the mean falls."""
    lo, hi, s, w = [], [], [], []
    for row in zip(pdf["lo"], pdf["hi"], pdf["s"], pdf["w"]):
        for held, v in zip((lo, hi, s, w), row):
            held.append(v)
        while len(s) > 1 and s[-2] * w[-1] >= s[-1] * w[-2]:
            hi[-2], s[-2], w[-2] = hi[-1], s[-2] + s[-1], w[-2] + w[-1]
            for held in (lo, hi, s, w):
                held.pop()
    return pd.DataFrame({"lo": lo, "hi": hi, "s": s, "w": w})


def isotonic_pools(df: DataFrame, x: str, y: str, rows: int = ROWS) -> DataFrame:
    """(lo, hi, value, w): the pools of the rising least-squares fit of ``y`` on ``x``.

    Equal ``x`` are one value with their mean; nulls take no part."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = known.groupBy(F.col(x).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    d = stage(d.select("lo", F.col("lo").alias("hi"), "s", "w"))
    spark = d.sparkSession
    parts = max(1, -(-d.count() // rows))
    ordered = d.repartitionByRange(parts, "lo").sortWithinPartitions("lo").withColumn("block", F.spark_partition_id())

    def first(batches):
        held, block = None, 0
        for pdf in batches:
            if len(pdf):
                block = int(pdf["block"].iloc[0])
                held = pool(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
        if held is not None:
            yield held.assign(block=block)[["block", "lo", "hi", "s", "w"]]

    left_over = stage(ordered.select("block", "lo", "hi", "s", "w").mapInPandas(first, _POOL))
    mean = F.col("s") / F.col("w")
    done = left_over.where("false").drop("block")
    while True:
        edges = left_over.groupBy("block").agg(F.min(mean).alias("a"), F.max(mean).alias("b")).orderBy("block").collect()
        if not edges:
            break
        a, b = np.array([e.a for e in edges]), np.array([e.b for e in edges])
        before = np.r_[-np.inf, np.maximum.accumulate(b)[:-1]]  # highest mean to the left
        after = np.r_[np.minimum.accumulate(a[::-1])[::-1][1:], np.inf]  # lowest mean to the right
        sides, run = [], 0  # (block, side, run) of every part, in order
        for e, m, n in zip(edges, before, after):
            sides.append((e.block, 0, run))
            if m <= n:
                run += 1
                sides.append((e.block, 1, run))
        place, size, target = {}, {}, []
        for block, side, r in sides:
            k = place[r] = place.get(r, -1) + 1
            size[r] = k + 1
            target.append((r, k // 2))
        number = {t: i for i, t in enumerate(dict.fromkeys(target))}
        rule = [(block, side, number[t], size[t[0]] <= 2) for (block, side, _), t in zip(sides, target)]
        cuts = spark.createDataFrame([(e.block, float(m), float(n)) for e, m, n in zip(edges, before, after)], "block int, before double, after double")
        at = left_over.join(cuts, "block")
        closed = F.col("before") <= F.col("after")
        side = F.when(~closed | (mean < F.col("before")), 0).when(mean > F.col("after"), 1)
        at = stage(at.withColumn("side", side).drop("before", "after"))
        done = done.unionByName(at.where(F.col("side").isNull()).select("lo", "hi", "s", "w"))
        goes = spark.createDataFrame(rule, "block int, side int, to int, last boolean")
        moved = at.join(goes, ["block", "side"]).select(F.col("to").alias("block"), "last", "lo", "hi", "s", "w")

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pool(pdf.sort_values("lo"))
            return out.assign(block=pdf["block"].iloc[0], last=pdf["last"].iloc[0])[["block", "last", "lo", "hi", "s", "w"]]

        merged = stage(moved.groupBy("block").applyInPandas(merge, "block int, last boolean, lo double, hi double, s double, w double"))
        done = done.unionByName(merged.where("last").select("lo", "hi", "s", "w"))
        left_over = merged.where("NOT last").drop("last")
    return stage(done.select("lo", "hi", mean.alias("value"), "w"))


def interpolate(df: DataFrame, pools: DataFrame, x: str, out: str) -> DataFrame:
    """``out``: the value of the pool of ``x``, between two pools on the line from one to the other,
    beyond the ends the nearest; null for null ``x`` and without pools.

    The last edge at or before a value and the first at or after it are carried inside buckets of
    neighbouring values; what a bucket lacks comes from the edges of the buckets around it."""
    edges = pools.select(F.explode(F.array("lo", "hi")).alias("v"), "value").distinct()
    asked = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v")).distinct()
    both = asked.withColumn("edge", F.lit(None).cast("struct<v:double,value:double>")).unionByName(edges.select("v", F.struct("v", "value").alias("edge")))
    both = stage(both.groupBy("v").agg(F.max("edge").alias("edge")).withColumn("part", order_bucket("v")))
    ends = both.where(F.col("edge").isNotNull()).groupBy("part").agg(F.min("edge").alias("a"), F.max("edge").alias("b"))
    # one row per bucket of numbers, whatever the data
    parts = both.select("part").distinct().join(ends, "part", "left")
    # frames that grow from the start only: one that ends at the last row is summed up anew for every row
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.max("b").over(before(Window.orderBy("part"))).alias("_before"), F.min("a").over(before(Window.orderBy(F.desc("part")))).alias("_after"))
    up_to = lambda *order: Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_a": F.max("edge").over(up_to("v")), "_b": F.min("edge").over(up_to(F.desc("v")))})
    found = found.join(parts, "part")
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_after")
    line = a["value"] + (b["value"] - a["value"]) * F.try_divide(F.col("v") - a["v"], b["v"] - a["v"])
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (a["v"] == b["v"]), a["value"]).otherwise(line)
    got = found.select(F.col("v").alias("_v"), value.alias(out))
    return df.join(got, F.col(x).cast("double") == F.col("_v"), "left").drop("_v")

"""Block means and bootstrap intervals.

Blocks are weeks or runs of dates, so a block table is calendar-sized; replicates are
generated as rows and averaged by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import flag
from tessella.functions.scalars import draw_number, week_start


def weekly_blocks(df: DataFrame, by: Sequence[str], metric: str, extra: Sequence[str] = ()) -> DataFrame:
    """Date means, then week means: one value per (by, extra, week)."""
    daily = df.where(F.col(metric).isNotNull()).groupBy(*by, *extra, "date").agg(F.avg(metric).alias("_v"))
    return daily.groupBy(*by, *extra, week_start("date").alias("week")).agg(F.avg("_v").alias("value"))


def block_summary(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    return blocks.groupBy(*by).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("blocks"))


def bootstrap_ci(blocks: DataFrame, by: Sequence[str], order: Sequence[str], samples: int, seed: int, weight: str | None = None) -> DataFrame:
    """Percentile interval of the mean over resampled blocks, with the exact mean.

    Draw ``d`` of replicate ``b`` picks block ``hash(seed, b, d) mod n``.  With ``weight`` a block
    counts with its number of rows (weeks concatenated instead of averaged)."""
    by = list(by)
    g = Window.partitionBy(*by)
    b = blocks.withColumns({"_k": F.row_number().over(g.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(g)})
    b = b.select(*by, "_k", "_n", "value", (F.col(weight) if weight else F.lit(1)).alias("_w"))
    sizes = b.select(*by, "_n").distinct()
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    draws = draws.withColumn("_k", draw_number(seed, *by, "_b", "_d") % F.col("_n")).drop("_n")
    means = draws.join(b.drop("_n"), [*by, "_k"]).groupBy(*by, "_b").agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("_m"))
    # ``samples`` means per group: a fixed number
    ci = means.groupBy(*by).agg(F.percentile("_m", 0.025).alias("ci_2_5"), F.percentile("_m", 0.975).alias("ci_97_5"), F.avg(flag(F.col("_m") > 0)).alias("positive_probability"))
    mean = b.groupBy(*by).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("mean"), F.count(F.lit(1)).alias("blocks"))
    return mean.join(ci, by)


def block_bootstrap(values: DataFrame, by: Sequence[str], order: Sequence[str], metric: str, block: int, samples: int, seed: int) -> DataFrame:
    """Bootstrap over contiguous runs of ``block`` dates, concatenated and cut to the original length."""
    by = list(by)
    g = Window.partitionBy(*by)
    v = values.where(F.col(metric).isNotNull()).withColumns({"_i": F.row_number().over(g.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(g)})
    v = v.withColumn("_k", F.floor(F.col("_i") / block))
    blocks = v.groupBy(*by, "_k", "_n").agg(F.array_sort(F.collect_list(F.struct("_i", F.col(metric).alias("x")))).alias("_v"))  # ``block`` values each
    blocks = blocks.withColumn("_c", F.count(F.lit(1)).over(g))
    sizes = blocks.select(*by, "_c", "_n").distinct()
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))))
    draws = draws.withColumn("_k", draw_number(seed, *by, "_b", "_d") % F.col("_c"))
    d = draws.select(*by, "_b", "_d", "_k", "_n").join(blocks.select(*by, "_k", "_v"), [*by, "_k"])
    before = Window.partitionBy(*by, "_b").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_room", F.col("_n") - F.coalesce(F.sum(F.size("_v")).over(before), F.lit(0)))
    d = d.where(F.col("_room") > 0).withColumn("_v", F.slice("_v", F.lit(1), F.least(F.col("_room"), F.size("_v")).cast("int")))
    total = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x["x"])
    m = d.groupBy(*by, "_b").agg((F.sum(total) / F.sum(F.size("_v"))).alias("_m"))
    ci = m.groupBy(*by).agg(F.percentile("_m", 0.025).alias("ci_2_5"), F.percentile("_m", 0.975).alias("ci_97_5"))
    return v.groupBy(*by).agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n")).join(ci, by)


def paired_deltas(df: DataFrame, side: str, a: str, b: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per key, metric of ``a`` minus metric of ``b`` where both exist."""
    pick = lambda v, m: F.avg(F.when(F.col(side) == v, F.col(m)))
    w = df.where(F.col(side).isin(a, b)).groupBy(*keys).agg(*[(pick(a, m) - pick(b, m)).alias(f"{m}_delta") for m in metrics])
    return w

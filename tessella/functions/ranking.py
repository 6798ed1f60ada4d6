"""Exact ranks, running sums and quantiles that survive hot groups.

A plain ``rank() OVER (PARTITION BY g ORDER BY x)`` sends a whole group through one
task.  Here equal values are first collapsed by a partial aggregate, so a value shared by
a third of all rows becomes one row.  The distinct values of a group are then cut by a
fixed order-preserving bucket, running sums are taken inside (group, bucket), and bucket
totals are added as offsets.  Buckets only spread the work; results are exact.

The stats pass reads the input a second time: give these functions a table or a staged
frame (:func:`tessella.session.stage`), not a long chain of transformations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 1024  # buckets per doubling of the absolute value


def order_bucket(value: str | Column) -> Column:
    """Non-decreasing integer code of a number: ``_STEPS`` equal parts per power of two."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(v)
    e = F.floor(F.log2(size))
    code = ((e + 1100) * _STEPS + F.floor(size / F.pow(F.lit(2.0), e) * _STEPS)).cast("int")
    return F.when(v > 0, code).when(v < 0, -code).otherwise(0)


def running_below(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """For rows unique on (by, order): ``<s>_below`` = sum over smaller ``order`` values of
    the group, ``<s>_total`` = sum over the group."""
    by = list(by)
    if not by:  # one group: give it a constant key
        keyed = df.withColumn("_all", F.lit(1))
        return running_below(keyed, ["_all"], order, sums).drop("_all")
    parts = df.withColumn("_part", order_bucket(order))
    w_group = Window.partitionBy(*by)
    w_part = w_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    offsets = totals.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_{s}").over(w_part), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}").over(w_group).alias(f"{s}_total") for s in sums],
    )
    w_in = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select("*", *[F.coalesce(F.sum(s).over(w_in), F.lit(0)).alias(f"_{s}_in") for s in sums])
    return inner.join(offsets, [*by, "_part"]).select(
        *df.columns,
        *[(F.col(f"_{s}_in") + F.col(f"_{s}_off")).alias(f"{s}_below") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values of each group with their number ``n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def rank_stats(df: DataFrame, by: Sequence[str], value: str, prefix: str = "r") -> DataFrame:
    """(by, value) with the rows below, the ties and the group's non-null rows."""
    return running_below(value_counts(df, by, value), by, value, ["n"]).select(
        *by, value,
        F.col("n_below").alias(f"{prefix}_below"),
        F.col("n").alias(f"{prefix}_ties"),
        F.col("n_total").alias(f"{prefix}_total"),
    )


def average_rank(prefix: str = "r") -> Column:
    """1-based average rank from the columns of :func:`rank_stats`."""
    return F.col(f"{prefix}_below") + (F.col(f"{prefix}_ties") + 1) / 2


def pct_rank(df: DataFrame, by: Sequence[str], value: str, out: str, ascending: bool = True, fill: float | None = None) -> DataFrame:
    """Average-tie percentile rank in (0, 1]; nulls stay null or take ``fill``."""
    by = list(by)
    up = average_rank()
    rank = up if ascending else F.col("r_total") + 1 - up
    stats = rank_stats(df, by, value).select(*by, value, (rank / F.col("r_total")).alias(out))
    ranked = df.join(stats, [*by, value], "left").select(*df.columns, out)
    return ranked if fill is None else ranked.withColumn(out, F.coalesce(out, F.lit(fill)))


def long_ranks(df: DataFrame, key: Sequence[str], by: Sequence[str], values: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """(key, metric, pct, have) of every non-null value: narrow rows, one ranking for all metrics.

    ``have`` is the number of non-null values of the metric in its group."""
    cols = [*key, *[b for b in by if b not in key]]
    metric = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]))
    long = df.select(*cols, metric.alias("_x")).select(*cols, "_x.metric", "_x.v").where(F.col("v").isNotNull())
    up = average_rank()
    rank = F.when(F.col("metric").isin(*descending), F.col("r_total") + 1 - up).otherwise(up) if descending else up
    stats = rank_stats(long, [*by, "metric"], "v").select(*by, "metric", "v", (rank / F.col("r_total")).alias("pct"), F.col("r_total").alias("have"))
    return long.join(stats, [*by, "metric", "v"]).select(*cols, "metric", "pct", "have")


def pct_ranks(df: DataFrame, key: Sequence[str], by: Sequence[str], outs: Mapping[str, str],
              descending: Sequence[str] = (), fill: float | None = None) -> DataFrame:
    """Average-tie percentile ranks of several columns at once; ``key`` identifies a row."""
    ranks = long_ranks(df, key, by, list(outs), descending)
    cols = [*key, *[b for b in by if b not in key]]
    wide = ranks.groupBy(*cols).agg(*[F.max(F.when(F.col("metric") == v, F.col("pct"))).alias(name) for v, name in outs.items()])
    out = df.join(wide, cols, "left")
    return out if fill is None else out.fillna(fill, list(outs.values()))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``probs``."""
    by = list(by)
    cum = running_below(value_counts(df, by, value), by, value, ["n"])
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n_total").cast("double") - 1) * p
        aggs.append(F.max(F.when(F.col("n_below") <= F.floor(pos), F.col(value))).alias(f"_{name}_lo"))
        aggs.append(F.max(F.when(F.col("n_below") <= F.ceil(pos), F.col(value))).alias(f"_{name}_hi"))
    agged = cum.groupBy(*by).agg(*aggs, F.max("n_total").alias("_n"))
    cols = []
    for name, p in probs.items():
        pos = (F.col("_n").cast("double") - 1) * p
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return agged.select(*by, *cols)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Top ``k`` rows per group.  Catalyst limits each group before the shuffle, so a
    hot group sends at most ``k`` rows per map task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)

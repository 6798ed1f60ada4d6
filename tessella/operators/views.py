"""Read views for dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import flag
from tessella.functions.ranking import first_rows, quantiles


def latest_snapshot(df: DataFrame, day: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of the newest snapshot date."""
    return df.where(F.col(day) == df.select(F.max(day)).scalar()).orderBy(*order).limit(n)


def trail(df: DataFrame, day: str, n: int) -> DataFrame:
    """All rows of the last ``n`` snapshot dates."""
    floor = df.select(day).distinct().orderBy(F.desc(day)).limit(n).select(F.min(day)).scalar()
    return df.where(F.col(day) >= floor)


def recent_prices(prices: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows of every ticker."""
    return first_rows(prices, ["ticker"], [F.desc("date")], n, "_k").drop("_k")


def ticker_detail(df: DataFrame, ticker: str) -> DataFrame:
    """One ticker's rows in date order; the filter reaches the scan."""
    return df.where(F.col("ticker") == ticker.strip().upper()).orderBy("date")


def status_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def paper_performance(outcomes: DataFrame) -> DataFrame:
    """Results at the declared horizon per action."""
    by = ["decision_horizon_days", "action"]
    o = outcomes.where((F.col("decision_horizon_days") == F.col("evaluation_horizon_days")) & F.col("return_pct").isNotNull())
    s = o.groupBy(*by).agg(F.countDistinct("decision_id").alias("decisions"), F.count("outcome_id").alias("outcome_events"),
                           F.avg("return_pct").alias("average_return"), F.avg(flag(F.col("return_pct") > 0)).alias("win_rate"))
    return s.join(quantiles(o, by, "return_pct", {"median_return": 0.5}), by)

"""Forward targets and the point-in-time panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import finite, history, ratio
from tessella.operators import cross_section as xs
from tessella.operators.features import CLOSE, residual_features
from tessella.session import stage

FEATURES = ("ret_1d", "ret_5d", "ret_20d", "ret_60d", "vol_20d", "drawdown_60d", "dollar_vol_20d_log")


def forward_target(df: DataFrame, h: int = 5, label: str | None = None) -> DataFrame:
    """The ``h``-th later row of the ticker: its date, close and return; optional 0/1 label."""
    w = history()
    df = df.withColumns({"evaluation_date": F.lead("date", h).over(w), "future_close": F.lead(CLOSE, h).over(w)})
    df = df.withColumn("future_return", ratio("future_close", CLOSE) - 1)
    return df if label is None else df.withColumn(label, (F.col("future_return") > 0).cast("int"))


def scrub(df: DataFrame, cols, required: bool = True) -> DataFrame:
    """Turn NaN and infinities into null, then drop rows missing any of ``cols``."""
    df = df.withColumns({c: finite(c) for c in cols})
    return df.dropna(subset=list(cols)) if required else df


def seal(df: DataFrame, holdout_start) -> DataFrame:
    """Keep rows whose decision and evaluation dates both lie before the holdout."""
    h = F.lit(holdout_start).cast("date")
    return df.where((F.col("date") < h) & (F.col("evaluation_date") < h))


def seal_violations(df: DataFrame, holdout_start) -> DataFrame:
    h = F.lit(holdout_start).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("date") >= h).alias("decision_violations"),
        F.count_if(F.col("evaluation_date") >= h).alias("evaluation_violations"),
    )


def last_n_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct dates (the first kept date is a scalar subquery)."""
    floor = df.select("date").distinct().orderBy(F.desc("date")).limit(n).select(F.min("date")).scalar()
    return df.where(F.col("date") >= floor)


def residual_panel(prices: DataFrame, sectors: DataFrame | None, holdout_start, h: int = 5, history_dates: int = 1260,
                   top_k: int = 1000, min_sector: int = 2, keep: Sequence[str] | None = None) -> DataFrame:
    """Prices to a labelled panel: features, forward target, sealed holdout, liquidity
    selection, point-in-time sector and leave-one-out residual targets.

    ``keep`` names the columns of the sealed panel that the result carries besides key, sector and
    targets (all by default)."""
    from tessella.operators.joins import interval_lookup

    df = forward_target(residual_features(prices), h)
    df = seal(scrub(df, [*FEATURES, "future_return"]), holdout_start)
    if keep is not None:
        df = df.select(*dict.fromkeys(["ticker", "date", *keep, "dollar_vol_20d_log", "future_return"]))
    if sectors is None:
        df = df.withColumn("sector", F.lit(None).cast("string"))
    else:
        df = interval_lookup(df, sectors, "sector")
    # ranks are taken inside a date, so the look-back may be cut after them: one table of features
    df = stage(xs.top_liquidity(df, top_k))
    return xs.residual_targets(last_n_dates(df, history_dates), min_sector)


def calendar(df: DataFrame) -> DataFrame:
    """Distinct trading dates with a 0-based index; bounded by the calendar, not by rows."""
    d = df.select("date").distinct()
    return d.withColumn("date_idx", F.row_number().over(Window.orderBy("date")) - 1)

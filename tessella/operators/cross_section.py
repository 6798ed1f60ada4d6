"""Operators across the entities of one date.

Means, sums and counts come from a partial aggregate joined back on the date, so a
crowded date is combined on the map side; ranks and medians use the split ranking of
:mod:`tessella.functions.ranking`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import clip, flag, ratio
from tessella.session import stage
from tessella.functions.ranking import first_rows, pct_rank, pct_ranks, quantiles


def loo_mean(df: DataFrame, keys: Sequence[str], value: str, mean: str, members: str) -> DataFrame:
    """Mean of ``value`` over the other rows of the group and the group's count."""
    stats = df.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias(members))
    out = df.join(stats, list(keys), "left").withColumn(members, F.coalesce(members, F.lit(0)))
    loo = F.when(F.col(members) > 1, (F.col("_s") - F.col(value)) / (F.col(members) - 1))
    return out.withColumn(mean, loo).drop("_s")


def xs_rank(df: DataFrame, value: str, out: str, fill: float | None = None, by: Sequence[str] = ("date",)) -> DataFrame:
    """Average-tie percentile rank within each date."""
    return pct_rank(df, by, value, out, fill=fill)


def top_liquidity(df: DataFrame, k: int, value: str = "dollar_vol_20d_log", out: str = "liquidity_rank", digits: int = 9) -> DataFrame:
    """The ``k`` most liquid entities per date, ties to ``digits`` by ticker."""
    return first_rows(df, ["date"], [F.round(value, digits).desc_nulls_last(), F.col("ticker")], k, out)


def residual_targets(df: DataFrame, min_sector: int = 2, ret: str = "future_return") -> DataFrame:
    """Market and sector leave-one-out residuals, the primary choice, its rank and flags.

    ``df`` is read three times: a table or a staged frame."""
    # market sums are the sum of the sector sums: one pass feeds both benchmarks; staged, so that
    # the joins know how small they are and rows stay where they are
    by_sector = stage(df.groupBy("date", "sector").agg(F.sum(ret).alias("_ss"), F.count(ret).alias("sector_members")))
    by_date = by_sector.groupBy("date").agg(F.sum("_ss").alias("_ms"), F.sum("sector_members").alias("market_members"))
    has = F.col("sector").isNotNull()
    loo = lambda total, n: F.when(F.col(n) > 1, (F.col(total) - F.col(ret)) / (F.col(n) - 1))
    df = df.join(by_date, "date").join(by_sector.where(has), ["date", "sector"], "left")
    df = df.withColumns({"market_return_loo": loo("_ms", "market_members"), "sector_return_loo": loo("_ss", "sector_members")})
    df = df.drop("_ss", "_ms").withColumns({
        "market_residual_return": F.col(ret) - F.col("market_return_loo"),
        "sector_members": F.when(has, F.col("sector_members")).otherwise(0),
        "sector_return_loo": F.when(has, F.col("sector_return_loo")),
    })
    use_sector = has & (F.col("sector_members") >= min_sector) & F.col("sector_return_loo").isNotNull()
    df = df.withColumn("sector_residual_return", F.col(ret) - F.col("sector_return_loo")).withColumns({
        "primary_benchmark": F.when(use_sector, "sector_leave_one_out").otherwise("market_leave_one_out"),
        "primary_residual_return": F.when(use_sector, F.col("sector_residual_return")).otherwise(F.col("market_residual_return")),
    })
    # nine digits, so that equal residuals tie whatever the order of the sums behind them
    df = df.withColumn("_nine", F.round("primary_residual_return", 9))
    df = xs_rank(df, "_nine", "primary_residual_rank_pct")
    return df.drop("_nine").withColumns({
        "primary_residual_positive": flag(F.round("primary_residual_return", 9) > 0),
        "primary_residual_top_decile": flag(F.col("primary_residual_rank_pct") >= 0.9),
    })


# Stock types in rule order with their codes.
STOCK_TYPES = {"Core": 0, "High volatility": 1, "Liquid leader": 2, "Trend leader": 3, "Recent laggard": 4}


def type_features(df: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Rank-based features, the stock type by ordered rules, and variant-family facts."""
    df = pct_ranks(df, ["date", "ticker"], ["date"], {
        "dollar_vol_20d": "liquidity_rank_pct", "vol_60d": "volatility_rank_pct",
        "trend_slope_60d": "trend_rank_pct", "ret_60d": "return_rank_pct"}, fill=0.5)
    c = F.col
    kind = (
        F.when(c("volatility_rank_pct") >= 0.75, "High volatility")
        .when((c("liquidity_rank_pct") >= 0.75) & (c("trend_rank_pct") >= 0.60), "Liquid leader")
        .when(c("trend_rank_pct") >= 0.75, "Trend leader")
        .when(c("return_rank_pct") <= 0.25, "Recent laggard")
        .otherwise("Core")
    )
    code = F.create_map(*[F.lit(x) for kv in STOCK_TYPES.items() for x in kv])
    df = df.withColumns({
        "log_dollar_vol_20d": F.log1p(clip("dollar_vol_20d", 0.0)),
        "volatility_ratio_20_60": ratio("vol_20d", F.abs("vol_60d") + 1e-9),
        "return_trend_alignment": c("ret_20d") * F.signum(F.coalesce("trend_slope_60d", F.lit(0.0))),
        "stock_type": kind,
    }).withColumn("stock_type_code", code[c("stock_type")])
    if families is None:
        return df.withColumns({"variant_family_size": F.lit(1), "variant_is_chosen": F.lit(1)})
    df = df.join(families.select("ticker", "variant_family_size", "variant_is_chosen"), "ticker", "left")
    return df.fillna(1, ["variant_family_size", "variant_is_chosen"])


def market_context(df: DataFrame) -> DataFrame:
    """One row per date: median return, median volatility, breadth and dispersion."""
    basic = df.groupBy("date").agg(
        F.avg(flag(F.col("ret_20d") > 0)).alias("breadth_ret20_positive"),
        F.stddev_samp("ret_20d").alias("market_ret20_dispersion"),
        F.count(F.lit(1)).alias("members"),
    )
    r = quantiles(df, ["date"], "ret_20d", {"market_ret20_median": 0.5})
    v = quantiles(df, ["date"], "vol_60d", {"market_vol60_median": 0.5})
    return basic.join(r, "date", "left").join(v, "date", "left")


def regimes(context: DataFrame, train_end, high: float = 0.60, low: float = 0.40, q: float = 0.75) -> DataFrame:
    """Regime of each later date, with the volatility cutoff taken from dates up to ``train_end``.

    ``context`` has one row per date, so the cutoff is a quantile over the calendar."""
    cutoff = context.where(F.col("date") <= train_end).select(F.percentile("market_vol60_median", q)).scalar()
    b = F.col("breadth_ret20_positive")
    label = (
        F.when(F.col("market_vol60_median") > cutoff, "stress")
        .when(b >= high, "trend_up")
        .when(b <= low, "trend_down")
        .otherwise("rotation_quiet")
    )
    return context.where(F.col("date") > train_end).withColumn("regime", label)


def regime_summary(daily: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Daily results split by market direction and by the median market volatility.

    ``daily`` has one row per strategy and date, so the median runs over the calendar."""
    cut = daily.select(F.percentile("market_volatility", 0.5)).scalar()
    label = lambda kind, name: F.struct(F.lit(kind).alias("regime_type"), name.alias("regime"))
    both = F.array(
        label("return", F.when(F.col("market_return") >= 0, "market_up").otherwise("market_down")),
        label("volatility", F.when(F.col("market_volatility") >= cut, "high_volatility").otherwise("low_volatility")),
    )
    return (
        daily.withColumn("_r", F.explode(both)).select("*", "_r.*")
        .groupBy("regime_type", "regime", *keys)
        .agg(
            F.count("date").alias("dates"),
            F.avg("excess_return").alias("mean_excess_return"),
            F.avg(flag(F.col("excess_return") > 0)).alias("win_rate"),
            F.min("net_return").alias("worst_net_return"),
        )
    )


def xs_zscore(df: DataFrame, value: str, out: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Population z-score per date, zero where the date is flat."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_sd") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_sd")).otherwise(0.0)
    return df.join(stats, list(by), "left").withColumn(out, z).drop("_m", "_sd")


def robust_z(df: DataFrame, value: str, out: str, by: Sequence[str] = ("date",), bound: float = 4.0) -> DataFrame:
    """(x - median) / (1.4826 MAD), falling back to the sample deviation, clipped."""
    by = list(by)
    med = quantiles(df, by, value, {"_med": 0.5})
    dev = df.join(med, by, "left").withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(dev, by, "_dev", {"_mad": 0.5})
    sd = df.groupBy(*by).agg(F.stddev_samp(value).alias("_sd"))
    scale = F.when(F.col("_mad") * 1.4826 >= 1e-9, F.col("_mad") * 1.4826).when(F.col("_sd") >= 1e-9, F.col("_sd"))
    z = F.when(scale.isNull(), 0.0).otherwise(clip((F.col(value) - F.col("_med")) / scale, -bound, bound))
    return dev.join(mad, by, "left").join(sd, by, "left").withColumn(out, z).drop("_med", "_dev", "_mad", "_sd")


def blend_ranks(df: DataFrame, weights: dict[str, float], out: str = "blended_score", by: Sequence[str] = ("date",)) -> DataFrame:
    """Weighted sum of cross-sectional percentile ranks."""
    names = {c: f"_rk{i}" for i, c in enumerate(weights)}
    df = pct_ranks(df, ["date", "ticker"], by, names, fill=0.5)
    total = sum((F.col(n) * w for n, w in zip(names.values(), weights.values())), F.lit(0.0))
    return df.withColumn(out, total).drop(*names.values())

"""Trailing features of a price panel ``(ticker, date, close_price, volume)``.

All windows share one partitioning and order, so Catalyst plans a single shuffle
on ``ticker`` and one sort however many features are stacked.  Windows count rows
of the ticker, not calendar days; missing values are never filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import clip, correlation, flag, history, ratio, rolling, trailing

CLOSE = "close_price"


def lagged(c: str, n: int) -> Column:
    return F.lag(c, n).over(history())


def pct_change(df: DataFrame, n: int = 1, out: str | None = None, col: str = CLOSE) -> DataFrame:
    """Return over ``n`` rows of the same ticker."""
    return df.withColumn(out or f"ret_{n}d", ratio(col, lagged(col, n)) - 1)


def log_return(df: DataFrame, lo: float = -0.35, hi: float = 0.35, out: str = "log_ret") -> DataFrame:
    """One-row log return, clipped."""
    r = F.ln(ratio(CLOSE, lagged(CLOSE, 1)))
    return df.withColumn(out, clip(r, lo, hi))


def roll_std(df: DataFrame, c: str, n: int, min_periods: int | None = None, annual: bool = False,
             out: str | None = None) -> DataFrame:
    """Sample standard deviation of ``c`` over ``n`` rows, optionally times sqrt(252)."""
    x = rolling(F.stddev_samp, c, n, min_periods)
    return df.withColumn(out or f"vol_{n}d", x * F.sqrt(F.lit(252.0)) if annual else x)


def roll(df: DataFrame, c: str, fn: str, n: int, min_periods: int | None = None, out: str | None = None) -> DataFrame:
    """Rolling mean / sum / max / median."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "median": lambda x: F.percentile(x, 0.5)}[fn]
    return df.withColumn(out or f"{c}_{fn}_{n}", rolling(agg, c, n, min_periods))


def ma_features(df: DataFrame) -> DataFrame:
    """5/20-row moving averages, crossover as flag and as ratio, z against MA20, 4-sigma band width."""
    df = roll(df, CLOSE, "mean", 5, out="ma_5d")
    df = roll(df, CLOSE, "mean", 20, out="ma_20d")
    df = df.withColumn("_sd20", rolling(F.stddev_samp, CLOSE, 20))
    return df.withColumns({
        "ma_crossover": flag(F.col("ma_5d") > F.col("ma_20d")),
        "ma_ratio": ratio("ma_5d", "ma_20d") - 1,
        "z_ma20": ratio(F.col(CLOSE) - F.col("ma_20d"), "_sd20"),
        "bb_width_20d": ratio(4 * F.col("_sd20"), "ma_20d"),
    }).drop("_sd20")


def risk_adjusted(df: DataFrame, ret: str, vol: str, form: str = "plain", n: int = 60, out: str = "riskadj_mom_60d") -> DataFrame:
    """Return per unit of risk: ``plain`` r/v, ``scaled`` r/(v*sqrt n), ``shrunk`` r/(|v|+1e-4)."""
    x = {
        "plain": lambda: ratio(ret, vol),
        "scaled": lambda: ratio(ret, F.col(vol) * F.sqrt(F.lit(float(n)))),
        "shrunk": lambda: ratio(ret, F.abs(F.col(vol)) + 1e-4),
    }[form]()
    return df.withColumn(out, x)


def trend_ols(df: DataFrame, n: int = 60, slope: str = "trend_slope_60d", r2: str = "trend_r2_60d") -> DataFrame:
    """Slope and R2 of close against row position in the window; null for a flat window.

    Positions are known, so their mean and variance are constants: one weighted sum, one mean
    and one variance per row replace the general regression aggregates (several times slower
    over sliding frames)."""
    w = trailing(n)
    df = df.withColumn("_i", F.row_number().over(history()).cast("double"))
    df = df.withColumns({
        "_iy": F.sum(F.col("_i") * F.col(CLOSE)).over(w), "_y": F.sum(CLOSE).over(w), "_v": F.var_pop(CLOSE).over(w), "_n": F.count(CLOSE).over(w)})
    sxx = n * (n * n - 1) / 12.0
    sxy = F.col("_iy") - (F.col("_i") - (n - 1) / 2.0) * F.col("_y")
    full = (F.col("_n") == n) & (F.col("_v") > 0)
    return df.withColumns({
        slope: F.when(full, sxy / sxx), r2: F.when(full, F.try_divide(sxy * sxy, F.col("_v") * (n * sxx))),
    }).drop("_i", "_iy", "_y", "_v", "_n")


def trend_path(df: DataFrame, n: int = 60, min_periods: int = 30, slope: str = "path_slope_60d", eff: str = "path_eff_60d") -> DataFrame:
    """Endpoint slope ``(P/P[-(n-1)]-1)/(n-1)`` and path efficiency: net move over ``n`` summed steps."""
    first = lagged(CLOSE, n - 1)
    df = df.withColumn("_step", F.abs(F.col(CLOSE) - lagged(CLOSE, 1)))
    walked = rolling(F.sum, "_step", n, min_periods)
    return df.withColumns({
        slope: (ratio(CLOSE, first) - 1) / (n - 1),
        eff: clip(ratio(F.abs(F.col(CLOSE) - first), walked), 0.0, 1.0),
    }).drop("_step")


def roll_ac1(df: DataFrame, n: int = 5, form: str = "inside", min_pairs: int | None = None, ret: str = "ret_1d", out: str = "ac1_5d") -> DataFrame:
    """Lag-1 autocorrelation: ``inside`` pairs the n returns of the window (n-1 pairs),
    ``shifted`` correlates the series with its shift over n pairs (at least ``min_pairs``)."""
    pairs = n - 1 if form == "inside" else n
    w = trailing(pairs)
    df = df.withColumn("_prev", F.lag(ret, 1).over(history()))
    both = F.col(ret).isNotNull() & F.col("_prev").isNotNull()
    x, y = F.when(both, F.col(ret)), F.when(both, F.col("_prev"))
    ready = F.count(x).over(w) >= (min_pairs or pairs)
    moving = (F.max(x).over(w) > F.min(x).over(w)) & (F.max(y).over(w) > F.min(y).over(w))
    return df.withColumn(out, F.when(ready & moving, correlation(x, y, w))).drop("_prev")


def roll_mdd(df: DataFrame, n: int = 60, out: str = "max_dd_60d") -> DataFrame:
    """Deepest peak-to-trough fall inside the window (at most zero)."""
    w = trailing(n)
    walk = F.aggregate(
        F.collect_list(CLOSE).over(w),
        F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("mdd")),
        lambda acc, x: F.struct(
            F.greatest(acc["peak"], x).alias("peak"),
            F.least(acc["mdd"], F.coalesce(F.try_divide(x, F.greatest(acc["peak"], x)), F.lit(1.0)) - 1).alias("mdd"),
        ),
        lambda acc: acc["mdd"],
    )
    return df.withColumn(out, F.when(F.count(CLOSE).over(w) == n, walk))


def drawdown(df: DataFrame, n: int = 60, min_periods: int | None = None, out: str = "drawdown_60d") -> DataFrame:
    """Close against the rolling high, minus one."""
    return df.withColumn(out, ratio(CLOSE, rolling(F.max, CLOSE, n, min_periods)) - 1)


def since_max(df: DataFrame, n: int = 60, out: str = "time_since_max_60d") -> DataFrame:
    """Rows since the window's maximum; the oldest of equal maxima counts."""
    w = trailing(n)
    df = df.withColumn("_i", F.row_number().over(history()))
    best = F.max(F.struct(F.col(CLOSE), (-F.col("_i")).alias("neg"))).over(w)["neg"]
    return df.withColumn(out, F.when(F.count(CLOSE).over(w) == n, F.col("_i") + best)).drop("_i")


def dollar_vol(df: DataFrame, n: int = 20, fn: str = "mean", min_periods: int | None = None,
               out: str = "dollar_vol_20d_log") -> DataFrame:
    """log1p of the rolling mean or median of close * max(volume, 0)."""
    df = df.withColumn("_dv", F.col(CLOSE) * clip("volume", 0.0))
    agg = F.avg if fn == "mean" else (lambda x: F.percentile(x, 0.5))
    return df.withColumn(out, F.log1p(rolling(agg, "_dv", n, min_periods))).drop("_dv")


def rsi(df: DataFrame, n: int = 14, min_periods: int = 7, ret: str = "ret_1d", out: str = "rsi_14") -> DataFrame:
    """Relative strength in [0, 1] from rolling mean gains and losses, 0.5 without any loss or history."""
    df = df.withColumns({"_up": clip(ret, 0.0), "_down": clip(-F.col(ret), 0.0)})
    up, down = rolling(F.avg, "_up", n, min_periods), rolling(F.avg, "_down", n, min_periods)
    return df.withColumn(out, F.coalesce(F.when(down > 0, ratio(up, up + down)), F.lit(0.5))).drop("_up", "_down")


def upside_freq(df: DataFrame, n: int = 126, min_periods: int = 40, ret: str = "ret_5d", out: str = "upside_freq") -> DataFrame:
    """Share of positive five-row returns over ``n`` rows; rows without a return are left out."""
    df = df.withColumn("_pos", (F.col(ret) > 0).cast("double"))
    return df.withColumn(out, rolling(F.avg, "_pos", n, min_periods)).drop("_pos")


def rebase(df: DataFrame, base: float = 1.0, out: str = "norm_price") -> DataFrame:
    """Price relative to the ticker's first close."""
    first = F.first(CLOSE).over(history().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, ratio(CLOSE, first) * base)


def rebase_common(df: DataFrame) -> DataFrame:
    """Rebase to 100 on the dates for which every ticker has a price."""
    universe = df.select(F.countDistinct("ticker").alias("n")).scalar()
    complete = df.groupBy("date").agg(F.count(CLOSE).alias("_n")).where(F.col("_n") == universe).select("date")
    return rebase(df.join(complete, "date", "left_semi"), 100.0, "index_100")


def ffill(df: DataFrame, c: str, limit: int | None = None, out: str | None = None, key: str = "ticker") -> DataFrame:
    """Carry the last non-null value forward over at most ``limit`` rows (no limit by default)."""
    lo = Window.unboundedPreceding if limit is None else -limit
    return df.withColumn(out or c, F.last(c, ignorenulls=True).over(history(key).rowsBetween(lo, 0)))


def ffill_grid(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Closes forward-filled onto the calendar between a ticker's first and last day.

    The grid comes from exploding each ticker's own range of calendar positions."""
    days = df.select("date").distinct()
    cal = days.withColumn("_k", F.row_number().over(Window.orderBy("date")))
    span = df.groupBy("ticker").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    span = (span.join(cal.select(F.col("date").alias("_lo"), F.col("_k").alias("_from")), "_lo")
            .join(cal.select(F.col("date").alias("_hi"), F.col("_k").alias("_to")), "_hi"))
    grid = span.select("ticker", F.explode(F.sequence("_from", "_to")).alias("_k")).join(cal, "_k").drop("_k")
    return ffill(grid.join(df.select("ticker", "date", CLOSE), ["ticker", "date"], "left"), CLOSE, limit, "filled_close")


def history_count(df: DataFrame, out: str = "history_observations") -> DataFrame:
    """How many rows of the ticker exist up to and including this one."""
    return df.withColumn(out, F.row_number().over(history()))


def research_features(prices: DataFrame) -> DataFrame:
    """The whole feature row of the daily refresh, one shuffle."""
    df = prices
    for n, name in ((1, "pct_1d"), (2, "pct_2d"), (3, "pct_3d"), (5, "pct_5d"), (10, "ret_10d"), (20, "ret_20d"), (60, "ret_60d")):
        df = pct_change(df, n, name)
    for n, name in ((5, "volatility_5d"), (10, "volatility_10d"), (20, "vol_20d"), (60, "vol_60d")):
        df = roll_std(df, "pct_1d", n, out=name)
    df = risk_adjusted(ma_features(df), "ret_60d", "vol_60d")
    df = trend_ols(df)
    df = df.withColumn("_dv", F.col(CLOSE) * F.col("volume"))
    df = roll(df, "_dv", "mean", 20, out="dollar_vol_20d").drop("_dv")
    df = roll_ac1(df, 5, "inside", ret="pct_1d")
    return since_max(roll_mdd(df))


def residual_features(prices: DataFrame) -> DataFrame:
    """The seven trailing features of the residual panel."""
    df = prices
    for n in (1, 5, 20, 60):
        df = pct_change(df, n)
    df = roll_std(roll_std(df, "ret_1d", 20), "ret_1d", 60)
    return dollar_vol(drawdown(df))


def motion(df: DataFrame, axes: tuple[str, str, str], neighbor_gap: str | None = None) -> DataFrame:
    """Movement of a 3-D point along its own history: deltas, velocity, acceleration, turn
    angle in degrees (0 when undefined), radius, radial expansion, and how fast the gap to
    the neighbours closes."""
    d = [f"delta_{a}" for a in axes]
    back = lambda c: F.lag(c, 1).over(history())
    df = df.withColumns({o: F.col(a) - back(a) for o, a in zip(d, axes)})
    norm = lambda cs: F.sqrt(sum((F.col(c) * F.col(c) for c in cs[1:]), F.col(cs[0]) * F.col(cs[0])))
    dot = sum((F.col(o) * back(o) for o in d[1:]), F.col(d[0]) * back(d[0]))
    df = df.withColumns({"velocity": norm(d), "radius": norm(axes), "_dot": dot})
    scale = F.col("velocity") * back("velocity")
    cos = F.when(scale > 1e-12, clip(F.col("_dot") / scale, -1.0, 1.0)).otherwise(1.0)
    out = {
        "acceleration": F.col("velocity") - back("velocity"),
        "curvature_deg": F.degrees(F.acos(cos)),
        "radial_expansion": F.col("radius") - back("radius"),
    }
    if neighbor_gap:
        out["neighbor_convergence_velocity"] = -(F.abs(neighbor_gap) - back(F.abs(neighbor_gap)))
    return df.withColumns(out).drop("_dot")


def state_runs(df: DataFrame, state: str, n: int = 20, min_periods: int = 1, first_is_switch: bool = False,
               crowding: str | None = None) -> DataFrame:
    """Switches of ``state`` over ``n`` rows and length of the current stay."""
    prev = F.lag(state, 1).over(history())
    changed = F.when(prev.isNull(), int(first_is_switch)).otherwise((F.col(state) != prev).cast("int"))
    df = df.withColumn("_sw", changed)
    df = df.withColumns({
        "state_switches": rolling(F.sum, "_sw", n, min_periods),
        "_run": F.sum("_sw").over(history().rowsBetween(Window.unboundedPreceding, 0)),
    })
    w_run = Window.partitionBy("ticker", "_run").orderBy("date")
    df = df.withColumn("residence_length", F.row_number().over(w_run))
    if crowding:
        df = df.withColumn("crowding_change", F.col(crowding) - F.lag(crowding, 5).over(history()))
    return df.drop("_sw", "_run")


def interactions(df: DataFrame) -> DataFrame:
    """Products and gaps of own and neighbour features."""
    c = F.col
    return df.withColumns({
        "neighbor_confirmation": c("ret_20d") * c("neighbor_ret_20d"),
        "neighbor_divergence": c("ret_20d") - c("neighbor_ret_20d"),
        "similarity_weighted_momentum": c("ret_20d") * c("graph_similarity_mean"),
        "risk_adjusted_momentum": ratio("ret_20d", F.abs(c("vol_20d")) + 1e-4),
        "crowding_risk": c("graph_degree") * c("vol_20d"),
    })

"""Trailing features, labels and cross-sectional features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.frames import flag
from tessella.operators import cross_section as xs
from tessella.operators import features as ft
from tessella.operators import targets as tg
from tessella.plans.ctes import roll
from tessella.plans.registry import query
from tessella.session import stage

W = "OVER (PARTITION BY ticker ORDER BY date)"


@query("E01_pct_change", "ticker date:d ret_1d:r ret_2d:r ret_3d:r ret_5d:r ret_10d:r ret_20d:r ret_60d:r",
       "SELECT * FROM rets")
def _(t):
    df = t.prices()
    for n in (1, 2, 3, 5, 10, 20, 60):
        df = ft.pct_change(df, n)
    return df


@query("E02_log_return", "ticker date:d log_ret:r",
       f"SELECT ticker, date, greatest(-0.35, least(0.35, ln(close_price / nullif(lag(close_price) {W}, 0)))) + 0 * lag(close_price) {W} AS log_ret FROM prices")
def _(t):
    return ft.log_return(t.prices())


@query("E03_roll_std", "ticker date:d vol_5d:r vol_10d:r vol_20d:r vol_60d:r vol_20d_annual:r",
       f"SELECT ticker, date, volatility_5d AS vol_5d, volatility_10d AS vol_10d, vol_20d, vol_60d, {roll('stddev_samp(ret_1d)', 'ret_1d', 20, 12)} * sqrt(252) AS vol_20d_annual FROM rolled")
def _(t):
    df = ft.pct_change(t.prices(), 1)
    for n in (5, 10, 20, 60):
        df = ft.roll_std(df, "ret_1d", n)
    return ft.roll_std(df, "ret_1d", 20, 12, annual=True, out="vol_20d_annual")


@query("E04_roll", "ticker date:d mean_20:r sum_20:r max_60:r median_20:r",
       f"""SELECT ticker, date, {roll('avg(close_price)', 'close_price', 20)} AS mean_20, {roll('sum(volume)', 'volume', 20)} AS sum_20,
       {roll('max(close_price)', 'close_price', 60, 30)} AS max_60, {roll('quantile_cont(close_price, 0.5)', 'close_price', 20, 10)} AS median_20 FROM prices""")
def _(t):
    df = ft.roll(t.prices(), "close_price", "mean", 20, out="mean_20")
    df = ft.roll(df, "volume", "sum", 20, out="sum_20")
    df = ft.roll(df, "close_price", "max", 60, 30, "max_60")
    return ft.roll(df, "close_price", "median", 20, 10, "median_20")


@query("E05_ma_features", "ticker date:d ma_5d:r ma_20d:r ma_crossover:i ma_ratio:r z_ma20:r bb_width_20d:r", "SELECT * FROM feats", digits=5)
def _(t):
    return ft.ma_features(t.prices())


@query("E06_risk_adjusted", "ticker date:d plain:r scaled:r shrunk:r",
       """SELECT ticker, date, ret_60d / nullif(vol_60d, 0) AS plain, ret_60d / nullif(vol_60d * sqrt(60.0), 0) AS scaled,
       ret_20d / (abs(vol_20d) + 1e-4) AS shrunk FROM rolled""")
def _(t):
    df = tg.residual_features(t.prices())
    df = ft.risk_adjusted(df, "ret_60d", "vol_60d", out="plain")
    df = ft.risk_adjusted(df, "ret_60d", "vol_60d", "scaled", out="scaled")
    return ft.risk_adjusted(df, "ret_20d", "vol_20d", "shrunk", out="shrunk")


@query("E07_trend_ols", "ticker date:d trend_slope_60d:r trend_r2_60d:r", "SELECT * FROM feats", digits=4)
def _(t):
    return ft.trend_ols(t.prices(), 60)


@query("E08_trend_path", "ticker date:d path_slope_60d:r path_eff_60d:r",
       f"""SELECT ticker, date, (close_price / nullif(lag(close_price, 59) {W}, 0) - 1) / 59 AS path_slope_60d,
       CASE WHEN lag(close_price, 59) {W} IS NOT NULL THEN least(1, greatest(0, abs(close_price - lag(close_price, 59) {W}) / nullif({roll('sum(step)', 'step', 60, 30)}, 0))) END AS path_eff_60d
       FROM (SELECT *, abs(close_price - lag(close_price) {W}) AS step FROM prices)""")
def _(t):
    return ft.trend_path(t.prices())


@query("E09_roll_ac1", "ticker date:d ac1_inside:r ac1_shifted:r",
       """SELECT ticker, date, CASE WHEN count(prev_ret) OVER w4 = 4 THEN corr(ret_1d, prev_ret) OVER w4 END AS ac1_inside,
       CASE WHEN count(prev_ret) OVER w5 >= 4 THEN corr(ret_1d, prev_ret) OVER w5 END AS ac1_shifted FROM rolled
       WINDOW w4 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
              w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", digits=5)
def _(t):
    df = ft.pct_change(t.prices(), 1)
    return ft.roll_ac1(ft.roll_ac1(df, 5, "inside", out="ac1_inside"), 5, "shifted", 4, out="ac1_shifted")


@query("E10_roll_mdd", "ticker date:d max_dd_60d:r", "SELECT * FROM feats")
def _(t):
    return ft.roll_mdd(t.prices())


@query("E11_drawdown", "ticker date:d drawdown_60d:r", "SELECT ticker, date, close_price / high60 - 1 AS drawdown_60d FROM rolled")
def _(t):
    return ft.drawdown(t.prices())


@query("E12_since_max", "ticker date:d time_since_max_60d:i", "SELECT * FROM feats")
def _(t):
    return ft.since_max(t.prices())


@query("E13_dollar_vol", "ticker date:d mean_log:r median_log:r",
       f"SELECT ticker, date, ln(1 + dollar_vol_20d) AS mean_log, ln(1 + {roll('quantile_cont(dv, 0.5)', 'dv', 20, 10)}) AS median_log FROM rolled")
def _(t):
    return ft.dollar_vol(ft.dollar_vol(t.prices(), 20, "mean", out="mean_log"), 20, "median", 10, "median_log")


@query("E14_rsi", "ticker date:d rsi_14:r",
       f"""SELECT ticker, date, coalesce(CASE WHEN {roll('avg(down)', 'down', 14, 7)} > 0 THEN 1 - 1 / (1 + {roll('avg(up)', 'up', 14, 7)} / {roll('avg(down)', 'down', 14, 7)}) END, 0.5) AS rsi_14
       FROM (SELECT *, CASE WHEN ret_1d > 0 THEN ret_1d WHEN ret_1d IS NOT NULL THEN 0 END AS up, CASE WHEN ret_1d < 0 THEN -ret_1d WHEN ret_1d IS NOT NULL THEN 0 END AS down FROM rets)""")
def _(t):
    return ft.rsi(ft.pct_change(t.prices(), 1))


@query("E15_upside_freq", "ticker date:d upside_freq:r",
       f"SELECT ticker, date, {roll('avg(up)', 'up', 126, 40)} AS upside_freq FROM (SELECT *, CASE WHEN ret_5d > 0 THEN 1.0 WHEN ret_5d IS NOT NULL THEN 0.0 END AS up FROM rets)")
def _(t):
    return ft.upside_freq(ft.pct_change(t.prices(), 5))


@query("E16_rebase", "ticker date:d norm_price:r",
       f"SELECT ticker, date, close_price / first_value(close_price) {W} AS norm_price FROM prices")
def _(t):
    return ft.rebase(t.prices())


@query("E16_rebase_common", "returnflag date:d index_100:r",
       """WITH px AS (SELECT returnflag, date, sum(amount) / sum(volume) AS close_price FROM raw_bars GROUP BY 1, 2),
       full_days AS (SELECT date FROM px GROUP BY date HAVING count(*) = (SELECT count(DISTINCT returnflag) FROM px))
       SELECT returnflag, date, 100 * close_price / first_value(close_price) OVER (PARTITION BY returnflag ORDER BY date) AS index_100 FROM px JOIN full_days USING (date)""")
def _(t):
    px = t.raw_bars().groupBy(F.col("returnflag").alias("ticker"), "date").agg((F.sum("amount") / F.sum("volume")).alias("close_price"))
    return ft.rebase_common(px).withColumnRenamed("ticker", "returnflag")


@query("E17_ffill", "ticker date:d filled_close:r",
       """WITH cal AS (SELECT DISTINCT date FROM prices), span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM prices GROUP BY ticker),
       grid AS (SELECT ticker, date FROM span JOIN cal ON date BETWEEN lo AND hi)
       SELECT g.ticker, g.date, last_value(close_price IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS filled_close
       FROM grid g LEFT JOIN prices p ON p.ticker = g.ticker AND p.date = g.date""")
def _(t):
    return ft.ffill_grid(t.prices(), 5)


@query("E18_forward_target", "ticker date:d evaluation_date:d future_return:r label:i",
       f"""SELECT ticker, date, lead(date, 20) {W} AS evaluation_date, lead(close_price, 20) {W} / close_price - 1 AS future_return,
       CASE WHEN lead(close_price, 20) {W} IS NULL THEN NULL WHEN lead(close_price, 20) {W} / close_price - 1 > 0 THEN 1 ELSE 0 END AS label FROM prices""")
def _(t):
    return tg.forward_target(t.prices(), 20, "label")


@query("E19_xs_rank", "ticker date:d r20:r v20:r",
       """SELECT ticker, date, CASE WHEN ret_20d IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY date ORDER BY ret_20d NULLS LAST) + (count(*) OVER (PARTITION BY date, ret_20d) - 1) / 2.0) / count(ret_20d) OVER (PARTITION BY date) END AS r20,
       CASE WHEN vol_20d IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY date ORDER BY vol_20d NULLS LAST) + (count(*) OVER (PARTITION BY date, vol_20d) - 1) / 2.0) / count(vol_20d) OVER (PARTITION BY date) END AS v20 FROM rfeats""")
def _(t):
    df = stage(ft.residual_features(t.prices()))
    return xs.xs_rank(xs.xs_rank(df, "ret_20d", "r20"), "vol_20d", "v20", fill=0.5)


@query("E20_top_liquidity", "ticker date:d liquidity_rank:i dollar_vol_20d_log:r",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY dollar_vol_20d_log DESC, ticker) AS liquidity_rank FROM panel) WHERE liquidity_rank <= 10")
def _(t):
    return xs.top_liquidity(t.panel(), 10)


@query("E21_residual_targets",
       "ticker date:d evaluation_date:d future_return:r liquidity_rank:i sector market_members:i market_return_loo:r market_residual_return:r sector_members:i sector_return_loo:r "
       "sector_residual_return:r primary_benchmark primary_residual_return:r primary_residual_rank_pct:r primary_residual_positive:i primary_residual_top_decile:i",
       "SELECT * FROM labelled")
def _(t):
    return t.staged("labelled")


FAMILIES_SQL = """fam AS (SELECT ticker, count(*) OVER (PARTITION BY nation) AS variant_family_size,
       CASE WHEN row_number() OVER (PARTITION BY nation ORDER BY acctbal DESC, ticker) = 1 THEN 1 ELSE 0 END AS variant_is_chosen FROM symbols)"""


def families(t):
    s = t.symbols()
    per = s.groupBy("nation").agg(F.count(F.lit(1)).alias("variant_family_size"), F.max("acctbal").alias("top"))
    lead = s.join(per, "nation").where(F.col("acctbal") == F.col("top")).groupBy("nation").agg(F.min("ticker").alias("chosen"))
    return s.join(per, "nation").join(lead, "nation").withColumn("variant_is_chosen", flag(F.col("ticker") == F.col("chosen")))


def _pct(c):
    return f"""coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END, 0.5)"""


@query("E22_type_features", "ticker date:d log_dollar_vol_20d:r volatility_ratio_20_60:r return_trend_alignment:r stock_type stock_type_code:i variant_family_size:i variant_is_chosen:i",
       f"""WITH {FAMILIES_SQL}, r AS (SELECT *, {_pct('dollar_vol_20d')} AS lq, {_pct('vol_60d')} AS vl, {_pct('trend_slope_60d')} AS tr, {_pct('ret_60d')} AS rt FROM feats),
       k AS (SELECT *, CASE WHEN vl >= 0.75 THEN 'High volatility' WHEN lq >= 0.75 AND tr >= 0.6 THEN 'Liquid leader' WHEN tr >= 0.75 THEN 'Trend leader' WHEN rt <= 0.25 THEN 'Recent laggard' ELSE 'Core' END AS stock_type FROM r)
       SELECT ticker, date, ln(1 + greatest(dollar_vol_20d, 0) + 0 * dollar_vol_20d) AS log_dollar_vol_20d, vol_20d / (abs(vol_60d) + 1e-9) AS volatility_ratio_20_60,
       ret_20d * sign(coalesce(trend_slope_60d, 0)) AS return_trend_alignment, stock_type,
       CASE stock_type WHEN 'Core' THEN 0 WHEN 'High volatility' THEN 1 WHEN 'Liquid leader' THEN 2 WHEN 'Trend leader' THEN 3 ELSE 4 END AS stock_type_code,
       variant_family_size, variant_is_chosen FROM k JOIN fam USING (ticker)""")
def _(t):
    # read twice by the ranks: the columns behind them only
    f = stage(t.feats().select("ticker", "date", "ret_20d", "vol_20d", "vol_60d", "ret_60d", "trend_slope_60d", "dollar_vol_20d"))
    return xs.type_features(f, families(t))


CONTEXT_SQL = """ctx AS (SELECT date, median(ret_20d) AS market_ret20_median, median(vol_60d) AS market_vol60_median, avg(CASE WHEN ret_20d > 0 THEN 1.0 ELSE 0.0 END) AS breadth_ret20_positive,
       stddev_samp(ret_20d) AS market_ret20_dispersion, count(*) AS members FROM panel GROUP BY date)"""


@query("E23_market_context", "date:d market_ret20_median:r market_vol60_median:r breadth_ret20_positive:r market_ret20_dispersion:r members:i",
       f"WITH {CONTEXT_SQL} SELECT * FROM ctx")
def _(t):
    return xs.market_context(t.staged("panel"))


@query("E24_regimes", "date:d regime",
       f"""WITH {CONTEXT_SQL} SELECT date, CASE WHEN market_vol60_median > (SELECT quantile_cont(market_vol60_median, 0.75) FROM ctx WHERE date <= DATE '1998-12-31') THEN 'stress'
       WHEN breadth_ret20_positive >= 0.6 THEN 'trend_up' WHEN breadth_ret20_positive <= 0.4 THEN 'trend_down' ELSE 'rotation_quiet' END AS regime FROM ctx WHERE date > DATE '1998-12-31'""")
def _(t):
    return xs.regimes(xs.market_context(t.staged("panel")), F.lit("1998-12-31").cast("date"))


@query("E25_regime_summary", "regime_type regime strategy dates:i mean_excess_return:r win_rate:r worst_net_return:r",
       """WITH u AS (SELECT date, avg(future_return) AS market_return, median(vol_60d) AS market_volatility FROM panel GROUP BY date),
       s AS (SELECT date, strategy, avg(r) AS net_return FROM (
              SELECT date, 'winners' AS strategy, CASE WHEN ret_20d > 0 THEN future_return END AS r FROM panel UNION ALL
              SELECT date, 'losers', CASE WHEN ret_20d <= 0 THEN future_return END FROM panel) GROUP BY 1, 2 HAVING count(r) > 0),
       d AS (SELECT *, net_return - market_return AS excess_return FROM s JOIN u USING (date)), c AS (SELECT median(market_volatility) AS cut FROM d),
       l AS (SELECT d.*, 'return' AS regime_type, CASE WHEN market_return >= 0 THEN 'market_up' ELSE 'market_down' END AS regime FROM d UNION ALL
             SELECT d.*, 'volatility', CASE WHEN market_volatility >= cut THEN 'high_volatility' ELSE 'low_volatility' END FROM d, c)
       SELECT regime_type, regime, strategy, count(*) AS dates, avg(excess_return) AS mean_excess_return, avg(CASE WHEN excess_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(net_return) AS worst_net_return
       FROM l GROUP BY 1, 2, 3""")
def _(t):
    p = t.staged("panel")
    u = p.groupBy("date").agg(F.avg("future_return").alias("market_return"))
    u = u.join(xs.market_context(p).select("date", F.col("market_vol60_median").alias("market_volatility")), "date")
    s = (p.withColumn("strategy", F.when(F.col("ret_20d") > 0, "winners").otherwise("losers"))
         .groupBy("date", "strategy").agg(F.avg("future_return").alias("net_return")))
    return xs.regime_summary(s.join(u, "date").withColumn("excess_return", F.col("net_return") - F.col("market_return")))


@query("E26_xs_zscore", "ticker date:d z:r",
       """SELECT ticker, date, CASE WHEN stddev_pop(ret_20d) OVER d > 1e-12 THEN (ret_20d - avg(ret_20d) OVER d) / stddev_pop(ret_20d) OVER d ELSE 0 END AS z FROM panel WINDOW d AS (PARTITION BY date)""")
def _(t):
    return xs.xs_zscore(t.staged("panel"), "ret_20d", "z")


@query("E26_robust_z", "ticker date:d z:r",
       """WITH m AS (SELECT ticker, date, ret_20d, median(ret_20d) OVER (PARTITION BY date) AS med FROM panel),
       s AS (SELECT *, median(abs(ret_20d - med)) OVER (PARTITION BY date) AS mad, stddev_samp(ret_20d) OVER (PARTITION BY date) AS sd FROM m),
       k AS (SELECT *, CASE WHEN 1.4826 * mad >= 1e-9 THEN 1.4826 * mad WHEN sd >= 1e-9 THEN sd END AS scale FROM s)
       SELECT ticker, date, CASE WHEN scale IS NULL THEN 0 ELSE greatest(-4, least(4, (ret_20d - med) / scale)) END AS z FROM k""")
def _(t):
    return xs.robust_z(t.staged("panel"), "ret_20d", "z")


@query("E27_motion", "ticker date:d delta_ret_5d:r velocity:r acceleration:r curvature_deg:r radius:r radial_expansion:r neighbor_convergence_velocity:r",
       f"""WITH a AS (SELECT *, ret_5d - lag(ret_5d) {W} AS dx, ret_20d - lag(ret_20d) {W} AS dy, ret_60d - lag(ret_60d) {W} AS dz, ret_20d - vol_20d AS gap FROM panel),
       b AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS velocity, sqrt(ret_5d * ret_5d + ret_20d * ret_20d + ret_60d * ret_60d) AS radius,
             dx * lag(dx) {W} + dy * lag(dy) {W} + dz * lag(dz) {W} AS dot FROM a)
       SELECT ticker, date, dx AS delta_ret_5d, velocity, velocity - lag(velocity) {W} AS acceleration, radius, radius - lag(radius) {W} AS radial_expansion,
       CASE WHEN velocity * lag(velocity) {W} > 1e-12 THEN degrees(acos(greatest(-1, least(1, dot / (velocity * lag(velocity) {W}))))) ELSE 0 END AS curvature_deg,
       -(abs(gap) - lag(abs(gap)) {W}) AS neighbor_convergence_velocity FROM b""", digits=4)
def _(t):
    df = t.panel().withColumn("gap", F.col("ret_20d") - F.col("vol_20d"))
    return ft.motion(df, ("ret_5d", "ret_20d", "ret_60d"), "gap")


@query("E28_state_runs", "ticker date:d state:i state_switches:i residence_length:i crowding_change:r switches_v2:i",
       f"""WITH s AS (SELECT *, CASE WHEN ret_20d > 0.5 THEN 2 WHEN ret_20d > 0 THEN 1 ELSE 0 END AS state FROM panel),
       c AS (SELECT *, CASE WHEN lag(state) {W} IS NULL THEN 0 WHEN state <> lag(state) {W} THEN 1 ELSE 0 END AS sw,
             CASE WHEN lag(state) {W} IS NULL OR state <> lag(state) {W} THEN 1 ELSE 0 END AS sw2 FROM s),
       g AS (SELECT *, sum(sw) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM c)
       SELECT ticker, date, state, {roll('sum(sw)', 'sw', 20, 1)} AS state_switches, row_number() OVER (PARTITION BY ticker, run ORDER BY date) AS residence_length,
       vol_20d - lag(vol_20d, 5) {W} AS crowding_change, {roll('sum(sw2)', 'sw2', 20, 5)} AS switches_v2 FROM g""")
def _(t):
    df = t.panel().withColumn("state", F.when(F.col("ret_20d") > 0.5, 2).when(F.col("ret_20d") > 0, 1).otherwise(0))
    df = ft.state_runs(df, "state", 20, 5, True).withColumnRenamed("state_switches", "switches_v2").drop("residence_length")
    return ft.state_runs(df, "state", crowding="vol_20d")


@query("E29_history_count", "ticker date:d history_observations:i", f"SELECT ticker, date, row_number() {W} AS history_observations FROM prices")
def _(t):
    return ft.history_count(t.prices())


@query("K11_blend_ranks", "ticker date:d blended_score:r",
       f"SELECT ticker, date, 0.40 * {_pct('ret_20d')} + 0.35 * {_pct('ret_5d')} + 0.25 * {_pct('drawdown_60d')} AS blended_score FROM panel")
def _(t):
    return xs.blend_ranks(t.staged("panel"), {"ret_20d": 0.40, "ret_5d": 0.35, "drawdown_60d": 0.25})


@query("B01_seal", "n_rows:i decision_violations:i evaluation_violations:i kept:i",
       f"""WITH f AS (SELECT *, lead(date, 20) {W} AS evaluation_date FROM prices)
       SELECT count(*) AS n_rows, count(*) FILTER (WHERE date >= DATE '2000-06-01') AS decision_violations, count(*) FILTER (WHERE evaluation_date >= DATE '2000-06-01') AS evaluation_violations,
       count(*) FILTER (WHERE date < DATE '2000-06-01' AND evaluation_date < DATE '2000-06-01') AS kept FROM f""")
def _(t):
    df = tg.forward_target(t.prices(), 20)
    kept = tg.seal(df, "2000-06-01").select(F.count(F.lit(1))).scalar()
    return tg.seal_violations(df, "2000-06-01").withColumn("kept", kept)


@query("B02_last_n_dates", "ticker date:d close_price:r",
       "SELECT * FROM prices WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 60))")
def _(t):
    return tg.last_n_dates(t.prices(), 60)


@query("B03_scrub", "ticker date:d ret_20d:r score:r",
       f"SELECT ticker, date, ret_20d, ln(ret_20d) AS score FROM rets WHERE ret_20d IS NOT NULL AND ret_20d > 0")
def _(t):
    df = ft.pct_change(t.prices(), 20)
    raw = df.withColumn("score", F.when(F.col("ret_20d") < 0, F.lit(float("nan"))).when(F.col("ret_20d") == 0, F.lit(float("-inf"))).otherwise(F.ln("ret_20d")))
    return tg.scrub(raw, ["ret_20d", "score"])

"""Splits, samples, models and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import flag
from tessella.operators import calibration as cb
from tessella.operators import models as ml
from tessella.operators import splits as sp
from tessella.operators import targets as tg
from tessella.plans.registry import draw_sql, query
from tessella.session import stage
from tessella.streaming import incremental as inc

COLS = ["ret_5d", "ret_20d", "ret_60d", "vol_20d", "drawdown_60d", "dollar_vol_20d_log"]


@query("J01_holdout_split", "role date:d", "SELECT CASE WHEN i < n - 180 - 20 THEN 'train' ELSE 'test' END AS role, date FROM panel_cal WHERE i < n - 180 - 20 OR i >= n - 180")
def _(t):
    return sp.holdout_split(t.staged("panel"), 180, 20)


@query("J02_walk_forward", "split:i role date:d", "SELECT * FROM wf_splits")
def _(t):
    return sp.walk_forward(t.staged("panel"), 5, 120, 5, 200)


@query("J02_walk_forward_validation", "split:i role date:d",
       """WITH s AS (SELECT c.*, s.split, n - (4 - s.split) * 100 AS start FROM panel_cal c, (SELECT unnest(range(1, 4)) AS split) s), k AS (SELECT *, start - 10 AS cut, greatest(4, least(80, floor((start - 10) / 5))) AS tail FROM s WHERE start >= 0 AND start - 10 >= 100)
       SELECT split, CASE WHEN i < cut - tail THEN 'fit' WHEN i < cut THEN 'validation' ELSE 'test' END AS role, date FROM k WHERE i < cut OR (i >= start AND i < start + 100)""")
def _(t):
    return sp.walk_forward(t.staged("panel"), 3, 100, 10, 100, validation=(4, 80, 5))


@query("J02_rolling_window", "split:i role first_date:d last_date:d dates:i",
       """WITH s AS (SELECT c.*, s.split, n - (4 - s.split) * 100 AS start FROM panel_cal c, (SELECT unnest(range(1, 4)) AS split) s)
       SELECT split, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role, min(date) AS first_date, max(date) AS last_date, count(*) AS dates FROM s WHERE (i < start - 5 AND i >= start - 5 - 250) OR (i >= start AND i < start + 100) GROUP BY 1, 2""")
def _(t):
    return sp.split_bounds(sp.walk_forward(t.staged("panel"), 3, 100, 5, 200, train_window=250))


@query("J03_purged_splits", "split:i test_start:d test_end:d train_decision_max:d train_evaluation_max:d training_dates:i training_rows:i",
       """WITH b AS (SELECT floor((i - n + 480) / 120) + 1 AS split, min(date) AS test_start, max(date) AS test_end FROM panel_cal WHERE i >= n - 480 GROUP BY 1)
       SELECT split, test_start, test_end, max(p.date) AS train_decision_max, max(evaluation_date) AS train_evaluation_max, count(DISTINCT p.date) AS training_dates, count(*) AS training_rows FROM b JOIN panel p ON p.evaluation_date < test_start GROUP BY 1, 2, 3""")
def _(t):
    return sp.purged_splits(t.staged("panel"), 4, 120, 200)


@query("J04_sealed_splits", "split:i role date:d",
       """WITH s AS (SELECT c.*, k.split, n - 200 - 20 - 1 - (4 - k.split) * (60 + 20) AS e FROM panel_cal c, (SELECT unnest(range(1, 5)) AS split) k), x AS (SELECT *, e - 59 AS st, e - 59 - 20 - 1 AS cut FROM s)
       SELECT split, CASE WHEN i <= cut THEN 'train' ELSE 'test' END AS role, date FROM x WHERE cut + 1 >= 200 AND (i <= cut OR (i >= st AND i <= e))""")
def _(t):
    return sp.sealed_splits(t.staged("panel"), 200, 4, 60, 20, 200)


@query("J05_chunk_splits", "split:i role date:d",
       """WITH p AS (SELECT *, ntile(4) OVER (ORDER BY date) AS split FROM panel_cal WHERE i >= n - least(350, greatest(20, floor(n / 3)))), b AS (SELECT split, min(i) AS st FROM p GROUP BY 1)
       SELECT split, 'test' AS role, date FROM p UNION ALL SELECT b.split, 'train', c.date FROM b JOIN panel_cal c ON c.i < b.st - 5 AND c.i >= b.st - 5 - 500""")
def _(t):
    return sp.chunk_splits(t.staged("panel"), 350, 4, 5, 500)


@query("J06_calibration_split", "role date:d",
       "WITH k AS (SELECT *, least(greatest(15, floor(n / 6)), greatest(15, floor(n / 3))) AS z FROM panel_cal) SELECT CASE WHEN i < greatest(1, n - z - 20) THEN 'fit' ELSE 'calibration' END AS role, date FROM k WHERE i < greatest(1, n - z - 20) OR i >= n - z")
def _(t):
    return sp.calibration_split(t.staged("panel"), 20)


@query("J07_sample_n", "ticker date:d ret_20d:r", f"SELECT ticker, date, ret_20d FROM panel ORDER BY {draw_sql(3, 'ticker', 'date')}, ticker, date LIMIT 5000")
def _(t):
    return sp.sample_n(t.staged("panel"), 5000, 3, ["ticker", "date"])


@query("J07_sample_per_date", "date:d n:i", "SELECT date, least(5, count(*)) AS n FROM panel GROUP BY 1")
def _(t):
    return sp.sample_n(t.staged("panel"), 5, 3, ["ticker"], ["date"]).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("J08_permute_within", "date:d n:i total:r square:r lowest:r highest:r", "SELECT date, count(*) AS n, sum(ret_20d) AS total, sum(ret_20d * ret_20d) AS square, min(ret_20d) AS lowest, max(ret_20d) AS highest FROM panel GROUP BY 1", digits=4)
def _(t):
    p = sp.permute_within(t.staged("panel").select("date", "ticker", "ret_20d", "vol_20d"), ["ret_20d"], ["date"], ["ticker"], 5)
    return p.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("ret_20d").alias("total"), F.sum(F.col("ret_20d") * F.col("ret_20d")).alias("square"), F.min("ret_20d").alias("lowest"), F.max("ret_20d").alias("highest"))


@query("J08_permute_dates", "ticker date:d regime_value:r",
       f"""WITH d AS (SELECT DISTINCT date FROM panel), a AS (SELECT date, row_number() OVER (ORDER BY {draw_sql(9, 'date')}, date) AS k FROM d),
       b AS (SELECT CAST(day(date) AS DOUBLE) AS regime_value, row_number() OVER (ORDER BY {draw_sql(10, 'date')}, date) AS k FROM d)
       SELECT p.ticker, p.date, b.regime_value FROM panel p JOIN a ON a.date = p.date JOIN b ON b.k = a.k""")
def _(t):
    p = t.staged("panel").select("ticker", "date", F.dayofmonth("date").cast("double").alias("regime_value"))
    return sp.permute_dates(p, ["regime_value"], 9)


@query("J09_pairwise_training", "date:d ticker other_ticker mirror:i draw:i ret_20d:r vol_20d:r label:i",
       f"""WITH z AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {draw_sql(4, 'date', 'ticker')}, ticker) - 1 AS pos, count(*) OVER (PARTITION BY date) AS n FROM panel),
       q AS (SELECT greatest(10, floor(60000.0 / count(DISTINCT date) / 2)) AS per_date FROM panel),
       l AS (SELECT z.*, draw, {draw_sql(6, 'date', 'ticker', 'draw')} % n AS other FROM z, q, (SELECT unnest([0, 1]) AS draw) WHERE pos * 2 + draw < per_date)
       SELECT l.date, l.ticker, r.ticker AS other_ticker, mirror, draw, mirror * (l.ret_20d - r.ret_20d) AS ret_20d, mirror * (l.vol_20d - r.vol_20d) AS vol_20d,
              CASE WHEN (l.future_return > r.future_return) = (mirror = 1) THEN 1 ELSE 0 END AS label
       FROM l JOIN z r ON r.date = l.date AND r.pos = l.other AND l.other <> l.pos, (SELECT unnest([1, -1]) AS mirror)""")
def _(t):
    return sp.pairwise_training(t.staged("panel"), ["ret_20d", "vol_20d"], "future_return", 60_000, 4)


@query("J10_equal_weight", "date:d holdings:i net_return:r", "SELECT date, count(*) AS holdings, avg(future_return) - 0.002 AS net_return FROM panel GROUP BY 1")
def _(t):
    return sp.equal_weight(t.staged("panel"), "future_return", 0.002)


@query("J10_random_top_k", "date:d holdings:i net_return:r",
       f"""SELECT date, count(*) AS holdings, avg(future_return) - 0.002 AS net_return FROM
       (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {draw_sql(42, 'ticker')}, ticker) AS k FROM panel WHERE future_return IS NOT NULL) WHERE k <= 5 GROUP BY 1""")
def _(t):
    return sp.random_top_k(t.staged("panel"), 5, "future_return", 42, 0.002)


FAMILIES = {"momentum": ["ret_5d", "ret_20d"], "volatility": ["vol_20d"], "liquidity": ["dollar_vol_20d_log"]}


def _mean(cols):
    return "(" + " + ".join(cols) + f") / {float(len(cols))}"


@query("J11_feature_configs", "config model split:i roc_auc:r",
       "WITH l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS config, model, split, label, {_mean(c)} AS s FROM scored" for n, c in sp.feature_configs(FAMILIES, "momentum").items()) + """),
       k AS (SELECT *, rank() OVER (PARTITION BY config, model, split ORDER BY s) + (count(*) OVER (PARTITION BY config, model, split, s) - 1) / 2.0 AS rk FROM l)
       SELECT config, model, split, (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label)::DOUBLE * (count(*) - sum(label)), 0) AS roc_auc FROM k GROUP BY 1, 2, 3""")
def _(t):
    return ml.config_scores(t.staged("scored"), sp.feature_configs(FAMILIES, "momentum"), ["model", "split"])


def train_test(t, h=5):
    panel = t.staged("panel") if h == 5 else stage(t.horizon_panel(h))
    p = panel.select("ticker", "date", *COLS, F.col("future_return").alias("forward_return"), flag(F.col("future_return") > 0).alias("label"))
    r = sp.holdout_split(panel, 300, h)
    pick = lambda role: stage(p.join(r.where(F.col("role") == role).select("date"), "date", "left_semi"))
    return pick("train"), pick("test")


@query("K01_prep", "feature median:r mean:r std:r",
       "WITH tr AS (SELECT p.* FROM panel p JOIN panel_cal c USING (date) WHERE i < n - 300 - 5) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median, avg({c}) AS mean, stddev_pop({c}) AS std FROM tr" for c in COLS))
def _(t):
    p = ml.prep(train_test(t)[0], COLS)
    return t.spark.createDataFrame(list(zip(p.cols, p.median, p.mean, p.std)), "feature string, median double, mean double, std double")


def predicted(t, fit, label="label"):
    a, b = train_test(t)
    return fit(a, COLS, label).predict(b)


@query("K02_logistic", "ticker date:d probability:r label:i", digits=4)
def _(t):
    return predicted(t, lambda d, c, y: ml.logistic(d, c, y, balanced=True))


@query("K02_elastic_net", "ticker date:d probability:r label:i", digits=4)
def _(t):
    return predicted(t, lambda d, c, y: ml.logistic(d, c, y, 0.5, 0.5))


@query("K03_ridge", "ticker date:d value:r probability:r", digits=4)
def _(t):
    return predicted(t, ml.ridge, "forward_return")


@query("K04_gbt", "ticker date:d probability:r label:i", digits=4)
def _(t):
    return predicted(t, ml.gbt)


@query("K04_forest", "ticker date:d probability:r label:i", digits=4)
def _(t):
    return predicted(t, ml.forest)


@query("K05_mlp", "ticker date:d probability:r label:i", digits=4)
def _(t):
    return predicted(t, ml.mlp)


@query("K06_tournament", "horizon_days:i model_name fit_status roc_auc:r brier_skill:r champion_score:r is_champion:i", digits=4)
def _(t):
    return ml.tournament({h: train_test(t, h) for h in (5, 20, 60)}, COLS)


@query("K06_mark_champions", "run_id:i horizon_days:i model_name is_champion:i", "SELECT run_id, horizon_days, model_name, CASE WHEN row_number() OVER (PARTITION BY run_id, horizon_days ORDER BY champion_score DESC, model_name) = 1 THEN 1 ELSE 0 END AS is_champion FROM evals")
def _(t):
    return ml.mark_champions(t.staged("evals").drop("is_champion"), ["run_id", "horizon_days"])


@query("K08_latest_predictions", "ticker as_of_date:d model_rank:i probability_up:r probability_bucket top_positive_drivers top_negative_drivers", digits=4)
def _(t):
    a, b = train_test(t)
    return ml.latest_predictions(ml.logistic(a, COLS, "label"), b, 5)


@query("K09_coef_importance", "feature coefficient:r importance_rank:i", digits=4)
def _(t):
    return ml.coef_importance(ml.logistic(train_test(t)[0], COLS, "label"), t.spark)


@query("K09_ridge_drivers", "target_name feature coefficient:r importance_rank:i test_r2:r test_mae:r", digits=4)
def _(t):
    return ml.ridge_drivers(*train_test(t), COLS)


@query("K10_perm_importance", "feature_group sample_rows:i baseline_brier:r permuted_brier:r importance_delta:r auc_importance:r", digits=4)
def _(t):
    a, b = train_test(t)
    return ml.perm_importance(ml.logistic(a, COLS, "label"), b, {**FAMILIES, "depth": ["drawdown_60d"]})


def halves(t, model=None):
    s = t.staged("scored")
    s = s if model is None else s.where(F.col("model") == model)
    return s.where(F.col("split") <= 3), s.where(F.col("split") > 3)


def per_model(t, calibrated):
    """What ``calibrated(fit, apply)`` returns for every model on its own rows."""
    models = sorted(r.model for r in t.staged("scored").select("model").distinct().collect())
    return reduce(DataFrame.unionByName, [calibrated(*(stage(x) for x in halves(t, m))).withColumn("model", F.lit(m)) for m in models])


# Newton's iteration from the log-odds, unrolled: one slope, and two slopes by Cramer's rule.
CLIPPED_SQL = "pc AS (SELECT *, greatest(1e-6, least(1 - 1e-6, probability)) AS p FROM scored)"


def newton1_sql(keys, source, ridge, steps=30):
    return f"""z AS (SELECT {keys}, ln(p / (1 - p)) AS x, label AS y FROM {source}),
    b AS (
        SELECT 0 AS step, {keys}, ln(avg(y) / (1 - avg(y))) AS b0, CAST(0 AS DOUBLE) AS b1 FROM z GROUP BY ALL
        UNION ALL
        SELECT step + 1, {keys},
            b0 + ((h11 + {ridge}) * g0 - h01 * (g1 - {ridge} * b1)) / (h00 * (h11 + {ridge}) - h01 * h01),
            b1 + (h00 * (g1 - {ridge} * b1) - h01 * g0) / (h00 * (h11 + {ridge}) - h01 * h01)
        FROM (
            SELECT step, {keys}, b0, b1, sum(y - m) AS g0, sum((y - m) * x) AS g1,
                sum(m * (1 - m)) AS h00, sum(m * (1 - m) * x) AS h01, sum(m * (1 - m) * x * x) AS h11
            FROM (SELECT b.*, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM b JOIN z USING ({keys}) WHERE step < {steps})
            GROUP BY step, {keys}, b0, b1)),
    w AS (SELECT * FROM b WHERE step = {steps})"""


def newton2_sql(keys, source, ridge, steps=30):
    return f"""z AS (SELECT {keys}, ln(p) AS x1, -ln(1 - p) AS x2, label AS y FROM {source}),
    b AS (
        SELECT 0 AS step, {keys}, ln(avg(y) / (1 - avg(y))) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM z GROUP BY ALL
        UNION ALL
        SELECT step + 1, {keys},
            b0 + (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det,
            b1 + (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - c * q)) / det,
            b2 + (a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / det
        FROM (
            SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det
            FROM (
                SELECT step, {keys}, b0, b1, b2,
                    sum(y - m) AS p, sum((y - m) * x1) - {ridge} * b1 AS q, sum((y - m) * x2) - {ridge} * b2 AS r,
                    sum(v) AS a, sum(v * x1) AS b, sum(v * x2) AS c,
                    sum(v * x1 * x1) + {ridge} AS d, sum(v * x1 * x2) AS e, sum(v * x2 * x2) + {ridge} AS f
                FROM (
                    SELECT *, m * (1 - m) AS v
                    FROM (SELECT b.*, x1, x2, y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS m FROM b JOIN z USING ({keys}) WHERE step < {steps}))
                GROUP BY step, {keys}, b0, b1, b2))),
    w AS (SELECT * FROM b WHERE step = {steps})"""


@query("L08_calibration_regression", "model split calibration_intercept:r calibration_slope:r", f"""
WITH RECURSIVE {CLIPPED_SQL}, {newton1_sql("model, split", "pc", "1e-6")}
SELECT model, split, b0 AS calibration_intercept, b1 AS calibration_slope
FROM w""", digits=5)
def _(t):
    return cb.calibration_regression(t.staged("scored"), ["model", "split"])


FIT_SQL = f"{CLIPPED_SQL}, fit AS (SELECT * FROM pc WHERE split <= 3)"


@query("O01_platt", "model ticker date:d probability:r calibrated:r", f"""
WITH RECURSIVE {FIT_SQL}, {newton1_sql("model", "fit", "1.0")}
SELECT a.*, 1 / (1 + exp(-greatest(-30, least(30, b0 + b1 * ln(p / (1 - p)))))) AS calibrated
FROM pc a JOIN w USING (model)
WHERE split > 3""")
def _(t):
    return cb.calibrate_logistic(*halves(t), by=["model"])


@query("O01_beta", "model ticker date:d probability:r calibrated:r", f"""
WITH RECURSIVE {FIT_SQL}, {newton2_sql("model", "fit", "1.0")}
SELECT a.*, 1 / (1 + exp(-greatest(-30, least(30, b0 + b1 * ln(p) - b2 * ln(1 - p))))) AS calibrated
FROM pc a JOIN w USING (model)
WHERE split > 3""")
def _(t):
    return cb.calibrate_logistic(*halves(t), form="beta", by=["model"])


# The largest of the smallest means: max over starts of min over ends of the mean of what lies between.
@query("O02_isotonic", "model ticker date:d probability:r calibrated:r", """
WITH x AS (
    SELECT model, probability AS p, sum(label)::DOUBLE AS s, count(*)::DOUBLE AS w
    FROM scored
    WHERE split <= 3
    GROUP BY 1, 2),
c AS (
    SELECT model, p, row_number() OVER o AS i, sum(s) OVER o AS cs, sum(w) OVER o AS cw, s, w
    FROM x WINDOW o AS (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING)),
m AS (
    SELECT j.model, k.i, min((k.cs - j.cs + j.s) / (k.cw - j.cw + j.w)) OVER (PARTITION BY j.model, j.i ORDER BY k.i DESC) AS low
    FROM c j JOIN c k ON j.model = k.model AND j.i <= k.i),
v AS (SELECT c.model, c.p, max(low) AS v FROM m JOIN c USING (model, i) GROUP BY 1, 2),
a AS (
    SELECT q.*, v.p AS p0, v.v AS v0
    FROM (SELECT * FROM scored WHERE split > 3) q ASOF LEFT JOIN v ON q.model = v.model AND q.probability >= v.p),
b AS (
    SELECT a.*, v.p AS p1, v.v AS v1
    FROM a ASOF LEFT JOIN v ON a.model = v.model AND a.probability <= v.p)
SELECT model, ticker, date, probability, greatest(1e-6, least(1 - 1e-6,
    CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (probability - p0) / (p1 - p0) END)) AS calibrated
FROM b""", digits=4)
def _(t):
    return per_model(t, cb.calibrate_isotonic)


GRID = [0.1 + 0.495 * k for k in range(21)]


@query("O03_temperature_grid", "model param:r log_loss:r", f"""
WITH s AS (SELECT model, label, greatest(1e-6, least(1 - 1e-6, probability)) AS p FROM scored WHERE split <= 3),
g AS (SELECT unnest({GRID}::DOUBLE[]) AS param),
q AS (
    SELECT model, param, label,
        greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-greatest(-30, least(30, ln(p / (1 - p)) / param)))))) AS q
    FROM s, g)
SELECT model, param, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss
FROM q
GROUP BY 1, 2""")
def _(t):
    return cb.loss_grid(halves(t)[0], "temperature", GRID, by=["model"])


@query("O03_shrinkage_grid", "model param:r log_loss:r", """
WITH s AS (
    SELECT model, label, probability AS p, avg(label) OVER (PARTITION BY model) AS prior
    FROM scored
    WHERE split <= 3),
g AS (SELECT k / 20.0 AS param FROM (SELECT unnest(range(0, 21)) AS k)),
q AS (
    SELECT model, param, label, greatest(1e-6, least(1 - 1e-6, param * p + (1 - param) * prior)) AS q
    FROM s, g)
SELECT model, param, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss
FROM q
GROUP BY 1, 2""")
def _(t):
    return cb.loss_grid(halves(t)[0], "shrinkage", [k / 20.0 for k in range(21)], by=["model"])


@query("O03_calibrate_scalar", "model ticker date:d calibrated:r param:r", digits=4)
def _(t):
    return per_model(t, lambda a, b: cb.calibrate_scalar(a, b, "temperature"))


@query("O04_compare", "model method n_rows:i brier:r log_loss:r", digits=4)
def _(t):
    return per_model(t, cb.compare)


@query("E31_features_incremental", "ticker date:d ret_60d:r vol_60d:r max_dd_60d:r trend_r2_60d:r", "SELECT * FROM feats WHERE date > DATE '2001-01-01'", digits=4)
def _(t):
    # what arrives holds new bars, bars stored before, and late ones for dates never stored
    p = t.prices()
    cut = F.lit("2001-01-01").cast("date")
    late = p.where(F.col("date") < F.lit("1999-01-01").cast("date")).withColumn("date", F.date_sub("date", 1))
    arrived = p.where(F.col("date") > F.date_sub(cut, 200)).unionByName(late)
    return inc.features_incremental(p.where(F.col("date") <= cut), arrived)


@query("S01_incremental_stream", "ticker date:d ret_20d:r vol_20d:r", "SELECT ticker, date, ret_20d, vol_20d FROM feats", digits=4)
def _(t):
    return inc.replay(t.spark, t.prices())

"""SQL twins of the domain tables."""

from __future__ import annotations

from tessella.plans.ctes import cte, roll
from tessella.operators.screens import LAST_VALID, WATCH_WEIGHTS
from tessella.sources.domain import HOLDOUT

W = "OVER (PARTITION BY ticker ORDER BY date)"


def code(c: str) -> str:
    return f"'S' || lpad(CAST({c} AS VARCHAR), 6, '0')"


cte("raw_bars", f"""
SELECT {code('l_suppkey')} AS ticker, CAST(l_shipdate AS DATE) AS date,
       l_extendedprice / nullif(l_quantity, 0) AS close_price, l_quantity AS volume,
       l_linenumber AS transactions, l_orderkey AS seq, l_returnflag AS returnflag, l_extendedprice AS amount
FROM lineitem""")
cte("prices", "SELECT ticker, date, sum(amount) / sum(volume) AS close_price, sum(volume) AS volume FROM raw_bars GROUP BY ticker, date")
cte("prices_alt", """SELECT ticker, date, sum(amount) / sum(volume) AS close_price, sum(volume) AS volume
FROM raw_bars WHERE returnflag <> 'R' GROUP BY ticker, date""")
cte("cust_prices", """SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS ticker, CAST(o_orderdate AS DATE) AS date,
       avg(o_totalprice) AS close_price, CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2""")
cte("sectors", f"""
SELECT {code('s_suppkey')} AS ticker, r_name AS sector, DATE '1995-01-01' AS valid_from, DATE '1998-07-01' AS valid_to
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT {code('s_suppkey')}, 'GROUP' || CAST(s_nationkey % 5 AS VARCHAR), DATE '1998-07-01', NULL
FROM supplier WHERE NOT s_acctbal < 0""")
cte("symbols", f"""
SELECT {code('s_suppkey')} AS ticker,
       ' s' || CAST(s_suppkey AS VARCHAR) || CASE s_nationkey % 5 WHEN 0 THEN '.TO' WHEN 1 THEN '-A' WHEN 2 THEN '-WS' WHEN 3 THEN '.PRB' ELSE '' END || ' ' AS symbol,
       s_name AS name, CASE WHEN s_nationkey % 4 <> 0 THEN 'CS' ELSE 'ETF' END AS security_type,
       CASE WHEN s_acctbal > 5000 THEN 'FIGI' || CAST(s_suppkey AS VARCHAR) END AS share_class_figi,
       CASE WHEN s_acctbal > 2500 THEN 'COMP' || CAST(s_suppkey AS VARCHAR) END AS composite_figi,
       CASE WHEN s_acctbal > 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS cik,
       s_nationkey AS nation, s_acctbal AS acctbal
FROM supplier""")

cte("rets", f"""
SELECT *, row_number() {W} AS i,
       close_price / nullif(lag(close_price, 1) {W}, 0) - 1 AS ret_1d,
       close_price / nullif(lag(close_price, 2) {W}, 0) - 1 AS ret_2d,
       close_price / nullif(lag(close_price, 3) {W}, 0) - 1 AS ret_3d,
       close_price / nullif(lag(close_price, 5) {W}, 0) - 1 AS ret_5d,
       close_price / nullif(lag(close_price, 10) {W}, 0) - 1 AS ret_10d,
       close_price / nullif(lag(close_price, 20) {W}, 0) - 1 AS ret_20d,
       close_price / nullif(lag(close_price, 60) {W}, 0) - 1 AS ret_60d,
       close_price * volume AS dv
FROM prices""")
cte("rolled", f"""
SELECT *, lag(ret_1d) {W} AS prev_ret,
       {roll('stddev_samp(ret_1d)', 'ret_1d', 5)} AS volatility_5d,
       {roll('stddev_samp(ret_1d)', 'ret_1d', 10)} AS volatility_10d,
       {roll('stddev_samp(ret_1d)', 'ret_1d', 20)} AS vol_20d,
       {roll('stddev_samp(ret_1d)', 'ret_1d', 60)} AS vol_60d,
       {roll('avg(close_price)', 'close_price', 5)} AS ma_5d,
       {roll('avg(close_price)', 'close_price', 20)} AS ma_20d,
       {roll('stddev_samp(close_price)', 'close_price', 20)} AS sd20,
       {roll('max(close_price)', 'close_price', 60)} AS high60,
       {roll('min(close_price)', 'close_price', 60)} AS low60,
       {roll('avg(dv)', 'dv', 20)} AS dollar_vol_20d,
       {roll('regr_slope(close_price, i)', 'close_price', 60)} AS raw_slope,
       {roll('corr(close_price, i)', 'close_price', 60)} AS raw_corr,
       {roll('list(close_price)', 'close_price', 60)} AS win60
FROM rets""")
cte("feats", """
SELECT ticker, date, close_price, volume, ret_1d AS pct_1d, ret_2d AS pct_2d, ret_3d AS pct_3d, ret_5d AS pct_5d,
       ret_10d, ret_20d, ret_60d, volatility_5d, volatility_10d, vol_20d, vol_60d, ma_5d, ma_20d,
       CASE WHEN ma_5d > ma_20d THEN 1 ELSE 0 END AS ma_crossover, ma_5d / nullif(ma_20d, 0) - 1 AS ma_ratio,
       (close_price - ma_20d) / nullif(sd20, 0) AS z_ma20, 4 * sd20 / nullif(ma_20d, 0) AS bb_width_20d,
       ret_60d / nullif(vol_60d, 0) AS riskadj_mom_60d,
       CASE WHEN high60 > low60 THEN raw_slope END AS trend_slope_60d,
       CASE WHEN high60 > low60 THEN raw_corr * raw_corr END AS trend_r2_60d, dollar_vol_20d,
       CASE WHEN count(prev_ret) OVER w4 = 4 AND max(ret_1d) OVER w4 > min(ret_1d) OVER w4 AND max(prev_ret) OVER w4 > min(prev_ret) OVER w4
            THEN corr(ret_1d, prev_ret) OVER w4 END AS ac1_5d,
       list_min(list_transform(range(1, len(win60) + 1), lambda k: win60[k] / list_max(win60[1:k]) - 1)) AS max_dd_60d,
       CASE WHEN win60 IS NOT NULL THEN 60 - list_position(win60, list_max(win60)) END AS time_since_max_60d
FROM rolled WINDOW w4 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
cte("rfeats", f"""
SELECT ticker, date, close_price, volume, ret_1d, ret_5d, ret_20d, ret_60d, vol_20d, vol_60d,
       close_price / nullif(high60, 0) - 1 AS drawdown_60d, ln(1 + dollar_vol_20d) AS dollar_vol_20d_log,
       lead(date, 5) {W} AS evaluation_date, lead(close_price, 5) {W} AS future_close,
       lead(close_price, 5) {W} / nullif(close_price, 0) - 1 AS future_return
FROM rolled""")
cte("panel", f"""
SELECT * FROM rfeats WHERE ret_60d IS NOT NULL AND vol_20d IS NOT NULL AND drawdown_60d IS NOT NULL AND dollar_vol_20d_log IS NOT NULL
  AND future_return IS NOT NULL AND date < DATE '{HOLDOUT}' AND evaluation_date < DATE '{HOLDOUT}'""")
cte("panel_sector", """
SELECT p.*, (SELECT CASE WHEN s.valid_to IS NULL OR p.date < s.valid_to THEN s.sector END FROM sectors s
             WHERE s.ticker = p.ticker AND s.valid_from <= p.date ORDER BY s.valid_from DESC LIMIT 1) AS sector
FROM panel p""")
cte("loo", """
SELECT *, count(future_return) OVER d AS market_members,
       (sum(future_return) OVER d - future_return) / nullif(count(future_return) OVER d - 1, 0) AS market_return_loo,
       CASE WHEN sector IS NULL THEN 0 ELSE count(future_return) OVER s END AS sector_members,
       CASE WHEN sector IS NOT NULL THEN (sum(future_return) OVER s - future_return) / nullif(count(future_return) OVER s - 1, 0) END AS sector_return_loo
FROM panel_sector WINDOW d AS (PARTITION BY date), s AS (PARTITION BY date, sector)""")
cte("primary_residual", """
SELECT *, future_return - market_return_loo AS market_residual_return, future_return - sector_return_loo AS sector_residual_return,
       CASE WHEN sector_members >= 2 AND sector_return_loo IS NOT NULL THEN 'sector_leave_one_out' ELSE 'market_leave_one_out' END AS primary_benchmark,
       CASE WHEN sector_members >= 2 AND sector_return_loo IS NOT NULL THEN future_return - sector_return_loo ELSE future_return - market_return_loo END AS primary_residual_return
FROM loo""")
cte("labelled", """
SELECT * EXCLUDE (nine), CASE WHEN nine > 0 THEN 1 ELSE 0 END AS primary_residual_positive,
       CASE WHEN primary_residual_rank_pct >= 0.9 THEN 1 ELSE 0 END AS primary_residual_top_decile
FROM (SELECT *, CASE WHEN primary_residual_return IS NOT NULL THEN
        (rank() OVER (PARTITION BY date ORDER BY nine NULLS LAST)
         + (count(*) OVER (PARTITION BY date, nine) - 1) / 2.0) / count(nine) OVER (PARTITION BY date) END AS primary_residual_rank_pct,
        row_number() OVER (PARTITION BY date ORDER BY round(dollar_vol_20d_log, 9) DESC, ticker) AS liquidity_rank
      FROM (SELECT *, round(primary_residual_return, 9) AS nine FROM primary_residual))""")
cte("panel_cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)")
cte("wf_splits", """
SELECT s.split, CASE WHEN i < start - 5 THEN 'train' ELSE 'test' END AS role, date
FROM (SELECT c.*, s.split, n - (6 - s.split) * 120 AS start FROM panel_cal c, (SELECT unnest(range(1, 6)) AS split) s) s
WHERE start >= 0 AND start - 5 >= 200 AND (i < start - 5 OR (i >= start AND i < start + 120))""")
cte("scored", """
SELECT split, p.date, ticker, evaluation_date, ret_5d, ret_20d, vol_20d, drawdown_60d, dollar_vol_20d_log, future_return, m.model,
       1 / (1 + exp(-4 * greatest(-7.5, least(7.5, CASE m.model WHEN 'slow' THEN ret_20d ELSE ret_5d END)))) AS probability,
       CASE WHEN future_return > 0 THEN 1 ELSE 0 END AS label
FROM panel p JOIN wf_splits USING (date), (SELECT unnest(['slow', 'fast']) AS model) m WHERE role = 'test'""")
cte("preds", """
SELECT *, row_number() OVER (PARTITION BY as_of_date, horizon_days, model_name ORDER BY round(probability_up, 9) DESC, ticker) AS model_rank
FROM (SELECT split AS run_id, date AS as_of_date, ticker, model AS model_name, h.horizon_days, future_return, label,
        1 / (1 + exp(-4 * greatest(-7.5, least(7.5, CASE model WHEN 'slow' THEN ret_20d ELSE ret_5d END)) / h.k)) AS probability_up
      FROM scored, (SELECT 5 AS horizon_days, 1.0 AS k UNION ALL SELECT 20, 2.0 UNION ALL SELECT 60, 3.0) h)""")
_LAST = ", ".join(f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in LAST_VALID)
cte("summary", f"""
SELECT *, trend_slope_60d / nullif(vol_60d, 0) AS trend_score, riskadj_mom_60d AS leader_score
FROM (SELECT ticker, min(date) AS "start", max(date) AS "end", count(*) AS n_rows, arg_max(close_price, date) / arg_min(close_price, date) - 1 AS total_return, {_LAST}
      FROM feats GROUP BY ticker) WHERE riskadj_mom_60d IS NOT NULL AND trend_slope_60d IS NOT NULL""")


def bottom_rank(c: str, desc: bool = False) -> str:
    """Percentile rank over all rows, ties averaged, nulls after every value."""
    return (f"((rank() OVER (ORDER BY {c} {'DESC' if desc else 'ASC'} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ())")


_RAW = " + ".join(f"{w} * {bottom_rank(c, c == 'vol_60d')}" for c, w in WATCH_WEIGHTS.items())
cte("watch_all", f"SELECT *, round({_RAW}, 12) AS raw_score FROM summary WHERE trend_score IS NOT NULL AND vol_60d IS NOT NULL AND dollar_vol_20d IS NOT NULL")
cte("watch", """
SELECT *, CASE WHEN confidence >= 80 AND trend_r2_60d >= 0.35 AND vol_60d <= 0.05 THEN '20d' WHEN confidence >= 65 THEN '5d' ELSE 'watch' END AS suggested_horizon,
       CASE WHEN rank <= 10 AND confidence >= 75 THEN 'consider entry' WHEN rank <= 25 THEN 'research' ELSE 'watch' END AS recommendation
FROM (SELECT *, 100 * raw_score AS confidence, row_number() OVER (ORDER BY raw_score DESC, leader_score DESC, dollar_vol_20d DESC, ticker) AS rank FROM watch_all)
WHERE rank <= 50""")
cte("decisions", """
SELECT *, substr(sha256(CAST(source_date AS VARCHAR) || '|' || ticker || '|' || action || '|' || CAST(horizon_days AS VARCHAR)), 1, 24) AS decision_id
FROM (SELECT *, CASE WHEN probability_up >= 0.6 THEN 'paper buy candidate' WHEN probability_up >= 0.5 THEN 'watch' ELSE 'avoid for now' END AS action
      FROM (SELECT ticker, date AS source_date, close_price AS reference_price, close_price * 0.92 AS stop_loss, close_price * 1.16 AS target_price,
              CASE day(date) % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 60 END AS horizon_days, 1 / (1 + exp(-4 * greatest(-7.5, least(7.5, ret_20d)))) AS probability_up
            FROM panel WHERE EXISTS (SELECT 1 FROM raw_bars r WHERE r.returnflag = 'R' AND r.ticker = panel.ticker AND r.date = panel.date)))""")
cte("price_pos", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM prices")
cte("market_days", "SELECT date, row_number() OVER (ORDER BY date) AS m, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM prices)")
cte("decision_paths", """
SELECT d.decision_id, h.h, min(f.date) FILTER (WHERE f.close_price <= d.stop_loss) AS stop_date, min(f.date) FILTER (WHERE f.close_price >= d.target_price) AS target_date,
       max(f.date) FILTER (WHERE f.pos = p.pos + h.h) AS eval_date, max(f.close_price) FILTER (WHERE f.pos = p.pos + h.h) AS eval_price
FROM decisions d JOIN price_pos p ON p.ticker = d.ticker AND p.date = d.source_date, (SELECT unnest([5, 20, 60]) AS h) h
LEFT JOIN price_pos f ON f.ticker = d.ticker AND f.pos > p.pos AND f.pos <= p.pos + h.h
GROUP BY 1, 2""")
cte("outcomes", """
SELECT *, substr(sha256(decision_id || '|' || CAST(evaluation_horizon_days AS VARCHAR) || '|' || status || '|' || CAST(evaluation_date AS VARCHAR)), 1, 24) AS outcome_id FROM (
SELECT d.decision_id, d.ticker, d.source_date, d.action, d.horizon_days AS decision_horizon_days, x.h AS evaluation_horizon_days,
       CASE WHEN eval_date IS NULL THEN md2.date ELSE eval_date END AS evaluation_date, eval_price AS evaluation_price, eval_price / d.reference_price - 1 AS return_pct,
       CASE WHEN eval_date IS NULL THEN 'unavailable' WHEN stop_date IS NOT NULL AND (target_date IS NULL OR stop_date <= target_date) THEN 'stopped'
            WHEN target_date IS NOT NULL THEN 'targeted' ELSE 'none' END AS barrier_result,
       CASE WHEN eval_date IS NULL THEN NULL ELSE least(stop_date, target_date) END AS barrier_date,
       CASE WHEN eval_date IS NULL THEN 'unavailable' WHEN stop_date IS NOT NULL AND (target_date IS NULL OR stop_date <= target_date) THEN 'stopped'
            WHEN target_date IS NOT NULL THEN 'targeted' ELSE 'matured' END AS status
FROM decisions d JOIN decision_paths x USING (decision_id) JOIN market_days md ON md.date = d.source_date JOIN market_days md2 ON md2.m = md.m + x.h)""")
_K = "PARTITION BY run_id, horizon_days, model_name"
cte("split_facts", """
SELECT split AS run_id, min(CASE WHEN role = 'train' THEN date END) AS training_start, max(CASE WHEN role = 'train' THEN date END) AS training_end,
       min(CASE WHEN role = 'test' THEN date END) AS test_start, max(CASE WHEN role = 'test' THEN date END) AS test_end,
       avg(CASE WHEN role = 'train' THEN CASE WHEN future_return > 0 THEN 1.0 ELSE 0.0 END END) AS train_positive_rate, count(*) FILTER (WHERE role = 'train') AS training_rows
FROM wf_splits JOIN panel USING (date) GROUP BY split""")
cte("eval_base", f"""
SELECT run_id, horizon_days, model_name, count(*) AS test_rows, avg(label) AS positive_rate, stddev_pop(p) AS probability_std, avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
       avg((p - label) * (p - label)) AS brier, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss, max(train_positive_rate) AS base_rate,
       avg((train_positive_rate - label) * (train_positive_rate - label)) AS baseline_brier, avg(-(label * ln(train_positive_rate) + (1 - label) * ln(1 - train_positive_rate))) AS baseline_log_loss,
       (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)), 0) AS roc_auc,
       avg(future_return) AS benchmark_average_return, count(*) FILTER (WHERE p >= 0.6) AS selected_rows, avg(future_return) FILTER (WHERE p >= 0.6) AS selected_average_return,
       avg(CASE WHEN future_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE p >= 0.6) AS selected_win_rate
FROM (SELECT *, probability_up AS p, greatest(1e-6, least(1 - 1e-6, probability_up)) AS q, rank() OVER ({_K} ORDER BY probability_up) + (count(*) OVER ({_K}, probability_up) - 1) / 2.0 AS rk
      FROM preds JOIN split_facts USING (run_id)) GROUP BY 1, 2, 3""")
cte("eval_scored", """
SELECT *, coalesce(roc_auc - 0.5, 0) + coalesce(greatest(-0.05, least(0.05, accuracy_lift)) * 0.75, 0) + coalesce(CASE WHEN selected_return_edge IS NOT NULL THEN greatest(-0.05, least(0.05, selected_return_edge)) END * 1.5, 0)
        + coalesce(CASE WHEN selected_win_lift IS NOT NULL THEN greatest(-0.2, least(0.2, selected_win_lift)) END * 0.25, 0) + coalesce(greatest(-0.2, least(0.2, brier_skill)) * 0.25, 0) AS holdout_score
FROM (SELECT *, greatest(positive_rate, 1 - positive_rate) AS majority_accuracy, accuracy - greatest(positive_rate, 1 - positive_rate) AS accuracy_lift, 1 - brier / nullif(baseline_brier, 0) AS brier_skill,
        1 - log_loss / nullif(baseline_log_loss, 0) AS log_loss_skill, selected_average_return - benchmark_average_return AS selected_return_edge, selected_win_rate - positive_rate AS selected_win_lift FROM eval_base)""")
cte("evals", """
SELECT e.*, f.* EXCLUDE (run_id), w.* EXCLUDE (horizon_days, model_name), 'ok' AS fit_status, 5 AS embargo_dates, b.champion_score,
       CASE WHEN row_number() OVER (PARTITION BY e.run_id, e.horizon_days ORDER BY b.champion_score DESC, e.model_name) = 1 THEN '1' ELSE '0' END AS is_champion
FROM eval_scored e JOIN split_facts f USING (run_id) JOIN (
  SELECT horizon_days, model_name, count(*) AS walk_forward_splits, count(*) FILTER (WHERE holdout_score > 0) AS walk_forward_positive_splits, avg(holdout_score) AS walk_forward_avg_score,
         stddev_pop(holdout_score) AS walk_forward_score_std, avg(selected_return_edge) AS walk_forward_avg_return_edge, avg(brier_skill) AS walk_forward_avg_brier_skill, avg(roc_auc) AS walk_forward_avg_auc
  FROM eval_scored GROUP BY 1, 2) w ON w.horizon_days = e.horizon_days AND w.model_name = e.model_name,
  LATERAL (SELECT 0.55 * holdout_score + 0.45 * walk_forward_avg_score + 0.02 * (CAST(walk_forward_positive_splits AS DOUBLE) / walk_forward_splits - 0.5) - 0.10 * walk_forward_score_std AS champion_score) b""")
cte("train_tail", """
SELECT *
FROM panel
WHERE date < DATE '2000-01-01' AND date >= (
    SELECT min(date)
    FROM (SELECT DISTINCT date FROM panel WHERE date < DATE '2000-01-01' ORDER BY date DESC LIMIT 1600))""")
cte("knn_edges", """
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, neighbor) AS place
FROM (
    SELECT a.ticker, b.ticker AS neighbor, CASE WHEN count(*) >= 40 THEN corr(a.ret_1d, b.ret_1d) END AS similarity
    FROM train_tail a JOIN train_tail b ON a.date = b.date AND a.ticker <> b.ticker
    GROUP BY 1, 2)
WHERE similarity > 0
QUALIFY place <= 8""")
cte("gcols", """
SELECT p.ticker, p.date, round(coalesce(s, 0), 9) AS graph_similarity_mean, round(coalesce(p.ret_20d * r, 0), 9) AS neighbor_confirmation,
    CAST(coalesce(d, 0) AS DOUBLE) AS graph_degree
FROM panel p LEFT JOIN (
    SELECT e.ticker, q.date, avg(ret_20d) AS r, avg(similarity) AS s, count(*) AS d
    FROM knn_edges e JOIN panel q ON q.ticker = e.neighbor
    GROUP BY 1, 2) n ON n.ticker = p.ticker AND n.date = p.date""")
cte("gscored", """
SELECT model, split, s.date, s.ticker, probability, label, future_return AS forward_return, ret_20d, dollar_vol_20d_log,
    graph_similarity_mean, neighbor_confirmation, graph_degree, CASE WHEN nation % 5 = 0 THEN -1 ELSE nation % 5 END AS cluster
FROM scored s JOIN symbols y ON y.ticker = s.ticker JOIN gcols g ON g.ticker = s.ticker AND g.date = s.date""")
cte("ret1d", """
SELECT ticker, date, r - (sum(r) OVER (PARTITION BY date) - r) / nullif(count(r) OVER (PARTITION BY date) - 1, 0) AS residual_return_1d FROM (
  SELECT p.ticker, p.date, CASE WHEN o.next_date = o.market_next THEN o.r END AS r FROM panel p LEFT JOIN (
    SELECT q.*, m2.date AS market_next FROM (SELECT ticker, date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS next_date, lead(close_price) OVER (PARTITION BY ticker ORDER BY date) / close_price - 1 AS r FROM prices) q
    JOIN market_days m ON m.date = q.date JOIN market_days m2 ON m2.m = m.m + 1) o ON o.ticker = p.ticker AND o.date = p.date)""")

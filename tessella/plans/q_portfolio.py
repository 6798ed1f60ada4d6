"""Portfolio analytics and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import inference as nf
from tessella.operators import portfolio as pf
from tessella.operators import rules as ru
from tessella.plans.registry import draw_sql, query
from tessella.session import stage

BY = ["split", "model"]


def daily_sql(k, bps, base, every=1, src="scored", by="split, model", score="probability", ret="future_return"):
    """CTEs ``picks`` and ``daily``."""
    size = {"min": "least(n, np)", "current": "n", "fixed": str(k)}[base]
    return f"""di AS (SELECT {by}, date, row_number() OVER (PARTITION BY {by} ORDER BY date) - 1 AS d FROM (SELECT DISTINCT {by}, date FROM {src})),
       s0 AS (SELECT s.*, {score} AS sc, {ret} AS rt FROM {src} s JOIN di USING ({by}, date) WHERE d % {every} = 0), uni AS (SELECT {by}, date, avg(rt) AS universe_return, count(*) AS observations FROM s0 GROUP BY ALL),
       oi AS (SELECT {by}, date, row_number() OVER (PARTITION BY {by} ORDER BY date) AS i FROM uni), picks AS (SELECT * FROM (SELECT s0.*, i, row_number() OVER (PARTITION BY {by}, date ORDER BY sc DESC, ticker) AS k FROM s0 JOIN oi USING ({by}, date)) WHERE k <= {k}),
       g AS (SELECT {by}, date, i, avg(rt) AS gross_return, count(*) AS n FROM picks GROUP BY ALL), c AS (SELECT {', '.join('a.' + x.strip() for x in by.split(','))}, a.i, count(*) AS c FROM picks a JOIN picks b ON {' AND '.join(f'a.{x.strip()} = b.{x.strip()}' for x in by.split(','))} AND b.i = a.i - 1 AND b.ticker = a.ticker GROUP BY ALL),
       h AS (SELECT *, lag(n) OVER (PARTITION BY {by} ORDER BY i) AS np FROM g), daily0 AS (SELECT h.*, universe_return, observations, CASE WHEN np IS NULL THEN 1 ELSE 1 - coalesce(c, 0) / greatest(1, {size})::DOUBLE END AS turnover FROM h LEFT JOIN c USING ({by}, i) JOIN uni USING ({by}, date)),
       daily AS (SELECT *, turnover * {bps / 10000.0!r} AS cost, gross_return - turnover * {bps / 10000.0!r} AS net_return, gross_return - universe_return AS excess_return FROM daily0)"""


@query("M01_topk_daily", "split:i model date:d selected:i gross_return:r universe_return:r excess_return:r turnover:r cost:r net_return:r win:i",
       f"WITH {daily_sql(5, 10, 'min')} SELECT *, n AS selected, CASE WHEN net_return > 0 THEN 1 ELSE 0 END AS win FROM daily")
def _(t):
    return pf.topk_daily(t.staged("scored"), BY, 5, 10, "probability", "future_return")


@query("M02_cohorts", "split:i model date:d holdings:i net_return:r benchmark_return:r excess_return:r",
       f"WITH {daily_sql(5, 10, 'min', 5)} SELECT *, n AS holdings, gross_return - 0.002 AS net_return, universe_return - 0.002 AS benchmark_return FROM (SELECT * EXCLUDE (net_return) FROM daily)")
def _(t):
    return pf.cohorts(t.staged("scored"), BY, 5, 5, 10, "probability", "future_return")


@query("M02_rebalance_turnover", "split:i model date:d gross_return:r turnover:r net_return:r excess_return:r",
       f"WITH {daily_sql(8, 10, 'fixed', 5)} SELECT * FROM daily")
def _(t):
    return pf.topk_daily(t.staged("scored"), BY, 8, 10, "probability", "future_return", "fixed", 5)


Z = "CASE WHEN stddev_pop({c}) OVER (PARTITION BY {by}) > 1e-12 THEN ({c} - avg({c}) OVER (PARTITION BY {by})) / stddev_pop({c}) OVER (PARTITION BY {by}) ELSE 0 END"


def strategies_sql(src, by, k):
    z1, z2 = Z.format(c="graph_similarity_mean", by=by), Z.format(c="neighbor_confirmation", by=by)
    return f"""e0 AS (SELECT *, {z1} AS z1, {z2} AS z2, CASE WHEN neighbor_confirmation >= 0 AND graph_similarity_mean >= median(graph_similarity_mean) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS ok,
       CASE WHEN cluster >= 0 AND row_number() OVER (PARTITION BY {by}, cluster ORDER BY probability DESC, ticker) > 2 THEN 1 ELSE 0 END AS over FROM {src}),
       e1 AS (SELECT *, sum(ok) OVER (PARTITION BY {by}) AS ne FROM e0),
       st AS (SELECT 'plain_probability' AS strategy, *, probability AS sc, 0 AS pri FROM e1 UNION ALL SELECT 'similarity_weighted', *, probability + 0.04 * z1 + 0.04 * z2, 0 FROM e1
       UNION ALL SELECT 'consensus_gate', *, probability, 0 FROM e1 WHERE ok = 1 OR ne < {k} UNION ALL SELECT 'cluster_diversified', *, probability, over FROM e1),
       sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, {by} ORDER BY pri, sc DESC, ticker) AS k FROM st) WHERE k <= {k})"""


@query("M03_select_strategy", "model strategy date:d ticker", f"WITH {strategies_sql('gscored', 'model, date', 5)} SELECT * FROM sel")
def _(t):
    out = None
    for name in pf.STRATEGIES:
        p = pf.select_strategy(t.staged("gscored"), name, 5, ["model", "date"]).select(F.lit(name).alias("strategy"), "model", "date", "ticker")
        out = p if out is None else out.unionByName(p)
    return out


STRAT_DAILY_SQL = f"""{strategies_sql('gscored', 'model, date', 5)},
u AS (SELECT model, date, avg(forward_return) AS universe_return FROM gscored GROUP BY 1, 2),
sg AS (
    SELECT strategy, model, date, avg(forward_return) AS gross_return, count(*) AS n,
        row_number() OVER (PARTITION BY strategy, model ORDER BY date) AS i
    FROM sel
    GROUP BY 1, 2, 3),
si AS (SELECT strategy, model, ticker, i FROM sel JOIN sg USING (strategy, model, date)),
cc AS (
    SELECT a.strategy, a.model, a.i, count(*) AS c
    FROM si a JOIN si b ON a.strategy = b.strategy AND a.model = b.model AND b.i = a.i - 1 AND a.ticker = b.ticker
    GROUP BY 1, 2, 3),
sd AS (
    SELECT sg.*, universe_return, CASE WHEN sg.i = 1 THEN 1 ELSE 1 - coalesce(c, 0) / n::DOUBLE END AS turnover
    FROM sg LEFT JOIN cc USING (strategy, model, i) JOIN u USING (model, date))"""


@query("M03_strategy_daily", "model strategy date:d gross_return:r universe_return:r turnover:r", f"WITH {STRAT_DAILY_SQL} SELECT * FROM sd")
def _(t):
    return pf.strategy_daily(t.staged("gscored"), 5, by=["model"])


@query("M04_cost_grid", "model strategy cost_bps:r dates:i mean_gross_return:r mean_net_return:r mean_excess_return:r win_rate:r mean_turnover:r worst_net_return:r", f"""
WITH {STRAT_DAILY_SQL},
c2 AS (SELECT unnest([0.0, 5.0, 10.0, 25.0, 50.0]) AS cost_bps),
nt AS (SELECT *, gross_return - turnover * cost_bps / 10000 AS net_return FROM sd, c2)
SELECT model, strategy, cost_bps, count(*) AS dates, avg(gross_return) AS mean_gross_return, avg(net_return) AS mean_net_return,
    avg(net_return - universe_return) AS mean_excess_return,
    avg(CASE WHEN net_return - universe_return > 1e-12 THEN 1.0 ELSE 0.0 END) AS win_rate,
    avg(turnover) AS mean_turnover, min(net_return) AS worst_net_return
FROM nt
GROUP BY 1, 2, 3""")
def _(t):
    return pf.cost_grid(pf.strategy_daily(t.staged("gscored"), 5, by=["model"]), (0, 5, 10, 25, 50), ["model", "strategy"])


SEG_SQL = """sm AS (
    SELECT *, median(dollar_vol_20d_log) OVER (PARTITION BY model, date) AS ml, median(graph_degree) OVER (PARTITION BY model, date) AS mg
    FROM gscored),
seg AS (
    SELECT 'all' AS segment, * FROM sm
    UNION ALL SELECT CASE WHEN dollar_vol_20d_log >= ml THEN 'liquidity_high' ELSE 'liquidity_low' END, * FROM sm
    UNION ALL SELECT CASE WHEN graph_degree >= mg THEN 'graph_degree_high' ELSE 'graph_degree_low' END, * FROM sm
    UNION ALL SELECT CASE WHEN ret_20d >= 0 THEN 'momentum_positive' ELSE 'momentum_negative' END, * FROM sm)"""


@query("M05_scenario_battery", "model segment strategy date:d portfolio_size:i cost_bps:r gross_return:r net_return:r universe_return:r excess_return:r turnover:r", f"""
WITH {SEG_SQL}, {strategies_sql('seg', 'model, segment, date', 4)},
u AS (SELECT model, segment, date, avg(forward_return) AS universe_return FROM seg GROUP BY 1, 2, 3),
p3 AS (SELECT * FROM sel WHERE strategy <> 'cluster_diversified'),
sg AS (
    SELECT strategy, model, segment, date, avg(forward_return) AS gross_return, count(*) AS n,
        row_number() OVER (PARTITION BY strategy, model, segment ORDER BY date) AS i
    FROM p3
    GROUP BY 1, 2, 3, 4),
si AS (SELECT strategy, model, segment, ticker, i FROM p3 JOIN sg USING (strategy, model, segment, date)),
cc AS (
    SELECT strategy, model, segment, a.i, count(*) AS c
    FROM si a JOIN (SELECT * REPLACE (i + 1 AS i) FROM si) b USING (strategy, model, segment, i, ticker)
    GROUP BY 1, 2, 3, 4),
sd AS (
    SELECT sg.*, universe_return, CASE WHEN sg.i = 1 THEN 1 ELSE 1 - coalesce(c, 0) / n::DOUBLE END AS turnover
    FROM sg LEFT JOIN cc USING (strategy, model, segment, i) JOIN u USING (model, segment, date)),
c2 AS (SELECT unnest([0.0, 10.0]) AS cost_bps)
SELECT *, 4 AS portfolio_size, gross_return - turnover * cost_bps / 10000 AS net_return,
    gross_return - turnover * cost_bps / 10000 - universe_return AS excess_return
FROM sd, c2""")
def _(t):
    return pf.scenario_battery(t.staged("gscored"), [4], [1], [0.0, 10.0], by=["model"])


@query("M05_scenario_carried", "model segment strategy portfolio_size:i rebalance_days:i cost_bps:r dates:i mean_net_return:r mean_excess_return:r win_rate:r mean_turnover:r worst_net_return:r")
def _(t):
    return pf.scenario_summary(pf.scenario_battery(t.staged("gscored"), [4], [5], [0.0, 10.0], by=["model"]), ["model"])


SLEEVE_SQL = """sk AS (SELECT * FROM (SELECT split, model, date, ticker, row_number() OVER (PARTITION BY split, model, date ORDER BY probability DESC, ticker) AS k FROM scored) WHERE k <= 5),
       sig AS (SELECT *, 1.0 / (5 * count(*) OVER (PARTITION BY split, model, date)) AS w FROM sk), span AS (SELECT split, model, min(date) AS lo, max(date) AS last FROM sig GROUP BY 1, 2),
       cal AS (SELECT split, model, last, date, row_number() OVER (PARTITION BY split, model ORDER BY date) - 1 AS i FROM span JOIN (SELECT DISTINCT date FROM ret1d) ON date >= lo),
       opened AS (SELECT sig.*, cal.i FROM sig JOIN cal USING (split, model, date)), offs AS (SELECT unnest(range(0, 5)) AS o),
       live AS (SELECT l.*, cal.date FROM (SELECT split, model, i + o AS i, ticker, sum(w) AS w FROM opened, offs GROUP BY 1, 2, 3, 4) l JOIN cal USING (split, model, i)),
       act AS (SELECT split, model, i + o AS i, count(*) AS a FROM (SELECT DISTINCT split, model, i FROM opened), offs GROUP BY 1, 2, 3),
       d0 AS (SELECT cal.*, coalesce(a, 0) AS active_sleeves FROM cal LEFT JOIN act USING (split, model, i)), fin AS (SELECT split, model, min(CASE WHEN date > last AND active_sleeves = 0 THEN i END) AS e FROM d0 GROUP BY 1, 2),
       d1 AS (SELECT d0.* FROM d0 JOIN fin USING (split, model) WHERE e IS NULL OR i <= e),
       mv AS (SELECT split, model, i, sum(abs(x)) AS l1 FROM (SELECT split, model, i, ticker, sum(w) AS x FROM (SELECT split, model, i, ticker, w FROM live UNION ALL SELECT split, model, i + 1, ticker, -w FROM live) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
       v AS (SELECT split, model, i, sum(w) AS invested_weight, count(*) AS positions, sum(w * residual_return_1d) AS gross, sum(CASE WHEN residual_return_1d IS NULL THEN w END) AS missing FROM live LEFT JOIN ret1d USING (date, ticker) GROUP BY 1, 2, 3),
       d2 AS (SELECT d1.*, coalesce(invested_weight, 0) AS invested_weight, coalesce(positions, 0) AS positions, coalesce(gross, 0) AS gross_residual_return, coalesce(missing, 0) AS missing_return_weight, coalesce(l1, 0) AS l1, greatest(0, 1 - coalesce(invested_weight, 0)) AS cash,
       CASE WHEN EXISTS (SELECT 1 FROM opened o WHERE o.split = d1.split AND o.model = d1.model AND o.date = d1.date) THEN 1 ELSE 0 END AS new_signal FROM d1 LEFT JOIN v USING (split, model, i) LEFT JOIN mv USING (split, model, i)),
       sleeves AS (SELECT *, 0.5 * (l1 + abs(cash - coalesce(lag(cash) OVER (PARTITION BY split, model ORDER BY i), 1.0))) AS turnover FROM d2),
       sleeve AS (SELECT *, turnover * 0.001 AS cost, gross_residual_return - turnover * 0.001 AS net_residual_return FROM sleeves)"""


def sleeves(t):
    return pf.sleeve_replay(t.staged("scored"), t.staged("ret1d"), BY, 5, 5, 10, "probability")


@query("M06_sleeve_replay", "split:i model date:d new_signal:i active_sleeves:i invested_weight:r positions:i turnover:r gross_residual_return:r cost:r net_residual_return:r missing_return_weight:r", f"WITH {SLEEVE_SQL} SELECT * FROM sleeve")
def _(t):
    return sleeves(t)


@query("M06_one_day_residuals", "ticker date:d residual_return_1d:r", "SELECT * FROM ret1d")
def _(t):
    return t.staged("ret1d")


PATH_SQL = """SELECT {by}, count(*) AS days, avg(r) AS mean_return, arg_max(w, date) - 1 AS cumulative_return, min(w / m - 1) AS maximum_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_day_rate, min(r) AS worst_day FROM (
       SELECT *, max(w) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, product(1 + r) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM ({src}))) GROUP BY ALL"""


@query("M07_path_metrics", "split:i model days:i mean_return:r cumulative_return:r maximum_drawdown:r positive_day_rate:r worst_day:r",
       f"WITH {SLEEVE_SQL} " + PATH_SQL.format(by="split, model", src="SELECT split, model, date, net_residual_return AS r FROM sleeve"))
def _(t):
    return pf.path_metrics(sleeves(t), BY, "net_residual_return")


@query("M08_cohort_summary", "split:i model cohorts:i holdings_evaluated:i mean_net_return:r median_net_return:r win_rate:r mean_excess_vs_universe:r worst_cohort_return:r average_sleeve_compound_return:r worst_sleeve_max_drawdown:r",
       f"""WITH {daily_sql(5, 10, 'min', 2)}, co AS (SELECT split, model, date, n, gross_return - 0.002 AS r, excess_return AS x, (row_number() OVER (PARTITION BY split, model ORDER BY date) - 1) % 3 AS o FROM daily), w1 AS (SELECT *, product(1 + r) OVER (PARTITION BY split, model, o ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM co),
       w2 AS (SELECT *, w / max(w) OVER (PARTITION BY split, model, o ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM w1), ps AS (SELECT split, model, o, arg_max(w, date) - 1 AS cum, min(dd) AS dd FROM w2 GROUP BY 1, 2, 3)
       SELECT * FROM (SELECT split, model, count(*) AS cohorts, sum(n) AS holdings_evaluated, avg(r) AS mean_net_return, median(r) AS median_net_return, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(x) AS mean_excess_vs_universe, min(r) AS worst_cohort_return FROM co GROUP BY 1, 2)
       JOIN (SELECT split, model, avg(cum) AS average_sleeve_compound_return, min(dd) AS worst_sleeve_max_drawdown FROM ps GROUP BY 1, 2) USING (split, model)""", digits=5)
def _(t):
    return pf.cohort_summary(pf.cohorts(t.staged("scored"), BY, 5, 2, 10, "probability", "future_return"), BY, 3)


@query("M09_phases", "split:i model phase:i cohorts:i mean_net_return:r win_rate:r worst_cohort:r",
       f"WITH {daily_sql(5, 10, 'min')} SELECT split, model, (i - 1) % 5 AS phase, count(*) AS cohorts, avg(gross_return - 0.002) AS mean_net_return, avg(CASE WHEN gross_return - 0.002 > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(gross_return - 0.002) AS worst_cohort FROM daily GROUP BY 1, 2, 3")
def _(t):
    return pf.phases(t.staged("scored"), BY, 5, 5, 10, "probability", "future_return")


REGIME = "CASE WHEN new_signal = 0 THEN NULL WHEN dayofmonth(date) % 3 = 0 THEN 'stress' WHEN dayofmonth(date) % 3 = 1 THEN 'trend_down' ELSE 'trend_up' END"


@query("M10_regime_policy", "split:i model date:d policy cost_bps:r effective_regime gate:r gate_transition:r policy_turnover:r policy_gross:r policy_cost:r policy_net:r",
       f"""WITH {SLEEVE_SQL}, rg AS (SELECT *, coalesce(last_value({REGIME} IGNORE NULLS) OVER (PARTITION BY split, model ORDER BY date ROWS UNBOUNDED PRECEDING), 'unknown') AS effective_regime FROM sleeve),
       po AS (SELECT 'all_regimes' AS policy, 1.0 AS gate, * FROM rg UNION ALL SELECT 'stress_only', CASE WHEN effective_regime = 'stress' THEN 1.0 ELSE 0.0 END, * FROM rg UNION ALL SELECT 'trend_down_cash', CASE WHEN effective_regime <> 'trend_down' THEN 1.0 ELSE 0.0 END, * FROM rg),
       tr AS (SELECT *, abs(gate - coalesce(lag(gate) OVER (PARTITION BY split, model, policy ORDER BY date), gate)) AS gate_transition FROM po), c2 AS (SELECT unnest([0.0, 10.0, 25.0]) AS cost_bps)
       SELECT *, turnover * gate + gate_transition * invested_weight AS policy_turnover, gross_residual_return * gate AS policy_gross, (turnover * gate + gate_transition * invested_weight) * cost_bps / 10000 AS policy_cost,
       gross_residual_return * gate - (turnover * gate + gate_transition * invested_weight) * cost_bps / 10000 AS policy_net FROM tr, c2""")
def _(t):
    return pf.regime_policy(sleeves(t).withColumn("new_signal_regime", F.expr(REGIME)), BY, (0, 10, 25))


@query("M11_risk_metrics", "ticker observations:i total_return:r annual_return:r annual_volatility:r sharpe:r max_drawdown:r",
       """SELECT ticker, count(*) AS observations, arg_max(close_price, date) / arg_min(close_price, date) - 1 AS total_return, avg(ret_1d) * 252 AS annual_return, stddev_samp(ret_1d) * sqrt(252) AS annual_volatility, avg(ret_1d) * 252 / nullif(stddev_samp(ret_1d) * sqrt(252), 0) AS sharpe, min(dd) AS max_drawdown
       FROM (SELECT *, close_price / max(close_price) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rets) GROUP BY ticker""", digits=4)
def _(t):
    return pf.risk_metrics(t.prices())


SIG_SQL = """sg AS (SELECT ticker, date, i - 1 AS i, ret_20d AS momentum, avg(ret_1d) OVER w * 252 / nullif(stddev_samp(ret_1d) OVER w * sqrt(252), 0) AS trailing_sharpe, lead(close_price, 10) OVER (PARTITION BY ticker ORDER BY date) / close_price - 1 AS forward_return FROM rets
       WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), sigs AS (SELECT *, CASE WHEN momentum >= 0.02 AND trailing_sharpe >= 1.0 THEN 1 ELSE 0 END AS signal FROM sg WHERE i >= 60 AND forward_return IS NOT NULL)"""


@query("M12_momentum_signals", "ticker date:d momentum:r trailing_sharpe:r forward_return:r signal:i", f"WITH {SIG_SQL} SELECT * FROM sigs")
def _(t):
    return pf.momentum_signals(t.prices(), 60, 10, 20, 0.02, 1.0)


@query("M12_signal_summary", "ticker signals:i average_forward_return:r win_rate:r median_forward_return:r",
       f"WITH {SIG_SQL} SELECT ticker, count(*) AS signals, avg(forward_return) AS average_forward_return, avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, median(forward_return) AS median_forward_return FROM sigs WHERE signal = 1 GROUP BY ticker")
def _(t):
    return pf.signal_summary(pf.momentum_signals(t.prices(), 60, 10, 20, 0.02, 1.0))


def cand_sql(dates):
    return f"""sdates AS ({dates}), hist AS (SELECT s.date AS sd, p.*, row_number() OVER (PARTITION BY s.date, ticker ORDER BY p.date DESC) AS back FROM sdates s JOIN prices p ON p.date < s.date AND p.date >= s.date - 120 QUALIFY back <= 60),
       h2 AS (SELECT *, close_price / lag(close_price) OVER (PARTITION BY sd, ticker ORDER BY date) - 1 AS r FROM hist),
       cs AS (SELECT sd AS date, ticker, arg_max(close_price, date) / arg_min(close_price, date) - 1 AS trailing_return, stddev_samp(r) AS volatility, avg(close_price * volume) FILTER (WHERE back <= 20) AS dollar_volume FROM h2 GROUP BY 1, 2 HAVING count(*) >= 30),
       cand AS (SELECT *, trailing_return / greatest(volatility, 1e-6) AS score FROM cs WHERE dollar_volume >= 20000 AND volatility <= 20)"""


MONTH_ENDS = "SELECT max(date) AS date FROM prices GROUP BY date_trunc('quarter', date)"


@query("M13_candidate_scores", "date:d ticker score:r trailing_return:r volatility:r dollar_volume:r", "WITH " + cand_sql(MONTH_ENDS).replace("count(*) >= 30", "count(*) >= 20").replace("s.date - 120", "s.date - 80").replace("back <= 60", "back <= 40") + " SELECT * FROM cand", digits=4)
def _(t):
    p = t.prices()
    d = p.groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("date")).select("date")
    return pf.candidate_scores(p, d, 40, 20_000.0, 20.0)


REPLAY_SQL = """dd AS (SELECT date, i, n FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM prices))), rd AS (SELECT date, i - n + 300 AS i FROM dd WHERE i >= n - 300),
       """ + cand_sql("SELECT date FROM rd WHERE i % 60 = 0").replace("count(*) >= 30", "count(*) >= 30").replace("s.date - 120", "s.date - 120") + """,
       pk AS (SELECT date AS anchor, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, dollar_volume DESC, ticker) AS place FROM cand QUALIFY place <= 8), an AS (SELECT anchor, lead(anchor) OVER (ORDER BY anchor) AS nxt FROM (SELECT DISTINCT anchor FROM pk)),
       px AS (SELECT pk.anchor, pk.ticker, rd.date, (SELECT arg_max(close_price, p.date) FROM prices p WHERE p.ticker = pk.ticker AND p.date <= rd.date) AS price, (SELECT arg_max(close_price, p.date) FROM prices p WHERE p.ticker = pk.ticker AND p.date <= pk.anchor) AS base FROM pk JOIN an USING (anchor) JOIN rd ON rd.date >= pk.anchor AND (nxt IS NULL OR rd.date <= nxt)),
       fc AS (SELECT anchor, date, avg(price / base) AS factor FROM px GROUP BY 1, 2), lv AS (SELECT an.anchor, product(coalesce(factor, 1)) OVER (ORDER BY an.anchor ROWS UNBOUNDED PRECEDING) AS level FROM an LEFT JOIN (SELECT date AS anchor, factor FROM fc WHERE date IN (SELECT nxt FROM an) AND date <> anchor) f ON f.anchor = an.anchor),
       hl AS (SELECT rd.date, sum(q.quantity * (SELECT arg_max(close_price, p.date) FROM prices p WHERE p.ticker = q.ticker AND p.date <= rd.date)) + 500 AS actual_hold FROM rd, (SELECT ticker, sum(volume) AS quantity FROM raw_bars WHERE returnflag = 'N' GROUP BY 1) q GROUP BY 1),
       s0 AS (SELECT actual_hold AS start FROM hl ORDER BY date LIMIT 1), cv AS (SELECT rd.date, max(an.anchor) AS anchor FROM rd LEFT JOIN an ON an.anchor <= rd.date GROUP BY 1)"""


def replayed(t):
    h = t.raw_bars().where(F.col("returnflag") == "N").groupBy("ticker").agg(F.sum("volume").alias("quantity"))
    return pf.rebalance_replay(t.prices(), h, 300, 60, 60, 8, 20_000.0, 20.0, 500.0)


@query("M14_rebalance_replay", "date:d strategy:r actual_hold:r strategy_return:r actual_return:r",
       f"WITH {REPLAY_SQL} SELECT cv.date, start * coalesce(factor * level, 1) / 1e6 AS strategy, actual_hold / 1e6 AS actual_hold, coalesce(factor * level, 1) - 1 AS strategy_return, actual_hold / start - 1 AS actual_return FROM cv JOIN hl USING (date) LEFT JOIN fc ON fc.anchor = cv.anchor AND fc.date = cv.date LEFT JOIN lv ON lv.anchor = cv.anchor, s0", digits=4)
def _(t):
    return replayed(t)[0].withColumns({c: F.col(c) / 1e6 for c in ("strategy", "actual_hold")})  # in millions


@query("M14_replay_trades", "date:d tickers portfolio_value:r",
       f"WITH {REPLAY_SQL} SELECT pk.anchor AS date, string_agg(ticker, ', ' ORDER BY place) AS tickers, max(start * level) / 1e6 AS portfolio_value FROM pk JOIN lv USING (anchor), s0 GROUP BY 1", digits=4)
def _(t):
    return replayed(t)[1].withColumn("portfolio_value", F.col("portfolio_value") / 1e6)


NEIGH_SQL = "nb AS (SELECT a.ticker, b.ticker AS neighbor FROM symbols a JOIN symbols b ON a.nation = b.nation AND a.ticker <> b.ticker QUALIFY row_number() OVER (PARTITION BY a.ticker ORDER BY b.acctbal DESC, b.ticker) <= 8)"
POOL_SQL = f"""{NEIGH_SQL}, fr AS (SELECT ticker, future_return AS r FROM panel), pr AS (SELECT ticker, 1 / (1 + exp(-4 * greatest(-7.5, least(7.5, arg_max(ret_20d, date))))) AS p FROM panel GROUP BY 1 UNION ALL SELECT 'ZZ' || CAST(r_regionkey AS VARCHAR), 0.2 + 0.15 * r_regionkey FROM region),
       peers AS (SELECT ticker, ticker AS peer FROM pr UNION ALL SELECT ticker, neighbor FROM nb), own AS (SELECT pr.ticker, p, r FROM pr JOIN peers USING (ticker) JOIN fr ON fr.ticker = peers.peer), pool AS (SELECT * FROM own UNION ALL SELECT pr.ticker, p, fr.r FROM pr, fr WHERE pr.ticker NOT IN (SELECT ticker FROM own)),
       pw AS (SELECT *, CASE WHEN count(*) FILTER (WHERE r > 0) OVER t = 0 OR count(*) FILTER (WHERE r <= 0) OVER t = 0 THEN 1.0 / count(*) OVER t WHEN r > 0 THEN p / count(*) FILTER (WHERE r > 0) OVER t ELSE (1 - p) / count(*) FILTER (WHERE r <= 0) OVER t END AS w FROM pool WINDOW t AS (PARTITION BY ticker)),
       pc AS (SELECT *, sum(w) OVER (PARTITION BY ticker ORDER BY r RANGE UNBOUNDED PRECEDING) AS cum FROM pw),
       risk AS (SELECT ticker, count(*) AS pool_rows, sum(w * r) AS expected_return, coalesce(sum(CASE WHEN r > 0 THEN w END), 0) AS probability_positive, coalesce(sum(CASE WHEN r <= -0.05 THEN w END), 0) AS drawdown_probability, coalesce(sum(CASE WHEN r >= 0.05 THEN w END), 0) AS target_probability,
       min(CASE WHEN cum >= 0.1 - 1e-9 THEN r END) AS p10_return, min(CASE WHEN cum >= 0.5 - 1e-9 THEN r END) AS median_return, min(CASE WHEN cum >= 0.9 - 1e-9 THEN r END) AS p90_return FROM pc GROUP BY 1)"""


def pool_risk(t):
    from tessella.functions.frames import clip
    from tessella.operators.sets import first_others

    nb = first_others(t.symbols(), "nation", "ticker", [F.desc("acctbal"), F.asc("ticker")], 8, "neighbor")
    p = t.staged("panel")
    pr = p.groupBy("ticker").agg(F.max(F.struct("date", "ret_20d"))["ret_20d"].alias("x")).select("ticker", (1 / (1 + F.exp(-4 * clip("x", -7.5, 7.5)))).alias("p"))
    unknown = t.table("region").select(F.concat(F.lit("ZZ"), F.col("r_regionkey").cast("string")).alias("ticker"), (0.2 + 0.15 * F.col("r_regionkey")).alias("p"))
    return pf.return_pool_risk(stage(pr.unionByName(unknown)), p.select("ticker", F.col("future_return").alias("r")), nb)


@query("M16_return_pool_risk", "ticker pool_rows:i expected_return:r probability_positive:r drawdown_probability:r target_probability:r p10_return:r median_return:r p90_return:r", f"WITH {POOL_SQL} SELECT * FROM risk")
def _(t):
    return pool_risk(t)


@query("M16_price_bands", "ticker trading_day:i p10_price:r median_price:r p90_price:r",
       f"WITH {POOL_SQL} SELECT ticker, d AS trading_day, c * (1 + p10_return * d / 5.0) AS p10_price, c * (1 + median_return * d / 5.0) AS median_price, c * (1 + p90_return * d / 5.0) AS p90_price FROM risk JOIN (SELECT ticker, arg_max(close_price, date) AS c FROM prices GROUP BY 1) USING (ticker), (SELECT unnest(range(0, 6)) AS d)", digits=4)
def _(t):
    return pf.price_bands(pool_risk(t), t.prices(), 5)


FAN_SQL = """lr AS (SELECT *, CASE WHEN lag(close_price) OVER w IS NOT NULL THEN greatest(-0.35, least(0.35, ln(close_price / lag(close_price) OVER w))) END AS lr FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
       mk AS (SELECT date, avg(lr) AS m FROM lr GROUP BY 1), mt AS (SELECT date, coalesce(CASE WHEN count(m) OVER z >= 10 THEN sum(m) OVER z END, 0) AS trend FROM mk WINDOW z AS (ORDER BY date ROWS 19 PRECEDING)),
       b AS (SELECT lr.ticker, lr.date, greatest(-0.2, least(0.2, lr)) AS v, row_number() OVER (PARTITION BY ticker ORDER BY lr.date DESC) AS back, CASE WHEN trend >= 0 THEN 1 ELSE 0 END AS up FROM lr JOIN mt ON mt.date = lr.date WHERE lr IS NOT NULL QUALIFY back <= 504),
       c AS (SELECT *, row_number() OVER t - 1 AS i, max(back) OVER (PARTITION BY ticker) AS len, CASE WHEN count(v) OVER r >= 15 THEN stddev_samp(v) OVER r END AS vol FROM b WINDOW t AS (PARTITION BY ticker ORDER BY date), r AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
       nw AS (SELECT ticker, median(vol) AS cv, max(CASE WHEN back = 1 THEN up END) AS cr FROM c WHERE back <= 20 GROUP BY 1),
       k AS (SELECT c.*, cr, CASE WHEN vol / nullif(cv, 0) BETWEEN 0.65 AND 1.35 AND up = cr THEN 1 ELSE 0 END AS lk FROM c JOIN nw USING (ticker) WHERE len >= 100 AND i >= 20 AND i < len - 10),
       s AS (SELECT *, sum(lk) OVER (PARTITION BY ticker) AS n FROM k QUALIFY CASE WHEN n >= 15 THEN lk = 1 ELSE i >= greatest(20, len - 252) END),
       q AS (SELECT s.ticker, s.i, s.cr, c.i - s.i + 1 AS day, exp(round(sum(c.v) OVER (PARTITION BY s.ticker, s.i ORDER BY c.i ROWS UNBOUNDED PRECEDING), 12)) - 1 AS x FROM s JOIN c ON c.ticker = s.ticker AND c.i BETWEEN s.i AND s.i + 9)"""


@query("M17_analog_fan", "ticker day:i q05:r q25:r q50:r q75:r q95:r",
       f"WITH {FAN_SQL} SELECT ticker, day, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95 FROM q GROUP BY 1, 2")
def _(t):
    return pf.analog_fan(t.prices(), 10)[0]


@query("M17_analog_summary", "ticker starts:i regime:i expected_return:r upside_probability:r target_before_stop:r stop_before_target:r expected_shortfall:r",
       f"""WITH {FAN_SQL}, e AS (SELECT ticker, i, max(cr) AS cr, max(CASE WHEN day = 10 THEN x END) AS f, coalesce(min(CASE WHEN x >= 0.05 THEN day END), 11) AS t, coalesce(min(CASE WHEN x <= -0.05 THEN day END), 11) AS s FROM q GROUP BY 1, 2), z AS (SELECT ticker, quantile_cont(f, 0.05) AS c FROM e GROUP BY 1)
       SELECT ticker, count(*) AS starts, max(cr) AS regime, avg(f) AS expected_return, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) AS upside_probability, avg(CASE WHEN t < s THEN 1.0 ELSE 0.0 END) AS target_before_stop, avg(CASE WHEN s < t THEN 1.0 ELSE 0.0 END) AS stop_before_target,
       avg(CASE WHEN f <= c + 1e-12 THEN f END) AS expected_shortfall FROM e JOIN z USING (ticker) GROUP BY ticker""", digits=5)
def _(t):
    return pf.analog_fan(t.prices(), 10)[1]


@query("M18_lognormal_bands", "ticker day:i p10:r p25:r median:r p75:r p90:r probability_up:r",
       """WITH s AS (SELECT ticker, avg(r) AS mu, stddev_samp(r) AS sd, arg_max(close_price, date) AS c FROM (SELECT *, ln(close_price / lag(close_price) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM prices) GROUP BY 1), d AS (SELECT unnest(range(1, 21)) AS day),
       z AS (SELECT *, mu * sqrt(day::DOUBLE) / sd AS x FROM s, d), y AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS k FROM z), u AS (SELECT *, exp(-x * x / 2) * 0.3989422804014327 * (0.319381530 * k - 0.356563782 * k^2 + 1.781477937 * k^3 - 1.821255978 * k^4 + 1.330274429 * k^5) AS tail FROM y)
       SELECT ticker, day, c * exp(mu * day - 1.2815515655446004 * sd * sqrt(day)) AS p10, c * exp(mu * day - 0.6744897501960817 * sd * sqrt(day)) AS p25, c * exp(mu * day) AS median, c * exp(mu * day + 0.6744897501960817 * sd * sqrt(day)) AS p75,
       c * exp(mu * day + 1.2815515655446004 * sd * sqrt(day)) AS p90, CASE WHEN x >= 0 THEN 1 - tail ELSE tail END AS probability_up FROM u""", digits=3)
def _(t):
    return pf.lognormal_bands(t.prices(), 20)


WEEK_SQL = f"{daily_sql(5, 10, 'min')}, wk AS (SELECT model, date_trunc('week', date) AS week, avg(v) AS value FROM (SELECT model, date, avg(net_return) AS v FROM daily GROUP BY 1, 2) GROUP BY 1, 2)"


def dailies(t):
    return stage(pf.topk_daily(t.staged("scored"), BY, 5, 10, "probability", "future_return"))


@query("N01_weekly_blocks", "model week:d value:r", f"WITH {WEEK_SQL} SELECT * FROM wk")
def _(t):
    return nf.weekly_blocks(dailies(t), ["model"], "net_return")


@query("N01_block_summary", "model mean:r blocks:i", f"WITH {WEEK_SQL} SELECT model, avg(value) AS mean, count(*) AS blocks FROM wk GROUP BY 1")
def _(t):
    return nf.block_summary(nf.weekly_blocks(dailies(t), ["model"], "net_return"), ["model"])


@query("N02_bootstrap_ci", "model mean:r blocks:i ci_2_5:r ci_97_5:r positive_probability:r",
       f"""WITH {WEEK_SQL}, k AS (SELECT model, value, row_number() OVER (PARTITION BY model ORDER BY week) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM wk),
       s AS (SELECT model, n, b, unnest(range(1, n + 1)) AS d FROM (SELECT DISTINCT model, n FROM k), (SELECT unnest(range(1, 2001)) AS b)),
       w AS (SELECT model, b, {draw_sql(17, 'model', 'b', 'd')} % n AS k FROM s), m AS (SELECT w.model, b, avg(value) AS m FROM w JOIN k ON k.model = w.model AND k.k = w.k GROUP BY 1, 2),
       ci AS (SELECT model, quantile_cont(m, 0.025) AS ci_2_5, quantile_cont(m, 0.975) AS ci_97_5, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS positive_probability FROM m GROUP BY 1)
       SELECT ci.*, mean, blocks FROM ci JOIN (SELECT model, avg(value) AS mean, count(*) AS blocks FROM wk GROUP BY 1) USING (model)""")
def _(t):
    return nf.bootstrap_ci(nf.weekly_blocks(dailies(t), ["model"], "net_return"), ["model"], ["week"], 2000, 17)


@query("N03_block_bootstrap", "model mean:r n:i ci_2_5:r ci_97_5:r",
       f"""WITH {daily_sql(5, 10, 'min')}, v AS (SELECT model, net_return AS x, row_number() OVER (PARTITION BY model ORDER BY split, date) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM daily WHERE net_return IS NOT NULL),
       bl AS (SELECT model, n, i // 10 AS k, list(x ORDER BY i) AS xs FROM v GROUP BY 1, 2, 3), sz AS (SELECT model, n, count(*) AS c FROM bl GROUP BY 1, 2),
       s AS (SELECT model, n, c, b, unnest(range(1, c + 1)) AS d FROM sz, (SELECT unnest(range(1, 2001)) AS b)), w AS (SELECT *, {draw_sql(442, 'model', 'b', 'd')} % c AS k FROM s),
       j AS (SELECT w.model, w.n, b, d, xs, w.n - coalesce(sum(len(xs)) OVER (PARTITION BY w.model, b ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM w JOIN bl ON bl.model = w.model AND bl.k = w.k),
       m AS (SELECT model, b, sum(list_sum(xs[1:room])) / sum(len(xs[1:room])) AS m FROM j WHERE room > 0 GROUP BY 1, 2),
       ci AS (SELECT model, quantile_cont(m, 0.025) AS ci_2_5, quantile_cont(m, 0.975) AS ci_97_5 FROM m GROUP BY 1)
       SELECT ci.*, mean, n FROM ci JOIN (SELECT model, avg(x) AS mean, count(*) AS n FROM v GROUP BY 1) USING (model)""")
def _(t):
    return nf.block_bootstrap(dailies(t), ["model"], ["split", "date"], "net_return", 10, 2000, 442)


@query("N04_paired_deltas", "split:i date:d net_return_delta:r turnover_delta:r",
       f"WITH {daily_sql(5, 10, 'min')} SELECT split, date, a.net_return - b.net_return AS net_return_delta, a.turnover - b.turnover AS turnover_delta FROM (SELECT * FROM daily WHERE model = 'slow') a JOIN (SELECT * FROM daily WHERE model = 'fast') b USING (split, date)")
def _(t):
    return nf.paired_deltas(dailies(t), "model", "slow", "fast", ["split", "date"], ["net_return", "turnover"])


@query("L11_calibration_summary", "horizon_days:i model_name auc:r minimum_split_auc:r brier_skill:r minimum_split_brier_skill:r mean_excess_vs_universe:r improves_calibration_error:i probability_ready:i",
       """WITH x AS (SELECT horizon_days, model_name, avg(roc_auc) AS auc, min(roc_auc) AS minimum_split_auc, avg(brier_skill) AS brier_skill, min(brier_skill) AS minimum_split_brier_skill, avg(log_loss_skill) AS lls, avg(accuracy) AS ce, min(accuracy_lift) AS lo, max(accuracy_lift) AS hi, min(probability_std) AS ps,
       avg(selected_return_edge) AS mean_excess_vs_universe, min(selected_return_edge) AS me FROM evals GROUP BY 1, 2)
       SELECT x.*, CASE WHEN coalesce(x.ce < r.ce, true) THEN 1 ELSE 0 END AS improves_calibration_error, CASE WHEN x.minimum_split_brier_skill > 0 AND x.lls > 0 AND coalesce(x.ce < r.ce, true) AND x.auc >= 0.51 AND x.minimum_split_auc >= 0.5 AND x.ce <= 0.05 AND x.lo >= 0.5 AND x.hi <= 1.5 AND x.ps >= 0.02 AND x.mean_excess_vs_universe > 0 AND x.me >= 0 THEN 1 ELSE 0 END AS probability_ready
       FROM x LEFT JOIN x r ON r.horizon_days = x.horizon_days AND r.model_name = 'slow'""")
def _(t):
    e = t.staged("evals").withColumns({"auc": F.col("roc_auc"), "calibration_error": F.col("accuracy"), "calibration_slope": F.col("accuracy_lift"), "mean_excess_vs_universe": F.col("selected_return_edge")})
    return ru.calibration_summary(e, ["horizon_days", "model_name"], "slow")


@query("L11_feature_registry", "feature decision reason auc:r excess:r max_psi:r",
       """WITH i AS (SELECT model_name AS feature, avg(roc_auc - 0.5) AS auc, avg(CASE WHEN roc_auc > 0.5 THEN 1.0 ELSE 0.0 END) AS auc_pos, avg(brier_skill) AS brier, avg(selected_return_edge) AS excess, avg(CASE WHEN selected_return_edge > 0 THEN 1.0 ELSE 0.0 END) AS excess_pos, min(probability_std) AS min_std, max(accuracy) AS max_psi FROM evals GROUP BY 1),
       c AS (SELECT *, auc < 0 AND excess < 0 AND auc_pos <= 0.33 AND excess_pos <= 0.33 AS harms, auc > 0 AND brier > 0 AND excess > 0 AND auc_pos >= 0.67 AND excess_pos >= 0.67 AS helps FROM i)
       SELECT *, CASE WHEN min_std <= 1e-8 OR harms THEN 'confirmatory_drop' WHEN helps AND max_psi >= 0.25 THEN 'watch' WHEN helps THEN 'keep' ELSE 'watch' END AS decision,
       CASE WHEN min_std <= 1e-8 THEN 'near-zero variance in at least one split' WHEN harms THEN 'usually harms both discrimination and ranking' WHEN helps AND max_psi >= 0.25 THEN 'helpful but exhibits material distribution drift' WHEN helps THEN 'helps discrimination, probability loss, and ranking consistently' ELSE 'mixed importance across seeds, horizons, or time splits' END AS reason FROM c""")
def _(t):
    e = t.staged("evals").withColumn("feature", F.col("model_name"))
    imp = e.select("feature", (F.col("roc_auc") - 0.5).alias("auc_importance"), F.col("brier_skill").alias("brier_importance"), F.col("selected_return_edge").alias("excess_return_importance"))
    q = e.select("feature", F.col("probability_std").alias("train_std"), F.lit(0.5).alias("maximum_absolute_correlation"), F.col("accuracy").alias("population_stability_index"))
    return ru.feature_registry(imp, q)


@query("L11_stable_challengers", "architecture horizons:i stable:i",
       """WITH h AS (SELECT model_name AS architecture, horizon_days, count(*) AS n, min(benchmark_average_return) AS w, avg(benchmark_average_return) AS m, stddev_samp(benchmark_average_return) AS s FROM evals GROUP BY 1, 2)
       SELECT architecture, count(*) AS horizons, CASE WHEN bool_and(n >= 5 AND w > 0 AND m >= 0.01 AND NOT coalesce(s > 5, false)) AND count(*) = 3 THEN 1 ELSE 0 END AS stable FROM h GROUP BY 1""")
def _(t):
    e = t.staged("evals").select(F.col("model_name").alias("architecture"), F.col("horizon_days").alias("horizon"), F.col("benchmark_average_return").alias("mean_excess_vs_universe"))
    return ru.stable_challengers(e, 5, 0.01, 5.0, 3)


@query("L11_advantage_gate", "model net_residual_return:r auc:r rank_ic:r absolute_gate_pass:i",
       "SELECT model_name AS model, max(selected_return_edge) AS net_residual_return, max(roc_auc) AS auc, max(brier_skill) AS rank_ic, CASE WHEN max(selected_return_edge) > 0 AND max(roc_auc) > 0.5 AND max(brier_skill) > 0 THEN 1 ELSE 0 END AS absolute_gate_pass FROM evals GROUP BY 1")
def _(t):
    e = t.staged("evals")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("ci_2_5")) for m, c in (("net_residual_return", "selected_return_edge"), ("auc", "roc_auc"), ("rank_ic", "brier_skill"))])
    return ru.advantage_gate(e.select(F.col("model_name").alias("model"), F.explode(rows).alias("x")).select("model", "x.*"))


@query("L11_confirmatory_registry", "method auc_delta:r excess_return_delta:r decision",
       """WITH s AS (SELECT 'drop_' || CAST(horizon_days AS VARCHAR) AS method, avg(roc_auc - 0.5) AS auc_delta, avg(selected_return_edge) AS excess_return_delta, avg(CASE WHEN selected_return_edge > 0 THEN 1.0 ELSE 0.0 END) AS ep, avg(selected_return_edge) - 1 AS rl, avg(roc_auc - 0.5) AS al, avg(brier_skill) AS bl FROM evals GROUP BY 1)
       SELECT *, CASE WHEN rl > 0 AND al >= -0.001 AND bl >= -0.001 AND ep >= 0.67 THEN 'confirmed_drop' WHEN excess_return_delta < 0 AND auc_delta < 0 THEN 'retain' ELSE 'watch' END AS decision FROM s""")
def _(t):
    e = t.staged("evals").withColumn("method", F.concat(F.lit("drop_"), F.col("horizon_days").cast("string")))
    c = e.select("method", (F.col("roc_auc") - 0.5).alias("auc_delta"), F.col("selected_return_edge").alias("excess_return_delta"))
    rows = F.array(F.struct(F.lit("excess_return_delta").alias("metric"), (F.col("selected_return_edge") - 1).alias("ci_2_5")), F.struct(F.lit("auc_delta").alias("metric"), (F.col("roc_auc") - 0.5).alias("ci_2_5")), F.struct(F.lit("brier_improvement").alias("metric"), F.col("brier_skill").alias("ci_2_5")))
    return ru.confirmatory_registry(c, e.select("method", F.explode(rows).alias("x")).select("method", "x.*"))


@query("L11_family_registry", "family tests:i passed:i worst_net_low:r confirmed:i", """
WITH w AS (
    SELECT model_name || '|' || run_id AS challenger, max(selected_return_edge) AS net_low, max(roc_auc) - 0.5 AS auc_low
    FROM evals
    GROUP BY 1),
t AS (
    SELECT DISTINCT model_name || CASE WHEN run_id <= 2 THEN '_early' ELSE '_late' END AS family, model_name || '|' || run_id AS challenger
    FROM evals)
SELECT family, count(*) AS tests, count(*) FILTER (WHERE net_low > 0 AND auc_low >= -0.001) AS passed, min(net_low) AS worst_net_low,
    CASE WHEN bool_and(coalesce(net_low > 0 AND auc_low >= -0.001, false)) THEN 1 ELSE 0 END AS confirmed
FROM t LEFT JOIN w USING (challenger)
GROUP BY 1""")
def _(t):
    e = t.staged("evals").withColumns({"challenger": F.concat_ws("|", "model_name", "run_id"), "comparison": F.lit("base")})
    bounds = F.array(
        F.struct(F.lit("net_residual_return").alias("metric"), F.col("selected_return_edge").alias("ci_2_5")),
        F.struct(F.lit("auc").alias("metric"), (F.col("roc_auc") - 0.5).alias("ci_2_5")))
    c = e.select("challenger", "comparison", F.explode(bounds).alias("x")).select("challenger", "comparison", "x.*")
    family = F.concat("model_name", F.when(F.col("run_id") <= 2, "_early").otherwise("_late"))
    return ru.family_registry(c, e.select(family.alias("family"), F.lit("removal").alias("test"), "challenger", "comparison").distinct())

"""Universe, lineage, identity, tracking and decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import lineage as ln
from tessella.operators import tracking as tr
from tessella.operators import views as vw
from tessella.plans.q_joins import MEMBER_SQL
from tessella.plans.q_summary import FWD_SQL, tracked
from tessella.plans.registry import query
from tessella.session import stage

LIFE_SQL = """d AS (SELECT ticker, date, count(*) AS n FROM raw_bars WHERE date < DATE '2001-06-01' GROUP BY 1, 2), cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM d)),
       life AS (SELECT l.*, b.i - a.i + 1 AS market_dates_in_observed_span, observed_dates / (b.i - a.i + 1)::DOUBLE AS coverage_ratio, CASE WHEN first_seen = (SELECT min(date) FROM d) THEN 1 ELSE 0 END AS left_censored_at_dataset_start,
       CASE WHEN last_seen = (SELECT max(date) FROM d) THEN 1 ELSE 0 END AS right_censored_at_training_end, (SELECT max(date) FROM d) - last_seen AS terminal_absence_calendar_days,
       CASE WHEN (SELECT max(date) FROM d) - last_seen >= 5 THEN 1 ELSE 0 END AS terminal_absence_proxy
       FROM (SELECT ticker, min(date) AS first_seen, max(date) AS last_seen, count(*) AS observed_dates, sum(n) AS source_rows FROM d GROUP BY 1) l JOIN cal a ON a.date = first_seen JOIN cal b ON b.date = last_seen)"""


def life(t):
    return ln.lifecycle(t.raw_bars(), "2001-06-01", 5)


@query("P01_membership", "ticker as_of_date:d history_observations:i source_rows_on_date:i universe_eligible:i eligibility_reason", f"WITH {MEMBER_SQL} SELECT * FROM membership")
def _(t):
    return ln.membership(t.raw_bars(), "2100-01-01", 60)


@query("P02_lifecycle", "ticker first_seen:d last_seen:d observed_dates:i source_rows:i market_dates_in_observed_span:i coverage_ratio:r left_censored_at_dataset_start:i right_censored_at_training_end:i terminal_absence_calendar_days:i terminal_absence_proxy:i",
       f"WITH {LIFE_SQL} SELECT * FROM life")
def _(t):
    return life(t)


def profiles(t):
    return t.symbols().where(F.col("acctbal") > 1000).select("ticker", F.col("security_type").alias("sector"), F.concat(F.lit("IND"), F.col("nation").cast("string")).alias("industry"))


@query("P03_sector_audit", "ticker current_sector current_industry current_profile_available:i point_in_time_sector_safe:i lineage_status",
       f"""WITH {LIFE_SQL} SELECT life.ticker, s.security_type AS current_sector, 'IND' || CAST(s.nation AS VARCHAR) AS current_industry, CASE WHEN s.ticker IS NULL THEN 0 ELSE 1 END AS current_profile_available, 0 AS point_in_time_sector_safe,
       CASE WHEN s.ticker IS NULL THEN 'no_sector_metadata' ELSE 'current_snapshot_only_not_valid_for_historical_features' END AS lineage_status FROM life LEFT JOIN symbols s ON s.ticker = life.ticker AND s.acctbal > 1000""")
def _(t):
    return ln.sector_audit(life(t), profiles(t))


def security_events(t):
    o = t.raw_bars()
    auth = F.when(F.col("transactions") == 1, " sec ").when(F.col("transactions") == 2, "FINRA").when(F.col("transactions") == 3, "blog").otherwise("")
    return o.where(F.col("returnflag") == "R").select(
        "seq", F.col("transactions").alias("line"), "ticker", F.lower("ticker").alias("prior_ticker"), auth.alias("source_authority"),
        F.when(F.col("volume") > 10, "Confirmed").otherwise("likely").alias("match_confidence"),
        F.when(F.col("volume") > 45, F.date_format("date", "yyyy/MM/dd")).otherwise(F.col("date").cast("string")).alias("effective_date"))


EVENT_SQL = """ev AS (SELECT seq, transactions AS line, ticker, CASE WHEN transactions NOT IN (1, 2) THEN 'untrusted_or_missing_authority' WHEN volume <= 10 THEN 'match_not_confirmed' WHEN volume > 45 THEN 'missing_or_invalid_effective_date' ELSE 'authoritative_dated_confirmed' END AS safety_reason
       FROM raw_bars WHERE returnflag = 'R')"""


@query("P04_event_safety", "seq:i line:i ticker safety_reason point_in_time_safe:i", f"WITH {EVENT_SQL} SELECT *, CASE WHEN safety_reason = 'authoritative_dated_confirmed' THEN 1 ELSE 0 END AS point_in_time_safe FROM ev")
def _(t):
    return ln.event_safety(security_events(t))


@query("P04_symbol_lineage", "security_id ticker effective_from:d effective_to:d source_authority match_confidence point_in_time_safe:i",
       f"WITH {LIFE_SQL} SELECT 'observed-' || substr(sha256(ticker || '|' || CAST(first_seen AS VARCHAR)), 1, 16) AS security_id, ticker, first_seen AS effective_from, last_seen AS effective_to, 'OBSERVED_PRICE_COVERAGE' AS source_authority, 'provisional' AS match_confidence, 0 AS point_in_time_safe FROM life")
def _(t):
    return ln.symbol_lineage(ln.observed_securities(life(t)))


@query("P04_classification_lineage", "security_id ticker sector industry point_in_time_safe:i",
       f"WITH {LIFE_SQL} SELECT 'observed-' || substr(sha256(life.ticker || '|' || CAST(first_seen AS VARCHAR)), 1, 16) AS security_id, life.ticker, security_type AS sector, 'IND' || CAST(nation AS VARCHAR) AS industry, 0 AS point_in_time_safe FROM life JOIN symbols s ON s.ticker = life.ticker AND acctbal > 1000")
def _(t):
    return ln.classification_lineage(ln.observed_securities(life(t)), ln.sector_audit(life(t), profiles(t)))


@query("P04_coverage_gaps", "gap_type affected_tickers:i sample_tickers model_feature_blocked:i",
       f"""WITH {LIFE_SQL}, {EVENT_SQL}, hit AS (SELECT DISTINCT ticker FROM ev WHERE safety_reason = 'authoritative_dated_confirmed'), u AS (SELECT ticker FROM life WHERE ticker NOT IN (SELECT ticker FROM symbols WHERE acctbal > 1000)),
       n AS (SELECT (SELECT count(*) FROM life) AS a, (SELECT count(*) FROM life WHERE ticker IN (SELECT ticker FROM hit)) AS m, (SELECT count(*) FROM u) AS u, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT ticker FROM life ORDER BY ticker LIMIT 20)) AS s,
       (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT ticker FROM u ORDER BY ticker LIMIT 20)) AS b)
       SELECT 'historical_listing_authority_missing' AS gap_type, a - m AS affected_tickers, s AS sample_tickers, 1 AS model_feature_blocked FROM n UNION ALL SELECT 'historical_delisting_authority_missing', a - m, s, 1 FROM n
       UNION ALL SELECT 'historical_sector_lineage_missing', a, s, 1 FROM n UNION ALL SELECT 'current_classification_missing', u, b, 0 FROM n""")
def _(t):
    return ln.coverage_gaps(ln.observed_securities(life(t)), ln.sector_audit(life(t), profiles(t)), ln.event_safety(security_events(t)))


@query("P05_entity_churn", "entity_id first_anchor_seen:d last_anchor_seen:d ticker_count:i types present_first_anchor:i present_last_anchor:i candidate_departure:i candidate_entry:i candidate_symbol_change:i names",
       """WITH r AS (SELECT date_trunc('quarter', o_orderdate) AS anchor, 'E' || CAST(o_custkey AS VARCHAR) AS entity_id, o_orderpriority AS ticker, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS type, CASE WHEN o_totalprice > 400000 THEN 'big' ELSE '' END AS name FROM orders)
       SELECT entity_id, min(anchor) AS first_anchor_seen, max(anchor) AS last_anchor_seen, count(DISTINCT ticker) AS ticker_count, string_agg(DISTINCT coalesce(type, 'UNMAPPED'), '|' ORDER BY coalesce(type, 'UNMAPPED')) AS types, max(CASE WHEN name <> '' THEN name ELSE '' END) AS names,
       CASE WHEN min(anchor) = (SELECT min(anchor) FROM r) THEN 1 ELSE 0 END AS present_first_anchor, CASE WHEN max(anchor) = (SELECT max(anchor) FROM r) THEN 1 ELSE 0 END AS present_last_anchor,
       CASE WHEN min(anchor) = (SELECT min(anchor) FROM r) AND max(anchor) <> (SELECT max(anchor) FROM r) THEN 1 ELSE 0 END AS candidate_departure, CASE WHEN min(anchor) <> (SELECT min(anchor) FROM r) AND max(anchor) = (SELECT max(anchor) FROM r) THEN 1 ELSE 0 END AS candidate_entry,
       CASE WHEN count(DISTINCT ticker) > 1 THEN 1 ELSE 0 END AS candidate_symbol_change FROM r GROUP BY 1""")
def _(t):
    r = t.table("orders").select(
        F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("anchor"), F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("entity_id"), F.col("o_orderpriority").alias("ticker"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("type"), F.when(F.col("o_totalprice") > 400000, "big").otherwise("").alias("name"))
    return ln.entity_churn(r)


ENT_SQL = "ent AS (SELECT ticker, security_type, coalesce(share_class_figi, composite_figi, CASE WHEN cik <> '' THEN 'CIK:' || cik END, 'TICKER:' || ticker) AS entity_id FROM symbols)"
MISSING_SQL = f"""{ENT_SQL}, days AS (SELECT DISTINCT date FROM mbars), w AS (SELECT a.anchor, min(d.date) AS lo, max(d.date) AS hi FROM (SELECT unnest([DATE '1997-06-01', DATE '1998-03-15', DATE '2000-02-15']) AS anchor) a,
       LATERAL (SELECT date FROM days WHERE date <= a.anchor ORDER BY date DESC LIMIT 2) d GROUP BY 1),
       v AS (SELECT w.hi AS anchor_date, b.ticker, sum(close_price * greatest(volume, 0)) / 2 AS mean_dollar_volume FROM w JOIN mbars b ON b.date BETWEEN w.lo AND w.hi GROUP BY 1, 2 HAVING count(*) = 2),
       r AS (SELECT v.*, e.security_type, e.entity_id, row_number() OVER (PARTITION BY anchor_date ORDER BY mean_dollar_volume DESC, v.ticker) AS rank_all_market FROM v JOIN ent e USING (ticker)),
       missing AS (SELECT *, row_number() OVER (PARTITION BY anchor_date ORDER BY mean_dollar_volume DESC, ticker) AS rank_common_stock FROM r WHERE security_type = 'CS'),
       cand AS (SELECT *, CASE WHEN rank_all_market <= 40 THEN 'conservative_all_market' WHEN rank_common_stock <= 40 THEN 'common_stock_sensitivity' END AS candidate_set FROM missing m
       WHERE NOT EXISTS (SELECT 1 FROM prices_alt a WHERE a.ticker = m.ticker AND a.date = m.anchor_date) AND (rank_all_market <= 40 OR rank_common_stock <= 40))"""
ANCHORS = ("1997-06-01", "1998-03-15", "2000-02-15")


def market_bars(t):
    """Thirty-day bars, so that complete short windows exist in sparse test data."""
    day = F.date_sub("date", F.pmod(F.unix_date("date"), F.lit(30)))
    return t.prices().groupBy("ticker", day.alias("date")).agg(F.avg("close_price").alias("close_price"), F.sum("volume").alias("volume"))


MBARS = "mbars AS (SELECT ticker, date - CAST((date - DATE '1970-01-01') % 30 AS INTEGER) AS date, avg(close_price) AS close_price, sum(volume) AS volume FROM prices GROUP BY 1, 2)"


def entities(t):
    from tessella.functions.scalars import entity_key

    return t.symbols().select("ticker", "security_type", entity_key("share_class_figi", "composite_figi", "cik", "ticker").alias("entity_id"))


def missing(t):
    return ln.missing_candidates(market_bars(t), entities(t), t.prices_alt(), ANCHORS, 2, 40)


@query("P06_missing_candidates", "anchor_date:d ticker entity_id mean_dollar_volume:r rank_all_market:i rank_common_stock:i candidate_set", f"WITH {MBARS}, {MISSING_SQL} SELECT * FROM cand", digits=4)
def _(t):
    return missing(t)


@query("P07_candidate_registry", "entity_id security_type anchor_tickers anchor_dates",
       f"""WITH {MBARS}, {MISSING_SQL} SELECT entity_id, arg_max(security_type, anchor_date) AS security_type, string_agg(DISTINCT ticker, '|' ORDER BY ticker) AS anchor_tickers,
       string_agg(DISTINCT CAST(anchor_date AS VARCHAR), '|' ORDER BY CAST(anchor_date AS VARCHAR)) AS anchor_dates FROM cand GROUP BY 1 HAVING count(DISTINCT anchor_date) = (SELECT count(DISTINCT anchor_date) FROM cand)""")
def _(t):
    return ln.candidate_registry(missing(t))


@query("P08_alias_intervals", "entity_id ticker valid_from:d valid_to:d validity_source",
       """WITH e AS (SELECT user_id AS entity_id, event_type AS ticker, max(CAST(ts AS DATE)) AS valid_from FROM events GROUP BY 1, 2), a AS (SELECT DISTINCT user_id AS entity_id, event_type || CASE WHEN value > 90 THEN 'X' ELSE '' END AS ticker FROM events)
       SELECT entity_id, ticker, valid_from, lead(valid_from) OVER (PARTITION BY entity_id ORDER BY valid_from, ticker) - 1 AS valid_to, 'ticker_event' AS validity_source FROM e
       UNION ALL SELECT a.entity_id, a.ticker, NULL, NULL, 'anchor_snapshot' FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.entity_id = a.entity_id AND e.ticker = a.ticker)""")
def _(t):
    e = t.table("events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "value")
    return ln.alias_intervals(e, e.select("entity_id", F.concat("ticker", F.when(F.col("value") > 90, "X").otherwise("")).alias("ticker")))


@query("P09_candidate_membership", "entity_id ticker date:d history_observations:i mean_dollar_volume:r combined_liquidity_rank:i universe_eligible:i eligibility_reason",
       """WITH c AS (SELECT ticker AS entity_id, ticker, date, close_price, volume FROM cust_prices UNION ALL SELECT 'E' || ticker, ticker, date, CASE WHEN day(date) % 7 <> 3 THEN close_price END, CASE WHEN day(date) % 7 <> 4 THEN volume END FROM prices WHERE volume < 15),
       days AS (SELECT DISTINCT date FROM prices_alt), warm AS (SELECT min(date) AS w FROM (SELECT date FROM days WHERE date <= DATE '1997-01-01' ORDER BY date DESC LIMIT 5)),
       k AS (SELECT 'SRC:' || ticker AS key, ticker, date, CASE WHEN volume IS NOT NULL THEN close_price * greatest(volume, 0) END AS dv, 0 AS cand FROM prices_alt, warm WHERE date >= w AND date < DATE '2001-01-01'
             UNION ALL SELECT 'ENT:' || entity_id, ticker, date, CASE WHEN volume IS NOT NULL THEN close_price * greatest(volume, 0) END, 1 FROM c WHERE date >= DATE '1997-01-01' AND date < DATE '2001-01-01' AND date IN (SELECT date FROM days)),
       r AS (SELECT *, count(dv) OVER (PARTITION BY key ORDER BY date) AS history_observations, avg(dv) OVER (PARTITION BY key, dv IS NULL ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM k),
       q AS (SELECT *, CASE WHEN dv IS NOT NULL AND history_observations >= 5 THEN m END AS mean_dollar_volume FROM r), z AS (SELECT *, CASE WHEN mean_dollar_volume IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY mean_dollar_volume DESC NULLS LAST, key) END AS rk FROM q),
       f AS (SELECT substr(key, 5) AS entity_id, ticker, date, history_observations, mean_dollar_volume, rk AS combined_liquidity_rank,
       CASE WHEN EXISTS (SELECT 1 FROM z s WHERE s.cand = 0 AND s.ticker = z.ticker AND s.date = z.date) THEN 'already_present_in_source' WHEN history_observations < 5 THEN 'insufficient_20_date_history' WHEN rk IS NULL THEN 'missing_liquidity_rank' WHEN rk > 10 THEN 'outside_top_10_liquidity'
       ELSE 'eligible_missing_past_only' END AS eligibility_reason FROM z WHERE cand = 1 AND date >= DATE '1997-01-01')
       SELECT *, CASE WHEN eligibility_reason = 'eligible_missing_past_only' THEN 1 ELSE 0 END AS universe_eligible FROM f""", digits=4)
def _(t):
    cols = ["entity_id", "ticker", "date", "close_price", "volume"]
    c = t.cust_prices().withColumn("entity_id", F.col("ticker")).select(*cols)
    # some days miss the close, others the volume
    day = F.dayofmonth("date") % 7
    d = t.prices().where(F.col("volume") < 15).withColumns({
        "entity_id": F.concat(F.lit("E"), "ticker"),
        "close_price": F.when(day != 3, F.col("close_price")), "volume": F.when(day != 4, F.col("volume"))}).select(*cols)
    return ln.candidate_membership(t.prices_alt(), c.unionByName(d), "1997-01-01", "2001-01-01", 5, 10)


def listings(t):
    e = t.table("events")
    sym = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string")))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot"), sym.alias("symbol"), F.col("event_type").alias("name"))


LIST_SQL = "l AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot, CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 'U' END || CAST(user_id AS VARCHAR) AS symbol, event_type AS name FROM events)"


@query("P10_listing_snapshots", "snapshot n_rows:i exact_symbol_duplicates:i case_collisions:i",
       f"""WITH {LIST_SQL} SELECT a.snapshot, n_rows, exact_symbol_duplicates, case_collisions FROM (SELECT snapshot, count(*) AS n_rows, count(*) - count(DISTINCT symbol) AS exact_symbol_duplicates FROM l GROUP BY 1) a
       JOIN (SELECT snapshot, count(*) FILTER (WHERE k > 1) AS case_collisions FROM (SELECT snapshot, upper(symbol) AS s, count(DISTINCT symbol) AS k FROM l GROUP BY 1, 2) GROUP BY 1) b USING (snapshot)""")
def _(t):
    return ln.listing_snapshots(listings(t))


@query("P10_reused_symbols", "symbol_norm names:i", f"WITH {LIST_SQL} SELECT upper(symbol) AS symbol_norm, count(DISTINCT name) AS names FROM l GROUP BY 1 HAVING count(DISTINCT name) > 1")
def _(t):
    return ln.reused_symbols(listings(t))


@query("P10_name_search", "snapshot symbol name", f"WITH {LIST_SQL} SELECT DISTINCT snapshot, symbol, name FROM l WHERE regexp_matches(name, 'CLI|err', 'i')")
def _(t):
    return ln.name_search(listings(t), "CLI|err")


@query("P11_identity_bridge", "symbol entity has_terminal_form:i match_count:i figi_count:i names in_directory:i",
       """WITH c AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS entity, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS has_terminal_form FROM supplier),
       m AS (SELECT l_suppkey AS k, count(*) AS match_count, count(DISTINCT l_partkey) AS figi_count, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS names FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
       SELECT c.symbol, c.entity, has_terminal_form, coalesce(match_count, 0) AS match_count, coalesce(figi_count, 0) AS figi_count, coalesce(names, '') AS names, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.k AND o_totalprice > 400000) THEN 1 ELSE 0 END AS in_directory FROM c LEFT JOIN m USING (k)""")
def _(t):
    forms = F.when(F.col("s_acctbal") < 0, F.array(F.lit("8-K"), F.lit("25-NSE"))).otherwise(F.array(F.lit("10-K")))
    doc = F.to_json(F.struct(F.col("s_name").alias("name"), F.struct(F.struct(forms.alias("form")).alias("recent")).alias("filings")))
    cases = t.table("supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), doc.alias("filings"))
    m = t.table("lineitem").where(F.col("l_quantity") > 49).select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_partkey").alias("figi"), F.col("l_returnflag").alias("name"))
    d = t.table("orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").cast("string").alias("symbol"))
    return ln.identity_bridge(cases, m, d)


@query("Q01_refresh_returns", "decision_id entry_price:r fwd_return_1d:r fwd_return_5d:r fwd_return_20d:r fwd_return_60d:r", f"WITH {FWD_SQL} SELECT *, entry AS entry_price FROM fwd", digits=5)
def _(t):
    return tracked(t)


@query("Q02_evaluate_outcomes", "outcome_id decision_id evaluation_horizon_days:i evaluation_date:d return_pct:r barrier_result barrier_date:d status", "SELECT * FROM outcomes")
def _(t):
    return tr.evaluate_outcomes(t.staged("decisions"), t.prices())


BOARD_SQL = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY probability_up DESC, horizon_days, as_of_date DESC, model_name DESC) AS k FROM preds WHERE probability_up >= 0.55) WHERE k = 1),
       hold AS (SELECT ticker, sum(volume) AS quantity FROM raw_bars WHERE date >= (SELECT max(date) - 20 FROM raw_bars) AND returnflag = 'A' GROUP BY 1), px AS (SELECT ticker, arg_max(close_price, date) AS close_price FROM prices GROUP BY 1),
       hv AS (SELECT hold.ticker, quantity, quantity * close_price AS market_value FROM hold LEFT JOIN px USING (ticker)), hw AS (SELECT *, market_value / ((SELECT sum(market_value) FROM hv) + 1000) AS portfolio_weight FROM hv),
       b AS (SELECT w.*, px.close_price AS entry_price, best.probability_up AS model_probability_up, best.horizon_days AS model_horizon_days, coalesce(hw.quantity, 0) AS quantity, coalesce(hw.portfolio_weight, 0) AS portfolio_weight,
             CASE WHEN coalesce(hw.quantity, 0) > 0 THEN 1 ELSE 0 END AS is_holding, CASE WHEN w.ticker IN (SELECT ticker FROM symbols WHERE security_type = 'ETF') THEN 1 ELSE 0 END AS in_shortlist FROM watch w LEFT JOIN px USING (ticker) LEFT JOIN best USING (ticker) LEFT JOIN hw USING (ticker)),
       p AS (SELECT *, CASE WHEN is_holding = 1 AND model_probability_up >= 0.6 AND confidence >= 60 THEN 'hold / consider add' WHEN is_holding = 1 AND rank <= 10 THEN 'hold' WHEN is_holding = 1 THEN 'review reduce'
             WHEN model_probability_up >= 0.6 AND rank <= 10 AND confidence >= 60 THEN 'paper buy candidate' WHEN rank <= 10 THEN 'watch' ELSE 'avoid for now' END AS decision,
             greatest(0, floor(1000000 * 0.01 / (entry_price * CASE WHEN vol_60d > 0 THEN least(0.18, greatest(0.05, vol_60d * 2)) ELSE 0.08 END))) AS paper_quantity_1pct_risk FROM b),
       board AS (SELECT *, CASE decision WHEN 'hold / consider add' THEN 0 WHEN 'paper buy candidate' THEN 1 WHEN 'hold' THEN 2 WHEN 'watch' THEN 3 WHEN 'review reduce' THEN 4 ELSE 5 END AS decision_priority,
             concat_ws('; ', 'watchlist rank ' || CAST(rank AS VARCHAR), printf('%.1f%% model probability', model_probability_up * 100) || coalesce(' over ' || CAST(model_horizon_days AS VARCHAR) || 'd', ''),
             CASE WHEN is_holding = 1 THEN printf('already held at %.1f%% of portfolio', portfolio_weight * 100) END) AS why FROM p)"""


def holdings(t):
    b = t.raw_bars()
    last = b.select(F.date_sub(F.max("date"), 20)).scalar()
    return stage(b.where((F.col("date") >= last) & (F.col("returnflag") == "A")).groupBy("ticker").agg(F.sum("volume").alias("quantity")))


def board(t):
    # the watch list is short: predictions and prices of its tickers only
    q = t.predicted().where(F.col("probability_up") >= 0.55).select("ticker", "probability_up", "horizon_days", "as_of_date", "model_name")
    watch = t.staged("watch")
    px = t.prices().join(watch.select("ticker"), "ticker", "left_semi").groupBy("ticker").agg(F.max_by("close_price", "date").alias("entry_price"))
    w = stage(watch.join(px, "ticker", "left"))
    return tr.decision_board(w, q, tr.holdings_value(holdings(t), t.prices(), 1000.0), t.symbols().where(F.col("security_type") == "ETF"), 1_000_000.0)


@query("Q03_apply_policy", "ticker rank:i decision why paper_quantity_1pct_risk:i decision_priority:i is_holding:i in_shortlist:i", f"WITH {BOARD_SQL} SELECT * FROM board")
def _(t):
    return board(t)


@query("Q04_decision_records", "decision_id ticker action reference_price:r stop_loss:r target_price:r paper_quantity:i risk_dollars:r",
       f"""WITH {BOARD_SQL}, r AS (SELECT *, decision = 'paper buy candidate' AND entry_price > 0 AS buy, CASE WHEN vol_60d IS NULL THEN 0.08 ELSE least(0.18, greatest(0.05, vol_60d * 2)) END AS sh FROM board)
       SELECT substr(sha256('2001-06-30|' || ticker || '|' || decision || '|' || coalesce(CAST(model_horizon_days AS VARCHAR), '') || '|baseline_v1'), 1, 20) AS decision_id, ticker, decision AS action, entry_price AS reference_price, CASE WHEN buy THEN entry_price * (1 - sh) END AS stop_loss,
       CASE WHEN buy THEN entry_price * (1 + 2 * sh) END AS target_price, CASE WHEN buy THEN paper_quantity_1pct_risk ELSE 0 END AS paper_quantity, CASE WHEN buy AND paper_quantity_1pct_risk > 0 THEN abs(entry_price - entry_price * (1 - sh)) * paper_quantity_1pct_risk END AS risk_dollars FROM r""", digits=4)
def _(t):
    return tr.decision_records(board(t), "2001-06-30")


@query("Q05_constraint_status", "ticker decision constraint_status constraint_reason",
       f"""WITH {BOARD_SQL}, s AS (SELECT 9000.0 AS equity, 12000.0 AS power, 2 AS day_trades, 3 AS weekly, 3 AS max_day, 4 AS max_week),
       x AS (SELECT b.*, decision LIKE '%buy%' OR decision LIKE '%add%' AS buys, decision LIKE '%reduce%' AS sells, paper_quantity_1pct_risk * entry_price AS notional FROM board b)
       SELECT ticker, decision, CASE WHEN NOT (buys OR sells) THEN 'no trade' WHEN buys AND notional > 12000 THEN 'blocked' ELSE 'caution' END AS constraint_status,
       CASE WHEN NOT (buys OR sells) THEN 'No trade is implied by this action.' ELSE concat_ws(' ', 'Only one day trade remains in the rolling 5-trading-day budget.',
            CASE WHEN buys AND notional > 12000 THEN 'Estimated notional $' || format('{{:,.2f}}', notional) || ' exceeds buying power $12,000.00.' END, 'Only one trade remains in the weekly trade budget.') END AS constraint_reason FROM x""")
def _(t):
    snap = t.table("region").select(
        F.date_add(F.lit("2001-01-01").cast("date"), F.col("r_regionkey")).alias("snapshot_at"), F.when(F.col("r_regionkey") == 4, 9000.0).otherwise(50_000.0).alias("equity"), F.lit(12_000.0).alias("buying_power"), F.lit(500.0).alias("cash"),
        F.lit(2).alias("day_trades_5d"), F.lit(3).alias("weekly_trades"),
        # the snapshot carries no maxima: the defaults hold
        F.lit(None).cast("int").alias("max_day_trades_5d"), F.lit(None).cast("int").alias("max_weekly_trades"))
    return tr.constraint_status(board(t), snap)


@query("Q06_decision_board", "ticker rank:i decision decision_priority:i model_probability_up:r model_horizon_days:i quantity:r portfolio_weight:r", f"WITH {BOARD_SQL} SELECT * FROM board")
def _(t):
    return board(t)


@query("F08_rank_decisions", "ticker rank:i decision decision_priority:i", f"WITH {BOARD_SQL} SELECT * FROM board ORDER BY decision_priority, rank, model_probability_up DESC NULLS LAST, ticker LIMIT 25")
def _(t):
    return tr.rank_decisions(board(t), 25)


@query("M15_holdings_value", "ticker quantity:r market_value:r portfolio_weight:r", f"WITH {BOARD_SQL} SELECT * FROM hw")
def _(t):
    return tr.holdings_value(holdings(t), t.prices(), 1000.0)


@query("Q07_latest_snapshot", "ticker as_of_date:d horizon_days:i model_name probability_up:r", "SELECT * FROM preds WHERE as_of_date = (SELECT max(as_of_date) FROM preds) ORDER BY probability_up DESC LIMIT 10000")
def _(t):
    return vw.latest_snapshot(t.staged("preds"), "as_of_date", [F.desc("probability_up"), F.asc("ticker")], 10_000)


@query("Q07_history", "ticker as_of_date:d model_rank:i", "SELECT ticker, as_of_date, model_rank FROM preds WHERE model_name = 'slow' AND horizon_days = 20 AND as_of_date >= (SELECT min(d) FROM (SELECT DISTINCT as_of_date AS d FROM preds WHERE model_name = 'slow' AND horizon_days = 20 ORDER BY d DESC LIMIT 30))")
def _(t):
    p = t.staged("preds").where((F.col("model_name") == "slow") & (F.col("horizon_days") == 20))
    return vw.trail(p, "as_of_date", 30)


@query("Q07_ticker_detail", "ticker date:d close_price:r volume:r", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices) WHERE k <= 120", digits=5)
def _(t):
    return vw.recent_prices(t.prices(), 120)


@query("Q07_universe_status", "status reason n:i", "SELECT CASE WHEN acctbal < 0 THEN 'rejected' ELSE 'passed' END AS status, security_type AS reason, count(*) AS n FROM symbols GROUP BY 1, 2")
def _(t):
    return vw.status_counts(t.symbols().select(F.when(F.col("acctbal") < 0, "rejected").otherwise("passed").alias("status"), F.col("security_type").alias("reason")), ["status", "reason"])


@query("Q07_paper_performance", "decision_horizon_days:i action decisions:i outcome_events:i average_return:r median_return:r win_rate:r",
       "SELECT decision_horizon_days, action, count(DISTINCT decision_id) AS decisions, count(*) AS outcome_events, avg(return_pct) AS average_return, median(return_pct) AS median_return, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM outcomes WHERE decision_horizon_days = evaluation_horizon_days AND return_pct IS NOT NULL GROUP BY 1, 2")
def _(t):
    return vw.paper_performance(t.staged("outcomes"))

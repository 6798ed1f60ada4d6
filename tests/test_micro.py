"""Hand-computed frames for the cases that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as sc
from tessella.operators import clean, features, graph, joins, metrics, portfolio, screens, sets, splits, targets, tracking
from tessella.operators import cross_section as xs
from tessella.sources import readers, sinks
from tessella.sources.domain import Domain

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
PX = "ticker string, date date, close_price double, volume double"


def prices(spark, closes, ticker="A", volume=10.0):
    return spark.createDataFrame([(ticker, D(i), float(c), volume) for i, c in enumerate(closes)], PX)


def vals(df, c, *order):
    return [r[c] for r in df.orderBy(*(order or ("date",))).collect()]


def test_flat_window_has_no_slope_and_no_z(spark):
    p = prices(spark, [5.0] * 60)
    assert vals(features.trend_ols(p, 60), "trend_slope_60d")[-1] is None
    assert vals(features.ma_features(p), "z_ma20")[-1] is None


def test_constant_returns_have_no_autocorrelation(spark):
    p = features.pct_change(prices(spark, [1, 2, 4, 8, 16, 32, 64]), 1)
    assert vals(features.roll_ac1(p, 5), "ac1_5d")[-1] is None


def test_constant_scores_have_no_rank_ic(spark):
    df = spark.createDataFrame([("g", 0.5, 1.0), ("g", 0.5, 2.0), ("h", 0.1, 1.0), ("h", 0.2, 2.0)], "g string, s double, r double")
    assert {r["g"]: r["rank_ic"] for r in metrics.rank_ic(df, ["g"], "s", "r").collect()} == {"g": None, "h": pytest.approx(1.0)}


def test_since_max_takes_the_oldest_maximum(spark):
    p = prices(spark, [1, 9, 2, 9, 3])
    assert vals(features.since_max(p, 5, "m"), "m") == [None, None, None, None, 3]


def test_drawdown_inside_window(spark):
    p = prices(spark, [10, 5, 8, 4])
    assert vals(features.roll_mdd(p, 4, "m"), "m")[-1] == pytest.approx(-0.6)


def test_group_of_one_has_no_leave_one_out(spark):
    df = spark.createDataFrame([("A", D(0), 1.0), ("A", D(1), 2.0), ("B", D(1), 4.0)], "ticker string, date date, r double")
    out = {(r["ticker"], r["date"]): r["m"] for r in xs.loo_mean(df, ["date"], "r", "m", "n").collect()}
    assert out == {("A", D(0)): None, ("A", D(1)): 4.0, ("B", D(1)): 2.0}


def test_zscore_of_flat_date_is_zero(spark):
    df = spark.createDataFrame([("A", D(0), 3.0), ("B", D(0), 3.0)], "ticker string, date date, r double")
    assert vals(xs.xs_zscore(df, "r", "z"), "z") == [0.0, 0.0]


def test_scrub_drops_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r["x"] for r in targets.scrub(df, ["x"]).collect()] == [1.0]


def test_expired_interval_gives_null_even_if_an_older_one_overlaps(spark):
    left = spark.createDataFrame([("A", D(0)), ("A", D(5)), ("A", D(9))], "ticker string, date date")
    iv = spark.createDataFrame([("A", "old", D(0), None), ("A", "new", D(3), D(6))], "ticker string, sector string, valid_from date, valid_to date")
    assert vals(joins.asof_interval_join(left, iv, "sector"), "sector") == ["old", "new", None]


def test_interval_end_is_open(spark):
    left = spark.createDataFrame([("A", D(6))], "ticker string, date date")
    iv = spark.createDataFrame([("A", "x", D(3), D(6))], "ticker string, sector string, valid_from date, valid_to date")
    assert vals(joins.asof_interval_join(left, iv, "sector"), "sector") == [None]


def test_nth_row_counts_rows_not_days(spark):
    p = spark.createDataFrame([("A", D(0), 1.0, 1.0), ("A", D(9), 2.0, 1.0), ("A", D(30), 3.0, 1.0)], PX)
    d = spark.createDataFrame([("A", D(2), "x")], "ticker string, date date, id string")
    r = joins.nth_row_after(d, p, 2).first()
    assert (r["target_date"], r["target_close"]) == (D(30), 3.0)
    assert joins.nth_row_after(d, p, 3).first()["target_close"] is None


def test_decision_before_first_price(spark):
    p = prices(spark, [1, 2, 3])
    d = spark.createDataFrame([("A", dt.date(2019, 1, 1))], "ticker string, date date")
    assert joins.nth_row_after(d, p, 1).first()["target_close"] == 1.0


def test_strict_merge_fails_on_unmatched_and_duplicates(spark):
    p = prices(spark, [1, 2])
    m = spark.createDataFrame([(D(0), "A", 1, "ok")], "as_of_date date, ticker string, universe_eligible int, eligibility_reason string")
    with pytest.raises(Exception, match="strict merge"):
        joins.strict_merge(p, m).collect()
    full = m.unionByName(m.withColumn("as_of_date", F.lit(D(1))))
    assert joins.strict_merge(p, full).count() == 2
    with pytest.raises(Exception, match="strict merge"):
        joins.strict_merge(p.unionByName(p), full).collect()


def test_stop_wins_a_tie_and_unavailable_needs_market_dates(spark):
    p = prices(spark, [10, 10, 10, 10]).unionByName(prices(spark, [10, 1], "B"))
    d = spark.createDataFrame([("1", "A", D(0), "buy", 2, 10.0, 10.0, 10.0), ("2", "B", D(0), "buy", 2, 10.0, 5.0, 20.0)],
                              "decision_id string, ticker string, source_date date, action string, horizon_days int, reference_price double, stop_loss double, target_price double")
    out = {r["decision_id"]: r for r in tracking.evaluate_outcomes(d, p, horizons=(2,)).collect()}
    assert out["1"]["status"] == "stopped" and out["1"]["barrier_date"] == D(1)
    assert out["2"]["status"] == "unavailable" and out["2"]["evaluation_date"] == D(2) and out["2"]["return_pct"] is None
    again = tracking.evaluate_outcomes(d, p, tracking.evaluate_outcomes(d, p, horizons=(2,)), (2,))
    assert again.count() == 0


def test_single_class_auc_is_null_and_ties_count_half(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.9, 1), ("b", 0.5, 0), ("b", 0.5, 1), ("c", 0.2, 0), ("c", 0.8, 1)], "g string, probability double, label int")
    assert {r["g"]: r["roc_auc"] for r in metrics.auc(df, ["g"]).collect()} == {"a": None, "b": 0.5, "c": 1.0}


def test_bin_edges(spark):
    df = spark.createDataFrame([("g", 0.1, 1), ("g", 0.0, 0), ("g", 1.0, 1)], "g string, probability double, label int")
    assert sorted(r["bin"] for r in metrics.reliability(df, ["g"]).collect()) == [0, 9]
    assert metrics.ece(df, ["g"]).first()["ece"] == pytest.approx(0.3)


def test_turnover_starts_at_one(spark):
    s = spark.createDataFrame([("A", D(0), .9, .1), ("B", D(0), .8, .2), ("C", D(0), .1, .3), ("A", D(1), .9, .1), ("C", D(1), .8, .3)], "ticker string, date date, score double, ret double")
    assert vals(portfolio.topk_daily(s, [], 2, 10), "turnover") == [1.0, 0.5]


def test_rebalance_date_without_survivors_reselects(spark):
    rows = [("A", D(0), .9, .1), ("B", D(1), .9, .2), ("B", D(2), .9, .3), ("A", D(3), .9, .4)]
    s = spark.createDataFrame([(t, d, p, r, 1.0, 1.0, 1.0, 1.0, 1.0) for t, d, p, r in rows],
                              "ticker string, date date, probability double, forward_return double, ret_20d double, dollar_vol_20d_log double, graph_degree double, graph_similarity_mean double, neighbor_confirmation double")
    out = portfolio.scenario_battery(s, [1], [3], [0.0], ["plain_probability"]).where("segment = 'all'")
    assert vals(out, "gross_return") == [.1, .2, .3, .4]
    assert vals(out, "turnover") == [1.0, 0.0, 0.0, 1.0]


def test_sleeve_weights_and_first_turnover(spark):
    p = spark.createDataFrame([("A", D(0), .9)], "ticker string, date date, score double")
    r = spark.createDataFrame([("A", D(i), 0.1 if i else None) for i in range(4)], "ticker string, date date, residual_return_1d double")
    out = portfolio.sleeve_replay(p, r, [], 1, 2, 0.0)
    assert vals(out, "invested_weight") == [.5, .5, 0.0]
    assert vals(out, "turnover") == [.5, 0.0, .5]
    assert vals(out, "missing_return_weight")[0] == .5


def test_upsert_keeps_entry_and_ignores_null_return(spark):
    sch = "k string, entry_price double, fwd double, note string"
    old = spark.createDataFrame([("a", 1.0, 0.5, "x"), ("b", None, 0.1, "y")], sch)
    new = spark.createDataFrame([("a", 2.0, None, "z"), ("c", 3.0, 0.2, "w")], sch)
    got = {r["k"]: tuple(r)[1:] for r in sinks.upsert_coalesce(old, new, ["k"], ["entry_price"], ["fwd"]).collect()}
    assert got == {"a": (1.0, 0.5, "z"), "b": (None, 0.1, "y"), "c": (3.0, 0.2, "w")}


def test_dedup_best_prefers_first_of_equals(spark):
    df = spark.createDataFrame([("A", None, 5.0, 1), ("A", 2, 1.0, 2), ("A", 2, 1.0, 3)], "ticker string, n int, v double, seq int")
    assert clean.dedup_best(df, ["ticker"], ["n", "v"], ["seq"]).first()["seq"] == 2


def test_trading_window_must_be_complete(spark):
    p = prices(spark, [1, 2, 3])
    assert clean.trading_window(p, str(D(2)), 3).count() == 3
    with pytest.raises(Exception, match="trading dates"):
        clean.trading_window(p, str(D(2)), 4).collect()


def test_latest_context_skips_empty_columns(spark):
    df = spark.createDataFrame([(None, "2020-01-02", "1"), (None, "2020-01-02", "2"), (None, "2020-01-01", "9")], "a string, b string, run_id string")
    assert [r["run_id"] for r in clean.latest_context(df, ["a", "b"]).collect()] == ["2"]


def test_screen_order_of_reasons(spark):
    rules = screens.ScreenRules(min_price=3, min_volume=5, min_dollar_volume=1, max_std=0.5)
    p = prices(spark, [1, 1, 1], "cheap").unionByName(prices(spark, [9, 9, 9], "thin", 1.0)).unionByName(prices(spark, [4, 40, 4], "wild")).unionByName(prices(spark, [4, 4, 4], "fine"))
    got = {r["ticker"]: r["reason"] for r in screens.screen(p, rules).collect()}
    assert got == {"cheap": "Price < $3", "thin": "Liquidity fail", "wild": "Volatility fail", "fine": None}


def test_symbols(spark):
    df = spark.createDataFrame([("BRK.B",), ("SHOP.TO",), ("ABC.PRA",), ("XYZ-WS",), (" goog ",)], "s string")
    got = [(r["b"], r["w"]) for r in df.select(sc.canonical_base("s").alias("b"), sc.is_warrant_or_unit("s").alias("w")).collect()]
    assert got == [("BRK", False), ("SHOP", False), ("ABC", False), ("XYZWS", True), ("GOOG", False)]


def test_probability_words_on_the_edges(spark):
    df = spark.createDataFrame([(0.70,), (0.55,), (0.40,), (0.41,)], "p double")
    assert [r["w"] for r in df.select(sc.describe_probability("p").alias("w")).collect()] == [
        "strong bullish research signal", "modest bullish lean", "bearish/avoid signal", "neutral / watch only"]


def test_driver_text(spark):
    df = spark.range(1).select(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(n).alias("name")) for n, v in (("a", .5), ("b", -.25), ("c", 1.0), ("d", .1), ("e", .2))]).alias("x"))
    assert df.select(sc.driver_text("x").alias("t")).first()["t"] == "c (+1.00); a (+0.50); e (+0.20)"
    assert df.select(sc.driver_text("x", False).alias("t")).first()["t"] == "b (-0.25)"


def test_driver_text_rounds_the_exact_value(spark):
    values = [1.005, 0.125, 0.375, -0.005, 0.145, 2.675, -1.115, 8.345, 0.015, 12.34, 123.455]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", sc.driver_text(F.array(F.struct(F.col("v").alias("value"), F.lit("x").alias("name"))), True).alias("up"),
                                                                         sc.driver_text(F.array(F.struct(F.col("v").alias("value"), F.lit("x").alias("name"))), False).alias("down"))
    assert {r.v: r.up or r.down for r in df.collect()} == {v: f"x ({v:+.2f})" for v in values}


def test_champion_rows_of_equal_rank_and_ticker_go_by_date(spark):
    from tessella.operators import clean
    df = spark.createDataFrame([(D(i), "a", 5, "slow", 1) for i in range(9, -1, -1)], "as_of_date date, ticker string, horizon_days int, model_name string, model_rank int")
    got = clean.flag_champions(df, df.limit(1).select("horizon_days", "model_name"), 3).collect()
    assert sorted(r.as_of_date for r in got) == sorted(r[0] for r in spark.createDataFrame([(D(i),) for i in range(3)], "d date").collect())


def test_liquidity_and_residual_ranks_tie_whatever_the_order_of_sums(spark):
    df = spark.createDataFrame([(D(0), t, v, r, "s") for t, v, r in (("b", 5.0 + 1e-15 * 8, .3), ("a", 5.0, .1 + .2), ("c", 4.0, .1))],
                               "date date, ticker string, dollar_vol_20d_log double, future_return double, sector string")
    assert {r.ticker: r.liquidity_rank for r in xs.top_liquidity(df, 3).collect()} == {"a": 1, "b": 2, "c": 3}
    ranks = {r.ticker: r.primary_residual_rank_pct for r in xs.residual_targets(df).collect()}
    assert ranks["a"] == ranks["b"]


def test_components_chain_hub_and_pair(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("hub", f"leaf{i}") for i in range(50)] + [("x", "y")]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"}
    assert {got[f"leaf{i}"] for i in range(50)} == {"hub"} and got["y"] == "x"


def test_blocked_pairs_do_not_depend_on_tiles(spark):
    import random
    r = random.Random(3)
    from tessella.operators import blocks
    df = spark.createDataFrame([(f"t{k:02d}", D(i), float(r.choice([-1, 0, 1]))) for k in range(23) for i in range(80) if r.random() < .8], "ticker string, date date, dir double")
    prof = blocks.profiles(df, "dir")
    big = {tuple(x) for x in blocks.similar_pairs(prof, 20, 0.05, tile=1000).collect()}
    small = {tuple(x) for x in blocks.similar_pairs(prof, 20, 0.05, tile=5).collect()}
    assert big == small and big


def test_diversified_selection_fills_up(spark):
    df = spark.createDataFrame([(f"t{i}", D(0), 1.0 - i / 10, 0 if i < 4 else -1) for i in range(6)], "ticker string, date date, score double, cluster int")
    assert [r["ticker"] for r in sets.diversified_top_k(df, 5, 2).orderBy("pick").collect()] == ["t0", "t1", "t4", "t5", "t2"]


def test_permutation_keeps_every_date_whole(spark):
    df = spark.createDataFrame([(f"t{i}", D(i % 3), float(i)) for i in range(200)], "ticker string, date date, v double")
    out = splits.permute_within(df, ["v"], ["date"], ["ticker"], 5)
    a = {d: sorted(r["v"] for r in df.where(F.col("date") == d).collect()) for d in (D(0), D(1), D(2))}
    b = {d: sorted(r["v"] for r in out.where(F.col("date") == d).collect()) for d in a}
    assert a == b and out.exceptAll(df).count() > 100


def test_purge_uses_evaluation_dates(spark):
    rows = [("A", D(i), D(i + (5 if i == 3 else 1))) for i in range(10)]
    out = splits.purged_splits(spark.createDataFrame(rows, "ticker string, date date, evaluation_date date"), 1, 4, 1).first()
    assert out["test_start"] == D(6) and out["train_decision_max"] == D(4) and out["training_dates"] == 4


def test_pipe_directory_drops_header_and_footer(spark):
    df = spark.createDataFrame([("Symbol|Name",), ("A| x ",), (" |y",), ("File Creation Time|1",)], "value string")
    assert [tuple(r) for r in readers.parse_pipe(df, ["Symbol", "Name"], "Symbol").collect()] == [("A", "x")]


def test_normal_cdf(spark):
    got = spark.range(1).select(*[portfolio.normal_cdf(F.lit(x)).alias(str(i)) for i, x in enumerate((-2.0, 0.0, 1.5))]).first()
    for g, x in zip(got, (-2.0, 0.0, 1.5)):
        assert g == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-6)


def test_late_bars_are_skipped_and_leave_features_alone(frame):
    import datetime as dt

    from tessella.operators.features import research_features
    from tessella.streaming.incremental import features_incremental, later_bars

    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=2 * k)
    bars = [("a", day(k), 10.0 + (k * k) % 17, 100.0) for k in range(300)] + [("b", day(k), 5.0 + k % 7, 50.0) for k in range(40)]
    schema = "ticker string, date date, close_price double, volume double"
    history = frame([b for b in bars if b[1] <= day(250)], schema)
    late = [("a", day(100) + dt.timedelta(days=1), 99.0, 1.0), ("b", day(20) + dt.timedelta(days=1), 99.0, 1.0)]
    new = frame([b for b in bars if b[1] > day(240)] + late + [("a", day(299), 1.0, 1.0)], schema)
    assert {(r.ticker, r.date) for r in later_bars(history, new).collect()} == {("a", day(k)) for k in range(251, 300)}
    got = {(r.ticker, r.date): r.ret_60d for r in features_incremental(history, new).collect()}
    want = {(r.ticker, r.date): r.ret_60d for r in research_features(frame(bars, schema)).collect() if r.date > day(250)}
    assert got == pytest.approx(want) and None not in got.values()


def test_candidate_rows_without_close_or_volume_have_no_rank(frame):
    import datetime as dt

    from tessella.operators.lineage import candidate_membership

    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    source = frame([("s", day(k), 1.0, 1.0) for k in range(12)], "ticker string, date date, close_price double, volume double")
    name = "e" * 1200
    rows = [(name, "c", day(k), None if k == 8 else 2.0, None if k == 9 else 10.0) for k in range(12)]
    cand = frame(rows, "entity_id string, ticker string, date date, close_price double, volume double")
    got = {r.date: r for r in candidate_membership(source, cand, "2020-01-01", "2020-02-01", 3, 10).collect()}
    assert {r.entity_id for r in got.values()} == {name}
    assert [got[day(k)].eligibility_reason for k in (1, 7, 8, 9, 10)] == [
        "insufficient_20_date_history", "eligible_missing_past_only", "missing_liquidity_rank", "missing_liquidity_rank", "eligible_missing_past_only"]
    assert got[day(8)].mean_dollar_volume is None and got[day(10)].mean_dollar_volume == 20.0


def test_constraints_without_maxima_use_the_defaults(frame):
    from tessella.operators.tracking import constraint_status

    board = frame([("a", "paper buy candidate", 10, 100.0), ("b", "hold", 0, 1.0)], "ticker string, decision string, paper_quantity_1pct_risk int, entry_price double")
    cols = "snapshot_at string, equity double, buying_power double, cash double, day_trades_5d int, weekly_trades int, max_day_trades_5d int, max_weekly_trades int"
    reason = lambda rows: {r.ticker: (r.constraint_status, r.constraint_reason) for r in constraint_status(board, frame(rows, cols)).collect()}
    got = reason([("2020", 100.0, 900.5, 1.0, 2, 4, None, None)])
    assert got["a"] == ("blocked", "Weekly trade budget is used up. Estimated notional $1,000.00 exceeds buying power $900.50.")
    assert got["b"] == ("no trade", "No trade is implied by this action.")
    assert reason([("2020", 100.0, 5000.0, 1.0, 2, 0, 0, 0)])["a"] == ("caution", "Only one day trade remains in the rolling 5-trading-day budget.")
    assert reason([])["a"][1].startswith("No local trading constraint snapshot")


def test_long_chains_have_one_component(frame):
    from tessella.operators.graph import components

    pairs = [(f"{k:03d}", f"{k + 1:03d}") for k in range(70)]
    got = {r.component for r in components(frame(pairs, "a string, b string")).collect()}
    assert got == {"000"}


def test_listed_tickers_without_bars_have_no_history(frame):
    from tessella.operators.screens import screen

    px = frame([("a", "2020-01-01", 5.0, 1.0)], "ticker string, date string, close_price double, volume double")
    got = {r.ticker: (r.bars, r.reason) for r in screen(px, listing=frame([("a",), ("z",)], "ticker string")).collect()}
    assert got["z"] == (0, "No history") and got["a"][0] == 1


def test_artifact_flags_follow_the_layout(frame):
    from tessella.operators.warehouse import artifact_health

    rows = [("r", "runs\\r\\analytics\\latest_model_predictions.csv"), ("r", "runs/r/analytics/model_tournament_evaluation.csv"), ("r", "runs/r/dashboard_data.db")]
    files = frame([(*x, 1, "2020-01-02", None, None) for x in rows], "run_id string, path string, bytes long, exported_at string, model_as_of_date string, latest_market_date string")
    r = artifact_health(files).first()
    assert (r.has_predictions, r.has_model_scores, r.has_dashboard_db, r.has_monte_carlo, r.analysis_ready) == (1, 1, 1, 0, 1)


def test_first_others_without_pairs_of_the_group(spark):
    df = spark.createDataFrame([("g", f"t{i:02d}", float(i // 3)) for i in range(12)] + [("h", "x", 1.0), (None, "y", 1.0)], "grp string, ticker string, v double")
    got = {}
    for r in sets.first_others(df, "grp", "ticker", [F.desc("v"), F.asc("ticker")], 3, "other").collect():
        got.setdefault(r["ticker"], set()).add(r["other"])
    order = sorted((f"t{i:02d}" for i in range(12)), key=lambda t: (-(int(t[1:]) // 3), t))
    assert got == {t: set([o for o in order if o != t][:3]) for t in order}


def test_return_pools_of_own_and_market_returns(spark):
    preds = spark.createDataFrame([("A", 0.6), ("B", 0.5), ("Z", 0.4)], "ticker string, p double")
    rets = [("A", 0.1), ("A", -0.1), ("A", 0.1), ("B", 0.2), ("B", -0.2)]
    returns = spark.createDataFrame(rets, "ticker string, r double")
    near = spark.createDataFrame([("A", "B"), ("Q", "B")], "ticker string, neighbor string")
    out = {r["ticker"]: r for r in portfolio.return_pool_risk(preds, returns, near).collect()}
    assert {t: r["pool_rows"] for t, r in out.items()} == {"A": 5, "B": 2, "Z": 5}
    assert out["A"]["probability_positive"] == pytest.approx(0.6)
    assert [out["A"][c] for c in ("p10_return", "median_return", "p90_return")] == [-0.2, 0.1, 0.2]
    assert [out["B"][c] for c in ("p10_return", "median_return", "p90_return")] == [-0.2, -0.2, 0.2]


def test_group_edges_equal_edges_of_all_pairs(spark):
    rows = [("A", D(0), 1.0), ("A", D(1), None), ("B", D(0), 2.0), ("B", D(2), 5.0), ("C", D(1), 4.0), ("C", D(3), None), ("X", D(0), 9.0), ("X", D(5), 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, r double")
    groups = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("N", 1), ("X", 2), ("Y", None)], "ticker string, grp int")
    other = groups.select(F.col("ticker").alias("neighbor"), "grp")
    edges = groups.join(other, "grp").where("ticker <> neighbor").select("ticker", "neighbor")
    rows = lambda d: {(r["ticker"], r["date"]): r["m"] for r in d.collect()}
    got = rows(graph.group_edges(df, groups, "r", "m"))
    assert got == rows(graph.expand_edges(df, edges, {"m": "r"}))
    assert "CartesianProduct" not in graph.group_edges(df, groups, "r", "m")._jdf.queryExecution().toString()


def test_summary_of_the_newest_rows_equals_that_of_all(spark):
    closes = {"long": [10 + math.sin(i) * (1 + i / 50) for i in range(200)], "short": [10 + i % 7 for i in range(70)],
              "flat": [10 + math.cos(i) for i in range(120)] + [9.0] * 90, "edge": [5 + math.sin(3 * i) for i in range(81)], "few": [1.0, 2.0]}
    px = None
    for name, c in closes.items():
        one = prices(spark, c, name)
        px = one if px is None else px.unionByName(one)
    want = screens.feature_summary(features.research_features(px))
    rows = lambda d: {r["ticker"]: {c: pytest.approx(r[c], rel=1e-9, abs=1e-12) if isinstance(r[c], float) else r[c] for c in want.columns if c != "ticker"} for r in d.collect()}
    got = {r["ticker"]: {c: r[c] for c in want.columns if c != "ticker"} for r in screens.price_summary(px).collect()}
    assert got == rows(want) and set(got) == {"long", "short", "flat", "edge"}


def test_summary_computes_features_of_the_newest_rows_only(spark):
    px = prices(spark, [10 + math.sin(i) for i in range(1500)], "A")
    seen = []
    whole = features.research_features

    def counted(df):
        seen.append(df.count())
        return whole(df)

    features.research_features = counted
    try:
        screens.price_summary(px).collect()
    finally:
        features.research_features = whole
    assert sum(seen) == screens.REACH + screens.NEWEST


def test_interval_lookup_matches_asof_join(frame):
    left = frame([("A", D(1)), ("A", D(5)), ("A", D(9)), ("B", D(5)), ("C", D(5))], "ticker string, date date")
    iv = frame([("A", "x", D(2), None), ("A", "y", D(6), D(8)), ("B", "z", D(5), None), ("B", "w", None, None)], "ticker string, sector string, valid_from date, valid_to date")
    got = {(r.ticker, r.date): r.sector for r in joins.interval_lookup(left, iv, "sector").collect()}
    assert got == {("A", D(1)): None, ("A", D(5)): "x", ("A", D(9)): None, ("B", D(5)): "z", ("C", D(5)): None}
    known = iv.where("valid_from IS NOT NULL")
    assert got == {(r.ticker, r.date): r.sector for r in joins.asof_interval_join(left, known, "sector").collect()}


def test_residual_panel_writes_its_features_once(spark, sf_dir, monkeypatch):
    written = []
    real = targets.stage
    for module in (targets, xs):
        monkeypatch.setattr(module, "stage", lambda df, *a: (written.append(df.columns), real(df, *a))[1])
    t = Domain(spark, sf_dir)
    whole = t.labelled()
    assert sum("future_return" in c for c in written) == 1
    narrow = t.labels()
    assert not any("ret_20d" in c for c in written[-2:])
    whole = whole.select(*narrow.columns)
    assert narrow.count() > 0 and narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()

"""Queries on predictions and decisions write what they need once."""

import pytest

from tessella.operators import features, tracking, warehouse
from tessella.plans import load_catalog
from tessella.session import scratch
from tessella.sources import domain


@pytest.fixture
def asked(monkeypatch):
    """Names of the domain tables that are staged."""
    names = []
    real = domain.Domain.staged
    monkeypatch.setattr(domain.Domain, "staged", lambda self, name: (names.append(name), real(self, name))[1])
    domain.forget_staged()
    yield names
    domain.forget_staged()


@pytest.mark.parametrize("key", ["D08_quality_gates", "B12_filter_champions", "Q06_decision_board", "C01_research_queue", "D30_findings", "D31_ledger_health"])
def test_no_table_of_ranked_predictions_or_outcomes(spark, sf_dir, asked, key):
    with scratch(spark):
        load_catalog()[key].run(spark, sf_dir).collect()
    assert not {"preds", "outcomes"} & set(asked)


def test_board_without_ranks_equals_board_with_ranks(spark, frame):
    watch = frame([("A", 1, 70.0, 10.0, 0.1), ("B", 2, 50.0, 20.0, None)], "ticker string, rank int, confidence double, entry_price double, vol_60d double")
    queue = frame([("A", 0.7, 5, "2020-01-01", "m", 3), ("A", 0.7, 20, "2020-01-02", "m", 1), ("Z", 0.9, 5, "2020-01-01", "m", 1)],
                  "ticker string, probability_up double, horizon_days int, as_of_date string, model_name string, model_rank int")
    hold = tracking.holdings_value(frame([("B", 2.0)], "ticker string, quantity double"),
                                   frame([("B", 1, 5.0), ("B", 2, 7.0), ("A", 3, 9.0)], "ticker string, date int, close_price double"), 86.0)
    assert [(r.market_value, r.portfolio_weight) for r in hold.collect()] == [(14.0, 0.14)]
    short = frame([("A",)], "ticker string")
    ranked = tracking.decision_board(watch, queue, hold, short, 1000.0)
    plain = tracking.decision_board(watch, queue.drop("model_rank"), hold, short, 1000.0)
    assert sorted(plain.collect()) == sorted(ranked.select(*plain.columns).collect())
    assert {r.ticker: (r.model_horizon_days, r.decision) for r in plain.collect()} == {"A": (5, "paper buy candidate"), "B": (None, "hold")}


def test_summary_aggregates_are_hashed(spark, frame):
    from tessella.operators import screens

    px = frame([("A", i, float(i)) for i in range(3)], "ticker string, date int, close_price double")
    df = px.groupBy("ticker").agg(*screens._spans())
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.collect()[0].asDict() == {"ticker": "A", "start": 0, "end": 2, "n_rows": 3, "_p0": 0.0, "_p1": 2.0}


def test_shares_match_shape(spark, frame):
    p = frame([("g", "A", 0.95, 1), ("g", "B", 0.75, 2), ("g", "C", 0.5, 30)], "g string, ticker string, probability_up double, model_rank int")
    a, b = warehouse.signal_shares(p, ["g"]), warehouse.signal_shape(p, ["g"])
    assert a.collect() == b.select(*a.columns).collect()
    assert b.collect()[0].median_probability_up == 0.75 and b.collect()[0].top25_avg_probability == pytest.approx(0.85)


def test_features_of_the_newest_rows_equal_those_of_all_rows(spark, sf_dir, monkeypatch):
    """The snapshot behind pairs: a table of all features before."""
    from tessella.operators import screens
    from tessella.operators.joins import latest_rows
    from tessella.plans import q_graph

    cols = ["trend_slope_60d", "ret_60d", "vol_60d", "dollar_vol_20d"]
    px = domain.Domain(spark, sf_dir).prices()
    px = px.unionByName(px.limit(0)).where("hash(ticker) % 3 <> 0 OR date < '1995-12-01'")  # short histories too
    want = latest_rows(features.research_features(px).select("ticker", "date", *cols), ["ticker"], ["date"])
    got = screens.newest_features(px, cols)
    got, want = ({r.ticker: r for r in d.collect()} for d in (got, want))
    assert got.keys() == want.keys() and len(got) > 3
    for t, r in got.items():
        assert r.date == want[t].date and [r[c] for c in cols] == [v if v is None else pytest.approx(v, rel=1e-9) for v in (want[t][c] for c in cols)]
    asked = []
    monkeypatch.setattr(domain.Domain, "staged", lambda self, name: asked.append(name))
    q_graph.snap(domain.Domain(spark, sf_dir))
    assert asked == []


def test_types_stage_no_table_of_all_features(spark, sf_dir, asked):
    with scratch(spark):
        assert load_catalog()["E22_type_features"].run(spark, sf_dir).count() > 0
    assert "feats" not in asked


def test_graph_columns_of_test_dates_only(spark, sf_dir):
    """Eight neighbours a row are joined on the dates that are scored."""
    with scratch(spark):
        t = domain.Domain(spark, sf_dir)
        days = {r.date for r in t.staged("splits").where("role = 'test'").select("date").distinct().collect()}
        assert {r.date for r in t.gcols().select("date").distinct().collect()} <= days
    domain.forget_staged()

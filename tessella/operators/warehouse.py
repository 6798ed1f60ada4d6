"""Cross-run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import flag, ratio
from tessella.functions.ranking import quantiles
from tessella.functions.scalars import coalesce_dates, truthy
from tessella.session import stage

# Upper bounds and names of the probability buckets (right-closed).
BUCKETS = ((0.40, "<=40%"), (0.50, "40-50%"), (0.55, "50-55%"), (0.60, "55-60%"), (0.65, "60-65%"), (0.70, "65-70%"), (0.80, "70-80%"), (1.001, "80%+"))


def probability_bucket(c: str) -> Column:
    x = F.col(c)
    out = F
    for bound, name in BUCKETS:
        out = out.when((x > -0.001) & (x <= bound), name)
    return out.otherwise("unknown")


def model_scores(evals: DataFrame) -> DataFrame:
    """Successful fits per horizon and model over all runs."""
    return evals.where(F.col("fit_status") == "ok").groupBy("horizon_days", "model_name").agg(
        F.countDistinct("run_id").alias("runs"), F.sum(truthy("is_champion")).alias("champion_runs"), F.avg("champion_score").alias("avg_score"),
        F.avg("selected_return_edge").alias("avg_return_edge"), F.avg("roc_auc").alias("avg_roc_auc"),
        F.avg("brier_skill").alias("avg_brier_skill"), F.avg("walk_forward_avg_score").alias("avg_walk_forward_score"))


def suspicious_metric() -> Column:
    """Metrics too good to be true."""
    high = [F.col("roc_auc") >= 0.70, F.col("brier_skill") >= 0.20, F.col("accuracy_lift") >= 0.20]
    return flag(high[0]) + flag(high[1]) + flag(high[2]) > 0


def quality_gates(evals: DataFrame) -> DataFrame:
    """Gate flags and trust tier of every evaluation row."""
    c = F.col
    g = evals.withColumns({
        "is_champion_gate": truthy("is_champion"), "fit_ok_gate": flag(c("fit_status") == "ok"), "auc_gate": flag(c("roc_auc") >= 0.52),
        "brier_gate": flag(c("brier_skill") >= 0), "return_edge_gate": flag(c("selected_return_edge") > 0),
        "walk_forward_gate": flag((c("walk_forward_avg_score") > 0) & (
            F.coalesce("walk_forward_positive_splits", F.lit(0)) >= F.coalesce("walk_forward_splits", F.lit(0)) / 2)),
        "sample_gate": flag(c("test_rows") >= 1000), "leakage_review_flag": flag(suspicious_metric())})
    passed = c("auc_gate") + c("brier_gate") + c("walk_forward_gate") + c("return_edge_gate")
    return g.withColumn("trust_tier", F.when(c("leakage_review_flag") == 1, "leakage_review")
                        .when((c("is_champion_gate") == 1) & (passed == 4), "paper_review")
                        .when((c("is_champion_gate") == 1) & (passed >= 2), "watch").otherwise("research_only"))


def gate_summary(gates: DataFrame) -> DataFrame:
    return gates.groupBy("horizon_days", "model_name", "trust_tier").agg(
        F.count("run_id").alias("n_rows"), F.countDistinct("run_id").alias("runs"), F.sum("is_champion_gate").alias("champions"),
        F.avg("roc_auc").alias("avg_roc_auc"), F.avg("brier_skill").alias("avg_brier_skill"),
        F.avg("selected_return_edge").alias("avg_return_edge"), F.avg("walk_forward_avg_score").alias("avg_walk_forward_score"))


def recurrence(preds: DataFrame, top: int = 25) -> DataFrame:
    """How often, how high and until when a ticker appeared among the top ranks."""
    return preds.where(F.col("model_rank") <= top).groupBy("horizon_days", "ticker").agg(
        F.countDistinct("run_id").alias("appearances"), F.avg("model_rank").alias("avg_rank"),
        F.avg("probability_up").alias("avg_probability_up"), F.max("as_of_date").alias("latest_seen"))


def probability_buckets(preds: DataFrame) -> DataFrame:
    return preds.withColumn("probability_bucket", probability_bucket("probability_up")).groupBy(
        "run_id", "horizon_days", "model_name", "probability_bucket").agg(
        F.count("ticker").alias("n_rows"), F.avg("probability_up").alias("avg_probability_up"), F.min("probability_up").alias("min_probability_up"),
        F.max("probability_up").alias("max_probability_up"), F.avg("model_rank").alias("avg_rank"))


def signal_shares(preds: DataFrame, by, *more: Column) -> DataFrame:
    """Mean and tail shares, and what ``more`` aggregates, in one pass and without ranks."""
    p = F.col("probability_up")
    s = preds.groupBy(*by).agg(
        F.count("ticker").alias("n_rows"), F.avg(p).alias("avg_probability_up"), F.count_if(p >= 0.70).alias("high_confidence_rows"),
        F.count_if(p >= 0.90).alias("extreme_rows"), *more)
    return s.withColumns({"high_confidence_share": ratio("high_confidence_rows", "n_rows"), "extreme_share": ratio("extreme_rows", "n_rows")})


def signal_shape(preds: DataFrame, by=("run_id", "as_of_date", "horizon_days", "model_name")) -> DataFrame:
    """Mean, median, tail shares and the average of the first 25 ranks."""
    by = list(by)
    s = signal_shares(preds, by, F.avg(F.when(F.col("model_rank") <= 25, F.col("probability_up"))).alias("top25_avg_probability"))
    return s.join(quantiles(preds, by, "probability_up", {"median_probability_up": 0.5}), by, "left")


def stability(df: DataFrame, keys, metrics, rank_by: str | None = None, rank_in=()) -> DataFrame:
    """Runs, mean and deviation of metrics over runs, optionally ranked inside ``rank_in``.

    The result has one row per named feature or type, so the rank window is small."""
    aggs = [F.countDistinct("run_id").alias("runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"avg_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    s = df.groupBy(*keys).agg(*aggs)
    if rank_by is None:
        return s
    w = Window.partitionBy(*rank_in).orderBy(F.desc(rank_by), *[k for k in keys if k not in rank_in])
    return s.withColumn("importance_rank", F.row_number().over(w))


def pair_stability(pairs: DataFrame, n: int = 1000) -> DataFrame:
    """Canonical pairs over runs, most recurrent and similar first."""
    p = pairs.where(F.col("similarity").isNotNull() & (F.col("A") != F.col("B")) & (F.col("A") != "") & (F.col("B") != ""))
    s = p.groupBy(F.least("A", "B").alias("A"), F.greatest("A", "B").alias("B")).agg(
        F.countDistinct("run_id").alias("runs"), F.count("similarity").alias("observations"), F.avg("similarity").alias("avg_similarity"),
        F.stddev_samp("similarity").alias("std_similarity"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"))
    return s.orderBy(F.desc("runs"), F.round("avg_similarity", 12).desc(), "A", "B").limit(n)


def outcome_means(outcomes: DataFrame) -> DataFrame:
    """Evaluated outcomes, mean return and win rate per action and horizon, in one pass."""
    return outcomes.where(F.col("return_pct").isNotNull()).groupBy("action", "evaluation_horizon_days").agg(
        F.count("decision_id").alias("evaluated"), F.avg("return_pct").alias("avg_return"), F.avg(flag(F.col("return_pct") > 0)).alias("win_rate"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    by = ["action", "evaluation_horizon_days"]
    o = outcomes.where(F.col("return_pct").isNotNull())
    return outcome_means(outcomes).join(quantiles(o, by, "return_pct", {"median_return": 0.5}), by)


def calibration_proxy(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Observed win rate against mean probability per bucket, horizon and action."""
    d = decisions.select("decision_id", "horizon_days", "probability_up")
    j = outcomes.where(F.col("return_pct").isNotNull()).join(d, "decision_id", "left").withColumns({
        "probability_bucket": probability_bucket("probability_up"),
        "matching_horizon": F.coalesce(F.col("horizon_days") == F.col("evaluation_horizon_days"), F.lit(False)).cast("int")})
    by = ["action", "horizon_days", "evaluation_horizon_days", "probability_bucket", "matching_horizon"]
    j = stage(j.select("decision_id", "return_pct", "probability_up", *by))
    s = j.groupBy(*by).agg(F.count("decision_id").alias("evaluated"), F.avg("probability_up").alias("avg_probability_up"),
                           F.avg(flag(F.col("return_pct") > 0)).alias("observed_win_rate"), F.avg("return_pct").alias("avg_return"))
    s = s.join(quantiles(j, by, "return_pct", {"median_return": 0.5}), by, "left")
    return s.withColumn("calibration_gap", F.col("observed_win_rate") - F.col("avg_probability_up"))


def leakage_audit(evals: DataFrame) -> DataFrame:
    """Train before test, embargo equal to horizon, plausible metrics; the last finding names the row."""
    a = evals.withColumns({
        "train_before_test": flag(F.col("training_end") < F.col("test_start")),
        "embargo_matches_horizon": flag(F.col("embargo_dates") == F.col("horizon_days")),
        "has_walk_forward": flag(F.coalesce("walk_forward_splits", F.lit(0)) > 0), "too_good_to_be_true_metric": flag(suspicious_metric())})
    return a.withColumn("leakage_audit_status", F.when(F.col("too_good_to_be_true_metric") == 1, "metric_spike_review")
                        .when(F.col("embargo_matches_horizon") == 0, "embargo_review")
                        .when(F.col("train_before_test") == 0, "train_test_overlap_review").otherwise("ok"))


# Artifact flags and the path fragment that proves each.
ARTIFACTS = {
    "has_model_scores": "analytics/model_tournament_evaluation.csv",
    "has_predictions": "analytics/latest_model_predictions.csv",
    "has_candidate_predictions": "analytics/latest_model_candidate_predictions.csv",
    "has_monte_carlo": "analytics/latest_monte_carlo_simulations.csv",
    "has_paper_decisions": "analytics/automatic_paper_decisions.csv",
    "has_paper_outcomes": "analytics/automatic_paper_decision_outcomes.csv",
    "has_dashboard_db": "dashboard_data.db",
}


def artifact_health(files: DataFrame, artifacts: dict[str, str] = ARTIFACTS) -> DataFrame:
    """Per run: which artifacts exist, sizes, readiness and lag of the context date.

    ``files``: (run_id, path, bytes, exported_at, model_as_of_date, latest_market_date)."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    g = files.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files_copied"), F.sum("bytes").alias("bytes_copied"),
        *[F.max(flag(path.contains(needle))).alias(name) for name, needle in artifacts.items()],
        *[F.max(c).alias(c) for c in ("exported_at", "model_as_of_date", "latest_market_date")])
    context = coalesce_dates(["model_as_of_date", "latest_market_date", "exported_at"])
    return g.withColumns({
        "megabytes_copied": F.col("bytes_copied") / 1e6, "compact_only": flag((F.col("files_copied") < 10) & (F.col("bytes_copied") < 10_000_000)),
        "analysis_ready": F.col("has_model_scores") * F.col("has_predictions"),
        "context_lag_days": F.datediff(F.col("exported_at").try_cast("date"), context)})


def weekly_scores(evals: DataFrame, created: str = "test_end") -> DataFrame:
    return evals.where(F.col("fit_status") == "ok").groupBy(
        F.to_date(F.date_trunc("week", created)).alias("run_week"), "horizon_days", "model_name").agg(
        F.countDistinct("run_id").alias("runs"), F.avg("champion_score").alias("avg_score"), F.avg("selected_return_edge").alias("avg_return_edge"))


def policy_baselines(decisions: DataFrame, outcomes: DataFrame, buy: str = "paper buy candidate", threshold: float = 0.55) -> DataFrame:
    """Three overlapping policies per horizon: combined, watch-list only, model only."""
    j = outcomes.where(F.col("return_pct").isNotNull()).join(decisions.select("decision_id", "probability_up"), "decision_id", "left")
    labels = F.array_compact(F.array(
        F.when(F.col("action") == buy, F.lit("Combined policy")), F.lit("Watchlist-only"), F.when(F.col("probability_up") >= threshold, F.lit("Model-only"))))
    return j.withColumn("baseline", F.explode(labels)).groupBy("baseline", "evaluation_horizon_days").agg(
        F.count(F.lit(1)).alias("evaluated"), F.avg("return_pct").alias("average_return"), F.avg(flag(F.col("return_pct") > 0)).alias("win_rate"))


def paper_status(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Open, matured and unavailable decisions; an id that both matured and was unavailable is matured.

    ``outcomes`` is read once; what is written is a row per decision."""
    own = F.col("evaluation_horizon_days") == F.col("decision_horizon_days")
    per = stage(outcomes.groupBy("decision_id").agg(
        F.max(flag(own & F.col("status").isin("matured", "stopped", "targeted"))).alias("m"),
        F.max(flag(own & (F.col("status") == "unavailable"))).alias("u"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("status") == "unavailable").alias("lost")))
    ids = per.agg(F.sum("m").alias("matured"), F.count_if((F.col("m") == 0) & (F.col("u") == 1)).alias("unavailable_decisions"),
                  F.sum("events").alias("outcome_events"), F.sum("lost").alias("unavailable"))
    resolved = per.where((F.col("m") == 1) | (F.col("u") == 1)).select("decision_id", F.lit(1).alias("_r"))
    d = decisions.join(resolved, "decision_id", "left").agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("_r").isNull()).alias("open"))
    return d.withColumn("_k", F.lit(1)).join(ids.withColumn("_k", F.lit(1)), "_k").drop("_k").fillna(0)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns) -> DataFrame:
    """Heat-map table: mean of ``value`` by row and a fixed list of columns."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def priorities(gates: DataFrame, leakage: DataFrame, proxy: DataFrame, outcomes: DataFrame, shape: DataFrame, buy: str = "paper buy candidate") -> DataFrame:
    """Prioritised action rows from five summaries; a monitoring row when nothing is wrong."""
    shape_rows = shape.where(F.col("n_rows") >= 100)
    small_rows = shape.where(F.col("n_rows") >= 10)
    top = lambda d, c: d.select(F.max(c)).scalar()
    extreme = F.coalesce(top(shape_rows, "extreme_share"), top(small_rows, "extreme_share"))
    high = F.coalesce(top(shape_rows, "high_confidence_share"), top(small_rows, "high_confidence_share"))
    ready = gates.select(F.count_if((F.col("is_champion_gate") == 1) & (F.col("trust_tier") == "paper_review"))).scalar()
    found = leakage.select(F.count_if(F.col("leakage_audit_status") != "ok")).scalar()
    matched = proxy.select(F.coalesce(F.sum(F.when(F.col("matching_horizon") == 1, F.col("evaluated"))), F.lit(0))).scalar()
    bought = outcomes.select(F.coalesce(F.sum(F.when(F.col("action") == buy, F.col("evaluated"))), F.lit(0))).scalar()
    row = lambda p, area: F.struct(F.lit(p).alias("priority"), F.lit(area).alias("area"))
    checks = F.array_compact(F.array(
        F.when(ready == 0, row("P0", "model_trust")), F.when(found > 0, row("P0", "leakage_audit")),
        F.when(matched < 50, row("P1", "calibration_proxy")), F.when(bought < 30, row("P1", "paper_outcomes")),
        F.when((extreme > 0.05) | (high > 0.10), row("P2", "probability_shape"))))
    one = gates.sparkSession.range(1).select(checks.alias("c"))
    one = one.select(F.when(F.size("c") == 0, F.array(row("P2", "monitoring"))).otherwise(F.col("c")).alias("c"))
    return one.select(F.explode("c").alias("x")).select("x.*")


def key_metrics(evals: DataFrame, preds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Headline numbers as (metric, value) rows."""
    a = evals.agg(F.countDistinct("run_id").alias("runs"), F.max("roc_auc").alias("best_auc"), F.avg("brier_skill").alias("avg_brier_skill"))
    b = preds.agg(F.count(F.lit(1)).alias("prediction_rows"), F.avg(flag(F.col("probability_up") >= 0.7)).alias("high_confidence_share"))
    c = outcomes.agg(F.count(F.lit(1)).alias("outcome_events"), F.avg(flag(F.col("return_pct") > 0)).alias("win_rate"))
    one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").join(c.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return metric_rows(one)


def metric_rows(one: DataFrame) -> DataFrame:
    """A one-row frame turned into (metric, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
    return one.select(F.explode(entries).alias("x")).select("x.*")


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """The inventory row with the newest context date, then most bytes, then newest export."""
    when = coalesce_dates(["model_as_of_date", "latest_market_date", "exported_at"])
    order = [when.desc_nulls_last(), F.coalesce(F.col("bytes_copied"), F.lit(0)).desc(), F.col("exported_at").desc_nulls_last()]
    return inventory.orderBy(*order, "run_id").limit(1)


def findings(gates: DataFrame, leakage: DataFrame, outcomes: DataFrame, shape: DataFrame, buy: str = "paper buy candidate", min_rows: int = 100) -> DataFrame:
    """(priority, area, evidence) of every rule that fires over the summaries.

    Trust: no champion is ready (evidence: best champion AUC).  Leakage: rows to review, also
    reported when clean.  Outcomes: too few evaluated buys.  Shape: largest extreme or
    high-confidence share among slices with enough rows."""
    champ = gates.where(F.col("is_champion_gate") == 1).select(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("trust_tier") == "paper_review").alias("ready"), F.max("roc_auc").alias("auc"))).scalar()
    bad = leakage.select(F.count_if(F.col("leakage_audit_status") != "ok")).scalar()
    bought = outcomes.select(F.coalesce(F.sum(F.when(F.col("action") == buy, F.col("evaluated"))), F.lit(0))).scalar()
    big = shape.where(F.col("n_rows") >= min_rows).select(F.struct(F.max("extreme_share").alias("x"), F.max("high_confidence_share").alias("h"))).scalar()
    row = lambda p, area, value: F.struct(p.alias("priority"), F.lit(area).alias("area"), value.cast("double").alias("evidence"))
    p = lambda x: F.lit(x)
    facts = gates.sparkSession.range(1).select(champ.alias("c"), bad.alias("b"), bought.alias("o"), big.alias("s"))
    c, b, o, s = F.col("c"), F.col("b"), F.col("o"), F.col("s")
    checks = F.array_compact(F.array(
        F.when(c["n"] == 0, row(p("P0"), "model_trust", F.lit(None))).when(c["ready"] == 0, row(p("P0"), "model_trust", c["auc"])),
        row(F.when(b == 0, "P1").otherwise("P0"), "leakage_audit", b), F.when(o < 30, row(p("P1"), "paper_outcomes", o)),
        F.when(s["x"] > 0.05, row(p("P2"), "probability_shape", s["x"])).when(s["h"] > 0.10, row(p("P2"), "probability_shape", s["h"]))))
    return facts.select(F.explode(checks).alias("x")).select("x.*")

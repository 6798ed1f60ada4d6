"""Decision rules over metric summaries (one row per feature, family, model or method)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import flag


def candidate_ranks(summary: DataFrame, weights: Mapping[str, tuple[float, bool]], method: str = "min") -> DataFrame:
    """Selection score of a candidate table.

    ``weights`` maps a metric to (weight, higher_is_better); each contributes
    ``weight * (1 - pct rank)`` with the best value ranked first.  The table has one row per
    candidate (a hand-made list), so its global windows stay small."""
    from pyspark.sql import Window

    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    score = F.lit(0.0)
    for metric, (w, high) in weights.items():
        rank = F.rank().over(Window.orderBy(F.desc(metric) if high else F.asc(metric)))
        if method == "average":
            rank = rank + (F.count(F.lit(1)).over(Window.partitionBy(metric)) - 1) / 2
        score = score + w * (1 - rank / F.count(F.lit(1)).over(every))
    return summary.withColumn("selection_score", score)


# Weight of every metric of the motion selection, and whether high is good.
MOTION = {"auc": (0.35, True), "brier": (0.25, False), "ece_10": (0.15, False), "mean_excess_return": (0.25, True)}


def motion_selection(rows: DataFrame, by: Sequence[str], weights: Mapping[str, tuple[float, bool]] = MOTION) -> DataFrame:
    """Mean of every metric per candidate, its percentile rank (the best one highest, ties shared)
    and ``selection_score``, the weighted sum of the ranks.

    Means that agree to twelve digits tie, whatever the order of their sums."""
    from tessella.functions.ranking import pct_ranks
    from tessella.session import stage

    means = stage(rows.groupBy(*by).agg(*[F.round(F.avg(m), 12).alias(f"{m}_mean") for m in weights]))
    falling = [f"{m}_mean" for m, (_, high) in weights.items() if not high]
    out = pct_ranks(means, by, [], {f"{m}_mean": f"{m}_rank" for m in weights}, falling)
    return out.withColumn("selection_score", sum((w * F.col(f"{m}_rank") for m, (w, _) in weights.items()), F.lit(0.0)))


def positive_share(c: str) -> Column:
    return F.avg(flag(F.col(c) > 0))


# Decision and reason of every case of the feature registry.
FEATURE_REASONS = {
    "flat": ("confirmatory_drop", "near-zero variance in at least one split"),
    "harmful": ("confirmatory_drop", "usually harms both discrimination and ranking"),
    "drifting": ("watch", "helpful but exhibits material distribution drift"),
    "helpful": ("keep", "helps discrimination, probability loss, and ranking consistently"),
    "mixed": ("watch", "mixed importance across seeds, horizons, or time splits"),
}


def feature_registry(importance: DataFrame, quality: DataFrame) -> DataFrame:
    """keep / watch / confirmatory_drop per feature from permutation importance and data quality."""
    imp = importance.groupBy("feature").agg(
        F.avg("auc_importance").alias("auc"), positive_share("auc_importance").alias("auc_pos"), F.avg("brier_importance").alias("brier"),
        F.avg("excess_return_importance").alias("excess"), positive_share("excess_return_importance").alias("excess_pos"))
    q = quality.groupBy("feature").agg(
        F.min("train_std").alias("min_std"), F.max("maximum_absolute_correlation").alias("max_corr"), F.max("population_stability_index").alias("max_psi"))
    c = F.col
    harms = (c("auc") < 0) & (c("excess") < 0) & (c("auc_pos") <= 0.33) & (c("excess_pos") <= 0.33)
    helps = (c("auc") > 0) & (c("brier") > 0) & (c("excess") > 0) & (c("auc_pos") >= 0.67) & (c("excess_pos") >= 0.67)
    r = FEATURE_REASONS
    case = F.when(c("min_std") <= 1e-8, "flat").when(harms, "harmful").when(helps & (c("max_psi") >= 0.25), "drifting").when(helps, "helpful").otherwise("mixed")
    look = lambda i: F.create_map(*[F.lit(x) for k, v in r.items() for x in (k, v[i])])[F.col("_case")]
    return imp.join(q, "feature", "left").withColumn("_case", case).withColumns({"decision": look(0), "reason": look(1)}).drop("_case")


def confirmatory_registry(comparisons: DataFrame, intervals: DataFrame) -> DataFrame:
    """confirmed_drop / retain / watch per removed component from deltas and interval bounds."""
    s = comparisons.where(F.col("method").startswith("drop_")).groupBy("method").agg(
        F.avg("auc_delta").alias("auc_delta"), F.avg("excess_return_delta").alias("excess_return_delta"),
        positive_share("excess_return_delta").alias("excess_pos"))
    low = lambda m: F.avg(F.when(F.col("metric") == m, F.col("ci_2_5"))).alias(f"{m}_low")
    b = intervals.groupBy("method").agg(low("excess_return_delta"), low("auc_delta"), low("brier_improvement"))
    c = F.col
    drop = ((c("excess_return_delta_low") > 0) & (c("auc_delta_low") >= -0.001) & (c("brier_improvement_low") >= -0.001) & (c("excess_pos") >= 0.67))
    return s.join(b, "method", "left").withColumn("decision", F.when(drop, "confirmed_drop").when(
        (c("excess_return_delta") < 0) & (c("auc_delta") < 0), "retain").otherwise("watch"))


def family_registry(comparisons: DataFrame, tests: DataFrame, auc_floor: float = -0.001) -> DataFrame:
    """A family is confirmed when every one of its tests keeps net return above zero and AUC above
    the floor at the lower bound.  ``tests``: (family, test, challenger, comparison)."""
    low = lambda m: F.max(F.when(F.col("metric") == m, F.col("ci_2_5")))
    wide = comparisons.groupBy("challenger", "comparison").agg(low("net_residual_return").alias("net_low"), low("auc").alias("auc_low"))
    j = tests.join(wide, ["challenger", "comparison"], "left")
    ok = F.coalesce((F.col("net_low") > 0) & (F.col("auc_low") >= auc_floor), F.lit(False))
    return j.groupBy("family").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(ok).alias("passed"), F.min("net_low").alias("worst_net_low"), flag(F.every(ok)).alias("confirmed"))


def advantage_gate(intervals: DataFrame, net: float = 0.0, auc: float = 0.5, ic: float = 0.0) -> DataFrame:
    """Models whose lower bounds of net return, AUC and rank IC all clear their limits."""
    low = lambda m: F.max(F.when(F.col("metric") == m, F.col("ci_2_5"))).alias(m)
    w = intervals.groupBy("model").agg(low("net_residual_return"), low("auc"), low("rank_ic"))
    ok = (F.col("net_residual_return") > net) & (F.col("auc") > auc) & (F.col("rank_ic") > ic)
    return w.withColumn("absolute_gate_pass", flag(ok))


def calibration_summary(by_split: DataFrame, keys: Sequence[str] = ("horizon", "method"), raw: str = "uncalibrated") -> DataFrame:
    """Method averages over splits with extremes and the probability-ready flag."""
    keys = list(keys)
    mean, low, high = (lambda c, o=None: F.avg(c).alias(o or c)), (lambda c: F.min(c).alias(f"minimum_split_{c}")), (lambda c: F.max(c).alias(f"maximum_split_{c}"))
    s = by_split.groupBy(*keys).agg(
        mean("auc"), low("auc"), mean("probability_std"), low("probability_std"), mean("brier"), mean("brier_skill"), low("brier_skill"),
        F.stddev_samp("brier_skill").alias("brier_skill_split_std"), mean("log_loss_skill"), mean("calibration_error"),
        mean("calibration_slope"), low("calibration_slope"), high("calibration_slope"), mean("mean_excess_vs_universe"), low("mean_excess_vs_universe"),
        F.stddev_samp("mean_excess_vs_universe").alias("excess_return_split_std"))
    base = s.where(F.col(keys[-1]) == raw).select(*keys[:-1], F.col("calibration_error").alias("_raw"))
    s = s.join(base, keys[:-1], "left") if len(keys) > 1 else s
    c = F.col
    better = F.coalesce(c("calibration_error") < c("_raw"), F.lit(True))
    ready = ((c("minimum_split_brier_skill") > 0) & (c("log_loss_skill") > 0) & better & (c("auc") >= 0.51) & (c("minimum_split_auc") >= 0.50)
             & (c("calibration_error") <= 0.05) & (c("minimum_split_calibration_slope") >= 0.50) & (c("maximum_split_calibration_slope") <= 1.50)
             & (c("minimum_split_probability_std") >= 0.02) & (c("mean_excess_vs_universe") > 0) & (c("minimum_split_mean_excess_vs_universe") >= 0))
    return s.withColumns({"improves_calibration_error": flag(better), "probability_ready": flag(ready)}).drop("_raw")


def stable_challengers(by_split: DataFrame, min_splits: int, min_mean: float, max_std: float, horizons: int) -> DataFrame:
    """Architectures with positive excess in every split and steady averages in every horizon."""
    per = by_split.groupBy("architecture", "horizon").agg(
        F.count(F.lit(1)).alias("splits"), F.min("mean_excess_vs_universe").alias("worst"),
        F.avg("mean_excess_vs_universe").alias("mean"), F.stddev_samp("mean_excess_vs_universe").alias("std"))
    ok = (F.col("splits") >= min_splits) & (F.col("worst") > 0) & (F.col("mean") >= min_mean) & ~F.coalesce(F.col("std") > max_std, F.lit(False))
    return per.groupBy("architecture").agg(F.count(F.lit(1)).alias("horizons"), flag(F.every(ok) & (F.count(F.lit(1)) == horizons)).alias("stable"))

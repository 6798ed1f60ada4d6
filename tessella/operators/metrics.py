"""Metrics of scored rows, all as grouped aggregates.

Rank-based metrics collapse equal scores first and rank with
:func:`tessella.functions.ranking.running_below`, so one model or split may hold most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import clip, correlation, flag, ratio
from tessella.functions.ranking import average_rank, quantiles, rank_stats, running_below


def auc(df: DataFrame, by: Sequence[str], score: str = "probability", label: str = "label", out: str = "roc_auc") -> DataFrame:
    """ROC AUC by the rank-sum identity with average ties; null for a single class."""
    by = list(by)
    votes = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    r = running_below(votes, by, score, ["n"])
    mid = F.col("n_below") + (F.col("n") + 1) / 2
    s = r.groupBy(*by).agg(F.sum(F.col("pos") * mid).alias("_s"), F.sum("pos").alias("_p"), F.sum(F.col("n") - F.col("pos")).alias("_q"))
    p = F.col("_p").cast("double")
    return s.select(*by, F.try_divide(F.col("_s") - p * (p + 1) / 2, p * F.col("_q")).alias(out))


def classification_metrics(df: DataFrame, by: Sequence[str], prob: str = "probability", label: str = "label",
                           base_rate: str | None = None, eps: float = 1e-6) -> DataFrame:
    """Accuracy, majority accuracy and lift, Brier and log-loss with skill over a base rate, spread.

    ``base_rate`` names a column with the training positive rate; the group's own rate otherwise."""
    y, p = F.col(label).cast("double"), F.col(prob)
    q = clip(p, eps, 1 - eps)
    s = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("test_rows"), F.avg(y).alias("positive_rate"), F.stddev_pop(p).alias("probability_std"),
        F.avg(flag((p >= 0.5) == (y == 1.0))).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        (F.max(base_rate) if base_rate else F.avg(y)).alias("base_rate"))
    r, b = F.col("positive_rate"), F.col("base_rate")
    c = clip(b, eps, 1 - eps)
    s = s.withColumns({
        "majority_accuracy": F.greatest(r, 1 - r),
        # mean of (b - y)^2 over rows with positive rate r
        "baseline_brier": r * (b - 1) * (b - 1) + (1 - r) * b * b,
        "_bl": -(r * F.ln(c) + (1 - r) * F.ln(1 - c))})
    return s.withColumns({
        "accuracy_lift": F.col("accuracy") - F.col("majority_accuracy"),
        "brier_skill": 1 - ratio("brier", "baseline_brier"), "log_loss_skill": 1 - ratio("log_loss", "_bl")}).drop("_bl")


def selected_metrics(df: DataFrame, by: Sequence[str], prob: str = "probability", ret: str = "forward_return",
                     label: str = "label", threshold: float = 0.60) -> DataFrame:
    """Rows chosen at the threshold against the whole group."""
    chosen = F.col(prob) >= threshold
    s = df.groupBy(*by).agg(
        F.avg(ret).alias("benchmark_average_return"), F.count_if(chosen).alias("selected_rows"),
        F.avg(F.when(chosen, F.col(ret))).alias("selected_average_return"),
        F.avg(F.when(chosen, flag(F.col(ret) > 0))).alias("selected_win_rate"), F.avg(F.col(label).cast("double")).alias("_r"))
    return s.withColumns({
        "selected_return_edge": F.col("selected_average_return") - F.col("benchmark_average_return"),
        "selected_win_lift": F.col("selected_win_rate") - F.col("_r")}).drop("_r")


def _bins(df: DataFrame, by: Sequence[str], prob: str, label: str, index) -> DataFrame:
    return df.withColumn("bin", index).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed_frequency"))


def ece(df: DataFrame, by: Sequence[str], prob: str = "probability", label: str = "label", bins: int = 10, binning: str = "floor") -> DataFrame:
    """Expected and maximum calibration error; ``floor`` bins floor(p*bins), ``edges`` tests [lo, hi)
    against the edge values with the last bin closed."""
    p = F.col(prob)
    if binning == "floor":
        index = F.least(F.floor(p * bins), F.lit(bins - 1))
    else:
        edges = [i / bins for i in range(1, bins)]
        index = sum((flag(p >= e) for e in edges), F.lit(0))
    b = _bins(df, by, prob, label, index).withColumn("_gap", F.abs(F.col("observed_frequency") - F.col("mean_probability")))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.col("_gap")) / F.sum("n")).alias("ece"), F.max("_gap").alias("maximum_calibration_error"))


def reliability(df: DataFrame, by: Sequence[str], prob: str = "probability", label: str = "label", bins: int = 10) -> DataFrame:
    """Right-closed bins (0 belongs to the first) with mean probability and observed frequency."""
    index = F.greatest(F.ceil(F.col(prob) * bins) - 1, F.lit(0))
    return _bins(df.where(F.col(prob).between(0, 1)), by, prob, label, index)


def rank_ic(df: DataFrame, by: Sequence[str], score: str, ret: str, out: str = "rank_ic") -> DataFrame:
    """Spearman correlation per group with average ranks; null when either side is constant."""
    by = list(by)
    d = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    a = rank_stats(d, by, score, "a").select(*by, score, average_rank("a").alias("_ra"))
    b = rank_stats(d, by, ret, "b").select(*by, ret, average_rank("b").alias("_rb"))
    r = d.join(a, [*by, score]).join(b, [*by, ret])
    moving = (F.max("_ra") > F.min("_ra")) & (F.max("_rb") > F.min("_rb"))
    return r.groupBy(*by).agg(F.when(moving, correlation("_ra", "_rb")).alias(out))


def regression_metrics(df: DataFrame, by: Sequence[str], pred: str, target: str) -> DataFrame:
    """Mean absolute error and R2."""
    e = F.col(target) - F.col(pred)
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"), F.var_pop(target).alias("_v"))
    return s.withColumn("r2", 1 - ratio("_sse", F.col("_v") * F.col("n"))).drop("_sse", "_v")


def evaluate(df: DataFrame, by: Sequence[str], prob: str, ret: str, label: str, base_rate: str | None = None, threshold: float = 0.60) -> DataFrame:
    """The whole evaluation row of a model: classification, AUC and selected-set metrics."""
    by = list(by)
    c = classification_metrics(df, by, prob, label, base_rate)
    return c.join(auc(df, by, prob, label), by).join(selected_metrics(df, by, prob, ret, label, threshold), by)


def champion_score(evals: DataFrame, out: str = "champion_score") -> DataFrame:
    """Clipped weighted sum of AUC, accuracy lift, return edge, win lift and Brier skill."""
    def part(c, bound, weight):
        return F.coalesce(clip(c, -bound, bound) * weight, F.lit(0.0))

    score = (
        F.coalesce(F.col("roc_auc") - 0.5, F.lit(0.0)) + part("accuracy_lift", 0.05, 0.75) + part("selected_return_edge", 0.05, 1.5)
        + part("selected_win_lift", 0.2, 0.25) + part("brier_skill", 0.2, 0.25))
    return evals.withColumn(out, F.when(F.col("fit_status") == "ok", score).otherwise(-1_000_000_000.0))


def walk_forward_summary(rows: DataFrame, by: Sequence[str] = ("horizon_days", "model_name")) -> DataFrame:
    """Split counts and averages of the successful walk-forward fits."""
    ok = rows.where((F.col("fit_status") == "ok") & F.col("champion_score").isNotNull())
    return ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("walk_forward_splits"), F.count_if(F.col("champion_score") > 0).alias("walk_forward_positive_splits"),
        F.avg("champion_score").alias("walk_forward_avg_score"), F.stddev_pop("champion_score").alias("walk_forward_score_std"),
        F.avg("selected_return_edge").alias("walk_forward_avg_return_edge"), F.avg("brier_skill").alias("walk_forward_avg_brier_skill"),
        F.avg("roc_auc").alias("walk_forward_avg_auc"))


def wf_blend(evals: DataFrame, summary: DataFrame, by: Sequence[str] = ("horizon_days", "model_name")) -> DataFrame:
    """Blend the holdout score with walk-forward average, consistency and spread."""
    e = evals.withColumnRenamed("champion_score", "holdout_score").join(summary, list(by), "left")
    splits = F.coalesce("walk_forward_splits", F.lit(0))
    share = F.try_divide(F.col("walk_forward_positive_splits").cast("double"), splits.cast("double"))
    blend = (0.55 * F.col("holdout_score") + 0.45 * F.col("walk_forward_avg_score") + 0.02 * (share - 0.5)
             - 0.10 * F.coalesce("walk_forward_score_std", F.lit(0.0)))
    usable = (F.col("fit_status") == "ok") & (splits > 0) & F.col("walk_forward_avg_score").isNotNull()
    return e.withColumn("champion_score", F.when(usable, blend).otherwise(F.col("holdout_score")))


def psi(train: DataFrame, test: DataFrame, cols: Sequence[str], bins: int = 10, min_rows: int = 50) -> DataFrame:
    """Population stability index per feature over the training quantile bins."""
    melt = lambda d, tag: d.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(
            "x.feature", "x.v", F.lit(tag).alias("side")).where(F.col("v").isNotNull())
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    q = quantiles(melt(train, "train"), ["feature"], "v", names)
    edges = q.select("feature", F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))
    # inner edges only: the outer two are replaced by -inf and +inf; bins are [lo, hi)
    inner = edges.withColumn("inner", F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))"))
    rows = melt(train, "train").unionByName(melt(test, "test")).join(inner, "feature")
    binned = rows.withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("v"))))
    counts = binned.groupBy("feature", "bin").agg(
        F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b"))
    totals = counts.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    # every bin between two edges counts, even when both sides are empty there
    grid = inner.select("feature", F.size("edges").alias("n_edges"), F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    g = grid.join(counts, ["feature", "bin"], "left").join(totals, "feature")
    share = lambda c, t: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(t), F.lit(1e-6))
    term = (share("b", "tb") - share("a", "ta")) * F.ln(share("b", "tb") / share("a", "ta"))
    out = g.groupBy("feature").agg(F.sum(term).alias("_psi"), F.max("ta").alias("_ta"), F.max("tb").alias("_tb"), F.max("n_edges").alias("_e"))
    value = F.when((F.col("_ta") < min_rows) | (F.col("_tb") < min_rows), F.lit(None)).when(F.col("_e") < 3, 0.0).otherwise(F.col("_psi"))
    return out.select("feature", value.alias("population_stability_index"))


def feature_quality(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing rates, mean, deviation and the largest absolute correlation with another feature."""
    def stats(d, prefix):
        return [F.avg(F.col(c).isNull().cast("double")).alias(f"{prefix}{c}") for c in cols]

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = train.agg(
        *stats(train, "m_"), *[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols],
        *[F.abs(correlation(a, b)).alias(f"c_{a}__{b}") for a, b in pairs])
    two = test.agg(*stats(test, "t_")).withColumn("_k", F.lit(1))
    row = one.withColumn("_k", F.lit(1)).join(two, "_k")
    best = {c: F.greatest(*[F.col(f"c_{a}__{b}") for a, b in pairs if c in (a, b)], F.lit(None).cast("double")) for c in cols}
    entry = lambda c: F.struct(
        F.lit(c).alias("feature"), F.col(f"m_{c}").alias("train_missing_rate"), F.col(f"t_{c}").alias("test_missing_rate"),
        F.col(f"a_{c}").alias("train_mean"), F.col(f"s_{c}").alias("train_std"), best[c].alias("maximum_absolute_correlation"))
    return row.select(F.explode(F.array(*[entry(c) for c in cols])).alias("x")).select("x.*")


def summarize_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count per metric, flattened as ``<metric>_mean`` and so on."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_count")]
    return df.groupBy(*by).agg(*aggs)

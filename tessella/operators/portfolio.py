"""Portfolio analytics on scored rows, all set-based.

Selections hold at most ``k`` rows per date and daily results one row per date, so every
window below runs over calendar-sized groups (by split, model or strategy)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import flag, history, ratio
from tessella.functions.ranking import first_rows, quantiles, running_below, value_counts
from tessella.session import stage


def date_index(df: DataFrame, by: Sequence[str], out: str = "i") -> DataFrame:
    """0-based position of every distinct date inside its group."""
    d = df.select(*by, "date").distinct()
    return d.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1)


def overlap_turnover(picks: DataFrame, by: Sequence[str], base: str = "min", k: int | None = None) -> DataFrame:
    """Share of the selection replaced since the previous one; 1 on the first date.

    ``picks``: (by, i, ticker) with consecutive ``i``; the overlap is divided by the smaller of
    both sizes (``min``), the current size (``current``) or ``k`` (``fixed``)."""
    by = list(by)
    n = picks.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("_n"))
    before = picks.select(*by, (F.col("i") + 1).alias("i"), "ticker")
    common = picks.join(before, [*by, "i", "ticker"], "left_semi").groupBy(*by, "i").agg(F.count(F.lit(1)).alias("_c"))
    prev = n.select(*by, (F.col("i") + 1).alias("i"), F.col("_n").alias("_np"))
    j = n.join(prev, [*by, "i"], "left").join(common, [*by, "i"], "left")
    size = {"min": F.least("_n", "_np"), "current": F.col("_n"), "fixed": F.lit(k)}[base]
    kept = F.coalesce("_c", F.lit(0)) / F.greatest(F.lit(1), size)
    return j.select(*by, "i", F.when(F.col("_np").isNull(), 1.0).otherwise(1.0 - kept).alias("turnover"))


def topk_daily(scored: DataFrame, by: Sequence[str], k: int, bps: float, score: str = "score", ret: str = "ret",
               turnover: str = "min", every: int = 1, need_full: bool = False) -> DataFrame:
    """Gross, universe, excess, turnover, cost and net of the best ``k`` per (rebalance) date."""
    by = list(by)
    idx = date_index(scored, by, "_d")
    s = scored.where(F.col(ret).isNotNull() & F.col(score).isNotNull()).join(idx, [*by, "date"])
    if every > 1:
        s = s.where(F.pmod("_d", F.lit(every)) == 0)
    uni = s.groupBy(*by, "date").agg(F.avg(ret).alias("universe_return"), F.count(F.lit(1)).alias("observations"))
    if need_full:
        uni = uni.where(F.col("observations") >= k)
    order = date_index(uni, by)
    picks = first_rows(s.select(*by, "date", "ticker", score, ret), [*by, "date"], [F.desc(score), F.asc("ticker")], k, "_k")
    picks = picks.join(order, [*by, "date"])
    gross = picks.groupBy(*by, "date", "i").agg(F.avg(ret).alias("gross_return"), F.count(F.lit(1)).alias("selected"))
    out = gross.join(uni, [*by, "date"]).join(overlap_turnover(picks, by, turnover, k), [*by, "i"])
    out = out.withColumn("cost", F.col("turnover") * (bps / 10_000.0)).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return out.withColumns({
        "excess_return": F.col("gross_return") - F.col("universe_return"), "net_excess_return": F.col("net_return") - F.col("universe_return"),
        "win": flag(F.col("net_return") > 0)})


def cohorts(scored: DataFrame, by: Sequence[str], k: int, every: int, bps: float, score: str = "score", ret: str = "ret") -> DataFrame:
    """Selections every ``every`` dates with a flat round-trip cost, charged to the benchmark too."""
    by = list(by)
    cost = 2.0 * bps / 10_000.0
    idx = date_index(scored, by, "_d").where(F.pmod("_d", F.lit(every)) == 0)
    s = scored.where(F.col(ret).isNotNull() & F.col(score).isNotNull()).join(idx, [*by, "date"])
    uni = s.groupBy(*by, "date").agg((F.avg(ret) - cost).alias("benchmark_return"))
    top = first_rows(s, [*by, "date"], [F.desc(score), F.asc("ticker")], k, "_k")
    sel = top.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("holdings"), (F.avg(ret) - cost).alias("net_return"))
    return sel.join(uni, [*by, "date"]).withColumn("excess_return", F.col("net_return") - F.col("benchmark_return"))


STRATEGIES = ("plain_probability", "similarity_weighted", "consensus_gate", "cluster_diversified")


def select_strategy(df: DataFrame, name: str, k: int, by: Sequence[str] = ("date",), prob: str = "probability") -> DataFrame:
    """Best ``k`` per date under a named strategy.

    Uses ``graph_similarity_mean`` and ``neighbor_confirmation`` (and ``cluster`` for the
    diversified one).  The consensus gate applies only on dates with at least ``k`` eligible rows."""
    from tessella.operators.cross_section import xs_zscore
    from tessella.operators.sets import diversified_top_k

    by = list(by)
    order = [F.desc("strategy_score"), F.asc("ticker")]
    if name == "similarity_weighted":
        d = xs_zscore(xs_zscore(df, "graph_similarity_mean", "_z1", by), "neighbor_confirmation", "_z2", by)
        d = d.withColumn("strategy_score", F.col(prob) + 0.04 * F.col("_z1") + 0.04 * F.col("_z2")).drop("_z1", "_z2")
        return first_rows(d, by, order, k, "pick")
    d = df.withColumn("strategy_score", F.col(prob))
    if name == "cluster_diversified":
        return diversified_top_k(d, k, 2, by, "strategy_score")
    if name == "consensus_gate":
        med = quantiles(df, by, "graph_similarity_mean", {"_med": 0.5})
        d = d.join(med, by, "left").withColumn("_ok", flag((F.col("neighbor_confirmation") >= 0) & (F.col("graph_similarity_mean") >= F.col("_med"))))
        n = d.groupBy(*by).agg(F.sum("_ok").alias("_e"))
        d = d.join(n, by).where((F.col("_ok") == 1) | (F.col("_e") < k)).drop("_ok", "_e", "_med")
    return first_rows(d, by, order, k, "pick")


def strategy_daily(scored: DataFrame, k: int, names: Sequence[str] = STRATEGIES, by: Sequence[str] = (), ret: str = "forward_return") -> DataFrame:
    """Daily gross, universe and turnover (over the current size) of several strategies."""
    by = list(by)
    uni = scored.groupBy(*by, "date").agg(F.avg(ret).alias("universe_return"))
    out = None
    for name in names:
        p = select_strategy(scored, name, k, [*by, "date"]).withColumn("strategy", F.lit(name)).select("strategy", *by, "date", "ticker", ret)
        out = p if out is None else out.unionByName(p)
    keys = ["strategy", *by]
    picks = stage(out)
    picks = picks.join(date_index(picks, keys), [*keys, "date"])
    g = picks.groupBy(*keys, "date", "i").agg(F.avg(ret).alias("gross_return"))
    return g.join(uni, [*by, "date"]).join(overlap_turnover(picks, keys, "current"), [*keys, "i"])


NOISE = 1e-12  # an excess that only rounding made is no win


def cost_grid(daily: DataFrame, costs: Sequence[float], by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Summary of daily strategy rows under every cost level."""
    c = daily.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in costs])))
    c = c.withColumn("_net", F.col("gross_return") - F.col("turnover") * F.col("cost_bps") / 10_000.0).withColumn("_x", F.col("_net") - F.col("universe_return"))
    return c.groupBy(*by, "cost_bps").agg(
        F.count(F.lit(1)).alias("dates"), F.avg("gross_return").alias("mean_gross_return"), F.avg("_net").alias("mean_net_return"), F.avg("_x").alias("mean_excess_return"),
        F.avg(flag(F.col("_x") > NOISE)).alias("win_rate"), F.avg("turnover").alias("mean_turnover"), F.min("_net").alias("worst_net_return"))


def segments(scored: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Each row under every segment it belongs to: all, liquidity, degree and momentum halves."""
    by = list(by)
    d = scored.join(quantiles(scored, by, "dollar_vol_20d_log", {"_l": 0.5}), by, "left").join(quantiles(scored, by, "graph_degree", {"_g": 0.5}), by, "left")
    half = lambda c, m, hi, lo: F.when(F.col(c) >= F.col(m), hi).when(F.col(c) < F.col(m), lo)
    tags = F.array_compact(F.array(
        F.lit("all"), half("dollar_vol_20d_log", "_l", "liquidity_high", "liquidity_low"), half("graph_degree", "_g", "graph_degree_high", "graph_degree_low"),
        F.when(F.col("ret_20d") >= 0, "momentum_positive").when(F.col("ret_20d") < 0, "momentum_negative")))
    return d.withColumn("segment", F.explode(tags)).drop("_l", "_g")


def scenario_battery(scored: DataFrame, sizes: Sequence[int], rebalances: Sequence[int], costs: Sequence[float],
                     names: Sequence[str] = STRATEGIES[:3], ret: str = "forward_return", by: Sequence[str] = ()) -> DataFrame:
    """Segment x strategy x size x rebalance interval x cost, holding selections between rebalances.

    A date on which nothing held is left re-selects without turnover and carries that selection
    on.  Such dates are found round by round (the first one of each holding run becomes a new
    anchor) until none is left, so no date loop runs anywhere."""
    by = list(by)
    used = ["ticker", "probability", "graph_similarity_mean", "neighbor_confirmation", *(["cluster"] if "cluster_diversified" in names else []), ret]
    seg = stage(segments(scored, [*by, "date"]).select(*by, "segment", "date", *dict.fromkeys(used)))  # four rows a row: no other columns
    picks = None
    for size in sizes:
        for name in names:
            p = select_strategy(seg, name, size, [*by, "segment", "date"]).select(*by, "segment", F.lit(name).alias("strategy"), F.lit(size).alias("portfolio_size"), "date", "ticker", ret)
            picks = p if picks is None else picks.unionByName(p)
    cfg = [*by, "segment", "strategy", "portfolio_size", "rebalance_days"]
    picks = stage(picks.withColumn("rebalance_days", F.explode(F.array(*[F.lit(r) for r in rebalances]))))
    days = picks.select(*cfg, "date").distinct().join(date_index(scored, [], "i"), "date")
    anchors = stage(days.withColumn("anchor", flag(F.pmod("i", "rebalance_days") == 0)).withColumn("again", F.lit(0)))
    run = Window.partitionBy(*cfg).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*cfg).orderBy("i")) == 1
    while True:
        a = anchors.withColumn("anchor", F.when(first, 1).otherwise(F.col("anchor")))
        a = a.withColumn("_from", F.max(F.when(F.col("anchor") == 1, F.col("date"))).over(run))
        held = a.join(picks.select(*cfg, F.col("date").alias("_from"), "ticker"), [*cfg, "_from"])
        alive = held.join(seg.select(*by, "segment", "date", "ticker", F.col(ret).alias("_r")), [*by, "segment", "date", "ticker"])
        alive = alive.groupBy(*cfg, "date").agg(F.avg("_r").alias("gross_return"))
        a = stage(a.join(alive, [*cfg, "date"], "left").withColumn("_found", F.lit(0)))
        lost = a.where((F.col("anchor") == 0) & F.col("gross_return").isNull())
        lost = lost.groupBy(*cfg, "_from").agg(F.min("date").alias("date")).select(*cfg, "date", F.lit(1).alias("_new"))
        if lost.isEmpty():
            break
        b = a.join(lost, [*cfg, "date"], "left").withColumns({
            "again": F.when(F.col("_new") == 1, 1).otherwise(F.col("again")), "anchor": F.when(F.col("_new") == 1, 1).otherwise(F.col("anchor"))})
        anchors = stage(b.select(*cfg, "date", "i", "anchor", "again"))
    prev = F.max(F.when(F.col("anchor") == 1, F.col("date"))).over(Window.partitionBy(*cfg).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    turns = a.withColumn("_prev", prev).where((F.col("anchor") == 1) & (F.col("again") == 0)).select(*cfg, "date", "_prev")
    now = turns.join(picks.select(*cfg, "date", "ticker"), [*cfg, "date"])
    old = picks.select(*cfg, F.col("date").alias("_prev"), "ticker", F.lit(1).alias("_o"))
    t = now.join(old, [*cfg, "_prev", "ticker"], "left").groupBy(*cfg, "date").agg(
        F.when(F.max("_prev").isNull(), 1.0).otherwise(1.0 - F.coalesce(F.sum("_o"), F.lit(0)) / F.count(F.lit(1))).alias("turnover"))
    uni = seg.groupBy(*by, "segment", "date").agg(F.avg(ret).alias("universe_return"))
    mkt = scored.groupBy(*by, "date").agg(F.avg(ret).alias("market_return"), F.stddev_pop("ret_20d").alias("market_volatility"))
    out = a.join(t, [*cfg, "date"], "left").fillna(0.0, ["turnover"]).join(uni, [*by, "segment", "date"]).join(mkt, [*by, "date"])
    out = out.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    out = out.withColumn("net_return", F.col("gross_return") - F.col("turnover") * F.col("cost_bps") / 10_000.0)
    out = out.withColumn("excess_return", F.col("net_return") - F.col("universe_return"))
    return out.select("date", *cfg, "cost_bps", "gross_return", "net_return", "universe_return", "excess_return", "turnover", "market_return", "market_volatility")


def scenario_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x = F.col("excess_return")
    return rows.groupBy(*by, "segment", "strategy", "portfolio_size", "rebalance_days", "cost_bps").agg(
        F.count(F.lit(1)).alias("dates"), F.avg("net_return").alias("mean_net_return"), F.avg(x).alias("mean_excess_return"), F.stddev_samp(x).alias("excess_std"),
        F.avg(flag(x > NOISE)).alias("win_rate"), F.avg("turnover").alias("mean_turnover"), F.min("net_return").alias("worst_net_return"))


def one_day_residuals(prices: DataFrame, keys: DataFrame) -> DataFrame:
    """Next-day residual returns (market leave-one-out) of the panel keys; null across gaps."""
    from tessella.operators.cross_section import loo_mean
    from tessella.operators.joins import consecutive_returns

    r = keys.select("ticker", "date").distinct().join(consecutive_returns(prices).select("ticker", "date", "next_return"), ["ticker", "date"], "left")
    r = loo_mean(stage(r), ["date"], "next_return", "_m", "_n")
    return r.select("ticker", "date", (F.col("next_return") - F.col("_m")).alias("residual_return_1d"))


def sleeve_replay(preds: DataFrame, ret1d: DataFrame, by: Sequence[str], k: int, sleeves: int, bps: float, score: str = "score") -> DataFrame:
    """Overlapping sleeves: every signal opens ``1/sleeves`` of the capital for ``sleeves`` dates.

    Turnover is half the L1 change of weights and cash; the replay ends on the first date after
    the last signal without an active sleeve.  Signals on dates without one-day rows never open."""
    by = list(by)
    if not by:  # one group: give it a constant key
        return sleeve_replay(preds.withColumn("_g", F.lit(1)), ret1d, ["_g"], k, sleeves, bps, score).drop("_g")
    sig = first_rows(preds.select(*by, "date", "ticker", score), [*by, "date"], [F.desc(score), F.asc("ticker")], k, "_k")
    size = sig.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("_n"))
    sig = stage(sig.join(size, [*by, "date"]).select(*by, "date", "ticker", (1.0 / (sleeves * F.col("_n"))).alias("w")))
    span = sig.groupBy(*by).agg(F.min("date").alias("_lo"), F.max("date").alias("_last"))
    # the calendar joins every group through its list of groups: both are calendar-sized
    days = ret1d.select("date").distinct()
    groups = span.select(F.collect_list(F.struct(*by, "_lo", "_last"))).scalar()
    cal = days.withColumn("_g", groups).withColumn("_g", F.explode("_g")).select("_g.*", "date").where(F.col("date") >= F.col("_lo"))
    cal = stage(cal.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1))
    opened = sig.join(cal.select(*by, "date", "i"), [*by, "date"])
    live = opened.withColumn("i", F.explode(F.sequence(F.col("i"), F.col("i") + (sleeves - 1)))).groupBy(*by, "i", "ticker").agg(F.sum("w").alias("w"))
    live = stage(live.join(cal.select(*by, "i", "date", "_last"), [*by, "i"]))
    active = opened.select(*by, "i").distinct().withColumn("i", F.explode(F.sequence(F.col("i"), F.col("i") + (sleeves - 1)))).groupBy(*by, "i").agg(F.count(F.lit(1)).alias("active_sleeves"))
    d = cal.join(active, [*by, "i"], "left").fillna(0, ["active_sleeves"])
    over = F.when((F.col("date") > F.col("_last")) & (F.col("active_sleeves") == 0), F.col("i"))
    end = d.groupBy(*by).agg(F.min(over).alias("_end"))
    d = d.join(end, by).where(F.col("_end").isNull() | (F.col("i") <= F.col("_end")))
    moves = live.select(*by, "i", "ticker", "w").unionByName(live.select(*by, (F.col("i") + 1).alias("i"), "ticker", (-F.col("w")).alias("w")))
    l1 = moves.groupBy(*by, "i", "ticker").agg(F.sum("w").alias("_d")).groupBy(*by, "i").agg(F.sum(F.abs("_d")).alias("_l1"))
    v = live.join(ret1d.select("date", "ticker", "residual_return_1d"), ["date", "ticker"], "left")
    r = F.col("residual_return_1d")
    v = v.groupBy(*by, "i").agg(
        F.sum("w").alias("invested_weight"), F.count(F.lit(1)).alias("positions"), F.sum(F.col("w") * r).alias("gross_residual_return"),
        F.sum(F.when(r.isNull(), F.col("w"))).alias("missing_return_weight"))
    d = d.join(v, [*by, "i"], "left").join(l1, [*by, "i"], "left").fillna(0.0).fillna(0, ["positions"])
    cash = F.greatest(F.lit(0.0), 1 - F.col("invested_weight"))
    d = d.withColumn("_cash", cash)
    before = F.coalesce(F.lag("_cash").over(Window.partitionBy(*by).orderBy("i")), F.lit(1.0))
    new = opened.select(*by, "date").distinct().withColumn("new_signal", F.lit(1))
    d = d.withColumn("turnover", 0.5 * (F.col("_l1") + F.abs(F.col("_cash") - before))).join(new, [*by, "date"], "left").fillna(0, ["new_signal"])
    d = d.withColumn("cost", F.col("turnover") * (bps / 10_000.0)).withColumn("net_residual_return", F.col("gross_residual_return") - F.col("cost"))
    return d.drop("_lo", "_last", "_end", "_l1", "_cash", "i")


def path_metrics(daily: DataFrame, by: Sequence[str], ret: str, order: Sequence[str] = ("date",)) -> DataFrame:
    """Cumulative return, maximum drawdown, positive rate, mean and worst day of a return path."""
    by = list(by)
    up = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_w", F.product(1 + F.col(ret)).over(up))
    d = d.withColumn("_dd", F.col("_w") / F.max("_w").over(up) - 1)
    last = F.max(F.struct(*order, "_w"))["_w"]
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg(ret).alias("mean_return"), (last - 1).alias("cumulative_return"), F.min("_dd").alias("maximum_drawdown"),
        F.avg(flag(F.col(ret) > 0)).alias("positive_day_rate"), F.min(ret).alias("worst_day"))


def cohort_summary(rows: DataFrame, by: Sequence[str], sleeves: int, order: Sequence[str] = ("date",)) -> DataFrame:
    """Cohort averages and the compounding of ``sleeves`` interleaved sleeves."""
    by = list(by)
    r = rows.withColumn("_o", F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.lit(sleeves)))
    paths = path_metrics(r, [*by, "_o"], "net_return", order).groupBy(*by).agg(
        F.avg("cumulative_return").alias("average_sleeve_compound_return"), F.min("maximum_drawdown").alias("worst_sleeve_max_drawdown"))
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cohorts"), F.sum("holdings").alias("holdings_evaluated"), F.avg("net_return").alias("mean_net_return"), F.percentile("net_return", 0.5).alias("median_net_return"),
        F.avg(flag(F.col("net_return") > 0)).alias("win_rate"), F.avg("excess_return").alias("mean_excess_vs_universe"), F.min("net_return").alias("worst_cohort_return"))
    return s.join(paths, by)


def phases(preds: DataFrame, by: Sequence[str], k: int, horizon: int, bps: float, score: str = "score", ret: str = "ret") -> DataFrame:
    """Non-overlapping cohorts for every start phase with a round-trip cost."""
    by = list(by)
    top = first_rows(preds, [*by, "date"], [F.desc(score), F.asc("ticker")], k, "_k")
    d = top.groupBy(*by, "date").agg((F.avg(ret) - 2.0 * bps / 10_000.0).alias("_net")).join(date_index(preds, by), [*by, "date"])
    return d.withColumn("phase", F.pmod("i", F.lit(horizon))).groupBy(*by, "phase").agg(
        F.count(F.lit(1)).alias("cohorts"), F.avg("_net").alias("mean_net_return"), F.avg(flag(F.col("_net") > 0)).alias("win_rate"), F.min("_net").alias("worst_cohort"))


def regime_policy(daily: DataFrame, by: Sequence[str], costs: Sequence[float], regime: str = "new_signal_regime") -> DataFrame:
    """Exposure policies by carried-forward regime: always on, stress only, cash in falling trends.

    A gate change trades the invested weight."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("date")
    d = daily.withColumn("effective_regime", F.coalesce(F.last(regime, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("unknown")))
    reg = F.col("effective_regime")
    gates = {"all_regimes": F.lit(1.0), "stress_only": (reg == "stress").cast("double"), "trend_down_cash": (reg != "trend_down").cast("double")}
    d = d.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), g.alias("gate")) for n, g in gates.items()]))).select("*", "_p.*").drop("_p")
    prev = F.coalesce(F.lag("gate").over(Window.partitionBy(*by, "policy").orderBy("date")), F.col("gate"))
    d = d.withColumn("gate_transition", F.abs(F.col("gate") - prev)).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    d = d.withColumn("policy_turnover", F.col("turnover") * F.col("gate") + F.col("gate_transition") * F.col("invested_weight"))
    d = d.withColumns({"policy_gross": F.col("gross_residual_return") * F.col("gate"), "policy_cost": F.col("policy_turnover") * F.col("cost_bps") / 10_000.0})
    return d.withColumn("policy_net", F.col("policy_gross") - F.col("policy_cost")).select(
        *by, "date", "policy", "cost_bps", "effective_regime", "gate", "gate_transition", "policy_turnover", "policy_gross", "policy_cost", "policy_net")


def risk_metrics(prices: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Annualised return, volatility, Sharpe ratio, total return and maximum drawdown per ticker."""
    up = history().rowsBetween(Window.unboundedPreceding, 0)
    p = prices.withColumns({"_r": ratio("close_price", F.lag("close_price").over(history())) - 1, "_dd": ratio("close_price", F.max("close_price").over(up)) - 1})
    edge = lambda f: f(F.struct("date", "close_price"))["close_price"]
    s = p.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("observations"), (edge(F.max) / edge(F.min) - 1).alias("total_return"), (F.avg("_r") * 252.0).alias("annual_return"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(252.0))).alias("annual_volatility"), F.min("_dd").alias("max_drawdown"))
    return s.withColumn("sharpe", ratio(F.col("annual_return") - risk_free, "annual_volatility"))


def momentum_signals(prices: DataFrame, training: int, holding: int, momentum: int, min_momentum: float, min_sharpe: float) -> DataFrame:
    """Row-wise momentum and trailing-Sharpe signal with the forward return; the Sharpe window
    ends one row before the decision."""
    w = history()
    p = prices.withColumn("_r", ratio("close_price", F.lag("close_price").over(w)) - 1)
    back = w.rowsBetween(-training, -1)
    p = p.withColumns({
        "_i": F.row_number().over(w) - 1, "momentum": ratio("close_price", F.lag("close_price", momentum).over(w)) - 1,
        "trailing_sharpe": ratio(F.avg("_r").over(back) * 252.0, F.stddev_samp("_r").over(back) * F.sqrt(F.lit(252.0))),
        "forward_return": ratio(F.lead("close_price", holding).over(w), "close_price") - 1})
    p = p.where((F.col("_i") >= max(training, momentum)) & F.col("forward_return").isNotNull())
    ok = (F.col("momentum") >= min_momentum) & (F.col("trailing_sharpe") >= min_sharpe)
    return p.withColumn("signal", flag(ok)).drop("_r", "_i")


def signal_summary(signals: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Number, mean, median and win rate of signalled forward returns (a ticker's rows are calendar-bounded)."""
    s = signals.where(F.col("signal") == 1)
    return s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"), F.avg("forward_return").alias("average_forward_return"), F.avg(flag(F.col("forward_return") > 0)).alias("win_rate"),
        F.percentile("forward_return", 0.5).alias("median_forward_return"))


def candidate_scores(prices: DataFrame, signal_dates: DataFrame, lookback: int, min_dollar: float, max_vol: float) -> DataFrame:
    """Trailing return per unit of volatility of every ticker before every signal date.

    Signal dates are merged into each ticker's history; a range frame over positions collects
    the last ``lookback`` rows, which are then aggregated per ticker and signal."""
    dates = signal_dates.select(F.array_sort(F.collect_set("date"))).scalar()
    asks = prices.select("ticker").distinct().withColumn("_all", dates).select("ticker", F.explode("_all").alias("date"), F.lit(1).alias("_ask"))
    step = ratio("close_price", F.lag("close_price").over(history())) - 1
    rows = prices.withColumn("_r", step).select(
        "ticker", "date", F.struct("date", F.col("close_price").alias("p"), (F.col("close_price") * F.col("volume")).alias("dv"), F.col("_r").alias("r")).alias("_px"), F.lit(0).alias("_ask"))
    both = rows.unionByName(asks, allowMissingColumns=True)
    upto = Window.partitionBy("ticker").orderBy("date", F.desc("_ask")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_pos", F.count("_px").over(upto).cast("int"))
    last = Window.partitionBy("ticker").orderBy("_pos").rangeBetween(-(lookback - 1), 0)
    a = both.withColumn("_h", F.collect_list("_px").over(last)).where(F.col("_ask") == 1)
    start = F.date_sub("date", max(10, lookback * 2))
    a = a.withColumn("_h", F.filter("_h", lambda x: x["date"] >= start)).withColumn("_n", F.size("_h")).where(F.col("_n") >= max(20, lookback // 2))
    e = a.select("date", "ticker", "_n", F.posexplode("_h").alias("_k", "x"))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("x.p")))
    s = e.groupBy("date", "ticker").agg(
        (at(F.col("_n") - 1) / at(0) - 1).alias("trailing_return"), F.stddev_samp(F.when(F.col("_k") > 0, F.col("x.r"))).alias("volatility"),
        F.avg(F.when(F.col("_k") >= F.col("_n") - 20, F.col("x.dv"))).alias("dollar_volume"))
    s = s.where((F.col("dollar_volume") >= min_dollar) & (F.col("volatility") <= max_vol))
    return s.withColumn("score", F.col("trailing_return") / F.greatest("volatility", F.lit(1e-6)))


def _price_at(prices: DataFrame, asks: DataFrame) -> DataFrame:
    """Last close on or before each asked (ticker, date)."""
    rows = prices.select("ticker", "date", F.col("close_price").alias("_c"), F.lit(0).alias("_ask"))
    both = rows.unionByName(asks.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("price", F.last("_c", ignorenulls=True).over(w)).where(F.col("_ask") == 1).drop("_c", "_ask")


def rebalance_replay(prices: DataFrame, holdings: DataFrame, replay_days: int, rebalance_days: int, lookback: int, positions: int,
                     min_dollar: float, max_vol: float, cash: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(curve, trades): equal-weight re-allocation every ``rebalance_days`` dates against buy and hold.

    Between rebalances the portfolio moves with the mean price relative of its holdings, so
    values are a product of period factors over the (few) rebalances."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = prices.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(every))
    days = stage(days.where(F.col("i") >= F.col("n") - replay_days).select("date", (F.col("i") - F.col("n") + replay_days).alias("i")))
    sched = days.where(F.pmod("i", F.lit(rebalance_days)) == 0)
    picks = first_rows(candidate_scores(prices, sched, lookback, min_dollar, max_vol), ["date"], [F.desc("score"), F.desc("dollar_volume"), F.asc("ticker")], positions, "place")
    picks = stage(picks.select(F.col("date").alias("anchor"), "ticker", "place"))
    anchors = picks.select("anchor").distinct()
    prev = F.max("anchor").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    d = days.join(anchors.withColumn("date", F.col("anchor")), "date", "left").withColumn("anchor", prev)
    # a rebalance date closes the old period and opens the new one
    nxt = anchors.withColumn("date", F.lead("anchor").over(Window.orderBy("anchor"))).where(F.col("date").isNotNull())
    asks = d.where(F.col("anchor").isNotNull()).select("anchor", "date").unionByName(nxt.select("anchor", "date")).distinct()
    rel = _price_at(prices, asks.join(picks, "anchor").select("anchor", "ticker", "date"))
    base = rel.where(F.col("anchor") == F.col("date")).select("anchor", "ticker", F.col("price").alias("_b"))
    rel = stage(rel.join(base, ["anchor", "ticker"]).groupBy("anchor", "date").agg(F.avg(F.col("price") / F.col("_b")).alias("factor")))
    grown = nxt.join(rel, ["anchor", "date"]).select(F.col("date").alias("anchor"), "factor")
    up = Window.orderBy("anchor").rowsBetween(Window.unboundedPreceding, 0)
    level = anchors.join(grown, "anchor", "left").withColumn("level", F.product(F.coalesce("factor", F.lit(1.0))).over(up)).drop("factor")
    held = _price_at(prices, holdings.select("ticker", "quantity").join(prices.select("ticker").distinct(), "ticker", "left_semi")
                     .withColumn("_d", days.select(F.collect_list("date")).scalar()).select("ticker", "quantity", F.explode("_d").alias("date")))
    hold = held.groupBy("date").agg((F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0)) + cash).alias("actual_hold"))
    start = hold.select(F.min(F.struct("date", "actual_hold"))["actual_hold"]).scalar()
    curve = d.join(rel, ["anchor", "date"], "left").join(level, "anchor", "left").join(hold, "date")
    curve = curve.withColumn("strategy", start * F.coalesce(F.col("factor") * F.col("level"), F.lit(1.0)))
    curve = curve.select("date", "strategy", "actual_hold", (F.col("strategy") / start - 1).alias("strategy_return"), (F.col("actual_hold") / start - 1).alias("actual_return"))
    sets = picks.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "ticker"))).alias("_s"))  # at most ``positions`` tickers
    sets = sets.withColumn("_t", F.transform("_s", lambda x: x["ticker"])).withColumn("_p", F.coalesce(F.lag("_t").over(Window.orderBy("anchor")), F.array().cast("array<string>")))
    packed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ", ")
    trades = sets.join(level, "anchor").select(
        F.col("anchor").alias("date"), F.array_join("_t", ", ").alias("tickers"), packed("_t", "_p").alias("entered"), packed("_p", "_t").alias("exited"), (start * F.col("level")).alias("portfolio_value"))
    return curve, trades


def return_pool_risk(preds: DataFrame, returns: DataFrame, neighbors: DataFrame, drop: float = -0.05, target: float = 0.05) -> DataFrame:
    """Exact risk summary of the probability-weighted return pool of every prediction.

    The pool is the ticker's own and its neighbours' forward returns, or the whole market when
    there are none.  Positive and non-positive returns weigh p and 1 - p together; quantiles are
    the smallest return whose cumulative weight reaches the level.  ``preds``: (ticker, p),
    ``returns``: (ticker, r), ``neighbors``: (ticker, neighbor)."""
    levels = {"p10_return": 0.10, "median_return": 0.50, "p90_return": 0.90}
    preds = preds.select("ticker", "p")
    peers = preds.withColumn("peer", F.col("ticker")).unionByName(
        neighbors.select("ticker", F.col("neighbor").alias("peer")).join(preds, "ticker"))
    returns = returns.select("ticker", "r")
    own_sizes = returns.groupBy(F.col("ticker").alias("peer")).agg(
        F.count(F.when(F.col("r") > 0, 1)).alias("_a"), F.count(F.when(F.col("r") <= 0, 1)).alias("_b"))
    # sizes come from one row per peer, so that the pool itself is sent once, to its ticker
    size = stage(peers.join(own_sizes, "peer").groupBy("ticker").agg(F.nullif(F.sum("_a"), F.lit(0)).alias("_a"), F.nullif(F.sum("_b"), F.lit(0)).alias("_b")))
    pool = peers.join(size, "ticker").join(returns.withColumnRenamed("ticker", "peer"), "peer")
    w = F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1.0 / F.coalesce("_a", "_b")).when(F.col("r") > 0, F.col("p") / F.col("_a")).otherwise((1 - F.col("p")) / F.col("_b"))
    # a pool holds at most the rows of one ticker and its few neighbours: calendar-bounded;
    # of equal returns the last reaches the level if any does, and they are the same answer
    cum = F.sum("w").over(Window.partitionBy("ticker").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    v = pool.select("ticker", "r", w.alias("w")).withColumn("_cum", cum)
    mass = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0.0))
    own = v.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("pool_rows"), F.sum(F.col("w") * F.col("r")).alias("expected_return"), mass(F.col("r") > 0).alias("probability_positive"),
        mass(F.col("r") <= drop).alias("drawdown_probability"), mass(F.col("r") >= target).alias("target_probability"),
        *[F.min(F.when(F.col("_cum") >= q - 1e-9, F.col("r"))).alias(o) for o, q in levels.items()])
    # market fallback: one ranked table of all returns, read at each prediction's own levels
    alone = preds.join(size, "ticker", "left_anti")
    sides = returns.withColumn("side", flag(F.col("r") > 0))
    ranked = running_below(value_counts(sides, ["side"], "r"), ["side"], "r", ["n"])
    lo, hi = F.col("n_below") / F.col("n_total"), (F.col("n_below") + F.col("n")) / F.col("n_total")
    grid = ranked.withColumns({"lo": lo, "hi": hi}).withColumn("b", F.explode(F.sequence(F.floor(lo * 256).cast("int"), F.floor(hi * 256).cast("int"))))
    facts = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.avg(flag(F.col("r") <= drop)).alias("d"), F.avg(flag(F.col("r") >= target)).alias("t"))
    ask = alone.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(o).alias("name"), F.lit(q).alias("q")) for o, q in levels.items()]))).select("ticker", "p", "_l.*")
    down = F.col("q") <= 1 - F.col("p")
    ask = ask.withColumns({"side": flag(~down), "u": F.when(down, F.try_divide(F.col("q"), 1 - F.col("p"))).otherwise(F.try_divide(F.col("q") - 1 + F.col("p"), F.col("p")))})
    ask = ask.withColumn("b", F.floor(F.col("u") * 256).cast("int")).join(grid.select("side", "b", "lo", "hi", "r"), ["side", "b"])
    ask = ask.where((F.col("hi") >= F.col("u") - 1e-9) & (F.col("lo") < F.col("u") + 1e-9)).groupBy("ticker").agg(*[F.min(F.when((F.col("name") == o) & (F.col("hi") >= F.col("u") - 1e-9), F.col("r"))).alias(o) for o in levels])
    share = F.when(F.col("side") == 1, F.col("p")).otherwise(1 - F.col("p"))
    sided = alone.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).join(facts, "side").groupBy("ticker").agg(
        F.sum("n").alias("pool_rows"), F.sum(share * F.col("m")).alias("expected_return"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("probability_positive"),
        F.sum(share * F.col("d")).alias("drawdown_probability"), F.sum(share * F.col("t")).alias("target_probability"))
    return own.unionByName(sided.join(ask, "ticker"))


def price_bands(risk: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """Linear price path of the pool quantiles from the latest close to the horizon."""
    last = prices.groupBy("ticker").agg(F.max(F.struct("date", "close_price"))["close_price"].alias("current_price"))
    r = risk.join(last, "ticker").where(F.col("current_price") > 0).withColumn("trading_day", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    at = lambda c: F.col("current_price") * (1 + F.col(c) * F.col("trading_day") / horizon)
    return r.select("ticker", "trading_day", at("p10_return").alias("p10_price"), at("median_return").alias("median_price"), at("p90_return").alias("p90_price"))


def analog_fan(prices: DataFrame, h: int, rows: int = 504, fallback: int = 252, min_starts: int = 15, barrier: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(fan, summary): forward paths after historical starts that resemble the present.

    A start has trailing volatility within .65-1.35 of the current level and the current market
    regime; with fewer than ``min_starts`` of them the last ``fallback`` rows serve.  Everything
    happens inside a ticker's last ``rows`` returns, so groups are bounded."""
    from tessella.functions.frames import clip, rolling

    w = history()
    raw = F.ln(ratio("close_price", F.lag("close_price").over(w)))
    p = prices.withColumn("_lr", clip(raw, -0.35, 0.35))
    mkt = p.groupBy("date").agg(F.avg("_lr").alias("_m"))
    m20 = Window.orderBy("date").rowsBetween(-19, 0)  # calendar-sized
    mkt = mkt.withColumn("_trend", F.when(F.count("_m").over(m20) >= 10, F.sum("_m").over(m20))).select("date", F.coalesce("_trend", F.lit(0.0)).alias("_trend"))
    p = first_rows(p.where(F.col("_lr").isNotNull()), ["ticker"], [F.desc("date")], rows, "_back").join(mkt, "date", "left")
    p = p.withColumn("v", clip("_lr", -0.20, 0.20)).withColumns({"i": F.row_number().over(w) - 1, "len": F.max("_back").over(Window.partitionBy("ticker"))})
    p = p.withColumn("_vol", rolling(F.stddev_samp, "v", 20, 15)).withColumn("_up", flag(F.coalesce("_trend", F.lit(0.0)) >= 0))
    now = p.where(F.col("_back") <= 20).groupBy("ticker").agg(F.percentile("_vol", 0.5).alias("_cv"), F.max(F.when(F.col("_back") == 1, F.col("_up"))).alias("_cr"))
    ahead = w.rowsBetween(0, h - 1)
    p = p.withColumn("_path", F.collect_list("v").over(ahead)).where((F.col("len") >= 100) & (F.col("i") >= 20) & (F.col("i") < F.col("len") - h)).join(now, "ticker")
    like = flag((F.col("_vol") / F.col("_cv")).between(0.65, 1.35) & (F.col("_up") == F.col("_cr")) & (F.col("_cv") > 0))
    p = p.withColumn("_like", like).withColumn("_n", F.sum("_like").over(Window.partitionBy("ticker")))
    p = p.where(F.when(F.col("_n") >= min_starts, F.col("_like") == 1).otherwise(F.col("i") >= F.greatest(F.lit(20), F.col("len") - fallback)))
    sums = F.aggregate("_path", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    p = stage(p.select("ticker", "date", F.col("_cr").alias("regime"), F.transform(sums, lambda x: F.expm1(F.round(x, 12))).alias("_c")))
    fan = p.select("ticker", F.posexplode("_c").alias("day", "x")).groupBy("ticker", (F.col("day") + 1).alias("day")).agg(
        *[F.percentile("x", q).alias(n) for n, q in (("q05", 0.05), ("q25", 0.25), ("q50", 0.50), ("q75", 0.75), ("q95", 0.95))])
    first = lambda cond: F.expr(f"coalesce(nullif(array_position(transform(_c, x -> {cond}), true), 0), {h} + 1)")
    s = p.withColumns({"_f": F.element_at("_c", h), "_t": first(f"x >= {barrier}"), "_s": first(f"x <= -{barrier}")})
    cut = s.groupBy("ticker").agg(F.percentile("_f", 0.05).alias("_q"))
    summary = s.join(cut, "ticker").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("starts"), F.max("regime").alias("regime"), F.avg("_f").alias("expected_return"), F.avg(flag(F.col("_f") > 0)).alias("upside_probability"),
        F.avg(flag(F.col("_t") < F.col("_s"))).alias("target_before_stop"), F.avg(flag(F.col("_s") < F.col("_t"))).alias("stop_before_target"),
        F.avg(F.when(F.col("_f") <= F.col("_q"), F.col("_f"))).alias("expected_shortfall"))
    return fan, summary


# Standard normal quantiles of the bands.
BAND_Z = {"p10": -1.2815515655446004, "p25": -0.6744897501960817, "median": 0.0, "p75": 0.6744897501960817, "p90": 1.2815515655446004}


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def lognormal_bands(prices: DataFrame, horizon: int) -> DataFrame:
    """Closed-form price quantiles and rise probability per day from the log-return mean and deviation."""
    p = prices.withColumn("_r", F.ln(ratio("close_price", F.lag("close_price").over(history()))))
    s = p.groupBy("ticker").agg(F.avg("_r").alias("mu"), F.stddev_samp("_r").alias("sd"), F.max(F.struct("date", "close_price"))["close_price"].alias("current_price"))
    s = s.where(F.col("sd") > 0).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    root = F.sqrt(F.col("day").cast("double"))
    band = lambda z: F.col("current_price") * F.exp(F.col("mu") * F.col("day") + z * F.col("sd") * root)
    return s.select("ticker", "day", *[band(z).alias(n) for n, z in BAND_Z.items()], normal_cdf(F.col("mu") * root / F.col("sd")).alias("probability_up"))

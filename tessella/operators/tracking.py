"""Tracked picks, decisions, their outcomes, and account constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import flag, ratio
from tessella.functions.scalars import hash_id
from tessella.operators.joins import future_path

HORIZONS = (5, 20, 60)
OUTCOME_COLUMNS = (
    "decision_id", "ticker", "source_date", "action", "decision_horizon_days", "evaluation_horizon_days", "entry_price", "stop_loss",
    "target_price", "evaluation_date", "evaluation_price", "return_pct", "barrier_result", "barrier_date", "status",
)


def refresh_returns(picks: DataFrame, prices: DataFrame, horizons: Sequence[int] = (1, 5, 20, 60)) -> DataFrame:
    """Entry price at the first row on or after the pick date and returns h rows later.

    ``picks``: (as_of_date, ticker, ...)."""
    p = future_path(picks.withColumn("date", F.col("as_of_date")), prices, max(horizons) + 1, inclusive=True).drop("date")
    at = lambda k: F.try_element_at("path", F.lit(k + 1))["close"]
    return p.withColumns({"entry_price": at(0), **{f"fwd_return_{h}d": ratio(at(h), at(0)) - 1 for h in horizons}}).drop("path")


def performance(hist: DataFrame, horizons: Sequence[int] = (1, 5, 20, 60)) -> DataFrame:
    """Evaluated picks, mean return and win rate per horizon of wide forward returns."""
    entries = F.array(*[F.struct(F.lit(f"{h}d").alias("horizon"), F.col(f"fwd_return_{h}d").alias("r")) for h in horizons])
    long = hist.select(F.explode(entries).alias("x")).select("x.*")
    return long.groupBy("horizon").agg(
        F.count("r").alias("evaluated_picks"), F.avg("r").alias("average_return"),
        F.try_divide(F.count_if(F.col("r") > 0).cast("double"), F.count("r").cast("double")).alias("win_rate"))


def evaluate_outcomes(decisions: DataFrame, prices: DataFrame, existing: DataFrame | None = None, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Outcome events of every matured (decision, horizon).

    A horizon matures when the market has that many later dates.  The ticker's own rows give the
    evaluation price; without enough of them (or without an entry price) the event is unavailable.
    The first barrier hit names the status, the stop winning a tie on the same date."""
    far = max(horizons)
    d = decisions.withColumn("date", F.col("source_date"))
    # market dates form a one-ticker history: the same path operator yields the global calendar
    market = prices.select("date").distinct().select(F.lit("*").alias("ticker"), "date", F.lit(0.0).alias("close_price"))
    days = d.select("source_date").distinct().withColumns({"ticker": F.lit("*"), "date": F.col("source_date")})
    market_path = future_path(days, market, far).select("source_date", F.transform("path", lambda x: x["date"]).alias("_market"))
    p = future_path(d, prices, far).drop("date").join(market_path, "source_date")
    p = p.withColumn("evaluation_horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    h = F.col("evaluation_horizon_days")
    p = p.where(F.size("_market") >= h)
    seen = F.slice("path", F.lit(1), h)
    first = lambda hit: F.array_min(F.transform(F.filter(seen, hit), lambda x: x["date"]))
    p = p.withColumns({
        "_ok": F.coalesce((F.col("reference_price") > 0) & (F.size("path") >= h), F.lit(False)),
        "_stop": first(lambda x: x["close"] <= F.col("stop_loss")), "_target": first(lambda x: x["close"] >= F.col("target_price"))})
    hit = F.when(F.col("_stop").isNotNull() & (F.col("_target").isNull() | (F.col("_stop") <= F.col("_target"))), "stopped").when(F.col("_target").isNotNull(), "targeted")
    at = F.try_element_at("path", h)
    own = lambda x: F.when(F.col("_ok"), x)
    p = p.withColumns({
        "evaluation_date": F.when(F.col("_ok"), at["date"]).otherwise(F.try_element_at("_market", h)),
        "evaluation_price": own(at["close"]), "return_pct": own(ratio(at["close"], "reference_price") - 1),
        "barrier_result": F.when(F.col("_ok"), F.coalesce(hit, F.lit("none"))).otherwise("unavailable"),
        "barrier_date": own(F.least("_stop", "_target")),
        "status": F.when(F.col("_ok"), F.coalesce(hit, F.lit("matured"))).otherwise("unavailable"),
        "decision_horizon_days": F.col("horizon_days"), "entry_price": F.col("reference_price")})
    p = p.withColumn("outcome_id", hash_id(["decision_id", "evaluation_horizon_days", "status", "evaluation_date"], 24))
    p = p.select("outcome_id", *OUTCOME_COLUMNS)
    return p if existing is None else p.join(existing.select("outcome_id"), "outcome_id", "left_anti")


# Order in which decisions are presented.
ACTION_PRIORITY = {
    "hold / consider add": 0, "paper buy candidate": 1, "hold": 2, "watch": 3, "review reduce": 4, "avoid for now": 5,
}


def stop_share(vol: str | Column) -> Column:
    """Twice the volatility within [5 %, 18 %], 8 % when unknown."""
    v = F.col(vol) if isinstance(vol, str) else vol
    return F.when(v > 0, F.least(F.lit(0.18), F.greatest(F.lit(0.05), v * 2))).otherwise(0.08)


def apply_policy(board: DataFrame, portfolio_value: float) -> DataFrame:
    """Decision, reason text, quantity at 1 % risk and priority of every board row."""
    c = F.col
    strong, listed = F.coalesce(c("model_probability_up") >= 0.60, F.lit(False)), F.coalesce(c("rank") <= 10, F.lit(False))
    sure, held = F.coalesce(c("confidence") >= 60, F.lit(True)), c("is_holding") == 1
    decision = (
        F.when(held & strong & sure, "hold / consider add").when(held & listed, "hold").when(held, "review reduce")
        .when(strong & listed & sure, "paper buy candidate").when(listed, "watch").otherwise("avoid for now"))
    chance = F.format_string("%.1f%% model probability", c("model_probability_up") * 100)
    parts = F.array_compact(F.array(
        F.when(c("rank").isNotNull(), F.concat(F.lit("watchlist rank "), c("rank").cast("int").cast("string"))),
        F.when(c("model_probability_up").isNotNull(), F.concat(chance, F.coalesce(F.concat(F.lit(" over "), c("model_horizon_days").cast("int").cast("string"), F.lit("d")), F.lit("")))),
        F.when(held & c("portfolio_weight").isNotNull(), F.format_string("already held at %.1f%% of portfolio", c("portfolio_weight") * 100))))
    risk = c("entry_price") * stop_share("vol_60d")
    quantity = F.when(F.lit(portfolio_value > 0) & (c("entry_price") > 0), F.greatest(F.lit(0), F.floor(F.try_divide(F.lit(portfolio_value * 0.01), risk)))).otherwise(0)
    order = F.create_map(*[F.lit(x) for kv in ACTION_PRIORITY.items() for x in kv])
    return board.withColumns({
        "decision": decision, "why": F.when(F.size(parts) == 0, "not enough signal yet").otherwise(F.array_join(parts, "; ")),
        "paper_quantity_1pct_risk": F.coalesce(quantity, F.lit(0)),
    }).withColumn("decision_priority", F.coalesce(order[c("decision")], F.lit(9)))


def decision_records(board: DataFrame, source_date: str, model_version: str = "baseline_v1") -> DataFrame:
    """Ledger records with stop, target and risk for buy candidates and a content id."""
    c = F.col
    buy = (c("entry_price") > 0) & (c("decision") == "paper buy candidate")
    v = c("vol_60d")
    share = F.when(v.isNull(), 0.08).otherwise(F.least(F.lit(0.18), F.greatest(F.lit(0.05), v * 2)))
    r = board.select(
        "ticker", F.lit(source_date).alias("source_date"), c("decision").alias("action"), c("why").alias("reason"), c("model_horizon_days").alias("horizon_days"),
        c("rank").alias("watchlist_rank"), c("model_probability_up").alias("probability_up"), "confidence", c("entry_price").alias("reference_price"),
        F.when(buy, c("entry_price") * (1 - share)).alias("stop_loss"), F.when(buy, c("entry_price") * (1 + share * 2)).alias("target_price"),
        F.when(buy, c("paper_quantity_1pct_risk")).otherwise(0).alias("paper_quantity"), F.lit(model_version).alias("model_version"))
    r = r.withColumn("risk_dollars", F.when((c("paper_quantity") > 0) & c("stop_loss").isNotNull(), F.abs(c("reference_price") - c("stop_loss")) * c("paper_quantity")))
    parts = [c("source_date"), c("ticker"), c("action"), F.coalesce(c("horizon_days").cast("string"), F.lit("")), c("model_version")]
    return r.withColumn("decision_id", hash_id(parts, 20))


# Texts of account constraints and the maxima that hold where a snapshot has none.
NO_TRADE, NO_SNAPSHOT = "No trade is implied by this action.", "No local trading constraint snapshot exists; keep this as review or paper only."
WEEKLY_USED, WEEKLY_LAST, WEEKLY_UNKNOWN = "Weekly trade budget is used up.", "Only one trade remains in the weekly trade budget.", "Weekly trade count is unknown."
PDT_CUSHION, PDT_CLEAR = "Equity snapshot is at or above the PDT threshold.", "Trading constraints snapshot does not show a current PDT block."
DAY_UNKNOWN = "Day-trade count is unknown for an account below or near the PDT threshold."
DAY_USED, DAY_LAST = "Rolling 5-trading-day day-trade budget is used up.", "Only one day trade remains in the rolling 5-trading-day budget."
FUNDS_UNKNOWN = "Buying power and cash are unknown in the local constraint snapshot."
POWER_UNKNOWN, POWER_NONE = "Buying power is unknown.", "Buying power is zero or negative."
POWER_SHORT = "Estimated notional $%s exceeds buying power $%s."
EXIT_UNKNOWN = "Do not treat same-day exit or re-entry as executable until the rolling day-trade count is known."
MAX_DAY_TRADES_5D, MAX_WEEKLY_TRADES = 3, 4


def constraint_status(board: DataFrame, snapshot: DataFrame, pdt_equity: float = 25_000.0) -> DataFrame:
    """Severity (safe < caution < blocked) and reasons of every board row under the latest account snapshot."""
    latest = snapshot.orderBy(F.desc("snapshot_at")).limit(1).select(
        F.lit(1).alias("_k"), F.lit(True).alias("_have"), *[F.col(c).alias(f"_{c}") for c in ("equity", "buying_power", "cash", "day_trades_5d", "weekly_trades", "max_day_trades_5d", "max_weekly_trades")])
    b = board.withColumn("_k", F.lit(1)).join(latest, "_k", "left")
    c = F.col
    have = c("_have").isNotNull()
    b = b.withColumns({
        "_max_day_trades_5d": F.coalesce(F.nullif("_max_day_trades_5d", F.lit(0)), F.lit(MAX_DAY_TRADES_5D)),
        "_max_weekly_trades": F.coalesce(F.nullif("_max_weekly_trades", F.lit(0)), F.lit(MAX_WEEKLY_TRADES))})
    text = F.lower("decision")
    has = lambda *words: F.coalesce(sum((flag(text.contains(w)) for w in words[1:]), flag(text.contains(words[0]))) > 0, F.lit(False))
    buys, sells = has("buy", "add"), has("reduce", "exit")
    weekly_used, cushion = F.coalesce(c("_weekly_trades") >= c("_max_weekly_trades"), F.lit(False)), F.coalesce(c("_equity") >= pdt_equity, F.lit(False))
    rule = lambda cond, level, code: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    overall = F.coalesce(
        rule(weekly_used, 3, WEEKLY_USED), rule(cushion, 1, PDT_CUSHION), rule(c("_day_trades_5d").isNull(), 2, DAY_UNKNOWN),
        rule(c("_day_trades_5d") >= c("_max_day_trades_5d"), 3, DAY_USED),
        rule(c("_day_trades_5d") == c("_max_day_trades_5d") - 1, 2, DAY_LAST),
        rule(c("_buying_power").isNull() & c("_cash").isNull(), 2, FUNDS_UNKNOWN), rule(F.lit(True), 1, PDT_CLEAR))
    notional = F.when((c("paper_quantity_1pct_risk") > 0) & (c("entry_price") > 0), c("paper_quantity_1pct_risk") * c("entry_price"))
    power = F.when(buys, F.coalesce(
        rule(c("_buying_power").isNull(), 2, POWER_UNKNOWN), rule(c("_buying_power") <= 0, 3, POWER_NONE),
        F.when(notional > c("_buying_power"), F.struct(F.lit(3).alias("level"), F.format_string(
            POWER_SHORT, F.format_number(notional, 2), F.format_number("_buying_power", 2)).alias("code")))))
    exits = rule(sells & ~cushion & c("_day_trades_5d").isNull(), 2, EXIT_UNKNOWN)
    weekly = F.coalesce(
        rule(c("_weekly_trades").isNull(), 2, WEEKLY_UNKNOWN), rule(weekly_used, 3, WEEKLY_USED),
        rule(c("_weekly_trades") == c("_max_weekly_trades") - 1, 2, WEEKLY_LAST))
    found = F.array_compact(F.array(overall, power, exits, weekly))
    level = F.array_max(F.transform(found, lambda x: x["level"]))
    codes = F.array_join(F.array_distinct(F.transform(found, lambda x: x["code"])), " ")
    trade = buys | sells
    status = F.when(~trade, "no trade").when(~have, "blocked").when(level >= 3, "blocked").when(level == 2, "caution").otherwise("safe")
    reason = F.when(~trade, NO_TRADE).when(~have, NO_SNAPSHOT).otherwise(codes)
    return b.withColumns({"constraint_status": status, "constraint_reason": reason}).select(*board.columns, "constraint_status", "constraint_reason")


def best_horizon(preds: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Each ticker's prediction with the highest probability, the shortest horizon winning ties,
    then the largest of the other columns in their order."""
    rest = [x for x in preds.columns if x not in (*by, "probability_up", "horizon_days")]
    best = preds.groupBy(*by).agg(F.max(F.struct("probability_up", (-F.col("horizon_days")).alias("_h"), *rest)).alias("_b"))
    return best.select(*by, "_b.probability_up", (-F.col("_b._h")).alias("horizon_days"), *[F.col(f"_b.{x}").alias(x) for x in rest])


def decision_board(watch: DataFrame, queue: DataFrame, holdings: DataFrame, shortlist: DataFrame, portfolio_value: float) -> DataFrame:
    """Watch list joined with the best model row, holdings and shortlist membership, under the policy.

    ``queue`` may come without ``model_rank``.  ``watch`` is read twice: a table or a staged frame."""
    from tessella.operators.joins import flag_in

    queue = queue.join(watch.select("ticker"), "ticker", "left_semi")
    rank = [c for c in ("model_rank",) if c in queue.columns]
    best = best_horizon(queue).select("ticker", F.col("probability_up").alias("model_probability_up"), F.col("horizon_days").alias("model_horizon_days"), "model_name", *rank)
    b = watch.join(best, "ticker", "left").join(holdings.select("ticker", "quantity", "portfolio_weight"), "ticker", "left")
    b = b.fillna(0.0, ["quantity", "portfolio_weight"]).withColumn("is_holding", flag(F.col("quantity") > 0))
    return apply_policy(flag_in(b, shortlist, "ticker", "in_shortlist"), portfolio_value)


def rank_decisions(board: DataFrame, n: int) -> DataFrame:
    return board.orderBy(F.asc("decision_priority"), F.asc("rank"), F.desc_nulls_last("model_probability_up"), F.asc("ticker")).limit(n)


def holdings_value(holdings: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """Market value and weight of every holding at its latest close, cash included in the total.

    ``holdings`` is read three times: a table or a staged frame."""
    last = prices.join(holdings.select("ticker"), "ticker", "left_semi").groupBy("ticker").agg(F.max_by("close_price", "date").alias("close_price"))
    h = holdings.join(last, "ticker", "left").withColumn("market_value", F.col("quantity") * F.col("close_price"))
    total = h.select(F.coalesce(F.sum("market_value"), F.lit(0.0)) + F.lit(cash)).scalar()
    return h.withColumn("portfolio_value", total).withColumn("portfolio_weight", F.when(F.col("portfolio_value") > 0, F.col("market_value") / F.col("portfolio_value")).otherwise(0.0))

"""Data-quality counters, health metrics and contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import flag
from tessella.operators.warehouse import metric_rows


def ticker_coverage(panel: DataFrame) -> DataFrame:
    """Decision span, rows, mean liquidity rank and sector coverage of every ticker."""
    return panel.groupBy("ticker").agg(
        F.min("date").alias("first_decision_date"), F.max("date").alias("last_decision_date"), F.count(F.lit(1)).alias("decision_rows"),
        F.avg("liquidity_rank").alias("mean_liquidity_rank"), F.avg(F.col("sector").isNotNull().cast("double")).alias("sector_coverage"))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Size, span and target facts of a labelled panel as metric rows."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    return metric_rows(df.agg(
        F.count(F.lit(1)).alias("panel_rows"), F.countDistinct("ticker").alias("panel_tickers"), F.countDistinct("date").alias("panel_dates"),
        day(F.min("date")).alias("first_day"), day(F.max("date")).alias("last_day"), day(F.max("evaluation_date")).alias("last_evaluation_day"),
        F.count_if(F.col("market_members") <= 1).alias("rows_without_peers"), F.avg(F.col("sector").isNotNull().cast("double")).alias("sector_coverage"),
        F.avg("primary_residual_top_decile").alias("top_decile_share")))


# Preference among spans with equally new data.
SPAN_PREFERENCE = {"5year": 5, "year": 4, "3month": 3, "month": 2, "week": 1}


def span_inventory(df: DataFrame) -> DataFrame:
    return df.groupBy("span").agg(F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("max_date"))


def choose_span(df: DataFrame, requested: str) -> DataFrame:
    """The requested span when populated, otherwise the newest, most preferred, largest one."""
    pref = F.create_map(*[F.lit(x) for kv in SPAN_PREFERENCE.items() for x in kv])
    order = [(F.col("span") == requested).desc(), F.desc("max_date"), F.coalesce(pref[F.col("span")], F.lit(0)).desc(), F.desc("n_rows")]
    return span_inventory(df).where(F.col("n_rows") > 0).orderBy(*order).limit(1)


def monthly_universe(prices: DataFrame) -> DataFrame:
    """Observed, first-seen and last-seen tickers per month."""
    per = prices.select("ticker", F.trunc("date", "month").alias("month")).distinct()
    life = per.groupBy("ticker").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    count = lambda d, m, out: d.groupBy(F.col(m).alias("month")).agg(F.count(F.lit(1)).alias(out))
    out = count(per, "month", "observed_tickers").join(count(life, "first", "first_seen_tickers"), "month", "left").join(count(life, "last", "last_seen_tickers"), "month", "left")
    return out.fillna(0)


def price_quality(bars: DataFrame, recent_days: int = 400) -> DataFrame:
    """Duplicate groups and invalid rows, split into recent, legacy and interpolated.

    ``bars``: (ticker, date, close_price, volume, interpolated)."""
    last = bars.select(F.max("date")).scalar()
    bad = F.coalesce(F.col("close_price").isNull() | (F.col("close_price") <= 0) | (F.col("volume") < 0), F.lit(True))
    raw = bad & (F.coalesce("interpolated", F.lit(0)) != 1)
    recent = F.col("date") >= F.date_sub(last, recent_days)
    per = bars.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("close_price").isNull()).alias("mc"), F.count_if(F.col("volume").isNull()).alias("mv"),
        F.count_if(raw & recent).alias("r"), F.count_if(raw & ~recent).alias("l"), F.count_if(bad & (F.col("interpolated") == 1)).alias("i"))
    return metric_rows(per.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_excess_rows"), F.sum("mc").alias("missing_close_rows"),
        F.sum("mv").alias("missing_volume_rows"), F.sum("r").alias("recent_invalid_raw_prices"), F.sum("l").alias("legacy_invalid_raw_prices"),
        F.sum("i").alias("invalid_interpolated_prices")))


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of nulls per column with a warning level."""
    rows = metric_rows(df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]))
    return rows.select(F.col("metric").alias("feature"), F.col("value").alias("null_rate"),
                       F.when(F.col("value") == 1, "unusable").when(F.col("value") > 0.25, "high").otherwise("ok").alias("level"))


def pipeline_health(prices: DataFrame, shortlist_dates: DataFrame, watch_dates: DataFrame) -> DataFrame:
    """Latest dates, coverage of the latest date, and alignment of the outputs with the market."""
    last = prices.select(F.max("date")).scalar()
    p = prices.agg(F.countDistinct("ticker").alias("tracked"), F.countDistinct(F.when(F.col("date") == last, F.col("ticker"))).alias("latest"), F.max("date").alias("market"))
    s, w = shortlist_dates.select(F.max("date")).scalar(), watch_dates.select(F.max("date")).scalar()
    text = lambda c: c.cast("string")
    one = p.withColumns({"shortlist": s, "watch": w})
    kv = [("latest_market_date", text(F.col("market"))), ("latest_market_tickers", text(F.col("latest"))), ("tracked_market_tickers", text(F.col("tracked"))),
          ("latest_market_coverage", F.format_string("%.6f", F.col("latest") / F.col("tracked"))), ("latest_shortlist_date", text(F.col("shortlist"))),
          ("shortlist_aligned", text(flag(F.col("shortlist") == F.col("market")))), ("watchlist_aligned", text(flag(F.col("watch") == F.col("market"))))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in kv])).alias("x")).select("x.*")


def readiness(evals: DataFrame, preds: DataFrame, horizons: Sequence[int], min_rows: int) -> DataFrame:
    """One row per expected horizon: predictions present, fits present, exactly one champion per run."""
    h = evals.sparkSession.createDataFrame([(int(x),) for x in horizons], "horizon_days long")
    p = preds.groupBy("horizon_days").agg(F.count(F.lit(1)).alias("prediction_rows"))
    per_run = evals.where(F.col("fit_status") == "ok").groupBy("horizon_days", "run_id").agg(F.sum(flag(F.col("is_champion") == "1")).alias("c"))
    e = per_run.groupBy("horizon_days").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("c") != 1).alias("bad_runs"))
    out = h.join(p, "horizon_days", "left").join(e, "horizon_days", "left").fillna(0)
    ok = (F.col("prediction_rows") >= min_rows) & (F.col("runs") > 0) & (F.col("bad_runs") == 0)
    return out.withColumn("ready", flag(ok))


def check_contract(df: DataFrame, required: Sequence[str], min_rows: int, max_rows: int | None = None, nonblank: Sequence[str] = ()) -> DataFrame:
    """One status row per rule: required columns, row bounds, blank values."""
    missing = [c for c in required if c not in df.columns]
    checked = [c for c in nonblank if c in df.columns]
    a = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"b_{c}") for c in checked])
    rule = lambda name, value, ok: F.struct(F.lit(name).alias("rule"), value.cast("long").alias("observed"), flag(ok).alias("passed"))
    rules = [rule("required columns missing", F.lit(len(missing)), F.lit(not missing)), rule("minimum rows", F.col("rows"), F.col("rows") >= min_rows)]
    if max_rows is not None:
        rules.append(rule("maximum rows", F.col("rows"), F.col("rows") <= max_rows))
    rules += [rule(f"blank {c}", F.col(f"b_{c}"), F.col(f"b_{c}") == 0) for c in checked]
    return a.select(F.explode(F.array(*rules)).alias("x")).select("x.*")


def ledger_health(status: DataFrame, health: DataFrame) -> DataFrame:
    """Decision-ledger counts upserted into the health table."""
    from tessella.sources.sinks import upsert

    names: Mapping[str, str] = {
        "decisions": "automatic_paper_decisions_rows", "outcome_events": "automatic_paper_outcome_events_rows", "open": "automatic_paper_open_decisions",
        "matured": "automatic_paper_matured_decisions", "unavailable_decisions": "automatic_paper_unavailable_decisions", "unavailable": "automatic_paper_unavailable_events"}
    rows = status.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("string").alias("value")) for c, n in names.items()])).alias("x")).select("x.*")
    return upsert(health, rows, ["metric"])

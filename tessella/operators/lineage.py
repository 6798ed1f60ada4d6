"""Universe membership, lifecycles, identity lineage and listing snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import flag, history
from tessella.functions.scalars import hash_id, is_iso_date


# Eligibility reasons of point-in-time membership, first failing rule first.
DUPLICATE, NO_CLOSE, TOO_SHORT, ELIGIBLE = "duplicate_source_rows", "missing_close", "insufficient_history", "eligible_past_only"
# Reasons of candidate membership, first failing rule first.
IN_SOURCE, SHORT_WINDOW, NO_RANK, ILLIQUID, MISSING_ELIGIBLE = (
    "already_present_in_source", "insufficient_20_date_history", "missing_liquidity_rank", "outside_top_{top}_liquidity", "eligible_missing_past_only")
# Status of sector lineage with and without a current profile.
SNAPSHOT_ONLY, NO_SECTOR = "current_snapshot_only_not_valid_for_historical_features", "no_sector_metadata"
# Safety of corporate events, first failing rule first.
UNTRUSTED, UNCONFIRMED, UNDATED, SAFE = "untrusted_or_missing_authority", "match_not_confirmed", "missing_or_invalid_effective_date", "authoritative_dated_confirmed"


def membership(bars: DataFrame, cutoff: str, min_history: int) -> DataFrame:
    """Point-in-time membership of every (date, ticker) with the reason of eligibility."""
    per = bars.where(F.col("date") < F.lit(cutoff).cast("date")).groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("source_rows_on_date"), F.max(flag(F.col("close_price").isNotNull())).alias("has_close"),
        F.max(flag(F.col("volume").isNotNull())).alias("has_volume"))
    per = per.withColumn("history_observations", F.row_number().over(history()))
    reason = (
        F.when(F.col("source_rows_on_date") != 1, DUPLICATE).when(F.col("has_close") == 0, NO_CLOSE)
        .when(F.col("history_observations") < min_history, TOO_SHORT).otherwise(ELIGIBLE))
    return per.withColumns({"eligibility_reason": reason, "universe_eligible": flag(reason == ELIGIBLE)}).withColumnRenamed("date", "as_of_date")


def lifecycle(bars: DataFrame, cutoff: str, absence_days: int = 30) -> DataFrame:
    """Observed span, coverage against the market calendar, censoring and terminal absence per ticker."""
    b = bars.where(F.col("date") < F.lit(cutoff).cast("date"))
    daily = b.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))
    per = daily.groupBy("ticker").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count(F.lit(1)).alias("observed_dates"), F.sum("n").alias("source_rows"))
    cal = b.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    lo, hi = b.select(F.min("date")).scalar(), b.select(F.max("date")).scalar()
    per = per.join(cal.select(F.col("date").alias("first_seen"), F.col("_i").alias("_a")), "first_seen")
    per = per.join(cal.select(F.col("date").alias("last_seen"), F.col("_i").alias("_b")), "last_seen")
    per = per.withColumns({
        "market_dates_in_observed_span": F.col("_b") - F.col("_a") + 1, "left_censored_at_dataset_start": flag(F.col("first_seen") == lo),
        "right_censored_at_training_end": flag(F.col("last_seen") == hi), "terminal_absence_calendar_days": F.datediff(hi, F.col("last_seen"))}).drop("_a", "_b")
    return per.withColumns({
        "coverage_ratio": F.col("observed_dates") / F.col("market_dates_in_observed_span"),
        "terminal_absence_proxy": flag((F.col("terminal_absence_calendar_days") >= absence_days) & (F.col("terminal_absence_calendar_days") > 0))})


def sector_audit(life: DataFrame, profiles: DataFrame) -> DataFrame:
    """Current profiles next to lifecycles; a current snapshot is never safe for the past."""
    p = profiles.select("ticker", F.col("sector").alias("current_sector"), F.col("industry").alias("current_industry"), F.lit(1).alias("_p"))
    have = F.col("_p").isNotNull()
    return life.select("ticker").join(p, "ticker", "left").withColumns({
        "current_profile_available": flag(have), "point_in_time_sector_safe": F.lit(0),
        "lineage_status": F.when(have, SNAPSHOT_ONLY).otherwise(NO_SECTOR)}).drop("_p")


# Authorities whose dated, confirmed events are safe.
TRUSTED_AUTHORITIES = ("SEC", "FINRA", "NASDAQ")


def event_safety(events: DataFrame) -> DataFrame:
    """Whether a corporate event is authoritative, confirmed and validly dated, and why not."""
    authority, conf = F.upper(F.trim(F.coalesce("source_authority", F.lit("")))), F.lower(F.trim(F.coalesce("match_confidence", F.lit(""))))
    dated = is_iso_date(F.trim(F.coalesce("effective_date", F.lit(""))))
    reason = (
        F.when(~authority.isin(*TRUSTED_AUTHORITIES), UNTRUSTED).when(conf != "confirmed", UNCONFIRMED)
        .when(~F.coalesce(dated, F.lit(False)), UNDATED).otherwise(SAFE))
    return events.withColumns({"safety_reason": reason, "point_in_time_safe": flag(reason == SAFE)})


def observed_securities(life: DataFrame) -> DataFrame:
    """Stable id of every observed (ticker, first seen)."""
    t = F.upper(F.trim("ticker"))
    return life.withColumns({"ticker": t, "security_id": F.concat(F.lit("observed-"), hash_id([t, "first_seen"], 16))})


def symbol_lineage(securities: DataFrame) -> DataFrame:
    """Provisional symbol intervals from observed coverage."""
    return securities.select(
        "security_id", "ticker", F.col("first_seen").alias("effective_from"), F.col("last_seen").alias("effective_to"),
        F.lit("OBSERVED_PRICE_COVERAGE").alias("source_authority"), F.lit("provisional").alias("match_confidence"), F.lit(0).alias("point_in_time_safe"))


def classification_lineage(securities: DataFrame, audit: DataFrame) -> DataFrame:
    """Undated current classifications, marked unsafe."""
    a = audit.where(F.col("current_profile_available") == 1).select("ticker", F.col("current_sector").alias("sector"), F.col("current_industry").alias("industry"))
    return securities.select("security_id", "ticker").join(a, "ticker").withColumns({
        "source_authority": F.lit("NASDAQ_CURRENT_SNAPSHOT"), "point_in_time_safe": F.lit(0)})


def coverage_gaps(securities: DataFrame, audit: DataFrame, events: DataFrame, sample: int = 20) -> DataFrame:
    """Gap types with affected tickers and the first tickers as a sample.

    Samples come from a sorted limit, so no task ever collects the whole ticker list."""
    safe = events.where(F.col("point_in_time_safe") == 1)
    hit = safe.select(F.upper(F.trim("ticker")).alias("ticker")).union(safe.select(F.upper(F.trim("prior_ticker")))).distinct()
    per = securities.select("ticker").join(hit.withColumn("_h", F.lit(1)), "ticker", "left").join(
        audit.select("ticker", "current_profile_available"), "ticker", "left")
    n = per.agg(F.count(F.lit(1)).alias("all"), F.count("_h").alias("matched"), F.count_if(F.coalesce("current_profile_available", F.lit(0)) == 0).alias("unclassified"))

    def first(d):
        s = d.select("ticker").orderBy("ticker").limit(sample)
        return s.select(F.array_join(F.array_sort(F.collect_list("ticker")), ",")).scalar()

    every, bare = first(per), first(per.where(F.coalesce("current_profile_available", F.lit(0)) == 0))
    row = lambda gap, c, s, b: F.struct(F.lit(gap).alias("gap_type"), c.alias("affected_tickers"), s.alias("sample_tickers"), F.lit(b).alias("model_feature_blocked"))
    unmatched = F.col("all") - F.col("matched")
    one = n.withColumns({"_s": every, "_b": bare})
    return one.select(F.explode(F.array(
        row("historical_listing_authority_missing", unmatched, F.col("_s"), 1), row("historical_delisting_authority_missing", unmatched, F.col("_s"), 1),
        row("historical_sector_lineage_missing", F.col("all"), F.col("_s"), 1), row("current_classification_missing", F.col("unclassified"), F.col("_b"), 0))).alias("x")).select("x.*")


def entity_churn(refs: DataFrame) -> DataFrame:
    """Presence of every entity over the anchors with entry, departure and symbol-change flags.

    ``refs``: (anchor, entity_id, ticker, type, name); the packed sets hold an entity's own
    symbols and names."""
    lo, hi = refs.select(F.min("anchor")).scalar(), refs.select(F.max("anchor")).scalar()
    pack = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "|")
    g = refs.groupBy("entity_id").agg(
        F.min("anchor").alias("first_anchor_seen"), F.max("anchor").alias("last_anchor_seen"), F.countDistinct("ticker").alias("ticker_count"),
        pack("ticker").alias("tickers"), F.array_join(F.array_sort(F.collect_set(F.coalesce("type", F.lit("UNMAPPED")))), "|").alias("types"), pack("name").alias("names"))
    a, b = F.col("first_anchor_seen") == lo, F.col("last_anchor_seen") == hi
    return g.withColumns({
        "present_first_anchor": flag(a), "present_last_anchor": flag(b), "candidate_departure": flag(a & ~b), "candidate_entry": flag(~a & b),
        "candidate_symbol_change": flag(F.col("ticker_count") > 1)})


def missing_candidates(bars: DataFrame, reference: DataFrame, source: DataFrame, anchors: Sequence[str], window: int = 20, top: int = 1000) -> DataFrame:
    """Liquid common stocks the source lacks at each anchor, from complete ``window``-date histories.

    ``reference``: (ticker, security_type, entity_id); ``source``: (ticker, date)."""
    from tessella.operators.sets import stable_rank
    from tessella.session import stage

    out = None
    days = bars.select("date").distinct()
    for a in anchors:
        # the window is a short list of dates: its first date is a scalar, so the scan is pruned
        upto = days.where(F.col("date") <= F.lit(a).cast("date")).orderBy(F.desc("date")).limit(window)
        lo, hi = upto.select(F.min("date")).scalar(), upto.select(F.max("date")).scalar()
        w = bars.where((F.col("date") >= lo) & (F.col("date") <= hi) & F.col("close_price").isNotNull() & F.col("volume").isNotNull())
        v = w.groupBy("ticker").agg(F.sum(F.col("close_price") * F.greatest("volume", F.lit(0.0))).alias("_s"), F.count(F.lit(1)).alias("_n"))
        v = v.where(F.col("_n") == window).select("ticker", (F.col("_s") / window).alias("mean_dollar_volume"))
        have = source.where(F.col("date") == hi).select("ticker").distinct()
        one = v.join(reference, "ticker", "left").withColumn("anchor_date", hi)
        one = one.join(have.withColumn("_in", F.lit(1)), "ticker", "left")
        out = one if out is None else out.unionByName(one)
    out = stage(out)
    cs = F.coalesce(F.col("security_type") == "CS", F.lit(False))
    r = stable_rank(out, "mean_dollar_volume", "ticker", "rank_all_market", ["anchor_date"])
    k = stable_rank(out.where(cs), "mean_dollar_volume", "ticker", "rank_common_stock", ["anchor_date"]).select("anchor_date", "ticker", "rank_common_stock")
    r = r.join(k, ["anchor_date", "ticker"], "left").where(cs & F.col("_in").isNull())
    kind = F.when(F.col("rank_all_market") <= top, "conservative_all_market").when(F.col("rank_common_stock") <= top, "common_stock_sensitivity")
    return r.withColumn("candidate_set", kind).where(F.col("candidate_set").isNotNull()).drop("_in")


def candidate_registry(cands: DataFrame) -> DataFrame:
    """Latest attributes and all tickers and anchor dates of the persistent entities."""
    anchors = cands.select(F.countDistinct("anchor_date")).scalar()
    g = cands.groupBy("entity_id").agg(
        F.countDistinct("anchor_date").alias("_n"), F.max(F.struct("anchor_date", "ticker", "security_type"))["security_type"].alias("security_type"),
        F.array_join(F.array_sort(F.collect_set("ticker")), "|").alias("anchor_tickers"),
        F.array_join(F.array_sort(F.collect_set(F.col("anchor_date").cast("string"))), "|").alias("anchor_dates"))
    return g.where(F.col("_n") == anchors).drop("_n")


def alias_intervals(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Alias validity per entity: from the change event until the day before the next one;
    anchor-only tickers have open intervals."""
    w = Window.partitionBy("entity_id").orderBy("date", "ticker")
    # an entity's change events: a ticker seen again keeps its last event
    ev = events.groupBy("entity_id", "ticker").agg(F.max("date").alias("date"))
    ev = ev.withColumn("valid_to", F.date_sub(F.lead("date").over(w), 1))
    ev = ev.select("entity_id", "ticker", F.col("date").alias("valid_from"), "valid_to", F.lit("ticker_event").alias("validity_source"))
    extra = anchors.select("entity_id", "ticker").distinct().join(ev, ["entity_id", "ticker"], "left_anti")
    none = F.lit(None).cast("date")
    return ev.unionByName(extra.select("entity_id", "ticker", none.alias("valid_from"), none.alias("valid_to"), F.lit("anchor_snapshot").alias("validity_source")))


def candidate_membership(source: DataFrame, candidates: DataFrame, start: str, cutoff: str, window: int = 20, top: int = 1000) -> DataFrame:
    """Daily membership of candidate entities ranked together with the source universe.

    Means run over the last ``window`` observations of a key; missing days do not reset them, and
    rows without close or volume are no observations and have no rank.
    Source rows start ``window - 1`` market dates before ``start``, candidate rows at ``start``."""
    from tessella.operators.sets import stable_rank
    from tessella.session import stage

    s, c = F.lit(start).cast("date"), F.lit(cutoff).cast("date")
    days = source.select("date").distinct()
    warm = days.where(F.col("date") <= s).orderBy(F.desc("date")).limit(window).select(F.min("date")).scalar()
    # greatest() skips nulls, a missing volume must not become 0
    dv = F.when(F.col("volume").isNotNull(), F.col("close_price") * F.greatest("volume", F.lit(0.0)))
    a = source.where((F.col("date") >= warm) & (F.col("date") < c)).select(F.concat(F.lit("SRC:"), "ticker").alias("key"), F.lit(None).cast("string").alias("entity_id"), "ticker", "date", dv.alias("dv"), F.lit(0).alias("cand"))
    on_market = candidates.join(days, "date", "left_semi")
    b = on_market.where((F.col("date") >= s) & (F.col("date") < c)).select(F.concat(F.lit("ENT:"), "entity_id").alias("key"), F.col("entity_id").cast("string").alias("entity_id"), "ticker", "date", dv.alias("dv"), F.lit(1).alias("cand"))
    w = Window.partitionBy("key").orderBy("date")
    observed = Window.partitionBy("key", F.col("dv").isNull()).orderBy("date")
    both = a.unionByName(b).withColumns({
        "history_observations": F.count("dv").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_mean": F.avg("dv").over(observed.rowsBetween(-(window - 1), 0))})
    full = F.col("dv").isNotNull() & (F.col("history_observations") >= window)
    both = stage(both.withColumn("mean_dollar_volume", F.when(full, F.col("_mean"))).drop("_mean"))
    ranked = stable_rank(both.where(F.col("mean_dollar_volume").isNotNull()), "mean_dollar_volume", "key", "combined_liquidity_rank", ["date"])
    out = both.where((F.col("cand") == 1) & (F.col("date") >= s)).join(ranked.select("key", "date", "combined_liquidity_rank"), ["key", "date"], "left")
    taken = both.where(F.col("cand") == 0).select("ticker", "date").distinct().withColumn("_t", F.lit(1))
    out = out.join(taken, ["ticker", "date"], "left")
    reason = (
        F.when(F.col("_t").isNotNull(), IN_SOURCE).when(F.col("history_observations") < window, SHORT_WINDOW)
        .when(F.col("combined_liquidity_rank").isNull(), NO_RANK).when(F.col("combined_liquidity_rank") > top, ILLIQUID.format(top=top))
        .otherwise(MISSING_ELIGIBLE))
    return out.withColumns({"eligibility_reason": reason, "universe_eligible": flag(reason == MISSING_ELIGIBLE)}).drop("_t", "key", "dv", "cand")


def listing_snapshots(rows: DataFrame) -> DataFrame:
    """Per snapshot: rows, exact duplicate symbols and symbols that differ only in case.

    ``rows``: (snapshot, symbol, name)."""
    sym = rows.groupBy("snapshot", "symbol").agg(F.count(F.lit(1)).alias("n"))
    norm = sym.groupBy("snapshot", F.upper("symbol").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("d"))
    return norm.groupBy("snapshot").agg(F.sum("n").alias("n_rows"), F.sum("d").alias("exact_symbol_duplicates"), F.count_if(F.col("k") > 1).alias("case_collisions"))


def reused_symbols(rows: DataFrame) -> DataFrame:
    """Normalised symbols that carry several names across all snapshots."""
    g = rows.groupBy(F.upper("symbol").alias("symbol_norm")).agg(F.countDistinct("name").alias("names"))
    return g.where(F.col("names") > 1)


def name_search(rows: DataFrame, pattern: str) -> DataFrame:
    """Distinct listings whose name matches the pattern, ignoring case."""
    return rows.where(F.col("name").rlike(f"(?i){pattern}")).select("snapshot", "symbol", "name").distinct()


FILINGS = "struct<name:string,filings:struct<recent:struct<form:array<string>,filingDate:array<string>>>>"


def identity_bridge(cases: DataFrame, matches: DataFrame, directory: DataFrame, forms: Sequence[str] = ("25", "25-NSE", "15-12G")) -> DataFrame:
    """Per symbol: identifier matches, distinct ids and names, terminal filing forms, directory presence.

    ``cases``: (symbol, filings JSON); ``matches``: (symbol, figi, name); ``directory``: (symbol)."""
    doc = F.from_json("filings", FILINGS)
    term = F.exists(F.coalesce(doc["filings"]["recent"]["form"], F.array().cast("array<string>")), lambda f: f.isin(*forms))
    c = cases.select("symbol", doc["name"].alias("entity"), flag(term).alias("has_terminal_form"))
    m = matches.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("match_count"), F.countDistinct("figi").alias("figi_count"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))
    d = directory.select("symbol").distinct().withColumn("_d", F.lit(1))
    return c.join(m, "symbol", "left").join(d, "symbol", "left").withColumns({
        "match_count": F.coalesce("match_count", F.lit(0)), "figi_count": F.coalesce("figi_count", F.lit(0)), "names": F.coalesce("names", F.lit("")), "in_directory": F.coalesce("_d", F.lit(0))}).drop("_d")

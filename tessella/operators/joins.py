"""Join operators: point-in-time, strict, as-of, n-th-row-after, latest, paired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import history, ratio
from tessella.functions.ranking import first_rows


def validate_intervals(iv: DataFrame, keys: Sequence[str] = ("ticker", "sector", "valid_from")) -> DataFrame:
    """Counts of rows with missing keys and of rows whose end is not after their start."""
    missing = None
    for k in keys:
        missing = F.col(k).isNull() if missing is None else missing | F.col(k).isNull()
    return iv.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.count_if(missing).alias("missing_keys"),
        F.count_if(F.col("valid_to") <= F.col("valid_from")).alias("non_positive"),
    )


def asof_interval_join(left: DataFrame, intervals: DataFrame, value: str) -> DataFrame:
    """Latest interval starting on or before the row's date; null once that interval has ended.

    Interval starts are merged into each ticker's history and carried forward, so the join
    is one shuffle without fan-out.  An expired latest interval yields null even when an
    older interval would still cover the date."""
    payload = F.struct(F.col(value).alias("v"), F.col("valid_to").alias("to"))
    starts = intervals.select("ticker", F.col("valid_from").alias("date"), payload.alias("_iv"), F.lit(0).alias("_row"))
    rows = left.withColumns({"_iv": F.lit(None).cast(starts.schema["_iv"].dataType), "_row": F.lit(1)})
    merged = rows.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "_row").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("_hit", F.last("_iv", ignorenulls=True).over(w)).where(F.col("_row") == 1)
    live = F.col("_hit.to").isNull() | (F.col("date") < F.col("_hit.to"))
    return merged.withColumn(value, F.when(live, F.col("_hit.v"))).drop("_iv", "_row", "_hit")


def interval_lookup(left: DataFrame, intervals: DataFrame, value: str) -> DataFrame:
    """:func:`asof_interval_join` for tickers with few intervals each: an interval is cut where the
    next one of its ticker starts, so a row meets at most one.  Rows that lie by ticker already are
    neither sent nor sorted again."""
    order = Window.partitionBy("ticker").orderBy("valid_from", "valid_to", value)
    iv = intervals.where(F.col("valid_from").isNotNull()).select(
        F.col("ticker").alias("_k"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"),
        F.col(value).alias("_v"), F.lead("valid_from").over(order).alias("_next"))
    day = F.col("date")
    hit = (F.col("ticker") == F.col("_k")) & (day >= F.col("_from")) & (F.col("_next").isNull() | (day < F.col("_next")))
    live = F.col("_to").isNull() | (day < F.col("_to"))
    return left.join(iv, hit, "left").withColumn(value, F.when(live, F.col("_v"))).drop("_k", "_from", "_to", "_v", "_next")


def eligible(prices: DataFrame, membership: DataFrame) -> DataFrame:
    """Prices that were universe members on their own date (keys upper-cased and trimmed)."""
    m = membership.where(F.col("universe_eligible") == 1).select(
        F.upper(F.trim("ticker")).alias("ticker"), F.to_date("as_of_date").alias("date"))
    p = prices.withColumns({"ticker": F.upper(F.trim("ticker")), "date": F.to_date("date")})
    return p.join(m, ["ticker", "date"], "left_semi")


def strict_merge(prices: DataFrame, membership: DataFrame) -> DataFrame:
    """1:1 merge on (ticker, date) that fails the job on duplicates or unmatched keys.

    Counting rows per key uses the partitioning and order of the merge join itself, so the
    checks add no shuffle and no sort."""
    key = Window.partitionBy("ticker", "date")
    p = prices.select("ticker", "date", "close_price", "volume", F.count(F.lit(1)).over(key).alias("_np"))
    m = membership.select("ticker", F.col("as_of_date").alias("date"), "universe_eligible", "eligibility_reason").withColumn("_nm", F.count(F.lit(1)).over(key))
    j = p.join(m, ["ticker", "date"], "full_outer")
    bad = (F.coalesce("_np", F.lit(0)) != 1) | (F.coalesce("_nm", F.lit(0)) != 1)
    check = F.when(bad, F.raise_error(F.lit("strict merge: duplicate or unmatched (ticker, date)")).cast("int"))
    return j.withColumn("_ok", F.coalesce(check, F.lit(0))).where(F.col("_ok") == 0).drop("_np", "_nm", "_ok")


def future_path(decisions: DataFrame, prices: DataFrame, n: int, inclusive: bool = False) -> DataFrame:
    """``path`` = the ticker's next ``n`` (date, close) rows after the decision date, or from it
    on when ``inclusive``.

    Decisions are merged into each ticker's history at their position, and a range frame over
    positions gathers the following price rows: one shuffle on the ticker, no fan-out join."""
    first = F.lit(1 if inclusive else 0)
    px = prices.select("ticker", "date", F.struct("date", F.col("close_price").alias("close")).alias("_px"), first.alias("_o"))
    mine = decisions.withColumns({"_px": F.lit(None).cast(px.schema["_px"].dataType), "_o": 1 - first, "_d": F.lit(1)})
    both = mine.unionByName(px, allowMissingColumns=True)
    hist = Window.partitionBy("ticker").orderBy("date", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_pos", F.count("_px").over(hist).cast("int"))
    ahead = Window.partitionBy("ticker").orderBy("_pos").rangeBetween(1, n)
    return both.withColumn("path", F.collect_list("_px").over(ahead)).where(F.col("_d") == 1).drop("_px", "_o", "_d", "_pos")


def nth_row_after(decisions: DataFrame, prices: DataFrame, h: int, inclusive: bool = False) -> DataFrame:
    """The ``h``-th price row of the ticker after the decision date (counted from it when ``inclusive``)."""
    hit = F.try_element_at("path", F.lit(h))
    return future_path(decisions, prices, h, inclusive).withColumns({
        "target_date": hit["date"], "target_close": hit["close"]}).drop("path")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key.  A max over a struct combines on the map side, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def enrich(left: DataFrame, *sides: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Chain of left joins."""
    for side, keys in sides:
        left = left.join(side, list(keys), "left")
    return left


def research_queue(watch: DataFrame, preds: DataFrame, horizon: int, n: int, threshold: float = 0.55) -> DataFrame:
    """Watch-list rows whose prediction reaches the threshold, in queue order."""
    p = preds.where((F.col("horizon_days") == horizon) & (F.col("probability_up") >= threshold))
    order = [F.desc("probability_up"), F.desc("confidence"), F.asc("rank"), F.asc("ticker")]
    order += [F.asc("model_name")] if "model_name" in preds.columns else []
    return watch.join(p, "ticker").orderBy(*order).limit(n)


def flag_in(df: DataFrame, keys: DataFrame, on: str = "ticker", out: str = "is_member") -> DataFrame:
    """1 when the row's key occurs in ``keys``."""
    k = keys.select(on).distinct().withColumn("_hit", F.lit(1))
    return df.join(k, on, "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def snapshot_motion(snaps: DataFrame, as_of: str, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Speed and acceleration of every point of the snapshot ``as_of`` against the two before it."""
    days = snaps.where(F.col("date") <= F.lit(as_of).cast("date")).select("date").distinct().orderBy(F.desc("date")).limit(3)
    days = days.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))))
    wide = snaps.join(days, "date").groupBy("ticker").agg(*[
        F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2, 3) for c in axes])
    gap = lambda c, a, b: (F.col(f"{c}{a}") - F.col(f"{c}{b}")) * (F.col(f"{c}{a}") - F.col(f"{c}{b}"))
    dist = lambda a, b: F.sqrt(sum((gap(c, a, b) for c in axes[1:]), gap(axes[0], a, b)))
    here = wide.where(F.col(f"{axes[0]}1").isNotNull())
    return here.select("ticker", dist(1, 2).alias("movement_speed"), (dist(1, 2) - dist(2, 3)).alias("movement_acceleration"))


def paired(df: DataFrame, side: str, a: str, b: str, keys: Sequence[str], metric: str) -> DataFrame:
    """Metric of two strategies on the same keys with their difference; ``is_duplicate``
    marks keys that hold more than one row of a side."""
    pick = lambda v: F.col(side) == v
    return (
        df.where(F.col(side).isin(a, b)).groupBy(*keys).agg(
            F.max(F.when(pick(a), F.col(metric))).alias("a_value"),
            F.max(F.when(pick(b), F.col(metric))).alias("b_value"),
            F.count_if(pick(a)).alias("_na"), F.count_if(pick(b)).alias("_nb"))
        .where((F.col("_na") > 0) & (F.col("_nb") > 0))
        .withColumns({"delta": F.col("a_value") - F.col("b_value"),
                      "is_duplicate": F.when((F.col("_na") > 1) | (F.col("_nb") > 1), 1).otherwise(0)})
        .drop("_na", "_nb")
    )


def consecutive_returns(prices: DataFrame) -> DataFrame:
    """One-day forward returns, only where the ticker's next row is the next market date."""
    days = prices.select("date").distinct()
    nxt = days.withColumn("market_next", F.lead("date").over(Window.orderBy("date")))
    w = history()
    own = prices.withColumns({"next_date": F.lead("date").over(w), "_nc": F.lead("close_price").over(w)})
    return (
        own.join(nxt, "date").where(F.col("next_date") == F.col("market_next"))
        .withColumn("next_return", ratio("_nc", "close_price") - 1).drop("_nc", "market_next")
    )

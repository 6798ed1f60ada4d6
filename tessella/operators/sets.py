"""Set operators over universes, pairs and snapshots, and small top-K operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ranking import first_rows


def universe_relation(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with its relation: both, a_only or b_only."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, list(keys), "full_outer")
    return j.withColumn("relation", F.when(F.col("_a").isNull(), "b_only").when(F.col("_b").isNull(), "a_only").otherwise("both")).drop("_a", "_b")


def universe_overlap(a: DataFrame, b: DataFrame, anchor: str = "anchor", key: str = "ticker") -> DataFrame:
    """Sizes, intersection, one-sided counts, coverage of ``a`` and Jaccard rate per anchor."""
    r = universe_relation(a, b, [anchor, key])
    n = lambda v: F.count_if(F.col("relation") == v)
    s = r.groupBy(anchor).agg(n("both").alias("intersection_count"), n("a_only").alias("a_only_count"), n("b_only").alias("b_only_count"), F.count(F.lit(1)).alias("_u"))
    return s.withColumns({
        "coverage_rate": F.coalesce(F.try_divide(F.col("intersection_count"), F.col("intersection_count") + F.col("a_only_count")), F.lit(0.0)),
        "jaccard_rate": F.col("intersection_count") / F.col("_u")}).drop("_u")


def mismatch_types(a: DataFrame, b: DataFrame, reference: DataFrame, anchor: str = "anchor", key: str = "ticker") -> DataFrame:
    """One-sided keys counted by relation and security type of the reference."""
    r = universe_relation(a, b, [anchor, key]).where(F.col("relation") != "both")
    typed = r.join(reference.select(key, "security_type"), key, "left").fillna("unknown", ["security_type"])
    return typed.groupBy(anchor, "relation", "security_type").agg(F.count(F.lit(1)).alias("n"))


def persistent_entities(cands: DataFrame) -> DataFrame:
    """Entities present at every anchor with packed tickers and value and rank ranges."""
    anchors = cands.select(F.countDistinct("anchor")).scalar()
    g = cands.groupBy("entity_id").agg(
        F.countDistinct("anchor").alias("anchor_count"), F.array_join(F.array_sort(F.collect_set("ticker")), "|").alias("tickers"),
        F.min("mean_dollar_volume").alias("min_mean_dollar_volume"), F.max("mean_dollar_volume").alias("max_mean_dollar_volume"),
        F.min("liquidity_rank").alias("best_rank"), F.max("liquidity_rank").alias("worst_rank"))
    return g.where(F.col("anchor_count") == anchors)


def pair_view(pairs: DataFrame, a: str = "A", b: str = "B", extra: Sequence[str] = ("similarity", "winner"), sided: Sequence[str] = ()) -> DataFrame:
    """Both directions of every pair; ``sided`` names attributes stored as ``A_x`` / ``B_x``."""
    def way(x, y):
        return F.struct(F.col(x).alias("ticker"), F.col(y).alias("neighbor"),
                        *[F.col(f"{x}_{s}").alias(f"ticker_{s}") for s in sided], *[F.col(f"{y}_{s}").alias(f"neighbor_{s}") for s in sided])
    return pairs.select(F.explode(F.array(way(a, b), way(b, a))).alias("x"), *extra).select("x.*", *extra)


def union_long(df: DataFrame, keys: Sequence[str], variants: dict[str, Column], name: str = "strategy", value: str = "value") -> DataFrame:
    """One row per variant whose value is not null."""
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias(name), v.alias(value))) for k, v in variants.items()]))
    return df.select(*keys, F.explode(entries).alias("x")).select(*keys, "x.*")


def snapshot_diff(cur: DataFrame, prev: DataFrame, key: str, val: str) -> DataFrame:
    """Typed events between two snapshots: added, removed, changed."""
    j = cur.select(key, F.col(val).alias("new_value"), F.lit(1).alias("_c")).join(
        prev.select(key, F.col(val).alias("prior_value"), F.lit(1).alias("_p")), key, "full_outer")
    kind = F.when(F.col("_p").isNull(), "listing_candidate").when(F.col("_c").isNull(), "removal_candidate").when(~F.col("new_value").eqNullSafe(F.col("prior_value")), "change_candidate")
    return j.withColumn("event_type", kind).where(F.col("event_type").isNotNull()).drop("_c", "_p")


# Kinds of issuer events.
ADDED_TO_ISSUER, REMOVED_FROM_ISSUER, EXCHANGE_CHANGE, TICKER_REUSE = (
    "ticker_added_to_cik", "ticker_removed_from_cik", "exchange_change_candidate", "ticker_reuse_candidate")


def issuer_events(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Typed events between two snapshots of issuer tickers (cik, ticker, exchange): mappings added
    and removed, exchanges changed, and tickers that name another issuer (the largest on ties)."""
    side = lambda d, name: d.groupBy("cik", "ticker").agg(F.max("exchange").alias(name)).withColumn(f"_{name}", F.lit(1))
    j = side(cur, "new_value").join(side(prev, "prior_value"), ["cik", "ticker"], "full_outer")
    kind = (
        F.when(F.col("_prior_value").isNull(), ADDED_TO_ISSUER).when(F.col("_new_value").isNull(), REMOVED_FROM_ISSUER)
        .when(~F.col("new_value").eqNullSafe(F.col("prior_value")), EXCHANGE_CHANGE))
    mapped = j.withColumn("event_type", kind).where(F.col("event_type").isNotNull()).select("event_type", "ticker", "cik", "prior_value", "new_value")
    issuer = lambda d, name: d.groupBy("ticker").agg(F.max("cik").cast("string").alias(name))
    moved = issuer(cur, "new_value").join(issuer(prev, "prior_value"), "ticker").where(F.col("new_value") != F.col("prior_value"))
    cik = F.col("new_value").cast(cur.schema["cik"].dataType)
    return mapped.unionByName(moved.select(F.lit(TICKER_REUSE).alias("event_type"), "ticker", cik.alias("cik"), "prior_value", "new_value"))


def diversified_top_k(df: DataFrame, k: int, per: int, by: Sequence[str] = ("date",), score: str = "score", cluster: str = "cluster") -> DataFrame:
    """Best ``k`` with at most ``per`` per cluster (cluster -1 is not capped), topped up by score.

    Only ``k`` rows per (group, cluster) can ever be chosen, and Catalyst drops the others
    before the first shuffle."""
    order = [F.desc(score), F.asc("ticker")]
    near = first_rows(df, [*by, cluster], order, k, "_c")
    capped = (F.col(cluster) >= 0) & (F.col("_c") > per)
    return first_rows(near.withColumn("_over", F.when(capped, 1).otherwise(0)), by, [F.asc("_over"), *order], k, "pick").drop("_c", "_over")


def stable_rank(df: DataFrame, value: str, key: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based rank by value descending, ties by key.

    Values are ranked by split groups; only rows with equal value are ordered by key together."""
    from pyspark.sql import Window

    from tessella.functions.ranking import rank_stats

    by = list(by)
    stats = rank_stats(df, by, value, "_r")
    j = df.join(stats, [*by, value])
    inside = F.row_number().over(Window.partitionBy(*by, value).orderBy(key))
    above = F.col("_r_total") - F.col("_r_below") - F.col("_r_ties")
    return j.withColumn(out, above + inside).drop("_r_below", "_r_ties", "_r_total")


def first_others(df: DataFrame, by: str, key: str, order: Sequence[Column], k: int, out: str) -> DataFrame:
    """(key, out): the first ``k`` others of every row's group, without pairing the group.

    They are among the first ``k + 1`` of the group."""
    head = first_rows(df, [by], order, k + 1, "_place").select(by, F.col(key).alias(out), "_place")
    pairs = df.select(by, key).join(head, by).where(F.col(key) != F.col(out))
    return first_rows(pairs, [key], [F.asc("_place")], k, "_k").select(key, out)

"""De-duplication, collapsing and table cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ranking import first_rows
from tessella.functions.scalars import norm_ticker, truthy


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the last or first by ``order``.

    A min/max over a struct keeps one candidate per key on the map side, so a key repeated a
    billion times never meets in one task.  ``order`` must be total."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    agg = F.max if keep == "last" else F.min
    best = df.groupBy(*keys).agg(agg(F.struct(*order, *rest)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def dedup_best(df: DataFrame, keys: Sequence[str], scores: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Best quality row per key: highest scores (missing counts as -1), then the earliest row."""
    rest = [c for c in df.columns if c not in keys]
    rank = [F.coalesce(F.col(s).cast("double"), F.lit(-1.0)).alias(f"_s{i}") for i, s in enumerate(scores)]
    # among equal scores the smallest tie columns win: compare them negated
    earliest = [(-F.col(c)).alias(f"_t{i}") for i, c in enumerate(tie)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*rank, *earliest, *rest)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def collapse_daily(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last close and summed volume per ticker and date."""
    last = F.max(F.struct(*order, "close_price"))["close_price"]
    return df.groupBy("ticker", "date").agg(last.alias("close_price"), F.sum("volume").alias("volume"))


def clean_pairs(df: DataFrame) -> DataFrame:
    """Normalised similarity pairs without blanks, self pairs or repeated (A, B); first row wins by ``seq``."""
    p = df.withColumns({"A": norm_ticker("A"), "B": norm_ticker("B"), "winner": norm_ticker("winner")})
    p = p.where(F.col("similarity").isNotNull() & (F.col("A") != "") & (F.col("B") != "") & (F.col("A") != F.col("B")))
    return dedup(p, ["A", "B"], ["seq"], "first")


def clean_families(df: DataFrame) -> DataFrame:
    """Family members with family size and chosen flag, one row per (Family, ticker)."""
    size = df.groupBy("Family").agg(F.count("Member").alias("variant_family_size"))
    f = df.withColumns({"ticker": norm_ticker("Member"), "variant_is_chosen": truthy("Chosen")})
    f = f.groupBy("Family", "ticker").agg(F.max("variant_is_chosen").alias("variant_is_chosen"))
    return f.join(size, "Family")


def trading_window(prices: DataFrame, anchor: str, n: int) -> DataFrame:
    """Exactly ``n`` trading dates ending at ``anchor``; the job fails otherwise."""
    a = F.lit(anchor).cast("date")
    d = prices.where(F.col("date") <= a).select("date").distinct().orderBy(F.desc("date")).limit(n)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bad = (F.count(F.lit(1)).over(every) != n) | (F.max("date").over(every) != a)
    fail = F.when(bad, F.raise_error(F.lit(f"no {n} trading dates end at {anchor}")).cast("int"))
    return d.withColumn("_ok", F.coalesce(fail, F.lit(0))).where(F.col("_ok") == 0).select("date")


def probe_dates(dates: DataFrame, n: int) -> DataFrame:
    """At most ``n`` evenly spaced dates including both ends (half-way positions round to even)."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = dates.select("date").distinct()
    d = d.withColumns({"_i": F.row_number().over(Window.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(every)})
    if n == 1:
        return d.where(F.col("_i") == F.col("_n") - 1).select("date")
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (n - 1), 0))
    return d.where((F.col("_n") <= n) | F.array_contains(spots, F.col("_i").cast("double"))).select("date")


def latest_context(df: DataFrame, date_cols: Sequence[str], run: str | None = "run_id") -> DataFrame:
    """Rows at the maximum of the first usable date column, then at the highest run id."""
    usable = [c for c in date_cols if c in df.columns]
    if usable:
        parsed = {c: F.col(c).try_cast("timestamp") for c in usable}
        top = df.select(*[F.max(parsed[c]).alias(c) for c in usable])
        # the first column that has any date decides; later ones are ignored
        keep: Column = F.lit(True)
        for c in reversed(usable):
            m = top.select(c).scalar()
            keep = F.when(m.isNotNull(), parsed[c].eqNullSafe(m)).otherwise(keep)
        df = df.where(keep)
    if run and run in df.columns:
        num = F.col(run).cast("string").try_cast("double")
        best = df.select(F.max(num)).scalar()
        df = df.where(best.isNull() | (num == best))
    return df


def select_universe(prices: DataFrame, n: int, min_rows: int = 180, share: float = 0.55, recent: int = 60) -> DataFrame:
    """The ``n`` tickers with the highest median dollar volume over the last dates among those
    observed on enough dates."""
    from tessella.operators.targets import last_n_dates

    total = prices.select(F.countDistinct("date")).scalar()
    seen = prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("observations"))
    need = F.greatest(F.lit(min_rows), F.floor(total * share))
    # a ticker holds at most ``recent`` rows here, so the exact median stays small
    liq = last_n_dates(prices, recent).groupBy("ticker").agg(
        F.percentile(F.col("close_price") * F.col("volume"), 0.5).alias("median_dollar_volume"))
    return seen.where(F.col("observations") >= need).join(liq, "ticker").orderBy(F.desc("median_dollar_volume"), "ticker").limit(n)


def covered_dates(df: DataFrame, share: float, n: int, warmup: int = 0) -> DataFrame:
    """Last ``n`` dates after the warm-up on which at least ``share`` of all tickers have a row."""
    universe = df.select(F.countDistinct("ticker")).scalar()
    c = df.groupBy("date").agg(F.count(F.lit(1)).alias("members"))
    c = c.withColumns({"_i": F.row_number().over(Window.orderBy("date")), "coverage": F.col("members") / universe})
    return c.where((F.col("_i") > warmup) & (F.col("coverage") >= share)).drop("_i").orderBy(F.desc("date")).limit(n)


def health_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("metric").like(pattern))


def filter_champions(df: DataFrame, champions: DataFrame, keys: Sequence[str] = ("horizon_days", "model_name")) -> DataFrame:
    """Rows of champion (horizon, model) pairs only."""
    return df.join(champions.select(*keys), list(keys), "left_semi")


def flag_champions(df: DataFrame, champions: DataFrame, per_model: int, keys: Sequence[str] = ("horizon_days", "model_name")) -> DataFrame:
    """Best ``per_model`` rows of each pair with a champion flag; equal ranks of a ticker by date."""
    order = [F.col(c) for c in ("model_rank", "ticker", "as_of_date") if c in df.columns]
    top = first_rows(df, keys, order, per_model, "_k").drop("_k")
    c = champions.select(*keys).distinct().withColumn("_c", F.lit(1))
    return top.join(c, list(keys), "left").withColumn("is_champion", F.coalesce("_c", F.lit(0))).drop("_c")

"""Chronological splits, deterministic samples and placebo permutations.

Splits are computed on the calendar of distinct dates (bounded by trading days, one row
each) and returned as ``(split, role, date)``; they join the panel by date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ranking import first_rows
from tessella.functions.scalars import DRAW_BITS, draw_number


def _indexed(df: DataFrame) -> DataFrame:
    d = df.select("date").distinct()
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(everything))


def _roles(cal: DataFrame, *roles: tuple[str, Column]) -> DataFrame:
    """One row per date and role whose condition holds."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in roles]))
    return cal.withColumn("role", F.explode(tags))


def holdout_split(df: DataFrame, test_dates: int, embargo: int) -> DataFrame:
    """Last dates for test; training ends ``embargo`` dates earlier."""
    start = F.col("n") - test_dates
    cal = _indexed(df)
    return _roles(cal, ("train", F.col("i") < start - embargo), ("test", F.col("i") >= start)).select("role", "date")


def walk_forward(df: DataFrame, n_splits: int, test_dates: int, embargo: int, min_train: int,
                 train_window: int | None = None, validation: tuple[int, int, int] | None = None) -> DataFrame:
    """Consecutive test blocks ending at the last date, growing (or rolling) training set.

    ``validation=(lo, hi, part)`` turns the last ``clamp(train/part, lo, hi)`` training
    dates into a validation tail."""
    cal = _indexed(df).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    start = F.col("n") - (n_splits + 1 - F.col("split")) * test_dates
    cut = start - embargo
    cal = cal.withColumns({"start": start, "cut": cut}).where((F.col("start") >= 0) & (F.col("cut") >= min_train))
    i, cut = F.col("i"), F.col("cut")
    low = F.lit(0) if train_window is None else cut - train_window
    test = (i >= F.col("start")) & (i < F.col("start") + test_dates)
    if validation is None:
        out = _roles(cal, ("train", (i < cut) & (i >= low)), ("test", test))
    else:
        lo, hi, part = validation
        tail = F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(cut / part)))
        out = _roles(cal, ("fit", i < cut - tail), ("validation", (i >= cut - tail) & (i < cut)), ("test", test))
    return out.select("split", "role", "date")


def split_bounds(splits: DataFrame) -> DataFrame:
    """First, last and number of dates of every split and role."""
    return splits.groupBy("split", "role").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("dates"))


def purged_splits(panel: DataFrame, n_splits: int, test_dates: int, min_train: int) -> DataFrame:
    """Test blocks whose training rows must have been *evaluated* before the block starts."""
    cal = _indexed(panel)
    blocks = cal.withColumn("split", F.floor((F.col("i") - F.col("n") + n_splits * test_dates) / test_dates) + 1)
    bounds = blocks.where(F.col("split") >= 1).groupBy("split").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    # (date, evaluation_date) pairs are bounded by the calendar, as is the list of blocks
    pairs = panel.groupBy("date", "evaluation_date").agg(F.count(F.lit(1)).alias("_rows"))
    every = bounds.select(F.collect_list(F.struct("split", "test_start", "test_end"))).scalar()
    usable = F.filter("_every", lambda b: F.col("evaluation_date") < b["test_start"])
    train = pairs.withColumn("_every", every).withColumn("_b", F.explode(usable)).select("_b.*", "date", "evaluation_date", "_rows")
    return train.groupBy("split", "test_start", "test_end").agg(
        F.max("date").alias("train_decision_max"), F.max("evaluation_date").alias("train_evaluation_max"),
        F.countDistinct("date").alias("training_dates"), F.sum("_rows").alias("training_rows"),
    ).where(F.col("training_dates") >= min_train)


def sealed_splits(df: DataFrame, holdout: int, n_splits: int, test_dates: int, horizon: int, min_train: int) -> DataFrame:
    """Newest-first blocks before a sealed holdout, each separated by ``horizon`` dates."""
    cal = _indexed(df).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    end = F.col("n") - holdout - horizon - 1 - (n_splits - F.col("split")) * (test_dates + horizon)
    cal = cal.withColumn("end", end).withColumn("start", F.col("end") - test_dates + 1)
    cal = cal.withColumn("cutoff", F.col("start") - horizon - 1).where(F.col("cutoff") + 1 >= min_train)
    i = F.col("i")
    return _roles(
        cal, ("train", i <= F.col("cutoff")), ("test", (i >= F.col("start")) & (i <= F.col("end"))),
    ).select("split", "role", "date")


def chunk_splits(df: DataFrame, pool: int, n_splits: int, horizon: int, train_window: int) -> DataFrame:
    """Last dates cut into ``n_splits`` nearly equal chunks (larger first), rolling training window."""
    cal = _indexed(df)
    size = F.least(F.lit(pool), F.greatest(F.lit(20), F.floor(F.col("n") / 3)))
    pooled = cal.where(F.col("i") >= F.col("n") - size)
    chunks = pooled.withColumn("split", F.ntile(n_splits).over(Window.orderBy("date")))
    starts = chunks.groupBy("split").agg(F.min("i").alias("start"))
    listed = starts.select(F.collect_list(F.struct("split", "start"))).scalar()
    cut = lambda b: b["start"] - horizon
    train = cal.withColumn("_all", listed).withColumn("_b", F.explode(F.filter(
        "_all", lambda b: (F.col("i") < cut(b)) & (F.col("i") >= cut(b) - train_window))))
    train = train.select(F.col("_b.split").alias("split"), F.lit("train").alias("role"), "date")
    return train.unionByName(chunks.select("split", F.lit("test").alias("role"), "date"))


def calibration_split(df: DataFrame, horizon: int, calibration: int | None = None) -> DataFrame:
    """Chronological fit / calibration parts with a gap of ``horizon`` dates.

    Without a fixed size the calibration part is min(max(15, n/6), max(15, n/3)) dates."""
    n = F.col("n")
    size = F.lit(calibration) if calibration else F.least(
        F.greatest(F.lit(15), F.floor(n / 6)), F.greatest(F.lit(15), F.floor(n / 3)))
    cal = _indexed(df).withColumn("size", size)
    return _roles(
        cal, ("fit", F.col("i") < F.greatest(F.lit(1), n - F.col("size") - horizon)),
        ("calibration", F.col("i") >= n - F.col("size")),
    ).select("role", "date")


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """Deterministic sample of at most ``n`` rows, overall or per group."""
    if by:
        return first_rows(df, by, [draw_number(seed, *key), *[F.col(k) for k in key]], n, "_k").drop("_k")
    return df.orderBy(draw_number(seed, *key), *key).limit(n)


def shuffled_positions(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, out: str) -> DataFrame:
    """0-based position of each row in a pseudo-random order of its group.

    The order is split on the hash's leading byte, so a hot group spreads over 256 parts."""
    by = list(by)
    df = df.withColumn("_h", draw_number(seed, *by, *key)).withColumn("_p", F.shiftright("_h", DRAW_BITS - 8))
    sizes = df.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_p").orderBy("_h", *key)
    return (
        df.withColumn("_k", F.row_number().over(inside) - 1).join(offsets, [*by, "_p"])
        .withColumn(out, F.col("_k") + F.col("_off")).drop("_h", "_p", "_k", "_off")
    )


def permute_within(df: DataFrame, cols: Sequence[str], by: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Move ``cols`` jointly between the rows of a group along a random bijection."""
    by = list(by)
    here = shuffled_positions(df, by, key, seed, "_pos")
    there = shuffled_positions(df.select(*by, *key, *cols), by, key, seed + 1, "_pos").drop(*key)
    order = df.columns
    return here.drop(*cols).join(there, [*by, "_pos"]).select(*order)


def permute_dates(df: DataFrame, cols: Sequence[str], seed: int) -> DataFrame:
    """Give every date the (date-constant) ``cols`` of another date."""
    per_date = df.groupBy("date").agg(*[F.max(c).alias(c) for c in cols])
    a = per_date.select("date").withColumn("_k", F.row_number().over(Window.orderBy(draw_number(seed, "date"), "date")))
    b = per_date.withColumn("_k", F.row_number().over(Window.orderBy(draw_number(seed + 1, "date"), "date"))).drop("date")
    return df.drop(*cols).join(a.join(b, "_k").drop("_k"), "date").select(*df.columns)


def pairwise_training(df: DataFrame, features: Sequence[str], target: str, max_pairs: int, seed: int) -> DataFrame:
    """Mirrored within-date feature differences labelled by which row returned more.

    Every row draws two partner positions, so pairs grow linearly with rows and a date
    never forms all its pairs."""
    dates = df.select(F.countDistinct("date")).scalar()
    per_date = F.greatest(F.lit(10), F.floor(F.lit(max_pairs) / dates / 2))
    pos = shuffled_positions(df.select("date", "ticker", target, *features), ["date"], ["ticker"], seed, "_pos")
    sizes = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    left = (
        pos.join(sizes, "date").withColumn("_draw", F.explode(F.array(F.lit(0), F.lit(1))))
        .where(F.col("_pos") * 2 + F.col("_draw") < per_date)
        .withColumn("_other", draw_number(seed + 2, "date", "ticker", "_draw") % F.col("_n"))
        .where(F.col("_other") != F.col("_pos"))
    )
    right = pos.select("date", F.col("_pos").alias("_other"), F.col("ticker").alias("other_ticker"),
                       *[F.col(c).alias(f"_r_{c}") for c in (target, *features)])
    pairs = left.join(right, ["date", "_other"])
    both = pairs.withColumn("mirror", F.explode(F.array(F.lit(1), F.lit(-1))))
    won = (F.col(target) > F.col(f"_r_{target}")).cast("int")
    return both.select(
        "date", "ticker", "other_ticker", "mirror", F.col("_draw").alias("draw"),
        *[(F.col("mirror") * (F.col(c) - F.col(f"_r_{c}"))).alias(c) for c in features],
        F.when(F.col("mirror") == 1, won).otherwise(1 - won).alias("label"))


def equal_weight(df: DataFrame, ret: str, cost: float = 0.0) -> DataFrame:
    """Universe return per date after a flat cost."""
    return df.where(F.col(ret).isNotNull()).groupBy("date").agg(
        F.count(F.lit(1)).alias("holdings"), (F.avg(ret) - cost).alias("net_return"))


def random_top_k(df: DataFrame, k: int, ret: str, seed: int, cost: float = 0.0) -> DataFrame:
    """Return of ``k`` pseudo-randomly chosen entities per date."""
    return equal_weight(sample_n(df.where(F.col(ret).isNotNull()), k, seed, ["ticker"], ["date"]), ret, cost)


def feature_configs(families: dict[str, list[str]], base: str) -> dict[str, list[str]]:
    """Ablation grid: base, base + one family, all, all minus one family."""
    rest = [f for f in families if f != base]
    everything = [c for cols in families.values() for c in cols]
    grid = {f"baseline_{base}": list(families[base])}
    grid |= {f"baseline_plus_{f}": families[base] + families[f] for f in rest}
    grid["all_families"] = everything
    grid |= {f"all_minus_{f}": [c for c in everything if c not in families[f]] for f in families}
    return grid

"""Mixing sources to target weights by entropy balancing.

Every source gets a share of the tokens by weight, at most ``cap`` times its own size; what a
source cannot take is shared again by weight (:func:`targets`).  The rates of the documents are
those closest to 1, in relative entropy summed over documents, that meet the token constraint of
every source and pass ``cap`` nowhere.  Their dual is convex with one multiplier per source, and
the rates are the exponential tilt ``min(cap, exp(l x / m))`` of a document of size ``x``, with
``m`` the mean size in the source.

:func:`tilt` solves the dual by Newton's iteration.  Every step sums gradient and Hessian over all
documents, of all sources at once; documents of one source and size have one rate, so the sums
run over (source, size) with the number of documents, which partial aggregates make once.  A step
that leaves the bracket of the root is replaced by bisection, and the iteration ends when every
source's tokens are within 1e-9 of its target.

Rates become whole copies.  Every document gets ``floor(rate)``.  The rest of the target is
filled with one more copy in the order of ``u / fraction``, u uniform by a hash, up to a
threshold per source, so that the chance of one more copy follows the rate's fraction (sequential
Poisson sampling).  The threshold is found from bucket totals and one bucket's rows, so that no
source is ever sorted as a whole.  A last document whose size is nearest to the remaining gap
closes it (:func:`plan`).  So a target is met up to the smallest change that a document can make,
and reruns agree.

Null texts have size 0.  A null source is a source of its own, the last one.  Rows that are equal
in all columns are told apart by a running number inside their hash, made from salted counts, so
each has its own order and no group of copies meets in one task.  Sources whose words are none get
the target 0, and texts without words no copy.  Texts of any length count as a whole.  Columns
named like the plan's (``size``, ``h``) are data of the documents as any other.  An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stage, whole_text, words

WEIGHTS = (5.0, 2.0, 1.0)  # by rank of the source, repeating
CAP = 3.0
STEPS = 200
_SALTS = 64
_BUCKETS = 1 << 14


def size_of(text: str | Column = "text") -> Column:
    return F.size(words(whole_text(text))).cast("long")


def row_hash(names: Sequence[str]) -> Column:
    """Hash of a whole row."""
    return F.xxhash64(F.lit("mixing"), *[F.col(f"`{c}`") for c in names])


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also ``weight`` and ``target``.

    Sharing again by weight until none is above its cap ends at min(cap * size, level * weight)
    with one level for all.  In the order of cap * size / weight the capped sources come first,
    so running sums give the level.  One row per source passes through one task."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights)).cast("int")))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    until, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum("most").over(until), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - capped) / left
    leveled = ranked.withColumn("level", level)
    # the level before the first source that is not capped by its own level
    level_all = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.least("most", F.coalesce(level_all * F.col("weight"), F.col("most")))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _with(rows: DataFrame, per_source: DataFrame, *names: str) -> DataFrame:
    other = per_source.select(F.col("source").alias("__source"), *names)
    return rows.join(other, rows["source"].eqNullSafe(other["__source"]), "left").drop("__source")


def rate(size: Column, lam: Column, mean: Column, cap: float = CAP) -> Column:
    """The tilt of a document; 0 without tokens or target (null ``lam``)."""
    tilted = F.least(F.lit(cap), F.exp(F.least(lam * size / mean, F.lit(50.0))))
    return F.when((size > 0) & lam.isNotNull(), tilted).otherwise(0.0)


def tilt(sizes: DataFrame, goal: DataFrame, cap: float = CAP, steps: int = STEPS, tolerance: float = 1e-9) -> DataFrame:
    """``goal`` (source, target, ...) with ``lam``, ``mean`` and ``off``, the relative error of the
    source's tokens, from ``sizes`` (source, size, n), n documents of that size.

    The multiplier of a source at its cap is where the smallest document reaches the cap; without
    tokens or target it is null."""
    some = sizes.where("size > 0")
    facts = some.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("size")).alias("tokens"), F.min("size").alias("least"))
    c = F.col
    state = _with(goal, facts, "mean", "tokens", "least")
    share = c("target") / c("tokens")
    open_ = (c("target") > 0) & (c("tokens") > 0)
    top = F.log(F.lit(cap)) * c("mean") / c("least")
    full = share >= cap * (1 - 1e-12)
    state = state.withColumns({
        "lam": F.when(open_, F.when(full, top).otherwise(0.0)),
        "low": F.when(open_, F.least(F.lit(0.0), F.log(share) * c("mean") / c("least"))),
        "high": F.when(open_, top),
        "off": F.when(open_ & ~full, F.lit(1.0)).otherwise(0.0)})
    state = stage(state, "mix-tilt")
    while steps and state.where(F.col("off") > tolerance).limit(1).count():
        steps -= 1
        going = state.where(c("off") > tolerance)
        j = some.join(going.select(c("source").alias("__source"), "lam", "mean"), c("source").eqNullSafe(c("__source")))
        r = rate(c("size"), c("lam"), c("mean"), cap)
        tokens = c("n") * r * c("size")
        sums = j.groupBy("source").agg(
            F.sum(tokens).alias("g"), F.sum(F.when(r < cap, tokens * c("size") / c("mean")).otherwise(0.0)).alias("h"))
        now = _with(going, sums, "g", "h").withColumn("gap", c("g") - c("target"))
        now = now.withColumns({
            "low": F.when(c("gap") < 0, F.greatest("low", "lam")).otherwise(c("low")),
            "high": F.when(c("gap") > 0, F.least("high", "lam")).otherwise(c("high")),
            "off": F.abs(c("gap")) / c("target")})
        newton = c("lam") - F.try_divide(c("gap"), c("h"))
        inside = (newton > c("low")) & (newton < c("high"))
        step = F.when(c("off") <= tolerance, c("lam")).when(F.coalesce(inside, F.lit(False)), newton).otherwise((c("low") + c("high")) / 2)
        state = stage(state.where(c("off") <= tolerance).unionByName(now.withColumn("lam", step).select(*state.columns)), "mix-tilt")
    # digits that a rerun may sum otherwise are dropped
    return state.withColumn("lam", F.round("lam", 11)).drop("low", "high", "tokens", "least")


def _place(r: Column, h: Column) -> Column:
    """Order of one more copy, in (0, 1]: monotone in u / fraction; null where the rate is whole."""
    u = (F.shiftrightunsigned(h, 11) + 1) / F.lit(float((1 << 53) + 1))
    part = r - F.floor(r + 1e-9)
    return F.when(part > 1e-9, u / (u + part))


def placed(rows: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """``rows`` (source, size, h) with ``base`` copies and the ``place`` of one more."""
    r = rate(F.col("size"), F.col("lam"), F.col("mean"), cap)
    out = _with(rows, goal, "lam", "mean").withColumn("rate", r)
    return out.withColumns({"base": F.floor(F.col("rate") + 1e-9).cast("long"), "place": _place(F.col("rate"), F.col("h"))}).drop("lam", "mean", "rate")


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source from (source, size, h): ``source_size, target, lam, mean`` and, for one
    more copy, the threshold ``upto`` of places and the hash ``fix`` of a closing document."""
    sizes = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    totals = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = stage(tilt(sizes, stage(targets(totals, weights, cap), "mix-targets"), cap), "mix-rates")
    r = rate(F.col("size"), F.col("lam"), F.col("mean"), cap)
    whole = _with(sizes, goal, "lam", "mean").groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.floor(r + 1e-9)).alias("whole"))
    goal = _with(goal, whole, "whole").withColumn("rest", F.greatest(F.col("target") - F.col("whole"), F.lit(0.0))).drop("whole")
    free = placed(rows, goal, cap).where((F.col("size") > 0) & F.col("place").isNotNull())
    bucket = F.floor(F.col("place") * _BUCKETS).cast("int")
    parts = free.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
    running = Window.partitionBy("source").orderBy("bucket")
    cut = _with(parts.withColumn("upto", F.sum("tokens").over(running)), goal, "rest")
    # the first bucket that exceeds the rest, and the tokens before it
    cut = cut.where(F.col("upto") > F.col("rest")).groupBy("source").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("tokens"), "bucket").alias("before"))
    goal = _with(goal, cut, "cut", "before")
    inside = _with(free.withColumn("bucket", bucket), goal, "cut", "before", "rest").where(F.col("bucket") == F.col("cut"))
    so_far = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("place", "h"))
    edge = inside.withColumn("so_far", so_far).where(F.col("so_far") <= F.col("rest"))
    edge = edge.groupBy("source").agg(F.max("place").alias("last"), F.max("so_far").alias("filled"))
    goal = _with(goal, edge, "last", "filled").withColumn(
        "upto",  # without a cut every free document has its one more copy
        F.when(F.col("cut").isNull(), F.lit(2.0)).otherwise(F.coalesce("last", F.col("cut") / F.lit(float(_BUCKETS)) - 1e-9)))
    goal = goal.withColumn("gap", F.when(F.col("cut").isNotNull(), F.col("rest") - F.coalesce("filled", "before"))).drop("cut", "before", "last", "filled")
    goal = stage(goal, "mix-plan")
    others = _with(free, goal, "upto", "gap").where(F.col("place") > F.col("upto"))
    off = F.abs(F.col("gap") - F.col("size"))
    near = others.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("h").alias("h")))["h"].alias("fix"))
    return stage(_with(goal, near, "fix"), "mix-plan")


def with_copies(rows: DataFrame, per_source: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``copies`` to (source, size, h)."""
    out = _with(placed(rows, per_source, cap), per_source, "upto", "fix")
    more = F.coalesce(F.col("place") <= F.col("upto"), F.lit(False)) | F.coalesce(F.col("h") == F.col("fix"), F.lit(False))
    return out.withColumn("copies", F.col("base") + more.cast("long")).drop("base", "place", "upto", "fix")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, row) of every document, written once: ``row`` hashes the whole row,
    and ``h`` also tells equal rows apart."""
    row = docs.select("doc_id", "source", size_of().alias("size"), row_hash(docs.columns).alias("row"))
    row = stage(row.withColumn("id", F.monotonically_increasing_id()), "mix-rows")
    again = row.groupBy("row").count().where("count > 1").select("row")
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    twins = stage(row.join(again, "row", "left_semi").withColumn("salt", salt), "mix-twins")
    counts = twins.groupBy("row", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("row").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("row", "salt").orderBy("id"))
    twins = twins.withColumn("number", number).join(counts.select("row", "salt", before.alias("before")), ["row", "salt"])
    twins = twins.select("doc_id", "source", "size", F.xxhash64("row", F.col("before") + F.col("number")).alias("h"), "row")
    single = row.join(again, "row", "left_anti").select("doc_id", "source", "size", F.col("row").alias("h"), "row")
    return stage(single.unionByName(twins), "mix-sizes")


def mix_report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document."""
    rows = measured(docs)
    per_source = plan(rows, weights, cap)
    out = _with(with_copies(rows, per_source, cap), per_source, "source_size", "target")
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mixture: every row as often as its copies say, with the columns of ``docs``.

    A row's copies follow from its hash and its source, so texts stay where they are; only rows
    that are equal to others are collapsed by their hash, and repeated by their sum of copies."""
    names = docs.columns
    rows = measured(docs)
    per_source = plan(rows, weights, cap)
    twins = with_copies(rows, per_source, cap).where("h <> row").groupBy("row").agg(F.sum("copies").alias("n"))
    twins = stage(twins, "mix-repeats").select(F.col("row").alias("__row"), F.col("n").alias("__n"))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("data"), F.col("source").alias("source"), size_of().alias("size"), row_hash(names).alias("h"))
    alone = with_copies(whole.join(twins.select("__row"), F.col("h") == F.col("__row"), "left_anti"), per_source, cap).select("data", F.col("copies").alias("n"))
    many = whole.join(twins, F.col("h") == F.col("__row")).groupBy("h", "__n").agg(F.first("data").alias("data")).select("data", F.col("__n").alias("n"))
    chunk = 1024  # copies made by one row at a time
    some = alone.unionByName(many).where("n > 0").select("data", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("part"))
    left = F.least(F.col("n") - F.col("part") * chunk, F.lit(chunk).cast("long"))
    return some.select("data", F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("copy")).select("data.*")

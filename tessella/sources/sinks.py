"""Writers, upserts, ledgers and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import hash_id


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet, or gzip-compressed CSV with a header."""
    w = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true").option("compression", "gzip")
    w.format(fmt).save(path)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates win over base rows with the same key."""
    return updates.unionByName(base.join(updates.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upsert_coalesce(base: DataFrame, updates: DataFrame, keys: Sequence[str], keep_old: Sequence[str], prefer_new: Sequence[str]) -> DataFrame:
    """Merge where ``keep_old`` columns keep an existing value, ``prefer_new`` take the new
    value unless it is null, and every other column is overwritten by a present update."""
    keys = list(keys)
    rest = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in rest], F.lit(1).alias("_old"))
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in rest], F.lit(1).alias("_new"))
    out = []
    for c in rest:
        old, new = F.col(f"_b_{c}"), F.col(f"_u_{c}")
        if c in keep_old:
            x = F.coalesce(old, new)
        elif c in prefer_new:
            x = F.coalesce(new, old)
        else:
            x = F.when(F.col("_new").isNotNull(), new).otherwise(old)
        out.append(x.alias(c))
    return b.join(u, keys, "full_outer").select(*keys, *out)


def append_run(base: DataFrame, frame: DataFrame, run: Mapping[str, str], retention_days: int) -> DataFrame:
    """Append a run: stamp its columns, replace an earlier version of the same run, widen the
    schema, drop runs created more than ``retention_days`` before this one."""
    stamped = frame.withColumns({k: F.lit(v) for k, v in run.items()})
    kept = base.where(F.col("run_id") != run["run_id"])
    both = kept.unionByName(stamped, allowMissingColumns=True)
    cutoff = F.date_sub(F.lit(run["run_created_at"]).cast("date"), retention_days)
    return both.where(F.col("run_created_at").cast("date") >= cutoff)


def append_ledger(base: DataFrame, rows: DataFrame, id_cols: Sequence[str | Column], n: int = 24, id_name: str = "decision_id") -> DataFrame:
    """Add rows under a content hash, skipping ids that are already present."""
    fresh = rows.withColumn(id_name, hash_id(id_cols, n)).dropDuplicates([id_name])
    return base.unionByName(fresh.join(base.select(id_name), id_name, "left_anti"), allowMissingColumns=True)


def ensure_columns(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Add missing optional columns with their default."""
    return df.withColumns({c: F.lit(v) for c, v in spec.items() if c not in df.columns})


def prune_span(df: DataFrame, span_days: Mapping[str, int], now: str) -> DataFrame:
    """Keep rows inside the retention window of their span."""
    days = F.create_map(*[F.lit(x) for kv in span_days.items() for x in kv])
    return df.where(F.col("date") >= F.date_sub(F.lit(now).cast("date"), days[F.col("span")]))


def load_snapshot(existing: DataFrame, incoming: DataFrame, day: str) -> DataFrame:
    """Rows to append for one observation day: none when the day is complete, each linked to
    the last completed day before it, with padded CIK and provisional entity id."""
    done = existing.where(F.col("observation_date") == day).select(F.count(F.lit(1))).scalar()
    previous = existing.where(F.col("observation_date") < day).select(F.max("observation_date")).scalar()
    cik = F.lpad(F.col("cik").cast("string"), 10, "0")
    return incoming.where(done == 0).withColumns({
        "run_id": F.lit(day), "observation_date": F.lit(day), "previous_run_id": previous, "cik": cik,
        "entity_id": F.concat(F.lit("SEC-CIK-"), cik)})

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import work_dir

#: ASCII white space, as a Java and as a Python pattern.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(c: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name that is unused, inside the folder that driver and executors share."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_no(key: str, n: int) -> Column:
    """Number of the part, of n, that a row belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(n))


def parts_of(df: DataFrame, key: str, most: int) -> int:
    """Into how many parts by a hash of ``key`` (a unique one) ``df`` falls, so that none has more
    than ``most`` rows: a part may then be broadcast."""
    n = -(-df.count() // most)
    while n > 1 and df.groupBy(part_no(key, n).alias("part")).count().agg(F.max("count")).first()[0] > most:
        n += 1 + n // 8
    return n


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): ``floor(256 c)`` of every component, of the rows whose vectors are not null and
    hold neither nulls nor values that are not finite or pass 2**31."""
    c = F.col(vector)
    known = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float(1 << 31)))
    floor = F.transform(c, lambda v: F.floor(256 * v.cast("double")).cast("long"))
    return vectors.where(c.isNotNull() & known).select(F.col(vec_id).cast("long").alias("vec_id"), floor.alias("x"))


def worker_state(key, make):
    """An object kept by the Python worker from task to task, made by ``make`` at first use.

    A worker keeps the last two only: workers live through many stages, and tables of earlier
    ones would pile up in an executor's memory."""
    module = sys.modules.setdefault("_tessella_llm_state", types.ModuleType("_tessella_llm_state"))
    kept: dict = module.__dict__.setdefault("kept", {})
    value = kept.pop(key, None)
    while value is None and len(kept) > 1:
        kept.pop(next(iter(kept)))
    kept[key] = make() if value is None else value  # the newest comes last
    return kept[key]

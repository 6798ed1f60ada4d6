"""Incremental feature maintenance.

New bars extend a feature table.  Features are computed for the new rows alone, from a bounded
tail of bars per ticker.  :func:`features_incremental` finds the tails in a stored table of bars;
the stream (:func:`incremental_features`) keeps them as keyed state, so that a micro-batch touches
the tickers that it brings and never reads stored bars."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.functions.ranking import first_rows
from tessella.operators.features import research_features
from tessella.session import work_dir

# The state processor travels with the task, so executors need pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTEXT_ROWS = 120
BAR_COLUMNS = ("ticker", "date", "close_price", "volume")


def later_bars(history: DataFrame, new: DataFrame) -> DataFrame:
    """New bars after the last stored date of their ticker, one per date (the largest on ties).

    Stored dates and late arrivals are skipped, so features never change after they are stored."""
    last = history.groupBy("ticker").agg(F.max("date").alias("_last"))
    one = new.groupBy("ticker", "date").agg(F.max(F.struct("close_price", "volume")).alias("_b"))
    one = one.select("ticker", "date", "_b.close_price", "_b.volume").join(last, "ticker", "left")
    return one.where(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).select(*BAR_COLUMNS)


def features_incremental(history: DataFrame, new: DataFrame, context: int = CONTEXT_ROWS) -> DataFrame:
    """Features of the later bars from the last ``context`` history rows of their tickers."""
    fresh = later_bars(history, new)
    old = history.select(*BAR_COLUMNS).join(fresh.select("ticker").distinct(), "ticker", "left_semi")
    tail = first_rows(old, ["ticker"], [F.desc("date")], context, "_k").drop("_k")
    both = tail.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return research_features(both).where(F.col("_new") == 1).drop("_new")


class Tail(StatefulProcessor):
    """The last ``context`` bars of a ticker, oldest first.

    Bars after the last kept date are new, one per date (the largest on ties); earlier ones and
    repetitions are skipped.  Returns the tail as it was, marked 0, and the new bars, marked 1.
    A ticker without new bars returns nothing."""

    STATE = "days array<int>, closes array<double>, volumes array<double>"
    OUT = "ticker string, date date, close_price double, volume double, new int"

    def __init__(self, context: int = CONTEXT_ROWS):
        self.context = context

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("tail", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        from datetime import date, timedelta

        tail = list(zip(*self.kept.get(), strict=True)) if self.kept.exists() else []
        last = tail[-1][0] if tail else None
        epoch = date(1970, 1, 1)
        fresh: dict[int, tuple] = {}
        for pdf in rows:  # memory is bounded by the dates of one ticker, whatever is repeated
            for day, close, volume in zip(pdf["date"], pdf["close_price"], pdf["volume"], strict=True):
                if day is None or day is pd.NaT:
                    continue
                at = (pd.Timestamp(day).date() - epoch).days
                bar = tuple(None if v is None or v != v else float(v) for v in (close, volume))
                if (last is None or at > last) and (at not in fresh or _order(bar) > _order(fresh[at])):
                    fresh[at] = bar
        if not fresh:
            return
        new = [(d, *fresh[d]) for d in sorted(fresh)]
        out = pd.DataFrame([(key[0], epoch + timedelta(days=d), c, v, 0 if k < len(tail) else 1) for k, (d, c, v) in enumerate(tail + new)],
                           columns=["ticker", "date", "close_price", "volume", "new"])
        days, closes, volumes = zip(*(tail + new)[-self.context :], strict=True)
        self.kept.update((list(days), list(closes), list(volumes)))
        yield out.astype({"close_price": "float64", "volume": "float64"})

    def close(self) -> None:
        pass


def _order(bar: tuple) -> tuple:
    """Nulls first, as in the largest struct."""
    return tuple((v is not None, v or 0.0) for v in bar)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def with_tails(bars: DataFrame, context: int = CONTEXT_ROWS) -> DataFrame:
    """New bars of a stream (``new`` = 1) and, before them, the bars they need (``new`` = 0)."""
    return bars.groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=Tail(context), outputStructType=Tail.OUT, outputMode="Append", timeMode="None")


def incremental_features(spark: SparkSession, source: str, state: str, schema: str = "ticker string, date date, close_price double, volume double",
                         max_files: int | None = None) -> None:
    """Structured Streaming job: file source to feature table with ``availableNow``.

    State and offsets are committed together in the checkpoint, so a restarted job goes on where it
    stopped.  Each micro-batch writes its features under its batch id with overwrite: a batch that
    is repeated after a failure finds the state before it and writes the same folder again."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def extend(batch: DataFrame, batch_id: int) -> None:
        done = research_features(batch.withColumnRenamed("new", "_new")).where(F.col("_new") == 1).drop("_new")
        done.write.mode("overwrite").parquet(f"{state}/features/batch={batch_id}")

    with _state_store(spark):
        job = with_tails(reader.parquet(source)).writeStream.outputMode("append").foreachBatch(extend)
        job.option("checkpointLocation", f"{state}/_stream").trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, prices: DataFrame, parts: int = 2) -> DataFrame:
    """Feed ``prices`` to the job in ``parts`` arrivals by date and return the feature table."""
    root = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    # date ranges of nearly equal calendar length, one arrival each, processed in order
    days = prices.select("date").distinct().select(F.percentile(F.unix_date("date"), [i / parts for i in range(1, parts)]).alias("c"))
    cuts = days.first()["c"]
    part = sum((F.when(F.unix_date("date") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(parts):
        prices.where(part == i).select(*BAR_COLUMNS).write.mode("append").parquet(f"{root}/source")
        incremental_features(spark, f"{root}/source", f"{root}/state")
    return spark.read.parquet(f"{root}/state/features").drop("batch")

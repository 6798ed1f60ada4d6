"""Incremental features equal the batch result, also when arrivals repeat."""

import datetime
import uuid

from pyspark.sql import functions as F

from tessella.operators.features import research_features
from tessella.session import checkpoint_dir
from tessella.sources.domain import Domain
from tessella.streaming.incremental import BAR_COLUMNS, _state_store, incremental_features, with_tails

COLS = ["ticker", "date", "round(ret_60d, 6) AS r", "round(vol_20d, 6) AS v", "time_since_max_60d"]


def folder(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def test_stream_equals_batch_and_is_idempotent(spark, sf_dir):
    p = Domain(spark, sf_dir).prices().select(*BAR_COLUMNS).persist()
    root = folder(spark)
    old, new = p.where("date < '1999-06-01'"), p.where("date >= '1999-03-01'")  # arrivals overlap
    for part in (old, new):
        part.write.mode("append").parquet(f"{root}/src")
        incremental_features(spark, f"{root}/src", f"{root}/state")  # restarts from the checkpoint
    incremental_features(spark, f"{root}/src", f"{root}/state")  # nothing new
    got = spark.read.parquet(f"{root}/state/features").selectExpr(*COLS)
    want = research_features(p).selectExpr(*COLS)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def bars(spark, rows):
    return spark.createDataFrame([(t, datetime.date.fromisoformat(d), c, v) for t, d, c, v in rows], "ticker string, date date, close_price double, volume double")


def test_late_bars_are_skipped_and_repeated_bars_count_once(spark):
    root = folder(spark)
    arrivals = [
        [("A", "2000-01-03", 1.0, 5.0), ("A", "2000-01-05", 2.0, 5.0), ("A", "2000-01-05", 2.5, 1.0), ("B", "2000-01-03", 7.0, 1.0)],
        [("A", "2000-01-04", 9.0, 9.0), ("A", "2000-01-05", 9.0, 9.0), ("A", "2000-01-06", 4.0, 5.0), ("C", "2000-01-01", 3.0, None)],
        [("B", "2000-01-02", 1.0, 1.0)]]
    for rows in arrivals:
        bars(spark, rows).write.mode("append").parquet(f"{root}/src")
        incremental_features(spark, f"{root}/src", f"{root}/state", max_files=1)
    got = spark.read.parquet(f"{root}/state/features").select("ticker", F.date_format("date", "dd"), "close_price")
    # C has one bar only; whatever the order of the files of one arrival, later dates are never changed
    rows = sorted(map(tuple, got.collect()))
    assert ("A", "05", 9.0) not in rows and ("A", "04", 9.0) not in rows and ("B", "02", 1.0) not in rows
    assert [r for r in rows if r[1] == "06"] == [("A", "06", 4.0)] and len(rows) == len({r[:2] for r in rows})


def test_state_is_a_bounded_tail(spark, tmp_path):
    """A context of two rows: the third arrival sees two bars before its own, of its tickers only."""
    root = folder(spark)
    out = []
    with _state_store(spark):
        for k, rows in enumerate([[("A", "2000-01-01", 1.0, 1.0), ("A", "2000-01-02", 2.0, 1.0), ("B", "2000-01-02", 8.0, 1.0)], [("A", "2000-01-03", 3.0, 1.0)], [("A", "2000-01-04", 4.0, 1.0)]]):
            bars(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/src")
            stream = with_tails(spark.readStream.schema("ticker string, date date, close_price double, volume double").parquet(f"{root}/src"), 2)
            q = stream.writeStream.outputMode("append").foreachBatch(lambda df, i, k=k: out.append((k, sorted(map(tuple, df.select("ticker", "close_price", "new").collect())))))
            job = q.option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
            job.awaitTermination()
            plan = job._jsq.explainInternal(False)
    assert dict(out) == {0: [("A", 1.0, 1), ("A", 2.0, 1), ("B", 8.0, 1)], 1: [("A", 1.0, 0), ("A", 2.0, 0), ("A", 3.0, 1)], 2: [("A", 2.0, 0), ("A", 3.0, 0), ("A", 4.0, 1)]}
    assert "TransformWithState" in plan and plan.count("FileScan") == 1 and "Join" not in plan

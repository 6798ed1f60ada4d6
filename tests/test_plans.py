"""Plan guards: pushdown, pruning, shuffle counts and no unbounded shortcuts."""

import pathlib
import re

from pyspark.sql import functions as F

from tessella.operators import features, joins
from tessella.sources.domain import Domain

ROOT = pathlib.Path(__file__).resolve().parent.parent / "tessella"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark, sf_dir):
    p = plan(Domain(spark, sf_dir).prices())
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"}


def test_filter_reaches_the_scan(spark, sf_dir):
    p = plan(Domain(spark, sf_dir).prices_alt())
    assert "PushedFilters: [" in p and "l_returnflag" in p.split("PushedFilters: [")[1].split("]")[0]


def test_all_features_share_one_ticker_shuffle(spark, sf_dir):
    p = plan(features.research_features(Domain(spark, sf_dir).prices()))
    assert p.count("Exchange hashpartitioning") == 2  # (ticker, date) for the bars, ticker for every window


def test_future_path_is_one_shuffle(spark, sf_dir):
    px = Domain(spark, sf_dir).prices()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = px.select("ticker", "date").where(F.col("date") > "1999-01-01")
        assert "Join" not in plan(joins.future_path(d, px, 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_forbidden_calls():
    text = "\n".join(f.read_text() for f in ROOT.rglob("*.py"))
    for bad in ("localCheckpoint", "crossJoin", "F.broadcast(", ".toPandas(", ".rdd"):
        assert bad not in text, bad


def test_tile_functions_travel_with_the_task():
    from pyspark import cloudpickle

    import tessella.operators.blocks  # noqa: F401

    assert "tessella.operators.blocks" in cloudpickle.list_registry_pickle_by_value()

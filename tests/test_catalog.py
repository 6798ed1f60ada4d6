"""Registered queries: shape of the catalog and agreement with their SQL twins on the small data."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one or more per module; tools/check.py runs all of them
SAMPLE = ["A03_dedup_last", "A06_explode_bars", "A11_upsert_coalesce", "B04_screen", "B11_probe_dates", "C04_strict_merge", "C05_asof_interval_join", "C07_nth_row_after", "C13_consecutive_returns",
          "D01_feature_summary", "D23_price_quality", "E09_roll_ac1", "E10_roll_mdd", "E19_xs_rank", "E21_residual_targets", "F06_diversified_top_k", "H05_snapshot_diff", "I02_canonical_base",
          "J03_purged_splits", "L01_auc", "M01_topk_daily", "N01_weekly_blocks", "P02_lifecycle", "P08_alias_intervals", "Q02_evaluate_outcomes"]
FAMILIES = {"A": 19, "B": 15, "C": 13, "D": 31, "E": 31, "F": 8, "G": 15, "H": 5, "I": 13, "J": 11, "K": 11, "L": 11, "M": 18, "N": 4, "O": 4, "P": 11, "Q": 7}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def test_every_inventory_id_has_a_query():
    have = {k.split("_")[0] for k in entry.queries()}
    want = {f"{f}{i:02d}" for f, n in FAMILIES.items() for i in range(1, n + 1)}
    assert want <= have


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_sql(spark, sf_dir, con, key):
    df = entry.queries()[key](spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    order = [cols.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0

"""Staged tables: where they go, when they are made anew, and that runs leave nothing behind."""

import os
import time

import pandas as pd
import pytest

from tessella.session import checkpoint_dir, scratch, stage
from tessella.sources.domain import Domain


def listing(spark):
    return set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))


def test_runs_leave_nothing_behind(spark):
    stage(spark.range(3))  # makes the folder
    before = listing(spark)
    for _ in range(2):
        with scratch(spark) as root:
            assert stage(spark.range(5)).count() == 5
            assert os.listdir(root.removeprefix("file:"))
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stage(spark.range(5))
        raise ZeroDivisionError
    assert listing(spark) == before


def test_changed_input_is_read_again(spark, tmp_path):
    def write(rows):
        pd.DataFrame({"s_suppkey": range(rows), "s_nationkey": 1, "s_name": "n", "s_acctbal": 1.0}).to_parquet(tmp_path / "supplier.parquet")

    write(3)
    with scratch(spark):
        first = Domain(spark, str(tmp_path)).staged("symbols")
        assert first.count() == 3 and Domain(spark, str(tmp_path)).staged("symbols") is first
        time.sleep(0.01)
        write(7)
        assert Domain(spark, str(tmp_path)).staged("symbols").count() == 7

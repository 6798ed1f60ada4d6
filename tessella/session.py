"""Session settings, the checkpoint folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Folders of the runs that are under way, the innermost last.
_RUNS: list[str] = []


def local_session(cores: int | str = 8, app: str = "tessella", folder: str | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    ``folder`` becomes ``spark.checkpoint.dir``, where staged tables go."""
    if folder:
        extra = {"spark.checkpoint.dir": folder, **extra}
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            shared = tempfile.mkdtemp(prefix="tessella-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """(file system, path) of an address, as Spark's own readers resolve it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder for everything staged inside the block, removed when it ends.

    Results are lazy and read staged tables: write them, or count them, before leaving."""
    root = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    _RUNS.append(root)
    try:
        yield root
    finally:
        _RUNS.remove(root)
        store, at = file_system(spark, root)
        store.delete(at, True)


def work_dir(spark: SparkSession) -> str:
    """The folder of the run that is under way, else the shared checkpoint folder."""
    return _RUNS[-1] if _RUNS else checkpoint_dir(spark)


def stage(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For operators that pass over their input several times: the lineage is cut, later
    passes prune columns, file sizes feed the join planner, and a lost executor costs one
    re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

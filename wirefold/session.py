"""Session and shared-folder helpers.

On a cluster the session comes from the launcher; these helpers only fill
in settings that are missing, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def get_session(master: str | None = None, app: str = "wirefold", **conf: str) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("WIREFOLD_MASTER", "local[8]"))
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local tests) a folder is
    created and registered, so cluster settings are never overridden.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="wirefold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    # Make RDD-level checkpoint() use the same folder.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job's output."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def wide_tasks(spark: SparkSession) -> int:
    """Number of tasks for rows that grow after a shuffle: Spark goes by the small shuffled rows and puts them into about one task per core."""
    return 8 * spark.sparkContext.defaultParallelism


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists many files by a few tasks a core meanwhile, unless the cluster says how many."""
    known = spark.conf.get(LISTING_TASKS, None)
    if known is None:
        spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if known is None:
            spark.conf.unset(LISTING_TASKS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

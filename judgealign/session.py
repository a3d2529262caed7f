"""Session helper for local runs, the bench and the tests.

On a cluster the caller hands in its own session; nothing in the library sets a master, a memory
size or a partition count.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "judgealign", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on and UTC timestamps."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("JUDGEALIGN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a session of one process (``local``, ``local[...]``) may go without that setting; it gets a temporary folder
    that goes with the process. On a cluster its absence is an error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix=f"judgealign-{name}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    return f"{base.rstrip('/')}/judgealign-{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """Write ``frame`` below a shared folder and return the frame that reads it.

    While it is written, batches for Python functions hold few rows where rows are large, so that two tasks of an executor share
    little memory with the JVM beside them.
    """
    schema, conf, setting = frame.schema, frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(setting)
    conf.set(setting, "16m")
    try:
        frame.write.parquet(path)
    finally:
        conf.set(setting, before)
    return frame.sparkSession.read.schema(schema).parquet(path)


def spread(table: DataFrame, parts: int = 1) -> DataFrame:
    """Spread a file scan with fewer splits than cores before expensive work per row.

    For scans only: the splits of other plans cannot be known without running them. ``parts`` above 1 is for narrow rows with
    far more work than bytes: the scan is dealt into so many parts per core, or per split where there are more of these, so
    that a task's share does not grow up to that of a whole split.
    """
    cores, splits = table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()
    if parts > 1:
        return table.repartition(parts * max(cores, splits))
    return table if splits >= cores else table.repartition(cores)


def ship_with_tasks(module: str) -> None:
    """Send a module's functions inside the tasks that use them.

    Executors then need no installed copy of this package for its few operators with Python inside tasks.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])

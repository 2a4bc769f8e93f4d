"""Session settings and the shared folder for derived tables."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Everything here is a plain Spark setting; a cluster's own values win over them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "gondola", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(parallelism),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # Small data on few cores: let adaptive execution keep several partitions of it.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a folder on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="gondola-")
    return _LOCAL_FOLDERS[context.applicationId]


_LOCAL_FOLDERS: dict[str, str] = {}


#: A Spark setting: the shuffle files of a query are removed at its end, not when the driver happens to collect its
#: garbage.  A stage whose files are gone is run again if it is needed, as after the loss of an executor.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin within remove their shuffle files when they end.  Those of a cached table stay until
    it is given up (``release``)."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, now and not
    when the driver next happens to collect its garbage.  To be called between steps."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)  # a thread of the gateway drops the references
        spark.sparkContext._jvm.System.gc()

"""Session set-up, the shared scratch folder and run folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every job here relies on; anything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # merge adjacent packets of a session before the shuffle, so a hot flow
    # leaves each task as a few partial sessions
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # streaming state lives on local disk, backed by the checkpoint, not in executor memory
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: few rows per batch that crosses to Python
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


class NoSharedFolder(RuntimeError):
    """Raised on a cluster without a folder that all executors see."""


def build_session(app: str = "netloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def adopt(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@cache
def _one_machine_root() -> tempfile.TemporaryDirectory:
    """Removed when this process ends."""
    return tempfile.TemporaryDirectory(prefix="netloom-", ignore_cleanup_errors=True)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see. Only a local master, one machine by definition, may do without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _one_machine_root().name
    return root.rstrip("/")


_RUNS: list[str] = []


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """Keep what a flow writes on its way in one folder and delete it at the end.

    Read or write the flow's results inside the block: tables made in it are gone afterwards.
    """
    path = scratch(spark, name)
    _RUNS.append(path)
    try:
        yield path
    finally:
        _RUNS.remove(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the innermost run folder or else the shared folder; never reused."""
    return f"{_RUNS[-1] if _RUNS else shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str = "step", **options: str):
    """Cut lineage through a written table, so a lost executor costs no replay. ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver's JVM has collected their plans, which a driver
    with little to do would leave for half an hour."""
    spark._jvm.System.gc()


def together(spark: SparkSession, jobs: Sequence[Callable], at_once: int = 8) -> list:
    """Results of jobs that do not need each other, ``at_once`` of them run side by side: one's small steps leave cores idle that
    another can use. The first failure is raised."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)

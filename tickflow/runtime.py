"""Session, shared scratch folder, written intermediate tables and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when it was written and has at most this many rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench, with a scratch folder of its one process; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tickflow-"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``, and ``local_session`` sets one. Only a session of one process that
    was started without the setting gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/tickflow-{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):     # one process, so its own folder is shared
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tickflow-")
    return _local_dirs[app]


def state_of(spark: SparkSession, path: str) -> tuple:
    """Number and size of the files of a table and when its folder last changed; no row is read and no job is run.

    A table that is written anew has another state. (Where folders have no times, as in object stores, one with as many
    files of the same total size has not.)
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = system.getContentSummary(folder)
    return held.getFileCount(), held.getLength(), system.getFileStatus(folder).getModificationTime()


def remove_stage_tables(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; its lazy results can't be read after."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for an application; tasks import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tickflow-"), "tickflow.zip")     # the driver hands it out itself
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def new_path(spark: SparkSession, label: str) -> str:
    ship(spark)
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and fixes values that depend on
    the physical partitioning (such as the partition id).
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(stored: DataFrame) -> int:
    """Size of a written table's files, as the planner knows it."""
    return int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The table computed once and written, and whether it has at most so many rows and bytes on disk.

    The count reads file footers only. (An observed count would save that job, but a session
    that has observed anything can no longer be shipped with a trained model's summary.)
    """
    stored = written(table, "table")
    return stored, stored_bytes(stored) <= max_bytes and stored.count() <= max_rows


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table that is expected to be small, after checking that it is.

    A counted table of at most ``max_rows`` rows is broadcast; otherwise both sides are
    shuffled on ``on``. Callers choose ``on`` so that one key never holds more than one
    block of rows (see ``order``), so the shuffle is even.
    """
    stored, small = sized(table, max_rows)
    return df.join(F.broadcast(stored) if small else stored, on, how)


def together(run: Callable, arguments: Sequence, parallelism: int = 4) -> list:
    """Submit independent Spark jobs from a few driver threads; results in order."""
    with ThreadPool(max(1, min(parallelism, len(arguments)))) as pool:
        return pool.map(run, arguments)

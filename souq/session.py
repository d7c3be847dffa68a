"""Session construction and lineage helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale.  AQE re-plans joins from runtime sizes
# (size-checked broadcast), coalesces small shuffle partitions and splits
# skewed join partitions.  Session time zone is pinned so timestamp_ntz input
# and date arithmetic agree with the SQL oracle.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256MB",
    # AQE sizes post-shuffle partitions from measured bytes; on a cluster
    # spark.sql.shuffle.partitions is set high (e.g. total shuffle bytes /
    # 256 MB) and coalesced down at run time
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    # no Python call-site capture per DataFrame call (4 extra JVM round trips
    # per function); plans are built with fewer driver RPCs
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoint files go with the frames that hold them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


_OWN: set[str] = set()  # checkpoint folders of this process that go when it ends


def get_spark(
    app: str = "souq",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Build or reuse a session with the scale settings applied.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them unset and let the submit configuration decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if k.startswith("spark.sql.") and not k.startswith("spark.sql.files"):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only in local mode is a folder created when the setting is absent; on a
    cluster a folder of this machine would be lost to the executors, so the
    missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="souq-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    # the folder of this application's frames below it
    own = sc.getCheckpointDir()
    if own not in _OWN:
        _OWN.add(own)
        remove_at_exit(spark, own)
    return path


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder on the cluster's file system when the driver ends."""
    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    atexit.register(remove)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the actions inside."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


@contextlib.contextmanager
def shuffles_end_with_actions(spark: SparkSession):
    """Actions planned inside drop their shuffle files when they end.

    For actions that write their whole result: nothing reads their shuffles
    again, and a job of many steps would otherwise keep every step's shuffle
    files on the executors' disks until it ends.  During the action a lost
    executor's shuffle output is computed again as always.
    """
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    with shuffles_end_with_actions(spark):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that the setting holds


#: keys that a join may send to every task: 1 million longs are about 60 MB there
BROADCAST_KEYS = 1_000_000


def keep_keys(df: DataFrame, most: int = BROADCAST_KEYS) -> tuple[DataFrame, bool]:
    """Materialise keys that several joins look up, and tell whether they are few.

    Counted when they are there: few are sent to every task, so the tables
    that look them up are not shuffled; more are joined by a shuffle.
    """
    kept = cut_lineage(df)
    few = kept.count() <= most
    return (F.broadcast(kept) if few else kept), few


#: rows of a table that a join may send to every task: with a few columns about 10 MB there
BROADCAST_ROWS = 100_000


def shuffled_if_many(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table as one side of joins: with many rows it is shuffled, however small its files are.

    Left to itself Spark sends a table to the driver and to every task when its
    files are small, but compressed files may hold fifty times their size in
    rows.  The rows are counted from the files' footers.
    """
    return df if df.count() <= most else df.hint("merge")


def local_test_session(cores: int = 8) -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    spark = get_spark(
        "souq-test",
        master=f"local[{cores}]",
        shuffle_partitions=cores,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Local sessions for tests and benches, and the folder jobs may share between executors."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(
    cpus: int | str = "*", app: str = "tallyloom", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-JVM session. A cluster brings its own session; nothing here is needed there."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Do not record a Python stack trace for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets one temporary folder per
    application. On a cluster a machine-local folder would lose data with its executor,
    so a missing setting is an error there. A ``file:`` folder is taken as a mount that all
    machines share, with a warning, since nothing here can tell.

    Staged tables stay until someone clears the folder, as checkpoints do. Every path that
    ``fresh_path`` gives ends with a random part, so a folder named for one job can be
    removed whole when the job is done.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        local = spark.conf.get("spark.master", "").startswith("local")
        if not local and (named.startswith("file:") or named.startswith("/") and _on_disk(spark)):
            warnings.warn(f"{named} must be a mount that all machines share", stacklevel=2)
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tallyloom-")
    return _LOCAL_FOLDERS[app]


def _on_disk(spark: SparkSession) -> bool:
    """True if a path without a scheme is one of the machine's own file system."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return default.startswith("file:")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a parquet table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the true size
    of the table, so that joins to it are broadcast only when it is really small.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session settings, the shared work folder and staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORK_DIRS: dict[str, str] = {}
_PATHS: list[str] = []


def build_session(app_name: str = "inkwell", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would vanish with its machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_WORK_DIRS:
        _LOCAL_WORK_DIRS[app] = tempfile.mkdtemp(prefix="inkwell-")
    return _LOCAL_WORK_DIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete one folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _PATHS:
        _PATHS.remove(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the folders that this process has staged so far; frames that read them no longer work.

    Returns how many there were. Call it once the results are written elsewhere.
    """
    paths = list(_PATHS)
    for path in paths:
        drop(spark, path)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    Later jobs see the very same rows even when executors are lost, and column pruning still
    reaches the staged files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

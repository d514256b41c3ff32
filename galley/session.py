"""Session settings the jobs are written for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "galley", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time.

    Nothing here overrides a cluster's own sizing: the number of shuffle partitions and the
    memory settings are left to the submitter unless they are passed in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # a side whose partitions turn out this small is hashed instead of sorting both sides
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or None when it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


_own_folders: list[str] = []


def work_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The shared folder for intermediate tables: the argument, else ``spark.checkpoint.dir``.

    A session inside one process that names neither gets a folder of its own, once, removed when
    the process ends. A cluster that names neither is refused: its machines share no local folder.
    """
    chosen = folder or checkpoint_folder(spark)
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir, or pass a folder, that all machines share")
    if not _own_folders:
        own = tempfile.mkdtemp(prefix="galley-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_folders.append(own)
    return _own_folders[0]


def new_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A path in the work folder that nothing else uses."""
    return f"{work_folder(spark, folder)}/galley-{label}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write a frame that several branches read as Parquet in the work folder, and read it back.

    Lineage ends there, columns and filters still reach the scan, and a lost executor loses nothing.
    """
    path = new_path(frame.sparkSession, label, folder)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

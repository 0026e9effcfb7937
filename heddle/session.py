"""Session helpers: table reading, the shared stage folder and written stages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_STAGES: dict[str, list[str]] = {}
_ONCE: dict[str, dict] = {}


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files have so few splits that at least half of the cores would idle.

    Only small inputs are that; a large one keeps its splits and is not shuffled.
    """
    importable(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written stages that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is missing (single-JVM
    tests) a temporary folder is made and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _LOCAL[app] = tempfile.mkdtemp(prefix="heddle-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def write_stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes a stage as a parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read of files, never a recomputation of the stages before.
    """
    spark = df.sparkSession
    importable(spark)
    path = stage_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def once(spark: SparkSession, key: tuple, build: Callable, marker: str) -> str:
    """The path that ``build`` returns, built at the first call for ``key`` in this application, and again where its file
    ``marker`` is gone; ``clear_stages`` forgets it."""
    known = _ONCE.setdefault(spark.sparkContext.applicationId, {})
    if key not in known or not exists(spark, f"{known[key]}/{marker}"):
        known[key] = build()
    return known[key]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``clear_stages``."""
    path = os.path.join(shared_dir(spark), f"stage-{name}-{uuid.uuid4().hex}")
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Deletes the stages that this application has written so far, and returns their number.

    To be called when no result that rests on them is needed any more; a long-running service does so between jobs.
    """
    jvm = spark.sparkContext._jvm
    _ONCE.pop(spark.sparkContext.applicationId, None)
    paths = _STAGES.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)

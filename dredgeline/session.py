"""Session helpers: defaults for a local run, and scratch tables in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "dredgeline", **conf: str) -> SparkSession:
    """A local session with settings that also suit a cluster: AQE on, UTC, Arrow batches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="dredgeline-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return shared_dir(spark)


_scratch: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder. Local ones are removed when the process ends, all by :func:`drop_scratch`."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch.append(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, "/" + path[5:].lstrip("/"), True)
    elif os.path.isabs(path) and os.path.isdir(os.path.dirname(path)):
        atexit.register(shutil.rmtree, path, True)
    return path


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, computes once."""
    path = scratch_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables made so far, on any file system. Results that still read from them become unusable."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where written tables go when the session names no shared folder (single-machine sessions only).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is set here only on a local master without any."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/{sc.applicationId}-{label}-{uuid.uuid4().hex[:12]}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once as a table in the shared folder and read from there.

    It cuts the lineage as checkpoint() would, computes df once (checkpoint()
    computes it twice) and survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Operators that remember something in this Python worker, and how each forgets it.
_remembered: dict[str, Callable[[], None]] = {}


def at_work(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called where an operator's work begins in a Python worker: what other operators remember there is given back.

    Workers outlive tasks, stages and queries, so one operator's memory would
    lie beside all that come after it. The operator's own stays from task to task.
    """
    others = [o for o in _remembered if o != operator]
    for o in others:
        _remembered.pop(o)()
    if others:
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed
            trim(0)
    if forget:
        _remembered[operator] = forget

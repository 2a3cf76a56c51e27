"""Files that a query writes on its way: in the folder that the session shares with its executors, gone when the driver ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []
_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path, not made yet, below spark.checkpoint.dir; below a temporary folder where that is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        root = f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
        root = f"file://{_own[0]}"
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear() -> None:
    for path, spark in _made.items():
        try:
            delete(spark, path)
        except Exception:  # the session has ended first
            pass

"""Where intermediate tables and logs go, and how they go again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders made by this process that are still there.
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder; it is deleted when the process ends."""
    path = f"{shared_dir(spark).removeprefix('file://')}/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already: the folder's owner cleans up
        return


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            forget(spark, path)

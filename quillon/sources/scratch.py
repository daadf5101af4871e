"""Tables that a query writes for itself: in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(path: str) -> None:
    """Delete a folder that is no longer read; one that is not there is none."""
    try:
        store, at = fs.FileSystem.from_uri(path)
        store.delete_dir(at)
    except (OSError, ValueError):  # not there, or in a store that only Spark reaches
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of Parquet files, read back: what it took is not computed again,
    whatever executors are lost.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, path)
    return spark.read.schema(df.schema).parquet(path)

"""Tables that a driver writes for itself in the folder that it shares with the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or, where that is unset on a local master, in the machine's temporary folder. It goes at the driver's end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/') if root else 'file://' + tempfile.gettempdir()}/gridmoments-{name}-{uuid.uuid4().hex}"
    atexit.register(_quietly, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to such a folder, which cuts their lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that Spark knows, named as Spark names files; nothing happens where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended
        if path.startswith("file:"):
            import shutil

            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)

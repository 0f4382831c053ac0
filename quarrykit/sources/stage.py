"""Small tables written to the folder that driver and executors share, so that plans that use them more than once don't grow."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir, gone when the interpreter ends; a local session without that setting takes a temporary folder, a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to a shared path and read back."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or context is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        return

"""The folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        set_by_code = context._jsc.sc().getCheckpointDir()
        if set_by_code.isDefined():
            folder = set_by_code.get()
        elif re.match(r"local($|\[)", context.master):
            folder = "file:///tmp/checkpoints/tidewatch"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows as Parquet in the shared folder: lineage ends there, lost executors cost nothing, and columns can be pruned. Deleted when the driver ends, if not before."""
    path = new_folder(df.sparkSession, kind)
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that no later action reads."""
    for x in tables:
        context = x.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(x.stored_in)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

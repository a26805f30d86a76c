"""Tables written between the jobs of one query, and result snapshots that are published at once."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset and all runs on this machine, as in tests."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder and not re.match(r"local($|\[)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or "file:///tmp/checkpoints/tidewatch").rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, if its files give fewer tasks than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's JVM ends in an orderly way; results may read it lazily until then."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stored(df: DataFrame, kind: str, parts: list[str] = ()) -> DataFrame:
    """The rows as Parquet in the shared folder: lineage ends there, and lost executors cost nothing. Deleted when the driver ends. `parts`: columns that name folders."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    spark, schema = df.sparkSession, df.schema
    df.write.partitionBy(*parts).parquet(path)
    delete_at_end(spark, path)
    del df
    gc.collect()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def gathered(spark: SparkSession, frames: Iterator[DataFrame], schema: str, kind: str) -> DataFrame:
    """The rows of one frame after another, as stored() has them; each frame is written before the next one is asked for."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    delete_at_end(spark, path)
    for df in frames:
        df.write.mode("append").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def released(df: DataFrame) -> None:
    """Delete what stored() or gathered() wrote, and the shuffles that nothing refers to any more; `df` can't be read after that."""
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    context._jvm.System.gc()

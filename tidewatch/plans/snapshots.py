"""Analysis results as snapshots: each run writes its own folder, and one pointer names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Runs under one folder in the shared storage.

    A run's tables are written first and the pointer last, by a rename, so that a reader sees
    the old run or the new one and never a mixture. A failed run leaves the pointer alone.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        names = [s.getPath().getName() for s in self.fs.globStatus(self.path(f"{self.folder}/current-*")) or []]
        return max((int(n.rsplit("-", 1)[1]) for n in names), default=None)

    def start(self, settings: str = "{}") -> int:
        taken = [int(s.getPath().getName().split("=")[1]) for s in self.fs.globStatus(self.path(f"{self.folder}/run=*")) or []]
        run = max(taken, default=0) + 1
        self.fs.mkdirs(self.path(f"{self.folder}/run={run}"))
        self.log(run, "running", "start", 0, settings=settings)
        return run

    def log(self, run: int, status: str, stage: str, percent: int, error: str | None = None, settings: str = "{}") -> None:
        """Progress of a run, clamped to 0..100; errors are cut to 2000 characters."""
        row = self.spark.range(1).select(F.lit(run).cast("long").alias("run_id"), F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.greatest(F.lit(0), F.least(F.lit(100), F.lit(percent))).alias("percent"), F.left(F.lit(error).cast("string"), F.lit(2000)).alias("error"), F.lit(settings).alias("settings"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def runs(self) -> DataFrame:
        """The last state of each run; a run that never ended and isn't the last one has failed."""
        log = self.spark.read.parquet(f"{self.folder}/log")
        last = log.groupBy("run_id").agg(F.max_by(F.struct("status", "stage", "percent", "error"), "at").alias("x"), F.min("at").alias("started_at"))
        newest = last.agg(F.max("run_id").alias("newest"))
        orphan = (F.col("x.status") == "running") & (F.col("run_id") < F.col("newest"))
        return last.crossJoin(F.broadcast(newest)).select("run_id", F.when(orphan, "failed").otherwise(F.col("x.status")).alias("status"), "x.stage", "x.percent", "x.error", "started_at")

    def status(self) -> DataFrame:
        """The run to show, in one row: a running one first, then the latest."""
        return self.runs().orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.desc("run_id")).limit(1)

    def publish(self, run: int, tables: dict[str, DataFrame]) -> None:
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.folder}/run={run}/{name}")
        except Exception as e:
            self.log(run, "failed", "publish", 96, str(e))
            raise
        self.fs.mkdirs(self.path(f"{self.folder}/current-{run}"))  # one step: the pointer
        self.log(run, "completed", "done", 100)

    def read(self, name: str) -> DataFrame:
        run = self.current()
        if run is None:
            raise LookupError("nothing is published yet")
        return self.spark.read.parquet(f"{self.folder}/run={run}/{name}")


def still_valid(groups: DataFrame, members: DataFrame, reviews: DataFrame) -> DataFrame:
    """Groups of which no member's text has changed: members (component, review_id, text_hash), reviews (review_id, text)."""
    now = reviews.select("review_id", F.sha2("text", 256).alias("now"))
    state = members.join(now, "review_id", "left").groupBy("component").agg(F.bool_and(F.coalesce(F.col("text_hash") == F.col("now"), F.lit(False))).alias("valid"))
    return groups.join(state.filter("valid").select("component"), "component", "left_semi")

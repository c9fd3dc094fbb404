"""Tables between steps, and numbering without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="duewise-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; lineage ends there, lost executors lose nothing. It goes when the driver ends.

    The shuffle files that made it go at once: nothing reads them again, and they would lie on disk until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/duewise-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows (counted here unless given)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` from 0 in total ``order``: ranges are sorted apart, then each adds the sizes of those before it."""
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes, offset = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}, 0
    starts = []
    for k in sorted(sizes):
        starts.append((k, offset))
        offset += sizes[k]
    starts = df.sparkSession.createDataFrame(starts, "_range int, _start bigint")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_k", within).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_k") + F.col("_start")).cast("int")).drop("_range", "_start", "_k")

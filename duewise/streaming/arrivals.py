"""Streams: daily arrivals by event time, and records that become visible on their issue day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_arrivals(events: DataFrame, *, time: str = "ts", value: str = "value", late: str = "1 day") -> DataFrame:
    """(day, arrivals, total) in tumbling days of event time; works on a stream (days close ``late`` after) and on a table."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("arrivals"), F.sum(value).alias("total"))
    return out.select(F.to_date("w.start").alias("day"), "arrivals", "total")


def edge_arrivals(records: DataFrame, *, late: str = "7 days") -> DataFrame:
    """(day, debtor, creditor, records, mass_cents) of records by issue day, streamed or not."""
    rows = records.withColumn("at", F.col("issue_date").cast("timestamp"))
    rows = rows.withWatermark("at", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("at", "1 day").alias("w"), "debtor", "creditor").agg(F.count(F.lit(1)).alias("records"), F.sum("amount_cents").alias("mass_cents"))
    return out.select(F.to_date("w.start").alias("day"), "debtor", "creditor", "records", "mass_cents")


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Writes closed windows as they come; ends when the source has nothing left."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

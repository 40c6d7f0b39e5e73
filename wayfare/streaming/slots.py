"""Stay clusters of slots as they close, from a stream of located updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.stays import from_sphere, sphere


def slot_centroids(updates: DataFrame, time: str, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Mean centre per agent and slot; a slot is emitted once the watermark has passed its end.

    State per open slot is a handful of sums, whatever the number of updates. Slots are counted from the epoch, which
    for steps that divide a day is the same as from UTC midnight.
    """
    x, y, z = sphere(F.col("lat"), F.col("lon"))
    summed = (
        updates.withColumn("_at", F.col(time).cast("timestamp"))
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", f"{seconds} seconds").alias("_w"), "agent_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias("_x"),
            F.avg(y).alias("_y"),
            F.avg(z).alias("_z"),
            F.min("_at").alias("first_at"),
            F.max("_at").alias("last_at"),
        )
    )
    lat, lon = from_sphere(F.col("_x"), F.col("_y"), F.col("_z"))
    return summed.select(
        "agent_id",
        F.col("_w.start").alias("slot"),
        "n",
        "first_at",
        "last_at",
        lat.alias("centre_lat"),
        lon.alias("centre_lon"),
    )


def write_slots(slots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed slots to parquet files; processes what is there and stops."""
    return (
        slots.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

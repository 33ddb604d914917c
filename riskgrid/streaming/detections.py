"""Detections and readings as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.operators.grid import assign_cell_ids, explode_neighbors


def located(stream: DataFrame, time_col: str = "ts", delay: str = "2 days") -> DataFrame:
    """Cell and day of each detection, with a watermark on the event time.

    The live feed carries no type, so every detection counts.
    """
    return (
        assign_cell_ids(stream.withColumn(time_col, F.col(time_col).cast("timestamp")))
        .withWatermark(time_col, delay)
        .withColumn("day", F.to_date(time_col))
    )


def ignition_days(stream: DataFrame, time_col: str = "ts", delay: str = "2 days") -> DataFrame:
    """One record per (cell, day), however many detections arrive.

    A repeat is dropped while its first record is within the watermark delay;
    state is held no longer than that.
    """
    return located(stream, time_col, delay).dropDuplicatesWithinWatermark(["cell_id", "day"]).select("cell_id", "day", time_col)


def sliding_neighbor_counts(
    stream: DataFrame, time_col: str = "ts", delay: str = "2 days", windows: tuple[int, ...] = K.NEIGHBOR_WINDOWS
) -> DataFrame:
    """Neighbour fire days before each target date, from the detection stream.

    A sliding window of the longest span ends at the target date, so it holds
    strictly prior days.  Repeats of a (cell, day) are dropped before anything
    is multiplied; a day whose repeats lie farther apart than the delay still
    counts once, as the state of a window is the set of its (neighbour, day)
    pairs, at most eight per day.
    """
    longest = max(windows)
    reached = explode_neighbors(ignition_days(stream, time_col, delay), "cell_id", "target_id")
    pairs = F.collect_set(F.struct(F.col("cell_id").alias("source"), "day"))
    grouped = reached.groupBy(F.window(time_col, f"{longest} days", "1 day"), "target_id").agg(pairs.alias("pairs"))
    target = F.to_date(F.col("window.end"))

    def within(n: int):
        return F.size(F.filter("pairs", lambda p: p["day"] >= F.date_sub(target, n))).cast("double")

    return grouped.select(
        F.col("target_id").alias("cell_id"),
        target.alias("date"),
        *[within(n).alias(f"neighbor_fire_count_{n}d") for n in windows],
    )


def daily_weather(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily mean, maximum and total per point from a stream of readings."""
    return (
        stream.withWatermark("valid_time", delay)
        .groupBy(F.window("valid_time", "1 day"), "latitude", "longitude")
        .agg(
            F.avg("t2m").alias("t2m"),
            F.max("cape").alias("cape"),
            (F.coalesce(F.sum("cp"), F.lit(0.0)) * K.MM_PER_METRE).alias("convective_precip_mm"),
            F.count(F.lit(1)).alias("readings"),
        )
        .select("latitude", "longitude", F.to_date(F.col("window.start")).alias("date"), "t2m", "cape", "convective_precip_mm", "readings")
    )


def daily_counts(stream: DataFrame, time_col: str = "ts", delay: str = "2 days") -> DataFrame:
    """Detections per cell and day.  In update mode a late record within the
    delay corrects its day's row; one that is later is dropped."""
    return (
        located(stream, time_col, delay)
        .groupBy(F.window(time_col, "1 day"), "cell_id")
        .agg(F.count(F.lit(1)).alias("detections"))
        .select("cell_id", F.to_date(F.col("window.start")).alias("date"), "detections")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, store it as Parquet, and read it back.

    In update mode each batch is stored under its number and the last version
    of a row can be told by `batch`; replaying a batch overwrites it.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:

        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(store).start()
    query.awaitTermination()
    return spark.read.parquet(path)

"""Detection tables: landed files, incremental append and gap reports."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions import constants as K
from riskgrid.functions import geo

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("type", T.IntegerType()),
    ]
)
# The near-real-time feed has no `type`.
FEED_SCHEMA = T.StructType([f for f in DETECTION_SCHEMA.fields if f.name != "type"])


def read_detections(
    spark: SparkSession,
    path: str,
    start: str | dt.date,
    end: str | dt.date,
    bbox: str = K.DEFAULT_BBOX,
    file_format: str = "parquet",
    schema: T.StructType = DETECTION_SCHEMA,
) -> DataFrame:
    """Landed detections inside the bbox and the dates, ends included.

    The schema is explicit and the predicates are plain comparisons, so they
    reach the file reader.
    """
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.format(file_format).load(path).filter(
        geo.in_bbox(F.col("latitude"), F.col("longitude"), bbox)
        & F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None where nothing has been written yet.

    Only a path that does not exist counts as that; an empty folder, files that
    can not be read or a refused path stay errors.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(spark: SparkSession, source: DataFrame, target: str, start: str, end: str) -> DataFrame:
    """Append what `source` has after the last date of `target`.

    A run that stopped halfway is simply run again: it resumes on the day after
    the last stored one, never before `start`.
    """
    resume = F.lit(start).cast("date")
    stored = read_or_none(spark, target)
    if stored is not None:
        newest = stored.agg(F.max("year")).first()[0]  # a partition column: no data is read
        last = stored.filter(F.col("year") == newest).agg(F.max("acq_date")).first()[0] if newest is not None else None
        if last is not None:
            resume = F.greatest(resume, F.lit(last + dt.timedelta(days=1)))
    fresh = source.filter((F.col("acq_date") >= resume) & (F.col("acq_date") <= F.lit(end).cast("date")))
    (
        fresh.withColumn("year", F.year("acq_date"))
        .write.mode("append")
        .partitionBy("year")
        .parquet(target)
    )
    return spark.read.parquet(target)


def missing_months(df: DataFrame, start: str, end: str, date_col: str = "date") -> DataFrame:
    """Months between start and end of which the table has no row."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    wanted = (
        df.sparkSession.range(1)
        .select(F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("m"))
        .select(F.year("m").alias("year"), F.month("m").alias("month"))
    )
    present = df.select(F.year(date_col).alias("year"), F.month(date_col).alias("month")).distinct()
    return wanted.join(present, ["year", "month"], "left_anti")

"""Counts, balances and summaries of panels and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_profile(df: DataFrame, label: str = "ignited", cell_col: str = "cell_id", date_col: str = "date") -> DataFrame:
    """One row: rows, distinct cells, first and last date, share of each class."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(cell_col).alias("cells"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        F.avg(F.when(F.col(label) == 0, 1.0).otherwise(0.0)).alias("share_0"),
        F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("share_1"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that have missing values and how many, from one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(columns)])
    return counted.select(F.inline(pairs)).filter("nulls > 0")


def split_description(df: DataFrame, label: str = "ignited", date_col: str = "date", by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        F.sum(label).alias("positives"),
    )


def rate_by_bucket(df: DataFrame, bucket: Column, label: str = "ignited") -> DataFrame:
    """Rows, share of all rows and positive rate per bucket of a feature."""
    per = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("positive_rate"))
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return per.join(F.broadcast(total)).select("bucket", "rows", (F.col("rows") / F.col("total")).alias("share"), "positive_rate")


def rates_by_split(df: DataFrame, first: str, second: str, by: str = "split") -> DataFrame:
    """Positive rate of two labels per split, and how many times larger the second is."""
    return (
        df.groupBy(by)
        .agg(F.avg(first).alias("first_rate"), F.avg(second).alias("second_rate"))
        .withColumn("ratio", F.when(F.col("first_rate") > 0, F.col("second_rate") / F.col("first_rate")))
    )


def class_ratio(df: DataFrame, label: str = "ignited", by: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive; an absent class counts 0, a missing positive class divides by 1."""
    negatives = F.count(F.when(F.col(label) == 0, 1))
    positives = F.count(F.when(F.col(label) == 1, 1))
    return df.groupBy(*by).agg(
        negatives.alias("negatives"),
        positives.alias("positives"),
        (negatives / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )


def with_class_weights(df: DataFrame, label: str = "ignited", out: str = "weight") -> DataFrame:
    """Balanced weights n / (2 n_class); the counts are one broadcast row."""
    counts = df.agg(F.count(label).alias("_n"), F.count(F.when(F.col(label) == 1, 1)).alias("_p"))
    own = F.when(F.col(label) == 1, F.col("_p")).when(F.col(label) == 0, F.col("_n") - F.col("_p"))
    return df.join(F.broadcast(counts)).withColumn(out, F.col("_n") / (2 * F.nullif(own, F.lit(0)))).drop("_n", "_p")


def category_mix(df: DataFrame, season: Column, category: str) -> DataFrame:
    """Share of each category within each season."""
    counts = df.groupBy(season.alias("season"), category).agg(F.count(F.lit(1)).alias("n")).filter(F.col("season").isNotNull())
    totals = counts.groupBy("season").agg(F.sum("n").alias("total"))
    return counts.join(totals, "season").select("season", category, "n", (F.col("n") / F.col("total")).alias("share"))


def fold_summary(per_year: DataFrame, metric: str) -> DataFrame:
    """Mean, median, standard deviation, minimum and maximum of a yearly figure."""
    return per_year.agg(
        F.avg(metric).alias("mean"),
        F.median(metric).alias("median"),
        F.stddev(metric).alias("stddev"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
    )


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"))

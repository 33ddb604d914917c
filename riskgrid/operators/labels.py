"""Dense label panel and forward labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import constants as K


def filter_real_fires(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Vegetation fires only; rows without a type go too."""
    return df.filter(F.col(type_col) == K.VEGETATION_FIRE_TYPE)


def distinct_ignitions(fires: DataFrame, date_col: str = "acq_date") -> DataFrame:
    """One row per (cell, day), however many detections; combined before the shuffle."""
    return fires.select("cell_id", F.to_date(date_col).alias("date")).distinct()


def dense_days(cells: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Every cell on every date: exploded from each cell's own row, so the
    cross product needs neither a join nor a shuffle."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return cells.withColumn("date", F.explode(days))


def label_days(panel: DataFrame, ignitions: DataFrame) -> DataFrame:
    """Mark the panel rows that have an ignition."""
    hits = ignitions.select("cell_id", "date", F.lit(1).alias("_hit"))
    return panel.join(hits, ["cell_id", "date"], "left").withColumn("ignited", F.coalesce("_hit", F.lit(0))).drop("_hit")


def build_label_scaffold(
    fires: DataFrame,
    cells: DataFrame,
    start: str | dt.date,
    end: str | dt.date,
    date_col: str = "acq_date",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Dense (cell, date) panel with `ignited` 0/1.

    `keep` carries further per-cell columns (centroid, matched weather point)
    along, which saves joining them back on.
    """
    panel = dense_days(cells.select("cell_id", *keep), start, end)
    return label_days(panel, distinct_ignitions(fires, date_col))


def add_forward_label(
    df: DataFrame,
    n_days: int,
    out_col: str | None = None,
    label_col: str = "ignited",
    cell_col: str = "cell_id",
    date_col: str = "date",
) -> DataFrame:
    """Label over today and the n_days - 1 days after; NULL without a full window.

    Expects one row per cell and date, which bounds each window group by the
    length of the record.
    """
    ahead = Window.partitionBy(cell_col).orderBy(date_col).rowsBetween(0, n_days - 1)
    full = F.count(label_col).over(ahead) == n_days
    return df.withColumn(out_col or f"{label_col}_next_{n_days}d", F.when(full, F.max(label_col).over(ahead)))


def drop_unlabelled(df: DataFrame, label_col: str) -> DataFrame:
    return df.na.drop(subset=[label_col]).withColumn(label_col, F.col(label_col).cast("int"))


def season_rows(df: DataFrame, date_col: str = "date", start: str = K.SEASON_START, end: str = K.SEASON_END) -> DataFrame:
    from riskgrid.functions.weather_math import season_filter

    return df.filter(season_filter(F.col(date_col), start, end))


def with_split(
    df: DataFrame, train_end: str = K.TRAIN_END, val_end: str = K.VAL_END, date_col: str = "date"
) -> DataFrame:
    """Column `split`: train, val or test, by date only."""
    date = F.col(date_col)
    return df.withColumn(
        "split",
        F.when(date < F.lit(train_end).cast("date"), "train")
        .when(date < F.lit(val_end).cast("date"), "val")
        .when(date.isNotNull(), "test"),
    )


def temporal_split(
    df: DataFrame, train_end: str = K.TRAIN_END, val_end: str = K.VAL_END, date_col: str = "date"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames by date; each is a filter that reaches the scan."""
    date, first, second = F.col(date_col), F.lit(train_end).cast("date"), F.lit(val_end).cast("date")
    return df.filter(date < first), df.filter((date >= first) & (date < second)), df.filter(date >= second)

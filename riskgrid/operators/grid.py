"""Cells, neighbours and nearest points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions import geo
from riskgrid.operators.quadtree import METRICS, nearest_point  # noqa: F401  (part of what a grid offers)


def assign_cell_ids(
    df: DataFrame,
    lat_col: str = "latitude",
    lon_col: str = "longitude",
    cell_size_km: float = K.DEFAULT_CELL_SIZE_KM,
    reference_latitude: float = K.DEFAULT_REFERENCE_LATITUDE,
) -> DataFrame:
    """Add `cell_id` to points; a projection, so it runs inside the scan stage."""
    height, width = geo.cell_size_degrees(cell_size_km, reference_latitude)
    return df.withColumn(
        "cell_id",
        geo.cell_key(geo.grid_index(F.col(lat_col), height), geo.grid_index(F.col(lon_col), width)),
    )


def build_grid_cells(
    spark: SparkSession,
    bbox: str = K.DEFAULT_BBOX,
    cell_size_km: float = K.DEFAULT_CELL_SIZE_KM,
    reference_latitude: float = K.DEFAULT_REFERENCE_LATITUDE,
) -> DataFrame:
    """Every cell that covers the bbox, with its centroid.

    Rows are generated by `range` partitions and columns exploded from them,
    so a continental grid is enumerated in parallel.
    """
    west, south, east, north = geo.parse_bbox(bbox)
    height, width = geo.cell_size_degrees(cell_size_km, reference_latitude)
    rows = spark.range(math.floor(south / height), math.floor(north / height) + 1)
    columns = F.sequence(F.lit(math.floor(west / width)), F.lit(math.floor(east / width)))
    return rows.select(F.col("id").cast("int").alias("row"), F.explode(columns).alias("col")).select(
        geo.cell_key(F.col("row"), F.col("col")).alias("cell_id"),
        ((F.col("row") + 0.5) * height).alias("latitude"),
        ((F.col("col") + 0.5) * width).alias("longitude"),
    )


def explode_neighbors(df: DataFrame, cell_col: str = "cell_id", out_col: str = "neighbor_id") -> DataFrame:
    """Eight rows per input row, one for each surrounding cell id."""
    return df.withColumn(out_col, F.explode(geo.moore_neighbor_ids(F.col(cell_col))))


def nearest_cell(
    places: DataFrame,
    cells: DataFrame,
    key: str = "place",
    cell_size_km: float = K.DEFAULT_CELL_SIZE_KM,
) -> DataFrame:
    """Nearest loaded cell to each named place, its distance in km and whether
    the place lies outside the grid (farther than half a cell's diagonal).
    Of cells with one centroid, the smallest id."""
    hit = nearest_point(places, cells, key=key, metric="great_circle", carry="cell_id")
    half_diagonal = cell_size_km * math.sqrt(2.0) / 2.0
    return hit.select(
        key,
        "cell_id",
        F.col("distance").alias("distance_km"),
        (F.col("distance") > half_diagonal).alias("out_of_grid"),
    )

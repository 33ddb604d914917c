"""Column functions for the regular latitude/longitude grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgrid.functions import constants as K

EARTH_RADIUS_KM = 6371.0088
MOORE_OFFSETS = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c)


def cell_size_degrees(
    cell_size_km: float = K.DEFAULT_CELL_SIZE_KM, latitude: float = K.DEFAULT_REFERENCE_LATITUDE
) -> tuple[float, float]:
    """Height and width of a cell in degrees; folded to literals in every plan."""
    height = cell_size_km / K.KM_PER_DEGREE_LAT
    return height, height / math.cos(math.radians(latitude))


def parse_bbox(bbox: str) -> tuple[float, float, float, float]:
    west, south, east, north = map(float, bbox.split(","))
    return west, south, east, north


def bbox_columns(bbox: Column) -> list[Column]:
    """west, south, east, north of a bbox held in a string column."""
    part = F.split(bbox, ",")
    return [part[i].cast("double").alias(name) for i, name in enumerate(("west", "south", "east", "north"))]


def in_bbox(latitude: Column, longitude: Column, bbox: str) -> Column:
    west, south, east, north = parse_bbox(bbox)
    return latitude.between(south, north) & longitude.between(west, east)


def grid_index(coordinate: Column, size: float) -> Column:
    """Row or column number; floor, so negative coordinates index correctly."""
    return F.floor(coordinate / F.lit(size)).cast("int")


def cell_key(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row, col)


def cell_row(cell_id: Column) -> Column:
    return F.split(cell_id, "_", 2)[0].cast("int")


def cell_col(cell_id: Column) -> Column:
    return F.split(cell_id, "_", 2)[1].cast("int")


def moore_neighbor_ids(cell_id: Column) -> Column:
    """Array of the eight surrounding cell ids, in the grid or not."""
    row, col = cell_row(cell_id), cell_col(cell_id)
    return F.array(*[cell_key(row + dr, col + dc) for dr, dc in MOORE_OFFSETS])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))

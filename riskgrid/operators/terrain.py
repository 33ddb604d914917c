"""Static per-cell attributes: slope, aspect and fuel codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions import geo


def slope_aspect(elevations: DataFrame, cell_size_km: float = K.DEFAULT_CELL_SIZE_KM) -> DataFrame:
    """Slope and aspect by Horn's 3 x 3 differences.

    Each cell hands its elevation to the cells around it, so one aggregation
    collects all nine values; no self-join.  A missing neighbour counts as
    level with the centre.
    """
    offsets = geo.MOORE_OFFSETS + ((0, 0),)
    given = (
        elevations.select(geo.cell_row(F.col("cell_id")).alias("r"), geo.cell_col(F.col("cell_id")).alias("c"), "elevation_m")
        .withColumn("o", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])))
        .select((F.col("r") - F.col("o.r")).alias("row"), (F.col("c") - F.col("o.c")).alias("col"), F.col("o.r").alias("dr"), F.col("o.c").alias("dc"), "elevation_m")
    )
    nine = given.groupBy("row", "col").agg(
        *[
            F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("elevation_m"))).alias(f"z{r + 1}{c + 1}")
            for r, c in offsets
        ],
        F.max(((F.col("dr") == 0) & (F.col("dc") == 0)).cast("int")).alias("own"),
    )

    def z(r: int, c: int):
        return F.coalesce(F.col(f"z{r + 1}{c + 1}"), F.col("z11"))

    span = 8 * cell_size_km * 1000.0
    east = ((z(1, 1) + z(0, 1) * 2 + z(-1, 1)) - (z(1, -1) + z(0, -1) * 2 + z(-1, -1))) / span
    north = ((z(1, -1) + z(1, 0) * 2 + z(1, 1)) - (z(-1, -1) + z(-1, 0) * 2 + z(-1, 1))) / span
    return (
        nine.filter("own = 1")
        .select(geo.cell_key(F.col("row"), F.col("col")).alias("cell_id"), F.col("z11").alias("elevation_m"), east.alias("e"), north.alias("n"))
        .withColumn("facing", F.atan2(-F.col("e"), -F.col("n")))
        .select(
            "cell_id",
            "elevation_m",
            F.degrees(F.atan(F.hypot("e", "n"))).alias("slope_degrees"),
            F.sin("facing").alias("aspect_sin"),
            F.cos("facing").alias("aspect_cos"),
        )
    )


def overlap_join(
    cells: DataFrame,
    polygons: DataFrame,
    half_degree: float = K.CENTROID_BOX_HALF_DEGREE,
    tile_degrees: float = 0.25,
    salts: int = 8,
) -> DataFrame:
    """Polygons whose bounding box meets the small box around each centroid.

    `polygons` has min_lat, max_lat, min_lon, max_lon and any attributes.
    Both sides are cut into tiles and joined on the tile, an equi-join.  A pair
    that meets in several tiles is kept only in the one that holds the corner
    of the overlap, so nothing is deduplicated afterwards.  Polygons of a busy
    tile are spread over `salts` sub-keys.
    """

    def tiles(low, high):
        return F.sequence(F.floor(low / tile_degrees), F.floor(high / tile_degrees))

    lat, lon = F.col("latitude"), F.col("longitude")
    boxes = (
        cells.select(
            "cell_id",
            (lat - half_degree).alias("b_lat0"),
            (lat + half_degree).alias("b_lat1"),
            (lon - half_degree).alias("b_lon0"),
            (lon + half_degree).alias("b_lon1"),
        )
        .withColumn("t_row", F.explode(tiles(F.col("b_lat0"), F.col("b_lat1"))))
        .withColumn("t_col", F.explode(tiles(F.col("b_lon0"), F.col("b_lon1"))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    cut = (
        polygons.withColumn("t_row", F.explode(tiles(F.col("min_lat"), F.col("max_lat"))))
        .withColumn("t_col", F.explode(tiles(F.col("min_lon"), F.col("max_lon"))))
        .withColumn("salt", F.pmod(F.xxhash64("min_lat", "min_lon", "max_lat", "max_lon"), F.lit(salts)).cast("int"))
    )
    meets = (
        (F.col("min_lat") <= F.col("b_lat1"))
        & (F.col("max_lat") >= F.col("b_lat0"))
        & (F.col("min_lon") <= F.col("b_lon1"))
        & (F.col("max_lon") >= F.col("b_lon0"))
    )
    corner = (F.floor(F.greatest("min_lat", "b_lat0") / tile_degrees) == F.col("t_row")) & (
        F.floor(F.greatest("min_lon", "b_lon0") / tile_degrees) == F.col("t_col")
    )
    return (
        boxes.join(cut, ["t_row", "t_col", "salt"])
        .filter(meets & corner)
        .drop("t_row", "t_col", "salt", "b_lat0", "b_lat1", "b_lon0", "b_lon1")
    )


def mode_code(candidates: DataFrame, cells: DataFrame | None = None, code_col: str = "code") -> DataFrame:
    """Most frequent code per cell, the smallest of equals, "unknown" for none.

    Counted per (cell, code) first, so a cell with very many candidates is
    reduced before the shuffle.  `cells` adds the cells without candidates.
    """
    counts = candidates.groupBy("cell_id", code_col).agg(F.count(code_col).alias("n"))
    best = counts.groupBy("cell_id").agg(
        F.min(F.when(F.col(code_col).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(code_col).alias("code")))).alias("b")
    )
    if cells is not None:
        best = cells.select("cell_id").join(best, "cell_id", "left")
    return best.select("cell_id", F.coalesce("b.code", F.lit(K.UNKNOWN_FUEL)).alias("fuel_type_cd"))


def one_hot_long(fuel: DataFrame, code_col: str = "fuel_type_cd") -> DataFrame:
    """(cell_id, code, 1.0) for each known code; the form to use where codes are
    many, as it needs no column for each."""
    return fuel.filter(F.col(code_col).isNotNull()).select("cell_id", F.col(code_col).alias("code"), F.lit(1.0).alias("present"))


def one_hot_present(fuel: DataFrame, code_col: str = "fuel_type_cd", prefix: str = "fuel_type_") -> DataFrame:
    """One 0/1 column per code that occurs.  The codes become the schema, so
    their names, and nothing else, are gathered."""
    found = fuel.select(code_col).na.drop().distinct().collect()
    return fuel.select("cell_id", *[_flag(code_col, c).alias(prefix + c) for c in sorted(r[0] for r in found)])


def one_hot_fixed(
    fuel: DataFrame, names: tuple[str, ...] = K.FUEL_FEATURES, code_col: str = "fuel_type_cd", prefix: str = "fuel_type_"
) -> DataFrame:
    """0/1 columns for a given list; an unlisted or missing code gives all 0."""
    return fuel.withColumns({name: _flag(code_col, name.removeprefix(prefix)) for name in names})


def _flag(code_col: str, code: str):
    return F.when(F.col(code_col) == code, 1.0).otherwise(0.0)


def lookup_codes(requests: DataFrame, fuel: DataFrame) -> DataFrame:
    """Code of each requested cell, NULL where unknown."""
    return requests.join(fuel.select("cell_id", "fuel_type_cd"), "cell_id", "left")


def attach_static(panel: DataFrame, *statics: DataFrame) -> DataFrame:
    """Per-cell attributes on every date; the size measured at run time decides
    whether a table is broadcast."""
    for static in statics:
        panel = panel.join(static, "cell_id", "left")
    return panel

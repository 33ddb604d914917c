import random

from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions import geo
from riskgrid.operators import grid


def test_near_points_share_a_cell_and_far_ones_do_not(spark):
    df = spark.createDataFrame([(50.60, -120.30), (50.601, -120.301), (50.90, -120.90)], "latitude double, longitude double")
    ids = [r.cell_id for r in grid.assign_cell_ids(df).collect()]
    assert ids[0] == ids[1] != ids[2]


def test_neighbors_are_the_eight_around(spark):
    df = spark.createDataFrame([("10_-20",)], "cell_id string")
    found = {r.neighbor_id for r in grid.explode_neighbors(df).collect()}
    assert found == {"9_-21", "9_-20", "9_-19", "10_-21", "10_-19", "11_-21", "11_-20", "11_-19"}


def test_signed_parts_are_parsed(spark):
    df = spark.createDataFrame([("-3_-20",)], "cell_id string")
    assert df.select(geo.cell_row(F.col("cell_id")), geo.cell_col(F.col("cell_id"))).first()[:] == (-3, -20)


def test_grid_covers_the_region_once(spark):
    cells = grid.build_grid_cells(spark).collect()
    assert len(cells) == len({c.cell_id for c in cells}) == 39 * 37
    west, south, east, north = geo.parse_bbox(K.DEFAULT_BBOX)
    corners = spark.createDataFrame([(south, west), (north, east)], "latitude double, longitude double")
    assert {r.cell_id for r in grid.assign_cell_ids(corners).collect()} <= {c.cell_id for c in cells}


def test_centroids_lie_in_their_own_cell(spark):
    cells = grid.build_grid_cells(spark)
    again = grid.assign_cell_ids(cells.withColumnRenamed("cell_id", "own"))
    assert again.filter("own <> cell_id").count() == 0


def test_nearest_point_of_each_cell(spark):
    cells = spark.createDataFrame([("a", 50.05, -120.05), ("b", 50.95, -120.95)], "cell_id string, latitude double, longitude double")
    points = spark.createDataFrame([(50.0, -120.0), (51.0, -121.0)], "latitude double, longitude double")
    found = {r.cell_id: r.p_lat for r in grid.nearest_point(cells, points).collect()}
    assert found == {"a": 50.0, "b": 51.0}


def test_nearest_point_equals_brute_force_far_and_near(spark):
    rng = random.Random(3)
    # Dense corner, sparse rest, and places far away from every point.
    points = [(50 + rng.random() * 0.3, -120 + rng.random() * 0.3) for _ in range(300)]
    points += [(rng.uniform(-60, 60), rng.uniform(-170, 170)) for _ in range(20)]
    places = [(f"p{i}", rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(60)]
    places += [(f"q{i}", 50 + rng.random(), -120 + rng.random()) for i in range(60)]
    df = grid.nearest_point(
        spark.createDataFrame(places, "cell_id string, latitude double, longitude double"),
        spark.createDataFrame(points, "latitude double, longitude double"),
    )
    found = {r.cell_id: (r.p_lat, r.p_lon) for r in df.collect()}
    for key, lat, lon in places:
        assert found[key] == min(points, key=lambda p: (lat - p[0]) ** 2 + (lon - p[1]) ** 2)


def test_ties_go_north_then_west(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0)], "cell_id string, latitude double, longitude double")
    points = spark.createDataFrame([(0.1, 0.0), (-0.1, 0.0), (0.0, 0.1), (0.0, -0.1)], "latitude double, longitude double")
    assert grid.nearest_point(cells, points).first()[1:3] == (0.1, 0.0)


def test_nearest_cell_flags_places_outside(spark):
    cells = grid.build_grid_cells(spark)
    places = spark.createDataFrame([("in", 50.67, -120.33), ("out", 51.65, -120.03)], "place string, latitude double, longitude double")
    found = {r.place: r for r in grid.nearest_cell(places, cells).collect()}
    assert not found["in"].out_of_grid and found["in"].distance_km < 3.6
    assert found["out"].out_of_grid and found["out"].distance_km > 5

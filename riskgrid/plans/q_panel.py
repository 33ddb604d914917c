"""Registered queries: grid, labels, filters, joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskgrid.functions import geo, weather_math as wm
from riskgrid.operators import features as ft
from riskgrid.operators import grid, labels as lb, profile, terrain, weather as wx
from riskgrid.plans import demo
from riskgrid.plans import relations as rel
from riskgrid.plans.catalog import query, r, rounded

POINT = f"{r('latitude', 'latitude')}, {r('longitude', 'longitude')}"


# --- scalar and grid --------------------------------------------------------


@query(
    "scl_1",
    f"SELECT event_id, {r(f'latitude / {rel.HEIGHT!r}::double', 'lat_cells')}, {r(f'longitude / {rel.WIDTH!r}::double', 'lon_cells')} FROM points",
    ("points",),
)
def scl_1(spark, sf):
    height, width = geo.cell_size_degrees()
    return rounded(
        demo.points(spark, sf).select(
            "event_id", (F.col("latitude") / height).alias("lat_cells"), (F.col("longitude") / width).alias("lon_cells")
        )
    )


@query("scl_2", "SELECT event_id, cell_id FROM points_in_cells", ("points_in_cells",))
def scl_2(spark, sf):
    return grid.assign_cell_ids(demo.points(spark, sf)).select("event_id", "cell_id")


@query(
    "scl_3",
    f"SELECT g.cell_id, {r('g.latitude', 'latitude')}, {r('g.longitude', 'longitude')}, count(p.event_id) AS points FROM grid g LEFT JOIN points_in_cells p USING (cell_id) GROUP BY g.cell_id, g.latitude, g.longitude",
    ("grid", "points_in_cells"),
)
def scl_3(spark, sf):
    """The full cell universe, with the points each cell received."""
    per_cell = grid.assign_cell_ids(demo.points(spark, sf)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    cells = grid.build_grid_cells(spark)
    return rounded(
        cells.join(per_cell, "cell_id", "left").select("cell_id", "latitude", "longitude", F.coalesce("n", F.lit(0)).alias("points"))
    )


@query(
    "scl_4",
    "SELECT event_id, split_part(cell_id, '_', 1)::int AS row, split_part(cell_id, '_', 2)::int AS col FROM points_in_cells",
    ("points_in_cells",),
)
def scl_4(spark, sf):
    c = F.col("cell_id")
    return grid.assign_cell_ids(demo.points(spark, sf)).select("event_id", geo.cell_row(c).alias("row"), geo.cell_col(c).alias("col"))


@query("scl_5", f"SELECT cell_id, date, {r('relative_humidity', 'relative_humidity')} FROM humid", ("humid",))
def scl_5(spark, sf):
    return rounded(ft.add_relative_humidity(demo.weather_panel(spark, sf)).select("cell_id", "date", "relative_humidity"))


@query(
    "scl_6",
    f"SELECT cell_id, date, {r('wind_speed', 'wind_speed')}, {r('wind_dir_sin', 'wind_dir_sin')}, {r('wind_dir_cos', 'wind_dir_cos')} FROM timed",
    ("timed",),
)
def scl_6(spark, sf):
    out = ft.add_wind_features(demo.weather_panel(spark, sf))
    return rounded(out.select("cell_id", "date", "wind_speed", "wind_dir_sin", "wind_dir_cos"))


_Z = ", ".join(
    f"coalesce(max(CASE WHEN n.row - e.row = {a} AND n.col - e.col = {b} THEN n.elevation_m END), e.elevation_m) AS z{'snN'[a + 1]}{'wcE'[b + 1]}"
    for a in (-1, 0, 1)
    for b in (-1, 0, 1)
)


@query(
    "scl_7",
    f"""SELECT cell_id, elevation_m, {r('degrees(atan(sqrt(e * e + n * n)))', 'slope_degrees')}, {r('sin(atan2(-e, -n))', 'aspect_sin')}, {r('cos(atan2(-e, -n))', 'aspect_cos')}
    FROM (SELECT cell_id, elevation_m, ((zNE2 + 2 * zcE + zsE) - (zNw + 2 * zcw + zsw)) / 4e4 AS e, ((zNw + 2 * zNc + zNE2) - (zsw + 2 * zsc + zsE)) / 4e4 AS n
      FROM (SELECT e.cell_id, e.elevation_m, {_Z.replace('zNE', 'zNE2').replace('znE', 'zcE').replace('znw', 'zcw').replace('znc', 'zcc')}
        FROM elevations e JOIN elevations n ON abs(n.row - e.row) <= 1 AND abs(n.col - e.col) <= 1 GROUP BY e.cell_id, e.elevation_m, e.row, e.col))""",
    ("elevations",),
)
def scl_7(spark, sf):
    return rounded(terrain.slope_aspect(demo.elevations(spark, sf)))


@query(
    "scl_9",
    "SELECT strftime(date, '%m-%d') AS month_day, month(date)::int AS month, year(date)::int AS year, count(*) AS rows FROM panel GROUP BY ALL",
    ("panel",),
)
def scl_9(spark, sf):
    return (
        demo.panel(spark, sf)
        .groupBy(F.date_format("date", "MM-dd").alias("month_day"), F.month("date").alias("month"), F.year("date").alias("year"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "scl_10",
    f"SELECT cell_id, date, {r('t2m - 27315e-2', 'temp_c')}, {r('wind_speed * 3.6', 'wind_kmh')}, {r('swvl1 * 1000', 'mm')} FROM humid",
    ("humid",),
)
def scl_10(spark, sf):
    out = ft.add_wind_features(demo.weather_panel(spark, sf))
    return rounded(
        out.select(
            "cell_id",
            "date",
            wm.kelvin_to_celsius(F.col("t2m")).alias("temp_c"),
            wm.ms_to_kmh(F.col("wind_speed")).alias("wind_kmh"),
            wm.metres_to_mm(F.col("swvl1")).alias("mm"),
        )
    )


# --- filters ---------------------------------------------------------------


@query("flt_1", "SELECT event_id, type FROM points WHERE type = 0", ("points",))
def flt_1(spark, sf):
    return lb.filter_real_fires(demo.points(spark, sf)).select("event_id", "type")


@query(
    "flt_2",
    "SELECT cell_id, date, ignited FROM panel WHERE strftime(date, '%m-%d') BETWEEN '05-01' AND '10-15'",
    ("panel",),
)
def flt_2(spark, sf):
    return lb.season_rows(demo.panel(spark, sf)).select("cell_id", "date", "ignited")


_SPLIT = "CASE WHEN date < date '1999-01-01' THEN 'train' WHEN date < date '2000-01-01' THEN 'val' ELSE 'test' END"


@query("flt_3", f"SELECT {_SPLIT} AS split, cell_id, count(*) AS rows, sum(ignited)::bigint AS positives FROM panel GROUP BY ALL", ("panel",))
def flt_3(spark, sf):
    parts = lb.temporal_split(demo.panel(spark, sf), demo.TRAIN_END, demo.VAL_END)
    named = [p.withColumn("split", F.lit(n)) for p, n in zip(parts, ("train", "val", "test"))]
    return (
        named[0].unionByName(named[1]).unionByName(named[2])
        .groupBy("split", "cell_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("ignited").alias("positives"))
    )


_NEEDED = ["days_since_rain", "precip_7d", "precip_30d", "t2m_mean_7d", "t2m_trend_7d", "rh_mean_7d", "neighbor_fire_count_7d", "cape"]


@query(
    "flt_4",
    "SELECT cell_id, date FROM features WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _NEEDED),
    ("features",),
)
def flt_4(spark, sf):
    return ft.drop_incomplete_history(demo.features(spark, sf), _NEEDED).select("cell_id", "date")


_FORWARD = "CASE WHEN count(ignited) OVER w = 3 THEN max(ignited) OVER w END"
_FORWARD_W = "WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"


@query(
    "flt_5",
    f"SELECT * FROM (SELECT cell_id, date, {_FORWARD}::int AS ignited_next_3d FROM panel {_FORWARD_W}) WHERE ignited_next_3d IS NOT NULL",
    ("panel",),
)
def flt_5(spark, sf):
    labelled = lb.add_forward_label(demo.panel(spark, sf), 3)
    return lb.drop_unlabelled(labelled, "ignited_next_3d").select("cell_id", "date", "ignited_next_3d")


@query(
    "flt_6",
    """SELECT event_id, b[1]::double AS west, b[2]::double AS south, b[3]::double AS east, b[4]::double AS north
       FROM (SELECT *, string_split('-121.0,50.0,-120.0,51.0', ',') AS b FROM points) WHERE latitude BETWEEN 50 AND 51 AND longitude BETWEEN -121 AND -120""",
    ("points",),
)
def flt_6(spark, sf):
    box = "-121.0,50.0,-120.0,51.0"
    inside = demo.points(spark, sf).filter(geo.in_bbox(F.col("latitude"), F.col("longitude"), box))
    return inside.select("event_id", *geo.bbox_columns(F.lit(box)))


@query(
    "flt_7",
    """SELECT o_orderkey, o_orderdate::date AS date, CASE WHEN strftime(o_orderdate, '%m-%d') BETWEEN '05-01' AND '10-15' THEN 'ok' ELSE 'off_season' END AS status FROM orders""",
)
def flt_7(spark, sf):
    asked = demo.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return asked.withColumn("status", F.when(wm.season_filter(F.col("date")), "ok").otherwise("off_season"))


@query(
    "flt_8",
    f"SELECT cell_id, date, {' AND '.join(f'{c} IS NOT NULL' for c in _NEEDED)} AS accepted FROM features",
    ("features",),
)
def flt_8(spark, sf):
    from riskgrid.plans.serve import check_vector

    return check_vector(demo.features(spark, sf), _NEEDED).select("cell_id", "date", "accepted")


@query(
    "flt_9",
    f"SELECT row_key, {r('v[1]', 'first')}, {r('v[2]', 'second')}, {r('v[3]', 'third')} FROM (SELECT k * 100000 + d AS row_key, [t2m, cape, swvl1] AS v FROM weather)",
    ("weather",),
)
def flt_9(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from riskgrid.learn.models import assemble

    frame = demo.weather_panel(spark, sf).withColumn("row_key", F.col("k") * 100000 + F.col("d"))
    shuffled = frame.select("swvl1", "row_key", "cape", "t2m")  # the order of the input does not matter
    v = vector_to_array("features")
    return rounded(assemble(shuffled, ["t2m", "cape", "swvl1"]).select("row_key", v[0].alias("first"), v[1].alias("second"), v[2].alias("third")))


@query(
    "flt_10",
    "SELECT cell_id, date FROM panel WHERE strftime(date, '%m-%d') BETWEEN '04-01' AND '10-15'",
    ("panel",),
)
def flt_10(spark, sf):
    from riskgrid.functions import constants as K

    return lb.season_rows(demo.panel(spark, sf), start=K.LOOKBACK_SEASON_START).select("cell_id", "date")


# --- joins ------------------------------------------------------------------


@query("join_1", "SELECT cell_id, date, ignited FROM panel", ("panel",))
def join_1(spark, sf):
    return demo.panel(spark, sf).select("cell_id", "date", "ignited")


_NEAREST = """SELECT cell_id, lat, lon FROM (SELECT c.cell_id, p.latitude AS lat, p.longitude AS lon, row_number() OVER (PARTITION BY c.cell_id
      ORDER BY (c.latitude - p.latitude) * (c.latitude - p.latitude) + (c.longitude - p.longitude) * (c.longitude - p.longitude), p.latitude DESC, p.longitude) AS rn
    FROM cells c, (SELECT DISTINCT latitude, longitude FROM readings) p) WHERE rn = 1"""
rel.relation("nearest", _NEAREST, "cells", "readings")


@query("join_2", f"SELECT cell_id, {r('lat', 'p_lat')}, {r('lon', 'p_lon')} FROM nearest", ("nearest",))
def join_2(spark, sf):
    return rounded(grid.nearest_point(demo.cells(spark, sf), demo.readings(spark, sf)).select("cell_id", "p_lat", "p_lon"))


rel.relation("daily", "SELECT latitude, longitude, valid_time::date AS date, avg(t2m) AS t2m, avg(d2m) AS d2m FROM readings GROUP BY ALL", "readings")


@query(
    "join_3",
    f"""SELECT p.cell_id, p.date, {r('w.t2m', 't2m')}, {r('w.d2m', 'd2m')} FROM panel p LEFT JOIN nearest n USING (cell_id)
       LEFT JOIN daily w ON w.latitude = n.lat AND w.longitude = n.lon AND w.date = p.date""",
    ("panel", "nearest", "daily"),
)
def join_3(spark, sf):
    daily = wx.daily_means(demo.readings(spark, sf), ("t2m", "d2m"))
    panel = demo.panel(spark, sf).select("cell_id", "date")
    points = demo.readings(spark, sf).select("latitude", "longitude")
    return rounded(wx.join_weather(panel, demo.cells(spark, sf), daily, points))


@query(
    "join_4",
    f"""SELECT {r('m.latitude', 'latitude')}, {r('m.longitude', 'longitude')}, m.date, {r('m.t2m', 't2m')}, {r('p.precip_mm', 'precip_mm')}
       FROM daily m LEFT JOIN (SELECT latitude, longitude, valid_time::date - 1 AS date, max(tp) * 1000 AS precip_mm FROM readings WHERE hour(valid_time) = 0 GROUP BY ALL) p
       USING (latitude, longitude, date)""",
    ("daily", "readings"),
)
def join_4(spark, sf):
    out = wx.daily_land_weather(demo.readings(spark, sf), ("t2m",))
    return rounded(out.select("latitude", "longitude", "date", "t2m", "precip_mm"))


@query(
    "join_5",
    "SELECT p.cell_id, p.date, f.fuel_type_cd, e.elevation_m FROM panel p LEFT JOIN fuel f USING (cell_id) LEFT JOIN elevations e USING (cell_id)",
    ("panel", "fuel", "elevations"),
)
def join_5(spark, sf):
    panel = demo.panel(spark, sf).select("cell_id", "date")
    return terrain.attach_static(panel, demo.fuel(spark, sf), demo.elevations(spark, sf))


_NEAR = "(SELECT unnest([-1, 0, 1]) AS dr) a, (SELECT unnest([-1, 0, 1]) AS dc) b"


@query(
    "join_6",
    f"""SELECT event_id, cell_id, (r + dr) || '_' || (c + dc) AS neighbor_id FROM (SELECT event_id, cell_id, split_part(cell_id, '_', 1)::int AS r,
       split_part(cell_id, '_', 2)::int AS c FROM points_in_cells), {_NEAR} WHERE dr <> 0 OR dc <> 0""",
    ("points_in_cells",),
)
def join_6(spark, sf):
    return grid.explode_neighbors(grid.assign_cell_ids(demo.points(spark, sf)).select("event_id", "cell_id"))


@query(
    "join_7",
    "SELECT cell_id, date + 1 AS date, near::bigint AS fires FROM (SELECT cell_id, date - 1 AS date, near FROM neighbor_flags WHERE near > 0)",
    ("neighbor_flags",),
)
def join_7(spark, sf):
    """Neighbour fires of the day before, grown outward from the ignitions."""
    fires = lb.distinct_ignitions(demo.detections(spark, sf))
    near = grid.explode_neighbors(fires).select(F.col("neighbor_id").alias("cell_id"), F.date_add("date", 1).alias("date"))
    counts = near.groupBy("cell_id", "date").agg(F.count(F.lit(1)).alias("fires"))
    # Kept are the rows of the panel, which has every cell on every date: known cells inside the calendar.
    inside = counts.join(F.broadcast(demo.calendar(spark, sf)), F.col("date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return inside.join(demo.cells(spark, sf).select("cell_id"), "cell_id", "left_semi")


@query(
    "join_8",
    f"""SELECT event_id, cell_id FROM points_in_cells WHERE cell_id IN (SELECT (r + dr) || '_' || (c + dc) FROM
       (SELECT split_part(cell_id, '_', 1)::int AS r, split_part(cell_id, '_', 2)::int AS c FROM points_in_cells WHERE type = 2 AND latitude > 51), {_NEAR} WHERE dr <> 0 OR dc <> 0)""",
    ("points_in_cells",),
)
def join_8(spark, sf):
    """Points beside a northern cell that has a static source."""
    located = grid.assign_cell_ids(demo.points(spark, sf))
    near = grid.explode_neighbors(located.filter("type = 2 AND latitude > 51").select("cell_id").distinct())
    return located.join(near.select(F.col("neighbor_id").alias("cell_id")), "cell_id", "left_semi").select("event_id", "cell_id")


@query(
    "join_9",
    f"SELECT s.row_key, {r('s.score', 'score')}, {r('c.latitude', 'latitude')}, {r('c.longitude', 'longitude')} FROM scores s LEFT JOIN cells c USING (cell_id)",
    ("scores", "cells"),
)
def join_9(spark, sf):
    at = demo.cells(spark, sf).select("cell_id", "latitude", "longitude")
    return rounded(demo.scores(spark, sf).join(at, "cell_id", "left").select("row_key", "score", "latitude", "longitude"))


@query(
    "join_10",
    """SELECT g.cell_id, p.event_id, p.code FROM grid g JOIN polygons p ON p.min_lat <= g.latitude + 25e-5 AND p.max_lat >= g.latitude - 25e-5
       AND p.min_lon <= g.longitude + 25e-5 AND p.max_lon >= g.longitude - 25e-5""",
    ("grid", "polygons"),
)
def join_10(spark, sf):
    hits = terrain.overlap_join(grid.build_grid_cells(spark), demo.polygons(spark, sf))
    return hits.select("cell_id", "event_id", "code")


@query(
    "join_11",
    "SELECT p.event_id, p.cell_id, f.fuel_type_cd FROM points_in_cells p LEFT JOIN fuel f USING (cell_id)",
    ("points_in_cells", "fuel"),
)
def join_11(spark, sf):
    asked = grid.assign_cell_ids(demo.points(spark, sf)).select("event_id", "cell_id")
    return terrain.lookup_codes(asked, demo.fuel(spark, sf))


rel.relation(
    "places",
    "SELECT c_custkey AS place, 5e1 + ((c_custkey * 7919) % 30011) / 30011e0 * 6e-1 AS latitude, -1212e-1 + ((c_custkey * 104729) % 20011) / 20011e0 AS longitude FROM customer",
)
_HAVERSINE = """2 * 6371.0088::double * asin(sqrt(pow(sin(radians(c.latitude - p.latitude) / 2), 2)
    + cos(radians(p.latitude)) * cos(radians(c.latitude)) * pow(sin(radians(c.longitude - p.longitude) / 2), 2)))"""


def places(spark, sf):
    k = F.col("c_custkey")
    return demo.table(spark, sf, "customer").select(
        k.alias("place"),
        (F.lit(50.0) + k * 7919 % 30011 / 30011.0 * 0.6).alias("latitude"),
        (F.lit(-121.2) + k * 104729 % 20011 / 20011.0).alias("longitude"),
    )


@query(
    "join_12",
    f"""SELECT place, cell_id, {r('km', 'distance_km', 5)}, km > sqrt(2) * 2.5 AS out_of_grid FROM (
       SELECT *, row_number() OVER (PARTITION BY place ORDER BY km) AS rn FROM (SELECT p.place, c.cell_id, {_HAVERSINE} AS km FROM places p, cells c)) WHERE rn = 1""",
    ("places", "cells"),
)
def join_12(spark, sf):
    return rounded(grid.nearest_cell(places(spark, sf), demo.cells(spark, sf)), 5)


# --- windows ------------------------------------------------------------------


@query("win_1", "SELECT cell_id, date, pos::int AS position FROM timed", ("timed",))
def win_1(spark, sf):
    return ft.add_row_position(demo.panel(spark, sf)).select("cell_id", "date", "position")


@query("win_2", "SELECT cell_id, date, days_since_rain::int AS days_since_rain FROM timed", ("timed",))
def win_2(spark, sf):
    return ft.add_days_since_rain(demo.weather_panel(spark, sf)).select("cell_id", "date", "days_since_rain")


def _rolled(spark, sf, *names, digits=6):
    frame = ft.add_relative_humidity(demo.weather_panel(spark, sf))
    return rounded(ft.add_rolling_features(frame).select("cell_id", "date", *names), digits)


@query("win_3", f"SELECT cell_id, date, {r('precip_7d', 'precip_7d')}, {r('precip_30d', 'precip_30d')} FROM timed", ("timed",))
def win_3(spark, sf):
    return _rolled(spark, sf, "precip_7d", "precip_30d")


@query("win_4", f"SELECT cell_id, date, {r('t2m_mean_7d', 't2m_mean_7d', 5)}, {r('rh_mean_7d', 'rh_mean_7d', 5)} FROM timed", ("timed",))
def win_4(spark, sf):
    return _rolled(spark, sf, "t2m_mean_7d", "rh_mean_7d", digits=5)


@query("win_5", f"SELECT cell_id, date, {r('t2m_trend_7d', 't2m_trend_7d')} FROM timed", ("timed",))
def win_5(spark, sf):
    return _rolled(spark, sf, "t2m_trend_7d")


@query("win_6", "SELECT * FROM neighbors", ("neighbors",))
def win_6(spark, sf):
    counts = [f"neighbor_fire_count_{n}d" for n in (1, 3, 7)]
    fires = lb.distinct_ignitions(demo.detections(spark, sf))
    return ft.add_neighbor_fire_features(demo.panel(spark, sf), ignitions=fires).select("cell_id", "date", *counts)


@query("win_7", f"SELECT cell_id, date, ignited, {_FORWARD} AS ignited_next_3d FROM panel {_FORWARD_W}", ("panel",))
def win_7(spark, sf):
    return lb.add_forward_label(demo.panel(spark, sf), 3).select("cell_id", "date", "ignited", "ignited_next_3d")


@query(
    "win_10",
    f"""SELECT cell_id, date, {r('seq[1]', 'oldest', 3)}, {r('seq[30]', 'newest', 3)}, len(seq)::int AS steps FROM (
       SELECT cell_id, date, list(t2m::float) OVER w AS seq, lag(date, 29) OVER (PARTITION BY cell_id ORDER BY date) AS start
       FROM weather WHERE precip_mm IS NOT NULL WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE date - start = 29""",
    ("weather",),
)
def win_10(spark, sf):
    """Days without rain data are dropped first, so histories have gaps."""
    gapped = demo.weather_panel(spark, sf).filter("precip_mm IS NOT NULL")
    seq = ft.build_sequences(gapped, ("t2m", "swvl1"), 30)
    return rounded(
        seq.select(
            "cell_id",
            "date",
            F.col("sequence")[0][0].cast("double").alias("oldest"),
            F.col("sequence")[29][0].cast("double").alias("newest"),
            F.size("sequence").alias("steps"),
        ),
        3,
    )


@query("win_12", "SELECT cell_id, date, (date - lo)::int AS day_index, date - 1 AS prior_day FROM panel, calendar", ("panel", "calendar"))
def win_12(spark, sf):
    out = ft.add_date_index(demo.panel(spark, sf))
    return out.select("cell_id", "date", "day_index", F.date_sub("date", 1).alias("prior_day"))


# --- flagship ---------------------------------------------------------------


def ignition_rate_by_neighbors(spark, sf):
    """How does the ignition rate grow with prior-day neighbour fires?"""
    counted = ft.add_neighbor_fire_features(demo.panel(spark, sf), (1,), ignitions=lb.distinct_ignitions(demo.detections(spark, sf)))
    known = counted.filter("neighbor_fire_count_1d IS NOT NULL")
    bucket = F.least(F.col("neighbor_fire_count_1d"), F.lit(3.0)).cast("int")
    return profile.rate_by_bucket(known, bucket)


@query(
    "agg_13",
    f"""SELECT bucket, count(*) AS rows, {r('count(*) / sum(count(*)) OVER ()', 'share')}, {r('avg(ignited)', 'positive_rate')} FROM (
       SELECT least(n.neighbor_fire_count_1d, 3)::int AS bucket, p.ignited FROM neighbors n JOIN panel p USING (cell_id, date) WHERE n.neighbor_fire_count_1d IS NOT NULL) GROUP BY bucket""",
    ("neighbors", "panel"),
)
def agg_13(spark, sf):
    return rounded(ignition_rate_by_neighbors(spark, sf))

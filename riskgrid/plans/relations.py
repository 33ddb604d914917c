"""The demo relations once more, in SQL."""

from riskgrid.functions import geo
from riskgrid.plans.catalog import relation

HEIGHT, WIDTH = geo.cell_size_degrees()

relation(
    "points",
    """SELECT event_id, 498e-1 + (event_id % 1700) / 1e3 AS latitude, -1215e-1 + (event_id % 2500) / 1e3 AS longitude,
       ts::date AS acq_date,
       CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' THEN 3 END AS type
       FROM events""",
)
relation(
    "grid",
    f"""SELECT r || '_' || c AS cell_id, r AS row, c AS col, (r + 0.5::double) * {HEIGHT!r}::double AS latitude, (c + 0.5::double) * {WIDTH!r}::double AS longitude
       FROM (SELECT unnest(range(floor(49.8::double / {HEIGHT!r}::double)::int, floor(51.5::double / {HEIGHT!r}::double)::int + 1)) AS r),
            (SELECT unnest(range(floor(-121.5::double / {WIDTH!r}::double)::int, floor(-119.0::double / {WIDTH!r}::double)::int + 1)) AS c)""",
)
relation(
    "points_in_cells",
    f"""SELECT *, floor(latitude / {HEIGHT!r}::double)::int || '_' || floor(longitude / {WIDTH!r}::double)::int AS cell_id FROM points""",
    "points",
)
relation(
    "cells",
    """SELECT s_suppkey AS k, (s_suppkey // 10)::int AS row, (s_suppkey % 10)::int AS col, (s_suppkey // 10) || '_' || (s_suppkey % 10) AS cell_id,
       5e1 + ((s_suppkey // 10) % 600) * 5e-2 AS latitude, -121e0 + (s_suppkey % 10) * 7e-2 AS longitude, s_nationkey, s_acctbal FROM supplier""",
)
relation(
    "detections",
    """SELECT (l_suppkey // 10) || '_' || (l_suppkey % 10) AS cell_id, l_shipdate::date AS acq_date FROM lineitem WHERE l_quantity >= 48""",
)
relation("calendar", "SELECT min(l_shipdate)::date AS lo, max(l_shipdate)::date AS hi FROM lineitem")
relation(
    "panel",
    """SELECT c.k, c.cell_id, c.latitude, c.row, c.col, c.date, (d.cell_id IS NOT NULL)::int AS ignited
       FROM (SELECT k, cell_id, latitude, row, col, unnest(generate_series(lo::timestamp, hi::timestamp, INTERVAL 1 DAY))::date AS date FROM cells, calendar) c
       LEFT JOIN (SELECT DISTINCT cell_id, acq_date FROM detections) d ON d.cell_id = c.cell_id AND d.acq_date = c.date""",
    "cells",
    "calendar",
    "detections",
)
relation(
    "weather",
    """SELECT *, t2m + CASE WHEN k % 17 = 3 THEN 105e-2 ELSE -5e-2 END - ((k * 5 + d) % 200) / 1e1 AS d2m FROM (
       SELECT p.*, 26315e-2 + ((p.k * 7 + dayofyear(p.date) * 3) % 350) / 1e1 AS t2m,
         ((p.k + p.d * 3) % 21 - 10) / 2e0 AS u10, ((p.k * 3 + p.d) % 17 - 8) / 2e0 AS v10, ((p.k * 13 + p.d) % 100) / 25e1 AS swvl1,
         CASE WHEN (p.k * 31 + p.d) % 997 <> 0 THEN coalesce(r.shipped, 0e0) END AS precip_mm,
         ((p.k * 17 + p.d * 7) % 1000)::double AS cape, ((p.k + p.d) % 13) / 1e1 AS convective_precip_mm
       FROM (SELECT *, date - date '1995-01-01' AS d FROM panel) p
       LEFT JOIN (SELECT l_suppkey AS k, l_shipdate::date AS date, sum(l_quantity) / 1e1 AS shipped FROM lineitem GROUP BY ALL) r
         ON r.k = p.k AND r.date = p.date)""",
    "panel",
)
relation(
    "humid",
    """SELECT *, 100 * exp(17625e-3 * (d2m - 27315e-2) / (24304e-2 + (d2m - 27315e-2))) / exp(17625e-3 * (t2m - 27315e-2) / (24304e-2 + (t2m - 27315e-2))) AS relative_humidity,
       sqrt(u10 * u10 + v10 * v10) AS wind_speed FROM weather""",
    "weather",
)
relation(
    "neighbor_flags",
    """SELECT p.cell_id, p.date, coalesce(sum(q.ignited), 0) AS near
       FROM panel p LEFT JOIN (SELECT * FROM panel WHERE ignited = 1) q
         ON q.date = p.date - 1 AND abs(q.row - p.row) <= 1 AND abs(q.col - p.col) <= 1 AND q.cell_id <> p.cell_id
       GROUP BY ALL""",
    "panel",
)
relation(
    "neighbors",
    "SELECT cell_id, date, "
    + ", ".join(
        f"CASE WHEN row_number() OVER w > {n} THEN sum(near) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END::double AS neighbor_fire_count_{n}d"
        for n in (1, 3, 7)
    )
    + " FROM neighbor_flags WINDOW w AS (PARTITION BY cell_id ORDER BY date)",
    "neighbor_flags",
)


def _rolled(column: str, n: int, how: str) -> str:
    w = f"(PARTITION BY cell_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {w} = {n} THEN {how}({column}) OVER {w} END"


relation(
    "timed",
    f"""SELECT *, pos - last_value(CASE WHEN precip_mm >= 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_rain FROM (
       SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY date) - 1 AS pos,
         {_rolled("precip_mm", 7, "sum")} AS precip_7d, {_rolled("precip_mm", 30, "sum")} AS precip_30d,
         {_rolled("t2m", 7, "avg")} AS t2m_mean_7d, {_rolled("relative_humidity", 7, "avg")} AS rh_mean_7d,
         t2m - lag(t2m, 7) OVER (PARTITION BY cell_id ORDER BY date) AS t2m_trend_7d,
         CASE WHEN wind_speed > 0 THEN u10 / wind_speed ELSE 0 END AS wind_dir_cos, CASE WHEN wind_speed > 0 THEN v10 / wind_speed ELSE 0 END AS wind_dir_sin
       FROM humid)""",
    "humid",
)
relation(
    "features",
    "SELECT t.*, n.neighbor_fire_count_1d, n.neighbor_fire_count_3d, n.neighbor_fire_count_7d FROM timed t JOIN neighbors n USING (cell_id, date)",
    "timed",
    "neighbors",
)
relation(
    "scores",
    """SELECT k * 100000 + d AS row_key, k, cell_id, date, year(date)::int AS year, ignited AS label,
       ((k * 37 + d * 11) % 160 + ignited * ((k + d) % 2) * 40) / 200e0 AS score
       FROM (SELECT *, date - date '1995-01-01' AS d FROM panel)""",
    "panel",
)
relation(
    "readings",
    """SELECT l_shipdate + INTERVAL 6 HOUR * (l_linenumber % 4) AS valid_time, 5e1 + (s_nationkey // 5) * 5e-1 AS latitude, -121e0 + (s_nationkey % 5) * 5e-1 AS longitude,
       l_quantity + 260 AS t2m, 250 + l_discount * 100 AS d2m, l_tax * 100 - 4 AS u10, l_discount * 100 - 5 AS v10, l_discount * 2 AS swvl1,
       l_extendedprice / 1e7 AS tp, l_extendedprice / 100 AS cape, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 1e4 END AS cp
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
relation(
    "fuel_candidates",
    """SELECT (l_suppkey // 10) || '_' || (l_suppkey % 10) AS cell_id, CASE WHEN l_returnflag <> 'N' THEN p_type END AS code
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
relation(
    "fuel",
    """SELECT c.cell_id, coalesce(m.code, 'unknown') AS fuel_type_cd FROM cells c LEFT JOIN (
       SELECT cell_id, code FROM (SELECT cell_id, code, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, code) AS rn
         FROM fuel_candidates WHERE code IS NOT NULL GROUP BY cell_id, code) WHERE rn = 1) m USING (cell_id)""",
    "cells",
    "fuel_candidates",
)
relation("elevations", "SELECT cell_id, row, col, s_acctbal / 4e0 AS elevation_m FROM cells", "cells")
relation(
    "polygons",
    """SELECT p.event_id, latitude - h AS min_lat, latitude + h AS max_lat, longitude - h AS min_lon, longitude + h AS max_lon, code FROM (
       SELECT p.*, (p.event_id % 5 + 1) * 4e-3 AS h, CASE WHEN e.event_type <> 'error' THEN e.event_type END AS code
       FROM points p JOIN events e USING (event_id)) p""",
    "points",
)

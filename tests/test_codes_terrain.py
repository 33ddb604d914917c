import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.functions import codes as C
from riskgrid.operators.codes import compute_codes
from riskgrid.operators import terrain

# Published reference cases of the six formulas.
FFMC = [
    (100.2, 34.8, 55.61, 0, 186.83, 52.87),
    (10.5, 2.4, 55.61, 0, 186.83, 13.87),
    (18.6, 2.4, 55.61, 0, 186.83, 13.87),
    (42.9, 2.4, 55.61, 0, 186.83, 15.01),
    (6.6, 10.5, 55.61, 0, 186.83, 18.81),
    (2.7, 18.6, 55.61, 0, 186.83, 25.44),
]
DMC = [
    (121.8, 18.6, 55.61, -10, -90, 1, 123.7),
    (210.9, 18.6, 55.61, 55.61, -90, 1, 67.97),
    (429.6, 18.6, 55.61, 55.61, -90, 1, 79.58),
    (138, 18.6, 55.61, -10, 55.8, 1, 139.08),
    (8.4, 18.6, 55.61, 55.61, 55.8, 1, 4.272),
    (227.1, 18.6, 55.61, 55.61, 55.8, 1, 68.76),
]
DC = [
    (121.8, 18.6, -10, -90, 1, 128.85),
    (210.9, 18.6, 55.61, -90, 1, 90.79),
    (429.6, 18.6, 55.61, -90, 1, 237.17),
    (138, 18.6, -10, 55.8, 1, 141.05),
    (8.4, 18.6, 55.61, 55.8, 1, 3.052),
    (227.1, 18.6, 55.61, 55.8, 1, 98.51),
]
ISI = [(0.6, 0, 2.986e-09), (85.2, 0, 2.164), (90.6, 0, 4.668), (50.7, 24.3, 0.6057), (10.2, 24.3, 4.946e-06)]
BUI = [(0, 0, 0), (2.7, 0, 1.777), (6.9, 218.7, 12.79), (35.1, 0, 33.97)]
FWI = [(0.5, 218.7, 3.379), (2.3, 218.7, 13.91), (8.6, 218.7, 35.57)]

CASES = [
    (C.ffmc_step, FFMC, (0, 1, 2, 3, 4), dict(abs=0.01)),
    (C.dmc_step, DMC, (0, 1, 2, 3, 4, 5), dict(abs=0.01)),
    (C.dc_step, DC, (0, 1, 2, 3, 4), dict(abs=0.01)),
    (C.initial_spread_index, ISI, (0, 1), dict(rel=0.01)),
    (C.buildup_index, BUI, (0, 1), dict(abs=0.01)),
    (C.fire_weather_index, FWI, (0, 1), dict(abs=0.01)),
]


@pytest.mark.parametrize("formula, rows, inputs, tolerance", CASES, ids=[c[0].__name__ for c in CASES])
def test_published_cases_on_arrays(formula, rows, inputs, tolerance):
    columns = [np.array([r[i] for r in rows], dtype=float) for i in inputs]
    if formula in (C.dmc_step, C.dc_step):
        columns[-1] = columns[-1].astype(int)
    with np.errstate(all="ignore"):
        got = formula(C.ArrayMath, *columns)
    assert list(got) == [pytest.approx(r[-1], **tolerance) for r in rows]


@pytest.mark.parametrize("formula, rows, inputs, tolerance", CASES, ids=[c[0].__name__ for c in CASES])
def test_published_cases_on_columns(spark, formula, rows, inputs, tolerance):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(len(rows[0]))))
    columns = [F.col(f"c{i}") for i in inputs]
    if formula in (C.dmc_step, C.dc_step):
        columns[-1] = columns[-1].cast("int")
    got = [r.v for r in df.select(formula(C.ColumnMath, *columns).alias("v")).collect()]
    assert got == [pytest.approx(r[-1], **tolerance) for r in rows]


def _panel(spark, start, end, **cells):
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    rows = [(c, d, 50.6, *map(float, weather)) for c, weather in cells.items() for d in days]
    return spark.createDataFrame(rows, "cell_id string, date date, latitude double, t2m double, relative_humidity double, wind_speed double, precip_mm double")


MILD = (280.0, 50.0, 3.0, 0.0)


def test_nothing_before_the_first_march(spark):
    rows = compute_codes(_panel(spark, "2020-01-01", "2020-01-10", **{"1_1": MILD})).collect()
    assert all(r[c] is None for r in rows for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi"))


def test_start_up_on_the_first_of_march(spark):
    out = {str(r.date): r for r in compute_codes(_panel(spark, "2019-12-25", "2020-03-05", **{"1_1": MILD})).collect()}
    step = C.ffmc_step(C.ArrayMath, np.array([85.0]), np.array([280 - 273.15]), np.array([50.0]), np.array([10.8]), np.array([0.0]))
    assert out["2020-03-01"].ffmc == pytest.approx(step[0])
    assert out["2020-02-29"].ffmc is None and out["2020-03-05"].dc > out["2020-03-01"].dc


def test_cells_never_mix(spark):
    panel = _panel(spark, "2020-02-15", "2020-03-10", DRY=(305.0, 15.0, 5.0, 0.0), WET=(275.0, 90.0, 1.0, 10.0))
    last = {r.cell_id: r for r in compute_codes(panel).filter("date = '2020-03-10'").collect()}
    assert last["DRY"].ffmc > last["WET"].ffmc + 10 and last["DRY"].dc > last["WET"].dc


def test_latitude_may_come_from_the_cells(spark):
    panel = _panel(spark, "2020-02-28", "2020-03-10", **{"1_1": MILD})
    cells = spark.createDataFrame([("1_1", 50.6)], "cell_id string, latitude double")
    a = compute_codes(panel).select("date", "dmc").orderBy("date").collect()
    b = compute_codes(panel.drop("latitude"), cells).select("date", "dmc").orderBy("date").collect()
    assert a == b


def test_missing_rain_stops_the_slow_codes_until_the_reset(spark):
    panel = _panel(spark, "2020-03-01", "2021-03-02", **{"1_1": MILD})
    panel = panel.withColumn("precip_mm", F.when(F.col("date") != "2020-06-01", F.col("precip_mm")))
    out = {str(r.date): r for r in compute_codes(panel).collect()}
    assert out["2020-05-31"].dmc is not None
    assert out["2020-06-01"].ffmc is not None and out["2020-06-01"].dmc is None and out["2020-06-01"].dc is None
    assert out["2021-02-28"].dc is None and out["2021-03-01"].dc is not None


def _ground(spark, height, skip=()):
    rows = [(f"{r}_{c}", float(height(r, c))) for r in range(3) for c in range(3) if (r, c) not in skip]
    return terrain.slope_aspect(spark.createDataFrame(rows, "cell_id string, elevation_m double")).filter("cell_id = '1_1'").first()


def test_flat_ground(spark):
    got = _ground(spark, lambda r, c: 500)
    assert got.slope_degrees == 0


def test_ground_rising_east_faces_west(spark):
    got = _ground(spark, lambda r, c: 100 * c)
    assert got.slope_degrees == pytest.approx(math.degrees(math.atan(0.02)))
    assert (got.aspect_sin, got.aspect_cos) == (pytest.approx(-1), pytest.approx(0, abs=1e-9))


def test_ground_rising_north_faces_south(spark):
    got = _ground(spark, lambda r, c: 100 * r)
    assert (got.aspect_sin, got.aspect_cos) == (pytest.approx(0, abs=1e-9), pytest.approx(-1))


def test_a_missing_neighbor_counts_as_level(spark):
    got = _ground(spark, lambda r, c: 100 * c, skip={(0, 2), (1, 2), (2, 2)})
    assert got.slope_degrees == pytest.approx(math.degrees(math.atan(0.01)))


def test_most_frequent_code(spark):
    rows = [("a", "S-2"), ("a", "S-2"), ("a", "O-1a"), ("c", None), ("c", "C-5"), ("d", "Z"), ("d", "B"), ("e", None)]
    cells = spark.createDataFrame([(c,) for c in "abcde"], "cell_id string")
    got = {r.cell_id: r.fuel_type_cd for r in terrain.mode_code(spark.createDataFrame(rows, "cell_id string, code string"), cells).collect()}
    assert got == {"a": "S-2", "b": "unknown", "c": "C-5", "d": "B", "e": "unknown"}


def test_one_hot_of_present_codes(spark):
    fuel = spark.createDataFrame([("a", "C-3"), ("b", "O-1a"), ("c", "C-3")], "cell_id string, fuel_type_cd string")
    out = terrain.one_hot_present(fuel)
    assert out.columns == ["cell_id", "fuel_type_C-3", "fuel_type_O-1a"]
    assert [tuple(r[1:]) for r in out.orderBy("cell_id").collect()] == [(1.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_one_hot_of_fixed_codes(spark):
    fuel = spark.createDataFrame([("a", "D-1/D-2"), ("b", "X"), ("c", None)], "cell_id string, fuel_type_cd string")
    out = terrain.one_hot_fixed(fuel, ("fuel_type_C-3", "fuel_type_D-1/D-2"))
    assert [tuple(r[2:]) for r in out.orderBy("cell_id").collect()] == [(0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_overlaps_are_found_once(spark):
    cells = spark.createDataFrame([("a", 50.0, -120.0), ("b", 50.25, -120.25), ("c", 10.0, 10.0)], "cell_id string, latitude double, longitude double")
    boxes = [("big", 49.0, 51.0, -121.0, -119.0), ("touch", 50.00025, 50.1, -120.1, -120.0), ("off", 50.001, 50.1, -120.1, -120.0)]
    polygons = spark.createDataFrame(boxes, "code string, min_lat double, max_lat double, min_lon double, max_lon double")
    got = sorted((r.cell_id, r.code) for r in terrain.overlap_join(cells, polygons).collect())
    assert got == [("a", "big"), ("a", "touch"), ("b", "big")]


def test_codes_do_not_depend_on_how_rows_are_held_together(spark, monkeypatch):
    """Few rows at a time, rows in any order, cells without an id, and a filter above: the same codes."""
    from riskgrid.operators import codes as module

    panel = _panel(spark, "2019-02-20", "2020-03-10", **{f"{k}_1": MILD for k in range(7)}).unionByName(
        _panel(spark, "2019-02-20", "2020-03-10", **{"x": MILD}).withColumn("cell_id", F.lit(None).cast("string"))
    )
    want = {(r.cell_id, r.date): (r.ffmc, r.dmc, r.fwi) for r in compute_codes(panel.orderBy(F.rand(3))).collect()}
    whole = compute_codes(panel).filter("date >= '2020-03-01'").collect()
    assert len(want) == panel.count() and len(whole) == 8 * 10
    assert all(want[r.cell_id, r.date] == (r.ffmc, r.dmc, r.fwi) for r in whole)
    assert all((v[0] is None) == (str(k[1]) < "2019-03-01") for k, v in want.items())

    def few():
        rows = panel.orderBy("cell_id", "date").toArrow().combine_chunks()
        season = [d.year - (d.month < 3) for d in rows["date"].to_pylist()]
        import datetime as dt

        import pyarrow as pa

        days = [(d - dt.date(s, 3, 1)).days for d, s in zip(rows["date"].to_pylist(), season)]
        columns = [rows["cell_id"].combine_chunks(), pa.array(season), pa.array(days), pa.array([d.month for d in rows["date"].to_pylist()])]
        columns += [pa.array([50.0] * len(rows))] + [pa.array([v] * len(rows)) for v in (20.0, 40.0, 10.0, 0.0)]
        return [tuple(c.slice(i, 100) for c in columns) for i in range(0, len(rows), 100)]

    at_once = [x for part in module._step_in_order(iter(few())) for x in part.to_pylist()]
    monkeypatch.setattr(module, "ROWS_TOGETHER", 150)
    by_cell = [x for part in module._step_in_order(iter(few())) for x in part.to_pylist()]
    assert at_once == by_cell and len(by_cell) == panel.count()

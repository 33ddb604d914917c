import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.operators import features as ft
from riskgrid.operators import weather as wx
from riskgrid.sources.readings import merge_readings, nan_to_null


def _readings(spark, days, names, steps):
    start, rows = dt.datetime(2021, 6, 1), []
    for i in range(days * 4):
        rows.append((start + dt.timedelta(hours=6 * i), 50.0, -120.0, *[float(s[i % len(s)]) for s in steps]))
    columns = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"valid_time timestamp, latitude double, longitude double, {columns}")


TP = [0, 0.001, 0.002, 0.003, 0.005, 0.001, 0.002, 0.004, 0.010, 0.001, 0.002, 0.003]


def test_daily_rain_is_the_next_midnight_value(spark, day):
    names = ["t2m", "d2m", "u10", "v10", "swvl1", "tp"]
    readings = _readings(spark, 3, names, [[290], [280], [1], [1], [0.2], TP])
    rows = wx.daily_land_weather(readings).orderBy("date").collect()
    assert [r.precip_mm for r in rows] == [pytest.approx(5.0), pytest.approx(10.0), None]
    assert {r.t2m for r in rows} == {290.0}
    shifted = {r.date: r.precip_mm for r in wx.daily_precip_from_cumulative(readings).collect()}
    assert shifted[day("2021-05-31")] == 0 and shifted[day("2021-06-02")] == pytest.approx(10.0)


def test_daily_means_skip_missing(spark):
    readings = _readings(spark, 1, ["t2m"], [[280, 290, math.nan, 300]])
    assert wx.daily_means(nan_to_null(readings), ("t2m",)).first().t2m == pytest.approx(290)


def test_convective_maximum_and_total(spark):
    cape, cp = [100, 400, 900, 200, 50, 50, 50, 50], [0.0001, 0.0002, 0.0003, 0.0001, 0, 0, 0, 0]
    rows = wx.daily_convective(_readings(spark, 2, ["cape", "cp"], [cape, cp])).orderBy("date").collect()
    assert [(r.cape, round(r.convective_precip_mm, 9)) for r in rows] == [(900, 0.7), (50, 0.0)]


def test_convective_total_of_missing_is_zero(spark):
    readings = _readings(spark, 1, ["cape"], [[1]]).withColumn("cp", F.lit(None).cast("double"))
    assert wx.daily_convective(readings).first().convective_precip_mm == 0


def test_weather_joins_through_the_nearest_point(spark, day):
    cells = spark.createDataFrame([("a", 50.05, -120.05), ("b", 50.95, -120.95)], "cell_id string, latitude double, longitude double")
    d = day("2021-06-01")
    daily = spark.createDataFrame([(50.0, -120.0, d, 290.0, 1.5), (51.0, -121.0, d, 280.0, 0.0)], "latitude double, longitude double, date date, t2m double, precip_mm double")
    panel = spark.createDataFrame([("a", d), ("b", d), ("a", day("2021-06-02"))], "cell_id string, date date")
    rows = {(r.cell_id, r.date): r.t2m for r in wx.join_weather(panel, cells, daily).collect()}
    assert rows == {("a", d): 290.0, ("b", d): 280.0, ("a", day("2021-06-02")): None}


def test_merge_prefers_the_first_table(spark):
    key = "valid_time timestamp, latitude double, longitude double"
    t = dt.datetime(2021, 6, 1)
    a = spark.createDataFrame([(t, 50.0, -120.0, 1.0, None), (t, 51.0, -120.0, 2.0, 5.0)], f"{key}, x double, y double")
    b = spark.createDataFrame([(t, 50.0, -120.0, 9.0, 7.0), (t, 52.0, -120.0, 9.0, 8.0)], f"{key}, y double, z double")
    rows = {r.latitude: (r.x, r.y, r.z) for r in merge_readings(a, b).collect()}
    assert rows == {50.0: (1.0, 9.0, 7.0), 51.0: (2.0, 5.0, None), 52.0: (None, 9.0, 8.0)}


def test_humidity(spark):
    df = spark.createDataFrame([(290.0, 290.0), (290.0, 270.0)], "t2m double, d2m double")
    got = [r.relative_humidity for r in ft.add_relative_humidity(df).collect()]
    assert got[0] == pytest.approx(100.0) and got[1] < 100


def test_wind(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0), (None, 1.0)], "u10 double, v10 double")
    got = [(r.wind_speed, r.wind_dir_cos, r.wind_dir_sin) for r in ft.add_wind_features(df).collect()]
    assert got == [(5.0, 0.6, 0.8), (0.0, 0.0, 0.0), (None, 0.0, 0.0)]


def _series(spark, column, **cells):
    rows = [(c, dt.date(2021, 6, 1) + dt.timedelta(days=i), None if v is None else float(v)) for c, vs in cells.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"cell_id string, date date, {column} double")


def _by_cell(df, column):
    out = {}
    for r in df.orderBy("cell_id", "date").collect():
        out.setdefault(r.cell_id, []).append(r[column])
    return out


def test_days_since_rain(spark):
    df = _series(spark, "precip_mm", a=[0, 5, 0, 0, 0], b=[0, 0], c=[1, 0.99, None, 2])
    got = _by_cell(ft.add_days_since_rain(df), "days_since_rain")
    assert got == {"a": [None, 0, 1, 2, 3], "b": [None, None], "c": [0, 1, 2, 0]}


def test_rolling_needs_full_windows(spark):
    df = _series(spark, "precip_mm", a=[1] * 8).withColumns({"t2m": F.lit(290.0), "relative_humidity": F.lit(50.0)})
    out = ft.add_rolling_features(df)
    assert _by_cell(out, "precip_7d")["a"] == [None] * 6 + [7.0, 7.0]
    assert _by_cell(out, "t2m_mean_7d")["a"] == [None] * 6 + [290.0, 290.0]
    assert _by_cell(out, "t2m_trend_7d")["a"] == [None] * 7 + [0.0]
    assert _by_cell(out, "precip_30d")["a"] == [None] * 8


def test_rolling_with_a_missing_value(spark):
    df = _series(spark, "precip_mm", a=[1, None, *[1] * 8]).withColumns({"t2m": F.lit(1.0), "relative_humidity": F.lit(1.0)})
    assert _by_cell(ft.add_rolling_features(df), "precip_7d")["a"] == [None] * 8 + [7.0, 7.0]


def _neighbor_panel(spark):
    cells = [f"{r}_{c}" for r in range(3) for c in range(3)] + ["5_5"]
    rows = [(c, dt.date(2021, 6, 1 + i), int(i == 1 and c in ("0_0", "5_5"))) for c in cells for i in range(4)]
    return spark.createDataFrame(rows, "cell_id string, date date, ignited int")


def test_neighbor_counts_exclude_the_same_day_and_the_cell_itself(spark):
    got = _by_cell(ft.add_neighbor_fire_features(_neighbor_panel(spark), (1, 3)), "neighbor_fire_count_1d")
    assert got["1_1"] == [None, 0, 1, 0]
    assert got["2_2"] == [None, 0, 0, 0]
    assert got["5_5"] == [None, 0, 0, 0]
    assert got["0_0"] == [None, 0, 0, 0]


def test_neighbor_counts_add_up_over_days(spark):
    rows = [(c, dt.date(2021, 6, 1 + i), int(c == "0_0" and i < 3)) for c in ("0_0", "0_1") for i in range(9)]
    df = spark.createDataFrame(rows, "cell_id string, date date, ignited int")
    out = ft.add_neighbor_fire_features(df)
    assert _by_cell(out, "neighbor_fire_count_3d")["0_1"] == [None, None, None, 3, 2, 1, 0, 0, 0]
    assert _by_cell(out, "neighbor_fire_count_7d")["0_1"] == [None] * 7 + [3, 2]
    assert out.count() == df.count()


def test_given_ignitions_change_nothing(spark):
    panel = _neighbor_panel(spark)
    fires = panel.filter("ignited = 1").select("cell_id", "date")
    a = ft.add_neighbor_fire_features(panel).collect()
    b = ft.add_neighbor_fire_features(panel, ignitions=fires.unionByName(fires)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_complete_rows_of_a_single_cell(spark):
    rows = [("0_0", dt.date(2021, 6, 1) + dt.timedelta(days=i), 290.0, 280.0, 1.0, 1.0, 2.0 if i % 10 == 0 else 0.0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "cell_id string, date date, t2m double, d2m double, u10 double, v10 double, precip_mm double, ignited int")
    out = ft.engineer_features(df)
    made = [c for c in K.COMPLETE_COLUMNS if c in out.columns]
    assert ft.drop_incomplete_history(out, made).count() == 40 - 29


def test_incomplete_rows_go(spark):
    values = {c: 1.0 for c in K.COMPLETE_COLUMNS}
    df = spark.createDataFrame([tuple(values.values()), tuple({**values, "cape": None}.values())], ", ".join(f"{c} double" for c in values))
    assert ft.drop_incomplete_history(df).count() == 1


def test_feature_chain_shuffles_the_panel_once(spark):
    rows = [("0_0", dt.date(2021, 6, 1), 290.0, 280.0, 1.0, 1.0, 2.0, 0)]
    df = spark.createDataFrame(rows, "cell_id string, date date, t2m double, d2m double, u10 double, v10 double, precip_mm double, ignited int")
    fires = df.select("cell_id", "date")
    plan = ft.engineer_features(df, ignitions=fires)._jdf.queryExecution().executedPlan().toString()
    by_cell = [line for line in plan.splitlines() if "Exchange hashpartitioning(cell_id" in line and "date" not in line]
    assert len(by_cell) == 1


def test_sequences_need_gapless_history(spark):
    rows = [("A", dt.date(2021, 6, i), float(i)) for i in range(1, 6)] + [("B", dt.date(2021, 6, i), 10.0 * i) for i in range(1, 6)]
    rows += [("C", dt.date(2021, 6, i), float(i)) for i in (1, 2, 3, 5, 6)] + [("D", dt.date(2021, 6, 1), 1.0)]
    df = spark.createDataFrame(rows, "cell_id string, date date, x double")
    got = {}
    for r in ft.build_sequences(df, ("x",), 3).orderBy("cell_id", "date").collect():
        got.setdefault(r.cell_id, []).append([step[0] for step in r.sequence])
    assert got == {
        "A": [[1, 2, 3], [2, 3, 4], [3, 4, 5]],
        "B": [[10, 20, 30], [20, 30, 40], [30, 40, 50]],
        "C": [[1, 2, 3]],
    }


def test_rows_that_lie_in_order_give_what_windows_give(spark):
    """Batches end inside cells; some values are missing, one cell has no id and one is short."""
    rows = spark.range(4000).select(
        F.when(F.col("id") < 3000, F.concat(F.lit("c"), F.floor(F.col("id") / 90).cast("string"))).when(F.col("id") < 3003, F.lit("short")).alias("cell_id"),
        F.expr("date_add(date'2020-01-01', cast(id AS int))").alias("date"),
        F.when(F.col("id") % 41 != 5, F.when(F.col("id") % 17 == 3, F.col("id") % 7 + 0.1).otherwise(F.col("id") % 3 / 10.0)).alias("precip_mm"),
        F.when(F.col("id") % 83 != 7, 280 + F.sin(F.col("id") * 1.7) * 9).alias("t2m"),
        (50 + F.cos(F.col("id") * 0.3) * 40).alias("relative_humidity"),
    )
    wanted = rows.transform(ft.add_days_since_rain).transform(ft.add_rolling_features)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        laid = rows.repartition(3, "cell_id").sortWithinPartitions("cell_id", "date")
        found = laid.transform(ft.add_days_since_rain, arranged=True).transform(ft.add_rolling_features, arranged=True)
        assert found.dtypes == wanted.dtypes
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        found, wanted = ({r.date: r for r in df.collect()} for df in (found, wanted))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == wanted and len(found) == 4000
    assert len({r.days_since_rain for r in found.values()}) > 10 and any(r.precip_30d is None for r in found.values())


def test_histories_cut_from_runs_are_those_of_the_windows(spark, day):
    """Written one by one, histories took `length` times the room of their rows."""
    days = [f"2021-06-{d:02d}" for d in range(1, 13) if d != 6]
    rows = [(c, day(d), float(i), None if i == 3 else i * 2.0, i % 2) for c in ("1_1", "1_2", None) for i, d in enumerate(days) if (c, i) != ("1_2", 9)]
    df = spark.createDataFrame(rows, "cell_id string, date date, t2m double, precip_mm double, ignited int").repartition(3)
    windows, runs = (ft.build_sequences(df, ("t2m", "precip_mm"), 3, by_run=by_run) for by_run in (False, True))
    assert runs.schema.simpleString() == windows.schema.simpleString()
    key = lambda r: str((r.cell_id, r.date))
    assert sorted(runs.collect(), key=key) == sorted(windows.collect(), key=key)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and runs.count() > 0

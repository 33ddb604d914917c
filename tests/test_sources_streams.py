import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskgrid.operators import features as ft
from riskgrid.operators.codes import compute_codes
from riskgrid.sources import detections as src
from riskgrid.sources import readings as rd
from riskgrid.streaming import detections as st
from riskgrid.streaming.codes import INPUT, stateful_codes


def _detections(spark, *dates):
    return spark.createDataFrame([(50.5, -120.0, dt.date.fromisoformat(d), 0) for d in dates], "latitude double, longitude double, acq_date date, type int")


def test_append_resumes_after_the_last_day(spark, tmp_path):
    target = str(tmp_path / "archive")
    source = _detections(spark, "2021-05-31", "2021-06-01", "2021-06-02", "2021-06-03", "2021-06-03")
    src.append_new(spark, source.filter("acq_date < '2021-06-03'"), target, "2021-06-01", "2021-06-30")
    for _ in range(2):  # the second run finds nothing new
        table = src.append_new(spark, source, target, "2021-06-01", "2021-06-30")
    assert sorted(str(r.acq_date) for r in table.collect()) == ["2021-06-01", "2021-06-02", "2021-06-03", "2021-06-03"]


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_landed_files_are_filtered(spark, tmp_path, file_format):
    path = str(tmp_path / "landed")
    far = _detections(spark, "2021-06-02").withColumn("latitude", F.lit(10.0))
    _detections(spark, "2021-06-01", "2021-06-02").unionByName(far).write.option("header", True).format(file_format).save(path)
    got = src.read_detections(spark, path, "2021-06-02", "2021-06-03", file_format=file_format)
    assert [str(r.acq_date) for r in got.collect()] == ["2021-06-02"]


def test_predicates_reach_the_file_reader(spark, tmp_path):
    path = str(tmp_path / "landed")
    _detections(spark, "2021-06-01").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = src.read_detections(spark, path, "2021-06-02", "2021-06-03")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(acq_date" in plan and "GreaterThanOrEqual(latitude" in plan


def test_missing_months(spark):
    df = spark.createDataFrame([("2021-01-15",), ("2021-03-01",)], "d string").selectExpr("to_date(d) AS date")
    got = sorted((r.year, r.month) for r in src.missing_months(df, "2020-12-20", "2021-04-02").collect())
    assert got == [(2020, 12), (2021, 2), (2021, 4)]


def test_static_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "deep" / "table")
    assert rd.load_or_build(spark, path, build).count() == rd.load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_feed_is_renamed_and_spans_the_lookback(spark):
    days = [(str(dt.date(2024, 5, 1) + dt.timedelta(days=i)), None if i == 60 else 10.0, 50.0, 0.0, 0.2, 3.0) for i in range(90)]
    feed = spark.createDataFrame(
        days,
        "time string, temperature_2m_mean double, relative_humidity_2m_mean double, precipitation_sum double, soil_moisture_0_to_7cm_mean double, wind_speed_10m_mean double",
    )
    out = rd.recent_weather(feed, "2024-07-01").orderBy("date").collect()
    assert len(out) == 46 and str(out[0].date) == "2024-05-17"
    assert out[0].t2m == pytest.approx(283.15) and [str(r.date) for r in out if r.t2m is None] == ["2024-06-30"]


def test_pruned_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).selectExpr("id", "id AS `fuel_type_M-1/M-2 (20 PC)`", "id AS other").write.parquet(path)
    df = rd.read_columns(spark, path, ["id", "fuel_type_M-1/M-2 (20 PC)"])
    assert "other" not in df._jdf.queryExecution().executedPlan().toString()


# --- streams ----------------------------------------------------------------

POINT = "latitude double, longitude double, ts timestamp"


def _stream(spark, path, *batches, schema=POINT):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(tmp_path, stream, mode="append"):
    return st.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), mode)


def _at(hour, day=1, lat=50.5):
    return (lat, -120.0, dt.datetime(2024, 7, day, hour))


def test_one_record_per_cell_and_day(spark, tmp_path):
    stream = _stream(spark, str(tmp_path / "in"), [_at(1), _at(2), _at(3, lat=50.9)], [_at(5), _at(1, day=2)])
    out = _run(tmp_path, st.ignition_days(stream)).collect()
    assert len(out) == 3


def test_stream_counts_equal_the_batch_counts(spark, tmp_path):
    rows = [_at(h, day=d, lat=50.5 + 0.045 * (d % 3)) for d in (1, 2, 3, 5, 8) for h in (1, 1, 13)]
    late_end = [(10.0, 10.0, dt.datetime(2024, 8, 20))]  # moves the watermark past every window
    stream = _stream(spark, str(tmp_path / "in"), rows, late_end)
    got = _run(tmp_path, st.sliding_neighbor_counts(stream)).filter("date < '2024-08-01'")
    located = st.assign_cell_ids(spark.createDataFrame(rows, POINT)).select("cell_id", F.to_date("ts").alias("date"))
    want = ft.neighbor_counts(located)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_records_count_until_the_watermark_passes(spark, tmp_path):
    cell = lambda df: {str(r.date): r.detections for r in df.collect()}
    stream = _stream(
        spark, str(tmp_path / "in"), [_at(1, day=1), _at(1, day=9), _at(12, day=10)], [_at(13, day=10)], [_at(2, day=1), _at(2, day=9)], [_at(14, day=10)]
    )
    versions = _run(tmp_path, st.daily_counts(stream), "update")
    last = versions.groupBy("date").agg(F.max_by("detections", "batch").alias("detections"))
    assert cell(last) == {"2024-07-01": 1, "2024-07-09": 2, "2024-07-10": 3}


def test_daily_weather_stream(spark, tmp_path):
    schema = "valid_time timestamp, latitude double, longitude double, t2m double, cape double, cp double"
    rows = [(dt.datetime(2024, 7, d, h), 50.0, -120.0, 280.0 + h, 100.0 * h, 0.001) for d in (1, 2) for h in (0, 6, 12)]
    end = [(dt.datetime(2024, 7, 9), 50.0, -120.0, 1.0, 1.0, None)]
    out = _run(tmp_path, st.daily_weather(_stream(spark, str(tmp_path / "in"), rows, end, schema=schema))).orderBy("date").collect()
    assert [(str(r.date), r.t2m, r.cape, round(r.convective_precip_mm, 6), r.readings) for r in out] == [
        ("2024-07-01", 286.0, 1200.0, 3.0, 3),
        ("2024-07-02", 286.0, 1200.0, 3.0, 3),
    ]


def test_stateful_codes_equal_the_batch_codes(spark, tmp_path):
    days = [dt.date(2020, 2, 20) + dt.timedelta(days=i) for i in range(40)]
    rows = [(f"{c}_0", d, 50.0, 5.0 + i % 9 + c, 60.0 - i % 30, 10.0, float(i % 5)) for c in range(3) for i, d in enumerate(days)]
    schema = "cell_id string, date date, latitude double, temp_c double, rh double, wind_kmh double, rain double"
    frame = spark.createDataFrame(rows, schema)
    assert frame.columns == INPUT
    stream = _stream(spark, str(tmp_path / "in"), [r for r in rows if r[1] < days[20]], [r for r in rows if r[1] >= days[20]], schema=schema)
    got = {(r.cell_id, r.date): (r.ffmc, r.dmc, r.dc) for r in _run(tmp_path, stateful_codes(stream)).collect()}
    batch = compute_codes(
        frame.selectExpr("cell_id", "date", "latitude", "temp_c + 273.15 AS t2m", "rh AS relative_humidity", "wind_kmh / 3.6 AS wind_speed", "rain AS precip_mm")
    )
    for r in batch.collect():
        want = (r.ffmc, r.dmc, r.dc)
        assert got[(r.cell_id, r.date)] == ((None,) * 3 if r.ffmc is None else pytest.approx(want))


def test_streamed_rows_are_exchanged_packed(spark):
    """Each row was exchanged by itself, and the landed rows a second time."""
    import numpy as np
    import pyarrow as pa

    from riskgrid.streaming import codes

    rng = np.random.default_rng(1)
    days, cells, values = rng.integers(-400, 20_000, 5000), rng.integers(0, 9, 5000), rng.random((5, 5000)).round(1)
    values[2, 7] = np.nan
    packed = codes.pack(days, cells, values)
    for a, b in zip(codes.unpack(packed), (days, cells, values)):
        np.testing.assert_array_equal(a, b)
    assert len(packed) < (values.nbytes + 8 * len(days)) / 3
    rows = [("a", "0_0", dt.date(2020, 1, 1), 1.0), ("b", "9_9", dt.date(2020, 1, 2), None), ("a", "0_1", None, 2.0), ("a", "0_0", dt.date(2020, 1, 3), 3.0)]
    batch = pa.RecordBatch.from_pylist([dict(zip(["tile", "cell_id", "date"], r)) | dict.fromkeys(codes.VALUES, r[3]) for r in rows], pa.schema([("tile", pa.string()), ("cell_id", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in codes.VALUES]]))
    found = {r["tile"]: r for r in next(codes._packed(iter([batch]))).to_pylist()}
    assert {t: r["cells"] for t, r in found.items()} == {"a": ["0_0"], "b": ["9_9"]}
    assert codes.unpack(found["a"]["packed"])[2].tolist() == [[1.0, 3.0]] * 5 and np.isnan(codes.unpack(found["b"]["packed"])[2]).all()


def test_the_code_stream_exchanges_packed_rows_only(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from riskgrid.plans import q_models

    def refuse(*args):
        raise AssertionError("rows are exchanged for landing")

    streams = []
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a, f=DataFrame.repartition: refuse() if "temp_c" in self.columns else f(self, *a))
    monkeypatch.setattr(q_models, "_run", lambda stream: streams.append(stream) or spark.createDataFrame([], stream.schema))
    q_models.str_5(spark, "/root/testdata/sf0.001")
    plan = streams[0]._jdf.queryExecution().analyzed().toString()
    assert "packed" in plan

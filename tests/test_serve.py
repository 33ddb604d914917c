import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskgrid.learn import models
from riskgrid.learn.bundle import Bundle
from riskgrid.operators import grid
from riskgrid.plans import serve

TARGET = dt.date(2024, 7, 15)
FEED = "cell_id string, date date, t2m double, relative_humidity double, precip_mm double, swvl1 double, wind_speed double"


def _history(cell, rain_on=0, days=46, last=TARGET):
    return [
        (cell, last - dt.timedelta(days=days - 1 - i), 290.0 + i * 0.1, 40.0, 5.0 if i == rain_on else 0.0, 0.2, 3.0) for i in range(days)
    ]


def _asked(spark, *pairs):
    return spark.createDataFrame(pairs, "cell_id string, date date")


def test_full_history_gives_a_full_row(spark):
    r = serve.live_feature_rows(_asked(spark, ("1_1", TARGET)), spark.createDataFrame(_history("1_1", rain_on=40), FEED)).first()
    assert (r.weather_status, r.missing, r.days_since_rain) == ("ok", [], 5)
    assert r.precip_7d == 5.0 and r.t2m_trend_7d == pytest.approx(0.7)


def test_no_rain_in_the_lookback_is_insufficient(spark):
    r = serve.live_feature_rows(_asked(spark, ("1_1", TARGET)), spark.createDataFrame(_history("1_1", rain_on=None), FEED)).first()
    assert (r.weather_status, r.missing) == ("insufficient_history", ["days_since_rain"])


def test_rain_before_the_lookback_does_not_count(spark):
    rows = _history("1_1", rain_on=None) + [("1_1", TARGET - dt.timedelta(days=46), 290.0, 40.0, 9.0, 0.2, 3.0)]
    r = serve.live_feature_rows(_asked(spark, ("1_1", TARGET)), spark.createDataFrame(rows, FEED)).first()
    assert r.weather_status == "insufficient_history"


def test_a_day_without_data_is_no_row(spark):
    feed = spark.createDataFrame(_history("1_1", last=TARGET - dt.timedelta(days=1)), FEED)
    assert serve.live_feature_rows(_asked(spark, ("1_1", TARGET)), feed).first().weather_status == "no_row"


def _at(row, col, date):
    height, width = 5.0 / 111.0, grid.geo.cell_size_degrees()[1]
    return ((row + 0.5) * height, (col + 0.5) * width, date)


def _counts(spark, *detections):
    points = spark.createDataFrame(detections, "latitude double, longitude double, acq_date date")
    return serve.live_neighbor_counts(_asked(spark, ("1105_-1677", TARGET)), points).first()[2:]


def test_live_neighbor_days(spark):
    d = lambda n: TARGET - dt.timedelta(days=n)
    assert _counts(spark, _at(1105, -1676, d(1)), _at(1104, -1677, d(5)), _at(1200, -1677, d(1)), _at(1105, -1677, d(1))) == (1, 1, 2)
    assert _counts(spark, _at(1105, -1676, d(0)), _at(1105, -1676, d(8))) == (0, 0, 0)
    assert _counts(spark, *[_at(1105, -1676, d(2))] * 3) == (0, 1, 1)
    assert _counts(spark, _at(1105, -1676, d(1)), _at(1105, -1676, d(2))) == (1, 2, 2)


@pytest.fixture(scope="module")
def bundle(spark):
    rows = [(float(280 + i % 20), float(i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "t2m double, neighbor_fire_count_7d double, ignited int")
    inputs = ["t2m", "neighbor_fire_count_7d"]
    return Bundle(models.fit_forest(df, inputs, n_estimators=2, max_depth=2), inputs)


@pytest.fixture(scope="module")
def answered(spark):
    cells = spark.createDataFrame([("1105_-1677", 49.8, -120.0), ("1_1", 50.0, -121.0)], "cell_id string, latitude double, longitude double")
    requests = spark.createDataFrame(
        [
            (1, "1105_-1677", TARGET),
            (2, "nowhere", TARGET),
            (3, "1_1", dt.date(2024, 8, 1)),
            (4, "1_1", dt.date(2024, 1, 10)),
            (5, "1_1", TARGET),
            (6, "1105_-1677", None),
            (7, "1105_-1677", TARGET),
            (8, "1105_-1677", dt.date(2024, 6, 20)),
        ],
        "request_id bigint, cell_id string, date date",
    )
    feed = spark.createDataFrame(_history("1105_-1677", rain_on=44), FEED)
    fires = spark.createDataFrame([_at(1105, -1676, TARGET - dt.timedelta(days=1))], "latitude double, longitude double, acq_date date")
    fuel = spark.createDataFrame([("1105_-1677", "C-3")], "cell_id string, fuel_type_cd string")
    return serve.request_features(requests, str(TARGET), cells, feed, fires, fuel, ("fuel_type_C-3", "fuel_type_S-2")).cache()


def test_every_request_gets_its_status(answered):
    got = {r.request_id: r.status for r in answered.collect()}
    assert got == {1: "ok", 2: "unknown_cell", 3: "future_date", 4: "off_season", 5: "no_row", 6: "ok", 7: "ok", 8: "insufficient_history"}


def test_only_good_requests_are_scored(answered, bundle):
    rows = {r.request_id: r for r in serve.score_requests(answered, bundle).collect()}
    assert len(rows) == 8
    assert {k for k, r in rows.items() if r.ignition_probability is not None} == {1, 6, 7}
    assert rows[1].ignition_probability == rows[7].ignition_probability
    several = serve.score_requests(answered, bundle, window_days=3)
    assert "calibrated_probability" not in several.columns and several.first().window_days == 3


def test_features_of_a_request(answered):
    r = answered.filter("request_id = 1").first()
    assert (r.neighbor_fire_count_1d, r.neighbor_fire_count_7d, r["fuel_type_C-3"], r["fuel_type_S-2"]) == (1.0, 1.0, 1.0, 0.0)


def test_explanations_are_sorted_and_bounded(spark, answered, bundle):
    background = spark.createDataFrame([(285.0, 0.0), (290.0, 1.0)], "t2m double, neighbor_fire_count_7d double")
    rows = serve.explain_requests(answered, bundle, background, 1).collect()
    assert {(r.request_id, r["rank"]) for r in rows} == {(1, 1), (6, 1), (7, 1)}
    for wrong in (0, 41):
        with pytest.raises(ValueError):
            serve.explain_requests(answered, bundle, background, wrong)


def test_vectors_are_checked(spark, bundle):
    df = spark.createDataFrame([(1, 280.0, 0.0), (2, None, 0.0)], "id int, t2m double, neighbor_fire_count_7d double")
    scored, rejected = serve.score_vectors(df, bundle)
    assert [r.id for r in scored.collect()] == [1] and [r.id for r in rejected.collect()] == [2]
    with pytest.raises(ValueError):
        serve.check_vector(df.withColumn("t2m", F.lit("warm")), bundle.feature_columns)
    with pytest.raises(ValueError):
        serve.check_vector(df.drop("t2m"), bundle.feature_columns)


def test_risk_map(spark, bundle, day):
    rows = [(c, day("2021-08-04"), 290.0, 1.0, i) for i, c in enumerate(("1124_-1696", "1125_-1696"))]
    data = spark.createDataFrame(rows, "cell_id string, date date, t2m double, neighbor_fire_count_7d double, ignited int")
    dates = spark.createDataFrame([(day(d),) for d in ("2021-08-04", "2021-08-05", "2021-12-01")], "date date")
    out = serve.risk_map(dates, data, grid.build_grid_cells(spark), bundle).collect()
    assert sorted((str(r.date), r.status) for r in out) == [
        ("2021-08-04", "ok"), ("2021-08-04", "ok"), ("2021-08-05", "no_data"), ("2021-12-01", "off_season")
    ]
    ok = [r for r in out if r.status == "ok"]
    assert {r.actual_ignited for r in ok} == {0, 1} and all(r.latitude and r.calibrated_risk_probability is None for r in ok)

"""Rows without score or group, twin centroids, the antimeridian, unreadable targets, resumed backtests, many buckets."""

import pytest
from pyspark.sql import functions as F

from riskgrid.learn import export, models
from riskgrid.operators import calibrate, grid, metrics, ranking
from riskgrid.operators import explain as xai
from riskgrid.session import clear_scratch, materialize
from riskgrid.sources.detections import read_or_none
from riskgrid.sources.readings import load_or_build

SCORES = [(1, "a", 0.9, 1), (2, "a", 0.1, 0), (3, "b", None, 1), (4, None, 0.8, 0), (5, None, 0.2, 1), (6, "a", None, 0)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "row_key long, g string, score double, label int")


def test_every_row_keeps_its_place(scores, spark):
    got = {r.row_key: r.in_top for r in ranking.top_k_flag(scores, by=["g"], fraction=0.5).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    none = scores.withColumn("score", F.lit(None).cast("double"))
    assert [r.in_top for r in ranking.top_k_flag(none).collect()] == [False] * 6


def test_null_scores_count_nowhere(scores):
    bins = calibrate.reliability_table(scores, 2).collect()
    assert sum(r["count"] for r in bins) == 4
    assert calibrate.score_counts(scores).agg(F.sum("n")).first()[0] == 4
    found = metrics.brier(scores).first()
    assert found.brier == pytest.approx((0.01 + 0.01 + 0.64 + 0.64) / 4) and found.brier_floor == pytest.approx(0.25)


def test_twin_centroids_give_one_row(spark):
    cells = spark.createDataFrame([("2_1", 50.0, -120.0), ("1_1", 50.0, -120.0), ("9_9", 51.0, -119.0)], "cell_id string, latitude double, longitude double")
    places = spark.createDataFrame([("x", 50.01, -120.01)], "place string, latitude double, longitude double")
    assert [(r.place, r.cell_id) for r in grid.nearest_cell(places, cells).collect()] == [("x", "1_1")]


@pytest.mark.parametrize("metric", ["planar", "great_circle"])
def test_nearest_across_the_antimeridian(spark, metric):
    points = spark.createDataFrame([(0.0, 179.99), (0.0, -179.70)], "latitude double, longitude double")
    places = spark.createDataFrame([("x", 0.0, -179.99)], "cell_id string, latitude double, longitude double")
    assert grid.nearest_point(places, points, metric=metric).first().p_lon == 179.99


@pytest.mark.parametrize("metric", ["planar", "great_circle"])
def test_nearest_at_every_distance(spark, metric):
    """Places near, far and very far from the points take different rounds."""
    points = [(50 + k * 0.3, -120 + k * 0.7) for k in range(12)]
    places = [(f"p{k}", lat, lon) for k, (lat, lon) in enumerate([(50.1, -120.1), (52.0, -118.0), (60.0, -100.0), (10.0, 40.0), (-80.0, 170.0)])]
    got = grid.nearest_point(
        spark.createDataFrame(places, "cell_id string, latitude double, longitude double"),
        spark.createDataFrame(points, "latitude double, longitude double"),
        metric=metric,
    )
    frame = spark.createDataFrame([(c, a, b, x, y) for c, a, b in places for x, y in points], "cell_id string, latitude double, longitude double, p_lat double, p_lon double")
    distance = grid.METRICS[metric][0](F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))
    want = {r.cell_id: r.d for r in frame.groupBy("cell_id").agg(F.min(distance).alias("d")).collect()}
    assert {r.cell_id: r.distance for r in got.collect()} == pytest.approx(want)


def test_only_a_missing_path_is_empty(spark, tmp_path):
    assert read_or_none(spark, str(tmp_path / "absent")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        load_or_build(spark, str(tmp_path / "bad"), lambda: spark.range(1)).collect()
    assert (tmp_path / "bad" / "part-0.parquet").read_text() == "not parquet"


def test_many_buckets_change_nothing(spark):
    df = spark.range(30_000).select(F.col("id").alias("row_key"), ((F.col("id") * 7919) % 30_000 / 3e4).alias("score"))
    counts = ranking.value_counts(df, "score")
    placed = ranking.place_in_buckets(counts, "score", ["n"], rows_per_bucket=10)
    sizes = placed.groupBy("_bucket").count()
    assert sizes.count() > 1000 and sizes.agg(F.max("count")).first()[0] < 100
    ladder = ranking.running_totals(counts, "score", ["n"], values_per_cell=10)
    assert ladder.filter(F.round(F.col("score") * 3e4) != F.col("n_before")).count() == 0


def test_backtest_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(k, "1_1", f"{2019 + k % 3}-06-{k % 28 + 1:02d}", k % 2, float(k % 2)) for k in range(90)]
    df = spark.createDataFrame(rows, "row_key long, cell_id string, date string, ignited int, a double").withColumn("date", F.to_date("date"))
    fitted = []

    def fit(train, **params):
        fitted.append(train.count())
        return models.fit_forest(train, **params)

    path = str(tmp_path / "folds")
    run = {"fit_fn": fit, "params": {"n_estimators": 1, "max_depth": 1}, "features": ["a"], "path": path}
    export.run_backtest(df, (2020,), **run)
    both = export.run_backtest(df, (2020, 2021), **run)
    assert len(fitted) == 2 and {r.year for r in both.select("year").distinct().collect()} == {2020, 2021}
    assert {r.year for r in export.run_backtest(df, (2021,), **run).select("year").distinct().collect()} == {2021}


def test_background_of_any_size(spark):
    df = spark.range(12_000).select(F.col("id").alias("row_key"), (F.col("id") % 2).cast("int").alias("ignited"), (F.col("id") % 7 + F.col("id") % 2 * 3).cast("double").alias("a"))
    model = models.fit_forest(df, ["a"], n_estimators=2, max_depth=2)
    parts = xai.attributions(model, df.limit(20), df)
    scored = models.predict(model, df).select("row_key", "score")
    off = parts.join(scored, "row_key").filter(F.abs(F.col("contribution") + F.col("base") - F.col("score")) > 1e-9)
    assert parts.count() == 20 and off.count() == 0


def test_scratch_is_removed(spark):
    df = materialize(spark.range(3), "kept")
    assert df.count() == 3 and clear_scratch(spark) >= 1
    from riskgrid.plans import demo, q_models

    demo._STORED.clear()  # relations and models that other tests would read from there
    q_models._small_bundle.cache_clear()

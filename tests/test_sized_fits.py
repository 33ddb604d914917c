"""Fits on large frames: how many run at a time, stumps on counts, season days."""

from pyspark.sql import functions as F

from riskgrid.learn import models, together


def test_fewer_fits_at_a_time_the_more_rows(spark, monkeypatch):
    rows = spark.range(10)
    assert together.how_many_at_once(rows) == together.AT_ONCE
    monkeypatch.setattr(together, "ROWS_AT_ONCE", 25)
    assert together.how_many_at_once(rows) == 2
    assert together.how_many_at_once(spark.range(1000)) == 1


def test_a_stump_sees_a_value_that_one_row_in_many_has(spark):
    """The learner takes its cuts from a sample of large frames."""
    rows = spark.range(400_000).select(
        F.when(F.col("id") == 77_777, 9.0).otherwise((F.col("id") % 3).cast("double")).alias("near"),
        (F.col("id") == 77_777).cast("int").alias("ignited"),
    )
    stump = models.fit_forest(rows, ["near"], n_estimators=1, max_depth=1, max_features=1.0, bootstrap=False)
    seen = spark.createDataFrame([(2.0,), (9.0,)], "near double")
    assert [r.score for r in models.predict(stump, seen).orderBy("near").collect()] == [0.0, 1.0]


def test_season_days_are_not_formatted(spark):
    """Formatting each date cost more than reading its row."""
    from riskgrid.operators.labels import season_rows

    days = spark.sql("SELECT explode(sequence(date'2019-12-25', date'2021-01-05')) AS date UNION ALL SELECT NULL")
    for window in (("05-01", "10-15"), ("04-01", "10-15"), ("02-29", "02-29")):
        kept = season_rows(days, start=window[0], end=window[1])
        assert "date_format" not in kept._jdf.queryExecution().optimizedPlan().toString()
        assert set(kept.collect()) == set(days.filter(F.date_format("date", "MM-dd").between(*window)).collect())

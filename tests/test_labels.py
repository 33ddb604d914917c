from riskgrid.operators import labels as lb


def test_only_vegetation_fires_are_kept(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (0,), (None,)], "type int")
    assert lb.filter_real_fires(df).count() == 2


def test_scaffold_is_dense_and_marks_the_fire(spark, day):
    cells = spark.createDataFrame([("1_1", 50.0, -120.0), ("2_2", 50.1, -120.1)], "cell_id string, latitude double, longitude double")
    fires = spark.createDataFrame([("1_1", "2021-06-02"), ("1_1", "2021-06-02"), ("9_9", "2021-06-02")], "cell_id string, acq_date string")
    rows = lb.build_label_scaffold(fires, cells, "2021-06-01", "2021-06-03").collect()
    assert len(rows) == 6
    assert [(r.cell_id, r.date) for r in rows if r.ignited] == [("1_1", day("2021-06-02"))]


def _panel(spark, **cells):
    rows = [(c, f"2021-06-{i + 1:02d}", v) for c, values in cells.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell_id string, d string, ignited int").selectExpr("cell_id", "to_date(d) AS date", "ignited")


def _forward(df, n):
    out = {}
    for r in lb.add_forward_label(df, n, "y").orderBy("cell_id", "date").collect():
        out.setdefault(r.cell_id, []).append(r.y)
    return out


def test_forward_label_looks_ahead_and_is_null_at_the_end(spark):
    assert _forward(_panel(spark, a=[0, 0, 1, 0, 0]), 3) == {"a": [1, 1, 1, None, None]}


def test_forward_label_of_one_day_is_the_label(spark):
    assert _forward(_panel(spark, a=[0, 1, 0, 1]), 1) == {"a": [0, 1, 0, 1]}


def test_forward_label_never_crosses_cells(spark):
    assert _forward(_panel(spark, a=[0, 0], b=[0, 1]), 2) == {"a": [0, None], "b": [1, None]}


def test_unlabelled_rows_go(spark):
    df = lb.add_forward_label(_panel(spark, a=[0, 0, 1, 0, 0]), 3, "y")
    kept = lb.drop_unlabelled(df, "y")
    assert kept.count() == 3 and dict(kept.dtypes)["y"] == "int"


def _dates(spark, *dates):
    return spark.createDataFrame([(d, 0) for d in dates], "d string, ignited int").selectExpr("to_date(d) AS date", "ignited")


def test_season_includes_both_ends_of_any_year(spark):
    df = _dates(spark, "2023-04-30", "2023-05-01", "2023-07-15", "2023-10-15", "2023-10-16", "2024-12-25")
    kept = [str(r.date) for r in lb.season_rows(df).orderBy("date").collect()]
    assert kept == ["2023-05-01", "2023-07-15", "2023-10-15"]


def test_split_is_by_date(spark):
    df = _dates(spark, "2020-01-01", "2022-12-31", "2023-01-01", "2023-06-01", "2024-01-01", "2024-06-01")
    assert [part.count() for part in lb.temporal_split(df)] == [2, 2, 2]
    counts = {r.split: r["count"] for r in lb.with_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 2, "val": 2, "test": 2}

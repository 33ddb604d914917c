import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.learn import export, importance, models, search
from riskgrid.learn.bundle import Bundle, load_bundle, save_bundle
from riskgrid.operators import explain as xai
from riskgrid.operators.calibrate import fit_isotonic

INPUTS = ["a", "b", "fuel_type_M-1/M-2 (20 PC)"]


@pytest.fixture(scope="module")
def frame(spark):
    """y follows a; b helps a little; the last column is noise."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        a, b, noise = rng.random(3)
        date = dt.date(2018 + i // 150, 7, 1) + dt.timedelta(days=i % 60)
        y = int(a + 0.2 * b > 0.8)
        rows.append((i, f"{i % 5}_0", date, float(a), float(b), float(noise > 0.5), y, y if i % 10 else None))
    schema = "row_key bigint, cell_id string, date date, a double, b double, `fuel_type_M-1/M-2 (20 PC)` double, ignited int, ignited_next_3d int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def forest(frame):
    return models.fit_forest(frame, INPUTS, n_estimators=8, max_depth=4, max_features=0.6)


def _fit(train, features=INPUTS, label="ignited", **params):
    return models.fit_forest(train, features, label, **{"n_estimators": 3, "max_depth": 3, **params})


@pytest.mark.parametrize("fit", [models.fit_logistic, models.fit_forest, models.fit_boosted])
def test_models_rank_well_and_report_all_metrics(frame, fit):
    params = {} if fit is models.fit_logistic else {"n_estimators": 4, "max_depth": 3}
    found = models.evaluate(fit(frame, INPUTS, **params), frame)
    assert set(found) == {"pr_auc", "roc_auc", "top_10pct_capture"}
    assert all(0 <= v <= 1 for v in found.values()) and found["roc_auc"] > 0.9


def test_the_random_floor_predicts_at_the_prior(frame):
    model = models.fit_dummy(frame)
    scored = model.predict(frame)
    assert abs(scored.agg(F.avg("score")).first()[0] - model.prior) < 0.06
    assert scored.select("score").collect() == model.predict(frame).select("score").collect()


def test_column_order_of_the_input_does_not_matter(frame, forest):
    swapped = frame.select(*reversed(frame.columns))
    a = models.predict(forest, frame).select("row_key", "score").orderBy("row_key").collect()
    b = models.predict(forest, swapped).select("row_key", "score").orderBy("row_key").collect()
    assert a == b


def test_a_missing_input_column_fails_loudly(frame, forest):
    with pytest.raises(Exception, match="a"):
        models.predict(forest, frame.drop("a")).collect()


def test_grid_returns_every_candidate_and_the_first_best(frame):
    train, val = frame.filter("row_key < 600"), frame.filter("row_key >= 600")
    model, best, results = search.grid_search(_fit, {"max_depth": [1, 3], "seed": [5]}, train, val)
    assert len(results) == 2 and model is not None
    top = max(r["pr_auc"] for r in results)
    assert best == next(r["params"] for r in results if r["pr_auc"] == top)


def test_random_draws_repeat_and_stay_in_range():
    space = {"n": ("int", 2, 5), "u": ("uniform", 0.3, 1.0), "g": ("loguniform", 0.01, 0.3)}
    draws = search.draw_candidates(space, 50, 1)
    assert draws == search.draw_candidates(space, 50, 1)
    assert {d["n"] for d in draws} == {2, 3, 4}
    assert all(0.3 <= d["u"] <= 1 and 0.01 <= d["g"] <= 0.3 for d in draws)


def test_the_winner_is_fitted_on_train_only(frame):
    seen = []

    def fit(train, **params):
        seen.append(train.count())
        return _fit(train, **params)

    train, val = frame.filter("row_key < 600"), frame.filter("row_key >= 600")
    search.random_search(fit, {"max_depth": ("int", 1, 3)}, train, val, n_iter=2)
    assert set(seen) == {600}


def test_bundle_survives_saving(spark, frame, forest, tmp_path):
    scored = models.predict(forest, frame)
    first = Bundle(forest, INPUTS, {"scores": {"val": {"pr_auc": 0.5}}}, fit_isotonic(scored, "ignited"))
    save_bundle(first, str(tmp_path / "deep" / "bundle"))
    again = load_bundle(spark, str(tmp_path / "deep" / "bundle"))
    assert again.feature_columns == INPUTS and again.metadata == first.metadata
    a = first.score(frame).select("row_key", "score", "calibrated").orderBy("row_key").collect()
    assert a == again.score(frame).select("row_key", "score", "calibrated").orderBy("row_key").collect()
    assert all(0 <= r.calibrated <= 1 for r in a)


def test_without_a_calibrator_the_calibrated_value_is_null(frame, forest):
    assert Bundle(forest, INPUTS).score(frame).filter("calibrated IS NOT NULL").count() == 0


def test_export_fits_scores_calibrates_and_saves(spark, frame, tmp_path):
    params = {"n_estimators": 3, "max_depth": 3}
    bundle = export.export_served_model(frame, str(tmp_path / "m"), INPUTS, (2021, 2022), "2022-01-01", "2023-01-01", params)
    stored = load_bundle(spark, str(tmp_path / "m"))
    assert stored.calibrator is not None and stored.metadata["calibrator"]["fold_years"] == [2021, 2022]
    assert set(bundle.metadata["scores"]["test"]) == {"pr_auc", "roc_auc", "top_10pct_capture"}
    several = export.export_multi_day_model(frame, str(tmp_path / "n"), "ignited_next_3d", INPUTS, "2022-01-01", "2023-01-01", params)
    assert several.calibrator is None and several.metadata["label"] == "ignited_next_3d"


def test_backtest_keeps_raw_scores_per_year(frame):
    folds = export.run_backtest(frame, (2020, 2021), models.fit_forest, {"n_estimators": 3, "max_depth": 3}, INPUTS)
    assert {r.year: r["count"] for r in folds.groupBy("year").count().collect()} == {2020: 150, 2021: 150}


def test_importances_put_the_real_input_first(spark, frame, forest):
    assert importance.impurity_importance(forest).first().feature == "a"
    ranked = importance.permutation_importance(forest, frame, INPUTS, repeats=2).collect()
    assert ranked[0].feature == "a" and ranked[0].importance_mean > 0.1
    assert abs(ranked[-1].importance_mean) < 0.05


def test_a_shuffled_column_keeps_its_values(frame):
    mixed = importance.shuffle_column(frame, "a", seed=1)
    assert mixed.columns == frame.columns and mixed.count() == 900
    a, b = (sorted(r.a for r in df.select("a").collect()) for df in (frame, mixed))
    assert a == b
    moved = frame.alias("x").join(mixed.alias("y"), "row_key").filter("x.a <> y.a").count()
    assert moved > 850


def test_ablation_reports_every_variant(spark, frame):
    out = search.ablation(spark, _fit, ["b"], {"main": ["a"]}, frame, frame).collect()
    assert [(r.variant, r.columns) for r in out] == [("base", 1), ("base + main", 2), ("base + all", 2)]
    assert out[1].pr_auc > out[0].pr_auc


def test_attributions_add_up_and_rank(spark, frame, forest):
    background = frame.limit(60)
    parts = xai.attributions(forest, frame.filter("row_key < 50"), background).cache()
    sums = parts.groupBy("row_key").agg((F.sum("contribution") + F.first("base")).alias("total"))
    scored = models.predict(forest, frame).select("row_key", "score")
    assert sums.join(scored, "row_key").filter("abs(total - score) > 1e-4").count() == 0
    ranked = xai.mean_abs(parts).orderBy(F.desc("mean_abs")).collect()
    assert ranked[0].feature == "a" and len(ranked) == 3
    top = xai.top_contributions(parts, 2).filter("row_key = 3").orderBy("rank").collect()
    assert len(top) == 2 and abs(top[0].contribution) >= abs(top[1].contribution)
    halves = xai.conditional_mean_abs(parts, "fuel_type_M-1/M-2 (20 PC)").collect()
    assert sum(r.rows for r in halves) == 50


def test_attributions_equal_the_definition(frame, forest):
    """Shapley values by all coalitions, inputs outside taken from the background."""
    from itertools import combinations
    from math import factorial

    background = frame.filter("row_key < 8")
    target = frame.filter("row_key = 700")
    got = {r.feature: r.contribution for r in xai.attributions(forest, target, background).collect()}
    x, rows = target.first(), background.collect()
    spark = frame.sparkSession
    sets = [s for k in range(4) for s in combinations(range(3), k)]
    mixed = []
    for i, chosen in enumerate(sets):
        for b in rows:
            mixed.append((i, *[float(x[c] if j in chosen else b[c]) for j, c in enumerate(INPUTS)]))
    df = spark.createDataFrame(mixed, "s int, a double, b double, `fuel_type_M-1/M-2 (20 PC)` double")
    value = {sets[r.s]: r.v for r in models.predict(forest, df).groupBy("s").agg(F.avg("score").alias("v")).collect()}
    for j, name in enumerate(INPUTS):
        want = 0.0
        for s in sets:
            if j not in s:
                weight = factorial(len(s)) * factorial(2 - len(s)) / factorial(3)
                want += weight * (value[tuple(sorted((*s, j)))] - value[s])
        assert got[name] == pytest.approx(want, abs=1e-9)


def test_example_pool_has_all_positives(frame):
    pool = xai.example_pool(frame, negatives=20)
    counts = {r.ignited: r["count"] for r in pool.groupBy("ignited").count().collect()}
    assert counts == {0: 20, 1: frame.filter("ignited = 1").count()}


def test_background_is_capped_at_the_rows_there_are(frame):
    assert xai.training_background(frame, "2019-01-01", 300).count() == 150
    assert xai.training_background(frame, "2019-01-01", 20).count() == 20


def test_histories_feed_a_network(spark):
    rows = [(i, i % 2, [[float(i % 2), 0.5], [0.1 * (i % 5), 0.5 + i % 2]]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_key bigint, ignited int, sequence array<array<float>>")
    model = models.fit_sequences(df, hidden=3, max_iter=30)
    found = models.evaluate(model, models.flatten_sequences(df))
    assert found["roc_auc"] > 0.9


def test_a_network_is_learned_in_passes_that_keep_no_history(spark, monkeypatch):
    """The learner of pyspark.ml stacked all histories; it now only holds the weights, which are those it would have found."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    rows = [(i, int(i % 4 == 0), [[float(i % 4), 280.0 + i % 7], [0.1 * (i % 5), 0.5 + i % 3]]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_key bigint, ignited int, sequence array<array<float>>").coalesce(1)
    copies = F.expr("explode(sequence(1, CASE WHEN ignited = 1 THEN 3 ELSE 1 END))")
    stacked = models.flatten_sequences(df).select("_raw", F.col("ignited").cast("double").alias("_label"), copies)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(stacked)
    for steps in (1, 3, 8):
        learner = MultilayerPerceptronClassifier(labelCol="_label", layers=[4, 3, 2], maxIter=steps, seed=5, blockSize=1000)
        theirs = learner.fit(scaled.transform(stacked)).transform(scaled.transform(models.flatten_sequences(df).withColumn("_label", F.lit(0.0))))
        seen = []

        class Watched(MultilayerPerceptronClassifier):
            def _fit(self, dataset):
                seen.append(dataset.count())
                return super()._fit(dataset)

        monkeypatch.setattr(models, "MultilayerPerceptronClassifier", Watched)
        ours = models.predict(models.fit_sequences(df, hidden=3, max_iter=steps, seed=5), models.flatten_sequences(df))
        monkeypatch.undo()
        assert max(seen) <= 2
        expected = {r.row_key: r.probability[1] for r in theirs.collect()}
        assert {r.row_key: r.score for r in ours.collect()} == pytest.approx(expected, abs=1e-6)


def test_example_pool_leaves_no_negative_out(spark):
    """By default it held 2,000 negatives, so the highest-scored one could be missing."""
    df = spark.range(5000).selectExpr("id AS row_key", "CASE WHEN id < 10 THEN 1 WHEN id < 12 THEN NULL ELSE 0 END AS ignited")
    counts = {r.ignited: r["count"] for r in xai.example_pool(df).groupBy("ignited").count().collect()}
    assert counts == {1: 10, 0: 4988}


def test_the_example_query_reads_no_sample(spark, monkeypatch):
    from riskgrid.plans import q_models

    def refuse(*args, **kwargs):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(xai, "seeded_sample", refuse)
    sf = "/root/testdata/sf0.001"
    _, _, test = q_models.split_frames(spark, sf)
    scored = models.predict(q_models.small_bundle(spark, sf).model, test).select("row_key", "ignited", "score").toPandas()
    found = {r.example: r.row_key for r in q_models.xai_4(spark, sf).select("example", "row_key").distinct().collect()}
    for name, label in (("highest_scored_actual_fire", 1), ("highest_scored_non_fire", 0)):
        first = scored[scored.ignited == label].sort_values(["score", "row_key"], ascending=[False, True]).head(1)
        assert [found[name]] == first.row_key.tolist() if len(first) else name not in found


def _histories(spark, rows):
    rng = np.random.default_rng(3)
    days = [dt.date(2021, 5, 1) + dt.timedelta(days=i) for i in range(rows) if i != 17]
    found = [(f"{c}_0", d, float(rng.random()), 280 + float(rng.random()), int(rng.random() < 0.3)) for c in range(4) for d in days]
    return spark.createDataFrame(found, "cell_id string, date date, a double, b double, ignited int").repartition(3)


def test_a_network_learned_from_runs_is_that_of_their_histories(spark):
    """Histories were cut out one by one for every pass; they are now cut where the gradient is added up."""
    from riskgrid.operators import features as ft

    df, used = _histories(spark, 40), lambda day: day < F.lit("2021-06-03").cast("date")
    runs = ft.build_runs(df, ("a", "b"), 5)
    rows = ft.cut_histories(runs, df.columns, 5)
    train = rows.filter(used(F.col("date")))
    a = models.fit_sequences(train, hidden=3, max_iter=6, seed=2)
    b = models.fit_runs(runs, used, 5, hidden=3, max_iter=6, seed=2)
    scored = models.flatten_sequences(rows)
    both = [{(r.cell_id, r.date): r.score for r in models.predict(m, scored).collect()} for m in (a, b)]
    assert train.count() < rows.count() == len(both[0]) == 4 * (39 - 2 * 4)
    assert both[1] == pytest.approx(both[0], abs=1e-6)
    assert max(both[0].values()) - min(both[0].values()) > 1e-3


def test_the_sequence_query_fits_the_whole_network(spark, monkeypatch):
    """It asked for 4 hidden units and 3 steps of the search, where the learner has 16 and 50."""
    from riskgrid.plans import q_models

    seen = []
    monkeypatch.setattr(models, "descend", lambda loss, start, steps: seen.append((len(start), steps)) or start)
    q_models.ml_15(spark, "/root/testdata/sf0.001")
    assert seen == [(150 * 16 + 16 + 16 * 2 + 2, 50)]


def test_the_forest_of_the_sequence_query_reads_stored_rows(spark, monkeypatch):
    """Each of its passes cut the rows out of the runs again."""
    from riskgrid.plans import q_models

    seen = []
    monkeypatch.setattr(models, "descend", lambda loss, start, steps: start)
    monkeypatch.setattr(q_models, "_fit_small", lambda train, f=q_models._fit_small: seen.append(train) or f(train))
    q_models.ml_15(spark, "/root/testdata/sf0.001")
    assert "explode" not in seen[0]._jdf.queryExecution().optimizedPlan().toString().lower() and seen[0].count() > 0

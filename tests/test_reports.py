import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import backtest as bt
from riskgrid.operators import calibrate as cal
from riskgrid.operators import metrics, profile, ranking


def _scores(spark, labels, scores, **extra):
    rows = [(i, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))]
    df = spark.createDataFrame(rows, "row_key bigint, label int, score double")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def _sample(n, seed, steps=None, hot=None):
    rng = np.random.default_rng(seed)
    s = rng.random(n)
    if steps:
        s = np.round(s * steps) / steps
    if hot is not None:
        s[rng.random(n) < 0.4] = hot  # one score holds more than a third of the rows
    y = (rng.random(n) < s * 0.3).astype(int)
    return y, s


def _average_precision(y, s):
    out, total = 0.0, y.sum()
    for t in np.unique(s)[::-1]:
        out += y[s == t].sum() / total * y[s >= t].mean()
    return out


def _auc(y, s):
    p, q = s[y == 1], s[y == 0]
    return np.mean((p[:, None] > q) + 0.5 * (p[:, None] == q))


@pytest.mark.parametrize("steps, hot", [(None, None), (50, None), (50, 0.0), (None, 0.5)])
def test_rank_metrics_against_brute_force(spark, monkeypatch, steps, hot):
    monkeypatch.setattr(ranking.place_in_buckets, "__defaults__", ((), 16, 50))  # many buckets on few rows
    monkeypatch.setattr(ranking.running_totals, "__defaults__", ((), False, 16, None, False))
    y, s = _sample(1500, 7, steps, hot)
    df = _scores(spark, y, s)
    assert metrics.average_precision(df).first()[0] == pytest.approx(_average_precision(y, s))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(_auc(y, s))
    order = sorted(range(len(y)), key=lambda i: (-s[i], i))
    top = set(order[:150])
    flagged = {r.row_key for r in ranking.top_k_flag(df).filter("in_top").collect()}
    assert flagged == top
    assert metrics.top_k_capture(df).first()[0] == pytest.approx(sum(y[i] for i in top) / y.sum())
    assert metrics.brier(df).first().brier == pytest.approx(np.mean((s - y) ** 2))


@pytest.mark.parametrize("hot", [None, 0.3])
def test_quantiles_against_numpy(spark, hot):
    _, s = _sample(999, 11, None, hot)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    got = ranking.quantiles(_scores(spark, s * 0, s), "score", probs).first().q
    assert got == [pytest.approx(v) for v in np.quantile(s, probs)]


def test_running_totals_with_more_values_than_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = {r.v: r.n_before for r in ranking.running_totals(df, "v", ["n"], values_per_cell=100).collect()}
    expected = np.concatenate([[0], np.cumsum(np.arange(5000) % 7)])[:-1]
    assert all(got[i] == expected[i] for i in range(5000))


def test_groups_are_ranked_apart(spark):
    y, s = _sample(400, 1, 20)
    df = _scores(spark, y, s).withColumn("year", F.when(F.col("row_key") < 100, 2020).otherwise(2021))
    counts = {r.year: r["count"] for r in ranking.top_k_flag(df, by=["year"]).filter("in_top").groupBy("year").count().collect()}
    assert counts == {2020: 10, 2021: 30}


def test_no_positives_gives_null(spark):
    df = _scores(spark, [0, 0, 0], [0.1, 0.2, 0.3])
    assert metrics.score_card(df).first()[:] == (None, None, None)


def test_perfect_and_reversed_order(spark):
    good = metrics.score_card(_scores(spark, [0] * 9 + [1], np.arange(10) / 10)).first()
    bad = metrics.score_card(_scores(spark, [1] + [0] * 9, np.arange(10) / 10)).first()
    assert good[:] == (1, 1, 1) and bad.roc_auc == 0 and bad.top_10pct_capture == 0


def test_months_without_positives_are_absent(spark):
    rows = [(0, dt.date(2021, 7, 1), 1, 0.99), (1, dt.date(2021, 8, 1), 1, 0.01)]
    rows += [(i + 2, dt.date(2021, 6, 1 + i), 0, 0.5) for i in range(18)]
    df = spark.createDataFrame(rows, "row_key bigint, date date, label int, score double").withColumn("year", F.lit(2021))
    got = {r.month: (r.total, r.caught) for r in bt.monthly_capture(df).collect()}
    assert got == {7: (1, 1), 8: (1, 0)}


def test_folds_never_see_their_own_year(spark):
    dates = ["2020-05-01", "2021-05-01", "2021-06-01", "2022-05-01", "2023-05-01"]
    df = spark.createDataFrame([(d, 1) for d in dates], "d string, ignited int").selectExpr("to_date(d) AS date", "ignited")
    got = {year: (train.count(), held.count()) for year, train, held in bt.rolling_origin_folds(df, [2021, 2022, 2023])}
    assert got == {2021: (1, 2), 2022: (3, 1), 2023: (4, 1)}
    sizes = {r.year: (r.train_rows, r.holdout_rows) for r in bt.fold_sizes(df, [2021, 2022, 2023]).collect()}
    assert sizes == got


def test_reliability_of_calibrated_scores(spark):
    rng = np.random.default_rng(0)
    s = rng.random(3000)
    table = cal.reliability_table(_scores(spark, rng.random(3000) < s, s)).collect()
    assert len(table) == 10 and {r["count"] for r in table} == {300}
    assert all(abs(r.mean_predicted - r.observed_rate) < 0.1 for r in table)


def test_equal_edges_merge(spark):
    s = np.r_[np.zeros(60), np.linspace(0.1, 1, 40)]
    table = cal.reliability_table(_scores(spark, s > 0.5, s)).collect()
    assert sum(r["count"] for r in table) == 100 and len(table) < 10


def _overconfident(spark, n=3000, factor=10, seed=0):
    rng = np.random.default_rng(seed)
    s = rng.random(n)
    return _scores(spark, rng.random(n) < s / factor, s)


@pytest.mark.parametrize("method", ["isotonic", "sigmoid", "venn_abers"])
def test_calibration_repairs_overconfidence(spark, method):
    train, test = _overconfident(spark, seed=1), _overconfident(spark, seed=2)
    raw = metrics.brier(test).first().brier
    if method == "isotonic":
        out = cal.apply_isotonic(test, cal.fit_isotonic(train), out="c")
    elif method == "sigmoid":
        out = cal.apply_sigmoid(test, cal.fit_sigmoid(train), out="c")
    else:
        out = cal.venn_abers(train, test).withColumnRenamed("point", "c")
        assert out.filter("p0 > p1 OR c < p0 - 1e-12 OR c > p1 + 1e-12").count() == 0
    assert metrics.brier(out, score="c").first().brier < raw / 3


def _added(scores, labels, at, gain):
    """Rate of the block that holds `at` after pooling with one more row."""
    groups = {}
    for s, y in [*zip(scores, labels), (at, gain)]:
        v, n = groups.get(s, (0, 0))
        groups[s] = (v + y, n + 1)
    keys = sorted(groups)
    blocks = []
    for k in keys:
        blocks.append([*groups[k], [k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v, n, ks = blocks.pop()
            blocks[-1][0] += v
            blocks[-1][1] += n
            blocks[-1][2] += ks
    return next(b[0] / b[1] for b in blocks if at in b[2])


@pytest.mark.parametrize("steps, buckets", [(12, 64), (None, 8), (40, 4)])
def test_intervals_equal_refitting_with_the_added_row(spark, steps, buckets):
    y, s = _sample(240, 5, steps, 0.25)
    asked = sorted({0.0, 0.001, 0.25, 0.2501, 0.999, 1.0, *np.round(s[:12], 6), *s[12:24]})
    known = [(float(a), 1, int(b), 0) for a, b in zip(s, y)] + [(float(a), 0, 0, 1) for a in asked]
    counts = (
        spark.createDataFrame(known, "score double, n int, pos int, t int")
        .groupBy("score")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), (F.max("t") == 1).alias("is_test"))
    )
    got = {r.score: (r.p0, r.p1) for r in cal.venn_abers_intervals(counts, buckets=buckets, rows_per_bucket=10).collect()}
    assert set(got) == set(map(float, asked))
    for a in asked:
        assert got[a] == (pytest.approx(_added(s, y, a, 0)), pytest.approx(_added(s, y, a, 1)))


def test_a_wrong_year_gets_worse_and_the_others_better(spark):
    rng = np.random.default_rng(4)
    rows, key = [], 0
    for year in range(2017, 2021):
        s = rng.random(1000)
        rate = s / 10 if year != 2020 else np.full(1000, 0.9)
        for a, b in zip(s, rng.random(1000) < rate):
            rows.append((key, year, int(b), float(a)))
            key += 1
    scores = spark.createDataFrame(rows, "row_key bigint, year int, label int, score double")
    report = {r.year: r for r in cal.leave_one_year_out(scores, range(2017, 2021)).collect()}
    assert len(report) == 4
    for year in (2017, 2018, 2019):
        r = report[year]
        assert r.isotonic_brier < r.raw_brier and r.venn_abers_brier < r.raw_brier and r.sigmoid_brier < r.raw_brier
    assert report[2020].isotonic_brier > report[2020].raw_brier
    assert all(r.pooled_train_positives + r.positives == sum(x[2] for x in rows) for r in report.values())
    checked = cal.interval_check(spark.createDataFrame(list(report.values())), (2017,)).first()
    assert checked.sparse_mean_width > 0


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "ignited int")
    weights = {r.ignited: r.weight for r in profile.with_class_weights(df).collect()}
    assert weights == {0: 0.625, 1: 2.5}
    assert profile.class_ratio(df).first().scale_pos_weight == 4
    assert profile.class_ratio(df.filter("ignited = 0")).first().scale_pos_weight == 8


def test_null_counts_list_only_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, `fuel_type_M-1/M-2 (20 PC)` int, c string")
    assert {r.column_name: r.nulls for r in profile.null_counts(df).collect()} == {"fuel_type_M-1/M-2 (20 PC)": 2, "c": 1}


def test_relative_risk_peaks_at_one(spark, day):
    df = spark.createDataFrame([(day("2021-06-01"), 0.1), (day("2021-06-01"), 0.4), (day("2021-06-02"), 0.0)], "date date, score double")
    got = sorted((r.score, r.relative_risk) for r in bt.relative_risk(df).collect())
    assert got == [(0.0, None), (0.1, 0.25), (0.4, 1.0)]


def test_seeded_sample_is_repeatable_and_bounded(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_key")
    a = {r[0] for r in ranking.seeded_sample(df, 50, "row_key", 3).collect()}
    b = {r[0] for r in ranking.seeded_sample(df.repartition(7), 50, "row_key", 3).collect()}
    assert a == b and len(a) == 50
    assert ranking.seeded_sample(df, 5000, "row_key").count() == 1000

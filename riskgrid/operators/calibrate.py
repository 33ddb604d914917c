"""Reliability tables and score calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.operators.ranking import (
    BUCKETS,
    ROWS_PER_BUCKET,
    _attach,
    add_running_totals,
    dealt_in_buckets,
    quantiles_of_counts,
    value_counts,
)
from riskgrid.session import materialize


def reliability_table(
    df: DataFrame,
    n_bins: int = 10,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Predicted against observed rate by score quantile.

    Bins are closed on the right, the lowest also on the left; equal edges
    merge.  `bin` counts from 1.  With `weight`, a row stands for that many
    rows of which `label` are positive.  Rows without a score count nowhere.
    Rows are read once, to be counted per score; the rest works on the counts.
    """
    counts = materialize(value_counts(df, score, {"_positives": F.col(label)}, by, weight), "reliability-counts")
    edges = quantiles_of_counts(counts, score, [i / n_bins for i in range(n_bins + 1)], by).withColumn("q", F.array_distinct("q"))
    below = F.size(F.filter("q", lambda e: e < F.col(score)))
    return (
        _attach(counts, edges, by)
        .withColumn("bin", F.greatest(below, F.lit(1)))
        .groupBy(*by, "bin")
        .agg(
            F.sum("n").alias("count"),
            (F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("mean_predicted"),
            (F.sum("_positives") / F.sum("n")).alias("observed_rate"),
        )
    )


def split_report(df: DataFrame, label: str = "label", score: str = "score", by: str = "split", n_bins: int = 10) -> DataFrame:
    """Reliability table per split, with its Brier score, floor and positive
    rate, all over the rows that have a score."""
    df = df.filter(F.col(score).isNotNull())
    rate = F.avg(label)
    totals = df.groupBy(by).agg(
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"),
        (rate * (1 - rate)).alias("brier_floor"),
        rate.alias("positive_rate"),
    )
    return _attach(reliability_table(df, n_bins, label, score, [by]), totals, [by])


def score_counts(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Rows `n` and positives `pos` per distinct score.  Calibrators are fitted
    on these: the fit is the same and a hot score is one row.  Rows without a
    score are left out."""
    return df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))


# --- isotonic -------------------------------------------------------------


def fit_isotonic(df: DataFrame, label: str = "label", score: str = "score") -> IsotonicRegressionModel:
    """Monotone score-to-rate curve."""
    return _isotonic_from_counts(score_counts(df, label, score), score)


def _isotonic_from_counts(counts: DataFrame, score: str) -> IsotonicRegressionModel:
    return _isotonic_from_knots(isotonic_knots(counts, score=score), score)


def _isotonic_from_knots(knots: DataFrame, score: str) -> IsotonicRegressionModel:
    """The model of a curve that is monotone already: there is nothing left to pool."""
    ends = F.array(F.struct(F.col("first").alias(score), "rate", "weight"), F.struct(F.col("last").alias(score), "rate", "weight"))
    rows = knots.select(F.inline(F.array_distinct(ends)))
    return IsotonicRegression(featuresCol=score, labelCol="rate", weightCol="weight").fit(rows)


def isotonic_knots(
    counts: DataFrame, by: Sequence[str] = (), score: str = "score", buckets: int = BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The blocks of the isotonic fit to `n` rows and `pos` positives per distinct
    score: `first` and `last` score, `rate`, `weight`; for each group.

    Pooling adjacent violators gives the slopes of the lower hull of cumulative
    positives over cumulative rows.  Each bucket of scores is pooled to the
    vertices of its own hull, and buckets are then merged sixteen by sixteen: what
    a task holds are vertices only, and none of it passes the driver.
    """
    group = list(by) or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    ranked, points, many = _cumulated(counts.filter("n > 0"), group, score, buckets, rows_per_bucket)
    # The score after each one: a block begins behind the vertex before it.
    inside = Window.partitionBy(*group, "_bucket").orderBy(score)
    starts = ranked.groupBy(*group, "_bucket").agg(F.min(score).alias("_start"))
    starts = starts.withColumn("_following", F.lead("_start").over(Window.partitionBy(*group).orderBy("_bucket"))).drop("_start")
    points = points.withColumns({"score": F.col(score), "next": F.lead(score).over(inside)})
    points = _attach(points, starts, [*group, "_bucket"]).withColumn("next", F.coalesce("next", "_following")).drop("_following")
    hulls = _top_hull(points.select(*group, "_bucket", "_last", "w", "s", "score", "next"), group, many)
    before = Window.partitionBy(*group).orderBy("w")
    w_0, s_0 = (F.coalesce(F.lag(c).over(before), F.lit(0)) for c in ("w", "s"))
    first = F.coalesce(F.lag("next").over(before), F.col("lowest"))
    lowest = counts.filter("n > 0").groupBy(*group).agg(F.min(score).alias("lowest"))
    out = _attach(hulls, lowest, group).select(
        *by, first.alias("first"), F.col("score").alias("last"), ((F.col("s") - s_0) / (F.col("w") - w_0)).alias("rate"), (F.col("w") - w_0).cast("double").alias("weight")
    )
    return out


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, score: str = "score", out: str = "calibrated") -> DataFrame:
    """Linear between knots, constant beyond them, within 0..1."""
    scored = model.copy().setFeaturesCol(score).setPredictionCol(out).transform(df)
    return scored.withColumn(out, F.greatest(F.least(F.col(out), F.lit(1.0)), F.lit(0.0)))


# --- sigmoid --------------------------------------------------------------


def fit_sigmoid(df: DataFrame, label: str = "label", score: str = "score") -> LogisticRegressionModel:
    """One-dimensional logistic curve with a unit L2 penalty on the slope."""
    return _sigmoid_from_counts(score_counts(df, label, score), score)


def _sigmoid_from_counts(counts: DataFrame, score: str) -> LogisticRegressionModel:
    classes = F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")),
        F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("pos")).cast("double").alias("w")),
    )
    rows = (
        counts.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("x"), F.explode(classes).alias("c"))
        .select("x", "c.y", "c.w")
        .filter("w > 0")
    )
    total = counts.agg(F.sum("n")).first()[0]
    return LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / total, standardization=False, maxIter=200, tol=1e-9
    ).fit(rows)


def apply_sigmoid(df: DataFrame, model: LogisticRegressionModel, score: str = "score", out: str = "calibrated") -> DataFrame:
    slope, shift = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-(F.col(score) * slope + shift))))


# --- Venn-Abers -----------------------------------------------------------
#
# p0 and p1 are isotonic fits of the calibration set with the scored point
# added as a negative or as a positive.  In the plot of cumulative positives
# against cumulative rows, the blocks left of the point are the lower hull of
# the points before it, those right of it the lower hull of the points after
# it; the added point then pools neighbouring blocks while they violate the
# order.  A bucket of scores needs, from all other buckets, only the vertices
# of their hulls, and of neighbouring buckets only those of their common hull.


def _next_vertex(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each point, the following vertex on the lower hull of the points
    from it to the end (its own index for the last one)."""
    follow = np.arange(len(w))
    for k in range(len(w) - 2, -1, -1):
        j = k + 1
        while follow[j] != j and (s[j] - s[k]) * (w[follow[j]] - w[j]) >= (s[follow[j]] - s[j]) * (w[j] - w[k]):
            j = follow[j]
        follow[k] = j
    return follow


def _lower_hull(w: np.ndarray, s: np.ndarray) -> list[int]:
    """Indices of the vertices of the lower hull of points in order of w."""
    w, s = w.tolist(), s.tolist()  # whole numbers of any size
    keep: list[int] = []
    for k in range(len(w)):
        while len(keep) > 1:
            i, j = keep[-2], keep[-1]
            if (s[j] - s[i]) * (w[k] - w[j]) < (s[k] - s[j]) * (w[j] - w[i]):
                break
            keep.pop()
        keep.append(k)
    return keep


def _hulled(rows: pd.DataFrame, origin: bool = False) -> pd.DataFrame:
    """The rows that are vertices; `origin` puts (0, 0) in front of the points."""
    rows = rows.sort_values("w")
    w, s = rows["w"].to_numpy(), rows["s"].to_numpy()
    if not origin:
        return rows.iloc[_lower_hull(w, s)]
    return rows.iloc[[k - 1 for k in _lower_hull(np.concatenate([[0], w]), np.concatenate([[0], s])) if k]]


def _cumulated(counts: DataFrame, group: list[str], score: str, buckets: int, rows_per_bucket: int) -> tuple[DataFrame, DataFrame, bool]:
    """Counts in buckets with running totals; the points (w, s) of cumulative
    rows and positives; whether a group has more than one bucket."""
    placed, many = dealt_in_buckets(counts, score, ["n", "pos"], group, buckets, rows_per_bucket)
    ranked = add_running_totals(placed, score, ["n", "pos"], group)
    ranked = materialize(ranked, "ranked-scores") if many else ranked
    w, s = ((F.col(f"{c}_before") + F.col(c)).cast("long").alias(n) for c, n in (("n", "w"), ("pos", "s")))
    return ranked, ranked.filter("n > 0").select(*group, "_bucket", "_last", score, w, s), many


def _hull_levels(points: DataFrame, group: list[str], fan: int) -> list[DataFrame]:
    """Vertices of the hull of each node, level by level: nodes are buckets at
    first, then `fan` neighbouring nodes each, until each group is one node.  Columns
    of a level are those of `points`, `_bucket` being the node's number."""
    schema, levels = points.schema, []
    points = materialize(points, "hull-points")
    most = (points.agg(F.max("_last")).first()[0] or 0) + 1
    while True:
        hulled = points.groupBy(*group, "_bucket").applyInPandas(lambda rows: _hulled(rows)[schema.names], schema)
        levels.append(materialize(hulled, f"hull-level{len(levels)}"))
        if most <= 1:
            return levels
        most = -(-most // fan)
        points = levels[-1].withColumn("_bucket", F.floor(F.col("_bucket") / fan).cast("int"))


def _top_hull(points: DataFrame, group: list[str], many: bool, fan: int = 16) -> DataFrame:
    """Vertices of the hull of all points of a group and the origin, which is not among them."""
    top, schema = _hull_levels(points, group, fan)[-1] if many else points, points.schema
    return top.groupBy(*group).applyInPandas(lambda rows: _hulled(rows, origin=True)[schema.names], schema)


def _pool(left, right, start, stop, w_l, s_l, w_r, s_r, gain: float) -> np.ndarray:
    """Rate of the block that holds an added row of outcome `gain`."""
    a, b = start.copy(), stop.copy()

    def slope(i, j):
        return (s_r[j] - s_l[i] + gain) / (w_r[j] - w_l[i] + 1.0)

    value = slope(a, b)
    active = np.arange(len(a))
    while len(active):
        i, j, v = a[active], b[active], value[active]
        back, on = left[i], right[j]
        with np.errstate(all="ignore"):
            pulls = (back != i) & ((s_l[i] - s_l[back]) >= v * (w_l[i] - w_l[back]))
            pushes = ~pulls & (on != j) & ((s_r[on] - s_r[j]) <= v * (w_r[on] - w_r[j]))
        a[active] = np.where(pulls, back, i)
        b[active] = np.where(pushes, on, j)
        active = active[pulls | pushes]
        value[active] = slope(a[active], b[active])
    return value


def _bucket_intervals(rows: pd.DataFrame, hulls: pd.DataFrame, by: list[str], score: str) -> pd.DataFrame:
    rows = rows.sort_values(score).reset_index(drop=True)
    if rows.empty:
        return pd.DataFrame(columns=[*by, score, "p0", "p1"])
    hulls = hulls.sort_values("w")
    before, after = hulls[hulls["before"].astype(bool)], hulls[~hulls["before"].astype(bool)]
    real = (rows["n"] > 0).to_numpy()
    own_w = (rows["n_before"] + rows["n"]).to_numpy(dtype=float)[real]
    own_s = (rows["pos_before"] + rows["pos"]).to_numpy(dtype=float)[real]

    # Points at or before a row, and points at or after it.
    w_l = np.concatenate([[0.0], before["w"].to_numpy(dtype=float), own_w])
    s_l = np.concatenate([[0.0], before["s"].to_numpy(dtype=float), own_s])
    w_r = np.concatenate([[w_l[len(before)]], own_w, after["w"].to_numpy(dtype=float)])
    s_r = np.concatenate([[s_l[len(before)]], own_s, after["s"].to_numpy(dtype=float)])
    left = len(w_l) - 1 - _next_vertex(-w_l[::-1], s_l[::-1])[::-1]
    right = _next_vertex(w_r, s_r)

    passed = np.cumsum(real)  # points of the bucket up to and including the row
    tested = rows["is_test"].to_numpy(dtype=bool)
    start = (len(before) + passed - real)[tested]
    stop = passed[tested]
    out = rows.loc[tested, [*by, score]].copy()
    for name, gain in (("p0", 0.0), ("p1", 1.0)):
        out[name] = _pool(left, right, start, stop, w_l, s_l, w_r, s_r, gain)
    return out


def venn_abers_intervals(
    counts: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    buckets: int = BUCKETS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """p0 and p1 for every score to be tested.

    Hulls of buckets are merged two by two up to the whole group.  The buckets
    before one and those after it are together the siblings of the nodes above
    it, so a bucket takes one merged hull from each level, not all other buckets'.

    `counts` has one row per group and distinct score: `n` and `pos` of the
    calibration set (0 where it lacks the score) and `is_test`.
    """
    by = list(by)
    group = by or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    ranked, points, many = _cumulated(counts, group, score, buckets, rows_per_bucket)
    types = dict((f.name, f.dataType) for f in ranked.schema.fields)
    keys = [T.StructField(c, types[c]) for c in group]
    out_schema = T.StructType(keys + [T.StructField(score, types[score]), T.StructField("p0", T.DoubleType()), T.StructField("p1", T.DoubleType())])
    rows = ranked.select(*group, "_bucket", score, "n", "pos", "n_before", "pos_before", "is_test").groupBy(*group, "_bucket")
    if many:
        spread = _siblings(points.select(*group, "_bucket", "_last", "w", "s"), group)
        out = rows.cogroup(spread.groupBy(*group, "_target")).applyInPandas(lambda own, others: _bucket_intervals(own, others, group, score), out_schema)
    else:
        none = pd.DataFrame({"w": np.empty(0), "s": np.empty(0), "before": np.empty(0, dtype=bool)})
        out = rows.applyInPandas(lambda own: _bucket_intervals(own, none, group, score), out_schema)
    return out if by else out.drop("_all")


def _siblings(points: DataFrame, group: list[str]) -> DataFrame:
    """_target, w, s, before: for each bucket the hulls of the siblings of the nodes above it."""
    levels = _hull_levels(points, group, 2)
    sibling = F.col("_bucket").bitwiseXOR(F.lit(1))
    reach = [
        level.withColumns({"_from": sibling * (1 << k), "_to": F.least((sibling + 1) * (1 << k) - 1, F.col("_last"))}).filter("_from <= _to")
        for k, level in enumerate(levels[:-1] or levels)
    ]
    spread = reduce(DataFrame.unionByName, reach).withColumn("_target", F.explode(F.sequence("_from", "_to")))
    # A node lies before the target if its number is the smaller of the two siblings'.
    return spread.select(*group, "_target", "w", "s", (F.col("_bucket") < sibling).alias("before"))


def _with_point(intervals: DataFrame) -> DataFrame:
    return intervals.withColumns(
        {
            "point": F.col("p1") / (1 - F.col("p0") + F.col("p1")),
            "width": F.col("p1") - F.col("p0"),
        }
    )


def venn_abers(
    calibration: DataFrame, test: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Add p0, p1, point and width to the rows of `test`."""
    known = calibration.select(*by, score, F.lit(1).alias("n"), F.col(label).cast("int").alias("pos"), F.lit(0).alias("t"))
    asked = test.select(*by, score, F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(1).alias("t"))
    counts = (
        known.unionByName(asked)
        .groupBy(*by, score)
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), (F.max("t") == 1).alias("is_test"))
    )
    return test.join(_with_point(venn_abers_intervals(counts, by, score)), [*by, score])


# --- checks across years --------------------------------------------------


METHODS = ("raw", "isotonic", "sigmoid", "venn_abers")


def leave_one_year_out(scores: DataFrame, years: Sequence[int], label: str = "label", score: str = "score") -> DataFrame:
    """Calibrate on every other year pooled, then score the year itself.

    One row per year: positives, Brier scores and top-bin ratios raw and under
    three calibrations, and the mean Venn-Abers width.  The score table is read
    once, to count its rows per year and score; a calibrator maps equal scores
    alike, so all else works on the counts.
    """
    from riskgrid.operators.backtest import top_bins
    from riskgrid.operators.metrics import brier

    counts = materialize(score_counts(scores, label, score, ["year"]), "year-score-counts")

    own = F.col("fold") == F.col("year")
    folds = (
        counts.withColumn("fold", F.explode(F.array(*[F.lit(y) for y in years])))
        .groupBy("fold", score)
        .agg(
            F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("n"),
            F.sum(F.when(own, 0).otherwise(F.col("pos"))).alias("pos"),
            F.max(own).alias("is_test"),
        )
        .withColumnRenamed("fold", "year")
    )
    folds = materialize(folds, "year-folds")
    knots = materialize(isotonic_knots(folds, ["year"], score), "year-knots")

    def read_off(year: int) -> DataFrame:
        others = folds.filter((F.col("year") == year) & (F.col("n") > 0))
        table = counts.filter(F.col("year") == year)
        table = apply_isotonic(table, _isotonic_from_knots(knots.filter(F.col("year") == year), score), score, "isotonic")
        return apply_sigmoid(table, _sigmoid_from_counts(others, score), score, "sigmoid")

    intervals = _with_point(venn_abers_intervals(folds, ["year"], score)).select(
        "year", score, F.col("point").alias("venn_abers"), "width"
    )
    table = reduce(DataFrame.unionByName, [read_off(y) for y in years]).join(intervals, ["year", score])
    table = materialize(table.withColumn("raw", F.col(score)), "year-calibrations")

    long = table.select(
        # Scores of one block may differ in the last bits after interpolation.
        "year", "n", "pos", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 12).alias("value")) for m in METHODS]))
    )
    by = ["year", "method"]
    judged = brier(long, "pos", "value", by, "n").join(top_bins(long, "pos", "value", by, weight="n"), by)
    wide = judged.groupBy("year").agg(
        *[F.max(F.when(F.col("method") == m, F.col("brier"))).alias(f"{m}_brier") for m in METHODS],
        *[F.max(F.when(F.col("method") == m, F.col("top_bin_ratio"))).alias(f"{m}_top_bin_ratio") for m in METHODS],
    )
    everything = counts.agg(F.sum("pos").alias("_all"))  # one row
    return (
        table.groupBy("year")
        .agg(F.sum("pos").alias("positives"), (F.sum(F.col("width") * F.col("n")) / F.sum("n")).alias("venn_abers_mean_interval_width"))
        .join(F.broadcast(everything))
        .withColumn("pooled_train_positives", F.col("_all") - F.col("positives"))
        .drop("_all")
        .join(wide, "year")
    )


def interval_check(report: DataFrame, sparse_years: Sequence[int]) -> DataFrame:
    """Mean interval width of the sparse and the other years, and the
    correlation of width with 1 / positives over all years."""
    width = F.col("venn_abers_mean_interval_width")
    flag = F.col("year").isin(*sparse_years)
    return report.agg(
        F.avg(F.when(flag, width)).alias("sparse_mean_width"),
        F.avg(F.when(~flag, width)).alias("other_mean_width"),
        F.corr(width, 1 / F.nullif(F.col("positives"), F.lit(0))).alias("width_vs_inverse_positives"),
    )


def pooled_reliability(scores: DataFrame, n_bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Reliability of one isotonic curve fitted on all years together."""
    counts = score_counts(scores, label, score)
    calibrated = apply_isotonic(counts, _isotonic_from_counts(counts, score), score, "calibrated")
    # Scores of one block differ in the last bits after interpolation.
    steps = calibrated.withColumn("calibrated", F.round("calibrated", 12))
    return reliability_table(steps, n_bins, "pos", "calibrated", weight="n")

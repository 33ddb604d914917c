"""Rolling-origin folds and the reports on their pooled scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.operators.calibrate import reliability_table, score_counts
from riskgrid.operators.metrics import brier, score_card
from riskgrid.operators.ranking import top_k_flag
from riskgrid.session import materialize


def rolling_origin_folds(
    df: DataFrame, years: Sequence[int] = K.HOLDOUT_YEARS, date_col: str = "date"
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(year, train, holdout): all earlier years against the year itself.

    Both are date filters on the same table, so they reach the scan and prune
    partitions.
    """
    for year in years:
        start, stop = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date")
        yield year, df.filter(F.col(date_col) < start), df.filter((F.col(date_col) >= start) & (F.col(date_col) < stop))


def fold_sizes(df: DataFrame, years: Sequence[int], label: str = "ignited", date_col: str = "date") -> DataFrame:
    """Rows and positives of the train and holdout part of every fold, in one
    pass: rows are counted per year, folds are summed from those few counts."""
    per_year = df.groupBy(F.year(date_col).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    folds = F.explode(F.filter(F.array(*[F.lit(y) for y in years]), lambda f: f >= F.col("y")))
    held = F.col("y") == F.col("year")
    return per_year.withColumn("year", folds).groupBy("year").agg(
        F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("holdout_rows"),
        F.coalesce(F.sum(F.when(held, F.col("p"))), F.lit(0)).alias("holdout_positives"),
    )


def all_but_year(scores: DataFrame, year: int) -> DataFrame:
    return scores.filter(F.col("year") != year)


def monthly_capture(
    scores: DataFrame, label: str = "label", score: str = "score", key: str = "row_key", fraction: float = 0.1, by: Sequence[str] = ("year",)
) -> DataFrame:
    """Positives and caught positives per month; months without any are absent.

    The cut-off is the group's own, over all its months.
    """
    flagged = top_k_flag(scores, score, key, fraction, by).filter(F.col(label) == 1)
    return (
        flagged.groupBy(*by, F.month("date").alias("month"))
        .agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("in_top"), 1)).alias("caught"))
        .withColumn("capture_rate", F.col("caught") / F.col("total"))
    )


def pooled_months(monthly: DataFrame) -> DataFrame:
    return (
        monthly.groupBy("month")
        .agg(F.sum("total").alias("total"), F.sum("caught").alias("caught"))
        .withColumn("capture_rate", F.col("caught") / F.col("total"))
    )


def yearly_summary(scores: DataFrame, label: str = "label", score: str = "score", key: str = "row_key") -> DataFrame:
    """Per year: metrics, Brier ratio, top-bin ratio and the July-August share.

    Rows are counted per year and score once; the Brier scores and the bins work
    on the counts.
    """
    counts = materialize(score_counts(scores, label, score, ["year"]), "yearly-counts")
    month = F.month("date")
    base = scores.groupBy("year").agg(
        F.sum(label).alias("positives"),
        F.sum(F.when(month.isin(7, 8), F.col(label)).otherwise(0)).alias("peak"),
    )
    return (
        base.join(score_card(scores, label, score, key, ["year"]), "year")
        .join(brier(counts, "pos", score, ["year"], "n"), "year")
        .join(top_bins(counts, "pos", score, ["year"], weight="n"), "year")
        .withColumn("jul_aug_fire_share", F.when(F.col("positives") > 0, F.col("peak") / F.col("positives")))
        .drop("peak")
    )


def top_bins(
    scores: DataFrame, label: str, score: str, by: Sequence[str], n_bins: int = 10, weight: str | None = None
) -> DataFrame:
    """The highest reliability bin of each group and its ratio, NULL where
    nothing was observed."""
    table = reliability_table(scores, n_bins, label, score, by, weight)
    top = table.groupBy(*by).agg(F.max(F.struct("bin", "mean_predicted", "observed_rate")).alias("t"))
    observed = F.col("t.observed_rate")
    return top.select(
        *by,
        F.col("t.mean_predicted").alias("top_bin_mean_predicted"),
        observed.alias("top_bin_observed_rate"),
        F.when(observed > 0, F.col("t.mean_predicted") / observed).alias("top_bin_ratio"),
    )


def same_day_buckets(
    scores: DataFrame, label: str = "label", score: str = "score", key: str = "row_key", by: Sequence[str] = ("year",)
) -> DataFrame:
    """Capture by how many positives fell on the same date.

    Positives and caught ones are counted per date before anything is joined,
    so a date with very many events is a single row.
    """
    positives = top_k_flag(scores, score, key, 0.1, by).filter(F.col(label) == 1)
    per_day = positives.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("fires"), F.count(F.when(F.col("in_top"), 1)).alias("caught")
    )
    n = F.col("fires")
    bucket = (
        F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").when(n <= 100, "51-100").otherwise("100+")
    )
    return (
        per_day.groupBy(*by, bucket.alias("bucket"))
        .agg(F.sum("fires").alias("fires"), F.sum("caught").alias("caught"))
        .withColumn("capture_rate", F.col("caught") / F.col("fires"))
    )


def same_day_count(events: DataFrame, date_col: str = "date", out: str = "same_day") -> DataFrame:
    """Attach to each event the number of events on its date, by a per-date
    count (a row per calendar day) joined back."""
    return events.join(events.groupBy(date_col).agg(F.count(F.lit(1)).alias(out)), date_col)


def caught_vs_missed(
    scores: DataFrame, features: Sequence[str], label: str = "label", score: str = "score", key: str = "row_key", by: Sequence[str] = ()
) -> DataFrame:
    """Mean feature values of the positives inside and outside the top share."""
    positives = top_k_flag(scores, score, key, 0.1, by).filter(F.col(label) == 1)
    return positives.groupBy(*by, F.col("in_top").alias("caught")).agg(
        F.count(F.lit(1)).alias("fires"), *[F.avg(f).alias(f"mean_{f}") for f in features]
    )


def relative_risk(scored: DataFrame, score: str = "score", date_col: str = "date") -> DataFrame:
    """Score over the highest score of its date; the maxima are a row per
    calendar day, so a date is never gathered in one task."""
    peaks = scored.groupBy(date_col).agg(F.max(score).alias("_peak"))
    return scored.join(peaks, date_col).withColumn("relative_risk", F.col(score) / F.nullif("_peak", F.lit(0.0))).drop("_peak")


def extreme_examples(scores: DataFrame, pool: DataFrame, label: str = "label", score: str = "score", key: str = "row_key") -> DataFrame:
    """The highest-scored fire, non-fire and missed fire of `pool`; missed means
    below the 90% quantile of all `scores`."""
    from riskgrid.operators.ranking import quantiles

    cut = quantiles(scores, score, [0.9]).select(F.col("q")[0].alias("_cut"))  # one row
    # The largest score, and among equals the smallest key.
    best = F.struct(F.col(score).alias("score"), (-F.col(key)).alias("k"))
    fire = F.col(label) == 1
    picked = pool.join(F.broadcast(cut)).agg(
        F.max(F.when(fire, best)).alias("highest_scored_actual_fire"),
        F.max(F.when(~fire, best)).alias("highest_scored_non_fire"),
        F.max(F.when(fire & (F.col(score) < F.col("_cut")), best)).alias("highest_scored_missed_fire"),
    )
    names = picked.columns
    rows = F.array(*[F.struct(F.lit(n).alias("example"), F.col(n).alias("b")) for n in names])
    return picked.select(F.inline(rows)).select("example", (-F.col("b.k")).alias(key), F.col("b.score").alias(score))

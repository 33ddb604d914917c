"""Rare-event metrics on score tables (label, score, and grouping columns).

`by` gives one row per group, so all folds or splits are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.ranking import _attach, cut_of_ladder, running_totals, tied_rows, value_counts


def score_ladder(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores from high to low with counts and positives ahead of each."""
    counts = value_counts(df, score, {"pos": F.col(label).cast("long")}, by)
    return running_totals(counts, score, ["n", "pos"], by, descending=True)


def _precision_steps():
    through_pos = F.col("pos_before") + F.col("pos")
    through_n = F.col("n_before") + F.col("n")
    gain = F.sum(F.col("pos") * through_pos / through_n)
    return F.when(F.max("pos_all") > 0, gain / F.max("pos_all"))


def _pairs_won():
    negatives = F.col("n") - F.col("pos")
    below = (F.col("n_all") - F.col("pos_all")) - (F.col("n_before") - F.col("pos_before")) - negatives
    won = F.sum(F.col("pos") * (below + negatives / 2))
    pairs = F.max("pos_all") * (F.max("n_all") - F.max("pos_all"))
    return F.when(pairs > 0, won / pairs)


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision; NULL without positives."""
    return score_ladder(df, label, score, by).groupBy(*by).agg(_precision_steps().alias("pr_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with one class."""
    return score_ladder(df, label, score, by).groupBy(*by).agg(_pairs_won().alias("roc_auc"))


def top_k_capture(
    df: DataFrame, label: str = "label", score: str = "score", key: str = "row_key", fraction: float = 0.1, by: Sequence[str] = ()
) -> DataFrame:
    """Share of the positives inside the top share; NULL without positives."""
    return _capture(df, score_ladder(df, label, score, by), label, score, key, fraction, by)


def _capture(df, ladder, label, score, key, fraction, by) -> DataFrame:
    """The ladder counts the positives above the cut-off score; only the rows
    tied at it are looked at once more."""
    cut = cut_of_ladder(ladder, score, fraction, by, ["pos_before", "pos_all"])
    tied = tied_rows(df.select(*by, score, key, label), cut, score, by)
    counts = tied.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("p"),
        *[F.max(c).alias(c) for c in ("need", "pos_before", "pos_all")],
    )
    taken = F.when(F.col("n_before") < F.col("need"), F.col("p")).otherwise(0)
    caught = F.max("pos_before") + F.sum(taken)
    ranked = running_totals(counts, key, ["n"], by)
    return ranked.groupBy(*by).agg(F.when(F.max("pos_all") > 0, caught / F.max("pos_all")).alias("capture"))


def brier(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Brier score, the floor a constant base rate reaches, and their ratio.

    With `weight`, a row stands for that many rows of which `label` are positive.
    Rows without a score count in neither.
    """
    df = df.filter(F.col(score).isNotNull())
    s, y = F.col(score), F.col(label)
    if weight is None:
        rate, loss = F.avg(y), F.avg((s - y) * (s - y))
    else:
        n = F.col(weight)
        rate = F.sum(y) / F.sum(n)
        loss = F.sum(y * (1 - s) * (1 - s) + (n - y) * s * s) / F.sum(n)
    return (
        df.groupBy(*by)
        .agg(loss.alias("brier"), (rate * (1 - rate)).alias("brier_floor"))
        .withColumn("brier_ratio", F.when(F.col("brier_floor") > 0, F.col("brier") / F.col("brier_floor")))
    )


def score_card(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    key: str = "row_key",
    by: Sequence[str] = (),
    fraction: float = 0.1,
) -> DataFrame:
    """pr_auc, roc_auc and top_10pct_capture for any label column."""
    ladder = score_ladder(df, label, score, by)
    ranks = ladder.groupBy(*by).agg(_precision_steps().alias("pr_auc"), _pairs_won().alias("roc_auc"))
    capture = _capture(df, ladder, label, score, key, fraction, by).withColumnRenamed("capture", "top_10pct_capture")
    return _attach(ranks, capture, by, "inner")

"""Which inputs a model leans on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.learn.models import predict
from riskgrid.operators.metrics import average_precision
from riskgrid.operators.ranking import running_totals, value_counts
from riskgrid.session import materialize


def impurity_importance(model: PipelineModel) -> DataFrame:
    """Mean impurity decrease per input, largest first."""
    from pyspark.sql import SparkSession

    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, map(float, values)), key=lambda pair: -pair[1])
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def _positions(df: DataFrame, order: str, out: str) -> DataFrame:
    """Row numbers from 0 along `order`, without a global sort in one task."""
    before = running_totals(value_counts(df, order), order, ["n"]).select(order, F.col("n_before").alias("_b"))
    ties = F.row_number().over(Window.partitionBy(order).orderBy("_key")) - 1
    return df.join(before, order).withColumn(out, F.col("_b") + ties).drop("_b")


def _partners(numbered: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, partner): a permutation of all keys, the same on every run.

    `numbered` has the keys and their places in key order; a second numbering,
    by a hash of the key, is joined to it.
    """
    drawn = numbered.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h"))
    given = _positions(drawn, "_h", "_at").select("_at", F.col("_key").alias("partner"))
    return numbered.join(given, "_at").select(key, "partner")


def _numbered(df: DataFrame, key: str) -> DataFrame:
    return _positions(df.select(key, F.col(key).alias("_key")), key, "_at").select(key, "_at")


def shuffle_column(df: DataFrame, column: str, key: str = "row_key", seed: int = 0) -> DataFrame:
    """`df` with one column permuted over all rows, the same on every run."""
    given = df.select(F.col(key).alias("partner"), F.col(f"`{column}`").alias("_value"))
    permuted = _partners(_numbered(df, key), key, seed).join(given, "partner").select(key, F.col("_value").alias(column))
    return df.drop(column).join(permuted, key).select(*[F.col(f"`{c}`") for c in df.columns])


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    label: str = "ignited",
    key: str = "row_key",
    repeats: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Loss of average precision when one column is permuted.

    Keys are ranked once, their hashes once per repeat; a repeat pairs each row
    with its partner's inputs, and every column is then permuted by taking it
    from the partner.  All columns and repeats are judged together.
    """
    spark = df.sparkSession
    inputs = list(model.stages[0].getInputCols())
    rows = materialize(df.select(key, label, *[F.col(f"`{c}`") for c in inputs]), "permuted-rows")

    def precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return average_precision(scored, label, "score", by)

    whole = precision(materialize(predict(model, rows).select(label, "score"), "scored")).first()["pr_auc"]
    numbered = materialize(_numbered(rows, key), "permuted-places")
    taken = rows.select(F.col(key).alias("partner"), *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(inputs) if c in features])
    paired = None
    for repeat in range(repeats):
        part = rows.join(_partners(numbered, key, seed + repeat), key).join(taken, "partner").withColumn("repeat", F.lit(repeat))
        paired = part if paired is None else paired.unionByName(part)
    paired = materialize(paired, "permuted-pairs")
    scored = None
    for column in features:
        moved = [F.col(f"_p{i}" if c == column else f"`{c}`").alias(c) for i, c in enumerate(inputs)]
        part = predict(model, paired.select("repeat", label, *moved)).select(F.lit(column).alias("feature"), "repeat", label, "score")
        scored = part if scored is None else scored.unionByName(part)
    drop = F.lit(whole) - F.col("pr_auc")
    found = precision(materialize(scored, "permuted-scores"), ["feature", "repeat"]).groupBy("feature").agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std")
    )
    return spark.createDataFrame(found.orderBy(F.desc("importance_mean")).collect(), "feature string, importance_mean double, importance_std double")

"""Class-weighted classifiers and their scores.

Every `fit_*` takes a training frame and returns a PipelineModel that finds
its inputs by name, so the column order of a frame does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.learn.descent import descend
from riskgrid.operators.metrics import score_card
from riskgrid.operators.profile import class_ratio, with_class_weights
from riskgrid.session import materialize

MAX_BINS = 128


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return _assembler(features, out).transform(df)


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def _weighted(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Only what a fit reads: inputs, label as double, balanced weight."""
    slim = train.select(*[F.col(f"`{c}`") for c in features], F.col(label).cast("double").alias("_label"))
    return with_class_weights(slim, "_label", "_weight")


@dataclass(frozen=True)
class PriorModel:
    """Predicts 1 at the training rate, at random but the same on every run."""

    prior: float
    seed: int = 0

    def predict(self, df: DataFrame, key: str = "row_key", out: str = "score") -> DataFrame:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), key)), 1, 8), 16, 10).cast("long") / float(1 << 32)
        return df.withColumn(out, (draw < self.prior).cast("double"))


def fit_dummy(train: DataFrame, label: str = "ignited", seed: int = 0) -> PriorModel:
    return PriorModel(train.agg(F.avg(label)).first()[0], seed)


def fit_logistic(
    train: DataFrame, features: Sequence[str] = K.SERVED_FEATURES, label: str = "ignited", max_iter: int = 1000
) -> PipelineModel:
    """Standardised inputs, balanced weights, unit L2 penalty."""
    rows = _weighted(train, features, label)
    total = train.filter(F.col(label).isNotNull()).count()  # the balanced weights add up to the rows
    stages = [
        _assembler(features, "_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            labelCol="_label", weightCol="_weight", regParam=1.0 / total, standardization=False, maxIter=max_iter
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = K.SERVED_FEATURES,
    label: str = "ignited",
    n_estimators: int = 100,
    max_depth: int = 6,
    max_features: float | str = "sqrt",
    min_samples_leaf: int = 1,
    seed: int = 0,
    bootstrap: bool = True,
) -> PipelineModel:
    """Forest with balanced class weights.

    More memory per round of split finding means fewer passes over the data.
    With a single input, no bootstrap and leaves of any size, rows of equal
    input and label go in as one of their weight: the same splits, on as many
    rows as there are values, and all of them are seen as possible cuts.
    """
    rows = _weighted(train, features, label)
    if len(features) == 1 and not bootstrap and min_samples_leaf == 1:
        rows = rows.groupBy(F.col(f"`{features[0]}`"), "_label").agg(F.sum("_weight").alias("_weight"))
    forest = RandomForestClassifier(
        labelCol="_label",
        weightCol="_weight",
        numTrees=n_estimators,
        maxDepth=max_depth,
        featureSubsetStrategy=str(max_features),
        minInstancesPerNode=min_samples_leaf,
        maxBins=MAX_BINS,
        maxMemoryInMB=1024,
        bootstrap=bootstrap,
        seed=seed,
    )
    return Pipeline(stages=[_assembler(features), forest]).fit(rows)


def fit_boosted(
    train: DataFrame,
    features: Sequence[str] = K.SERVED_FEATURES,
    label: str = "ignited",
    n_estimators: int = 100,
    max_depth: int = 6,
    learning_rate: float = 0.1,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    seed: int = 0,
) -> PipelineModel:
    """Boosted trees; positives weigh negatives / positives of this very fold."""
    slim = train.select(*[F.col(f"`{c}`") for c in features], F.col(label).cast("double").alias("_label"))
    ratio = class_ratio(train, label).select("scale_pos_weight")  # one row
    rows = slim.join(F.broadcast(ratio)).withColumn("_weight", F.when(F.col("_label") == 1, F.col("scale_pos_weight")).otherwise(1.0))
    boosted = GBTClassifier(
        labelCol="_label",
        weightCol="_weight",
        maxIter=n_estimators,
        maxDepth=max_depth,
        stepSize=learning_rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(float(colsample_bytree)) if colsample_bytree < 1 else "all",
        maxBins=MAX_BINS,
        maxMemoryInMB=1024,
        seed=seed,
    )
    return Pipeline(stages=[_assembler(features), boosted]).fit(rows.drop("scale_pos_weight"))


def fit_sequences(
    train: DataFrame, label: str = "ignited", column: str = "sequence", hidden: int = 16, max_iter: int = 50, seed: int = 0
) -> PipelineModel:
    """A small network on the flattened raw history, each step standardised.

    Positives weigh the class ratio, as a whole number.  The learner of
    `pyspark.ml` would keep all histories stacked, in memory or on disk; here
    every step of the search is a pass over `train` that keeps none and adds up
    the gradient.  Start, loss and search are those of that learner, whose
    model is given the weights that are found.
    """
    rows = train.select(F.flatten(column).alias("_raw"), F.col(label).cast("int").alias("_label"))
    return _fit_network(rows, _whole, class_ratio(train, label), hidden, max_iter, seed)


def fit_runs(
    runs: DataFrame, used: Callable[[Column], Column], length: int = K.SEQUENCE_LENGTH, label: str = "ignited", hidden: int = 16, max_iter: int = 50, seed: int = 0, date_col: str = "date"
) -> PipelineModel:
    """`fit_sequences` on the histories of the runs (`features.build_runs`) that end on a day for which `used` holds.

    A pass reads each day once, and histories are cut out of their run where the
    gradient is added up; so the days and labels are written as bytes, once.
    """
    days = F.arrays_zip(F.col(date_col).alias("d"), F.col(label).alias("y"))
    kept = runs.select("_step", F.transform(days, lambda x, i: F.when((i >= length - 1) & used(x["d"]), x["y"].cast("int"))).alias("_labels"))
    labels = kept.select(F.explode("_labels").alias(label)).filter(F.col(label).isNotNull())
    channels = runs.select(F.size(F.get("_step", F.lit(0)))).first()[0]
    packed = materialize(kept.filter(F.exists("_labels", lambda y: y.isNotNull())).mapInArrow(_packed, "_days binary, _at binary, _label binary"), "packed-runs")
    return _fit_network(packed, partial(_windows, length, channels), class_ratio(labels, label), hidden, max_iter, seed)


# Inputs (a row each) and labels of a batch, in parts.
Cut = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]
WINDOW_ROWS = 2_048  # histories that are cut out at a time


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if batch.num_rows:
        inputs = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        yield inputs, batch.column(1).to_numpy(zero_copy_only=False)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run its steps (float), the days that end a history, and their labels, as bytes."""
    for batch in batches:
        found = []
        for days, labels in zip(batch.column(0), batch.column(1)):
            y = labels.values.to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.flatnonzero(~np.isnan(y))
            steps = days.values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            found.append((steps.tobytes(), at.astype(np.int32).tobytes(), y[at].astype(np.int8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in range(3)], ["_days", "_at", "_label"])


def _windows(length: int, channels: int, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The histories of packed runs, laid end to end: one is `length` days that stand together."""
    days, ends, labels = [[np.frombuffer(v.as_py(), t) for v in batch.column(k)] for k, t in enumerate((np.float32, np.int32, np.int8))]
    if not days:
        return
    flat = np.concatenate(days).astype(np.float64)
    first = np.cumsum([0, *(len(d) // channels for d in days[:-1])])
    at, y = np.concatenate([e + f for e, f in zip(ends, first)]) - (length - 1), np.concatenate(labels)
    rows = np.lib.stride_tricks.sliding_window_view(flat, length * channels)[::channels]
    for start in range(0, len(at), WINDOW_ROWS):
        part = slice(start, start + WINDOW_ROWS)
        yield rows[at[part]], y[part]


def _fit_network(rows: DataFrame, cut: Cut, classes: DataFrame, hidden: int, max_iter: int, seed: int) -> PipelineModel:
    ratio = max(int(round(classes.first()["scale_pos_weight"])), 1)
    origin = _first_inputs(rows, cut)
    width = len(origin)
    n, total, squares = np.split(sums_of_rows(rows, cut, partial(_moments, ratio, origin)), [1, 1 + width])
    mean = origin + total / n
    spread = np.sqrt(np.maximum(squares - total * total / n, 0) / np.maximum(n - 1, 1))
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)

    def loss_and_gradient(weights: np.ndarray) -> tuple[float, np.ndarray]:
        found = sums_of_rows(rows, cut, partial(_network_gradient, weights, hidden, mean, scale, ratio))
        return found[1] / found[0], found[2:] / found[0]

    start = _network(rows.sparkSession, [width, hidden, 2], seed).weights.toArray()
    weights = descend(loss_and_gradient, start, max_iter)
    # The standardised input is an affine function of the raw one, and goes into the first layer.
    own, rest = weights[: width * hidden].reshape(width, hidden) * scale[:, None], weights[width * hidden :].copy()
    rest[:hidden] -= mean @ own
    return PipelineModel([_network(rows.sparkSession, [width, hidden, 2], seed, np.concatenate([own.ravel(), rest]))])


def _network(spark: SparkSession, layers: list[int], seed: int, weights: np.ndarray | None = None):
    """The network of `pyspark.ml` with these weights, or those that it starts from: fitted in no steps on a row a class."""
    learner = MultilayerPerceptronClassifier(featuresCol="_raw", labelCol="_label", layers=layers, maxIter=0, seed=seed)
    if weights is not None:
        learner.setInitialWeights(Vectors.dense(weights))
    return learner.fit(spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(y)) for y in (0, 1)], ["_raw", "_label"]))


def sums_of_rows(rows: DataFrame, cut: Cut, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all batches of what `of` makes of their (inputs, labels); added up where the rows are first."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for inputs, labels in cut(batch):
                total = total + of(inputs, labels)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(add_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in found])


def _first_inputs(rows: DataFrame, cut: Cut) -> np.ndarray:
    """The inputs of one row, any: moments are taken about them."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = next((inputs[0] for batch in batches for inputs, _ in cut(batch) if len(inputs)), None)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.list_(pa.float64()))], ["v"])

    return np.array(rows.limit(1).mapInArrow(first, "v array<double>").first()["v"])


def _copies(labels: np.ndarray, ratio: int) -> np.ndarray:
    return np.where(labels == 1, ratio, 1)


def _moments(ratio: int, origin: np.ndarray, inputs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    off, copies = inputs - origin, _copies(labels, ratio)
    return np.concatenate([[copies.sum()], copies @ off, copies @ (off * off)])


def _network_gradient(
    weights: np.ndarray, hidden: int, mean: np.ndarray, scale: np.ndarray, ratio: int, inputs: np.ndarray, labels: np.ndarray
) -> np.ndarray:
    """Rows, cross entropy and its gradient for one sigmoid layer and two softmax outputs; a layer's weights go input by input, biases last.

    Inputs are standardised in the first layer's weights, not one by one."""
    cut, copies = inputs.shape[1] * hidden, _copies(labels, ratio)
    own = weights[:cut].reshape(-1, hidden) * scale[:, None]
    inner = 1 / (1 + np.exp(-(inputs @ own + (weights[cut : cut + hidden] - mean @ own))))
    outer = weights[cut + hidden : -2].reshape(hidden, 2)
    z = inner @ outer + weights[-2:]
    z -= z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    off = np.exp(log_p)
    off[np.arange(len(off)), labels] -= 1
    off *= copies[:, None]
    back = off @ outer.T * inner * (1 - inner)
    loss = -(copies * log_p[np.arange(len(off)), labels]).sum()
    first = scale[:, None] * (inputs.T @ back - np.outer(mean, back.sum(0)))
    return np.concatenate([[copies.sum(), loss], first.ravel(), back.sum(0), (inner.T @ off).ravel(), off.sum(0)])


def flatten_sequences(df: DataFrame, column: str = "sequence") -> DataFrame:
    return df.withColumn("_raw", array_to_vector(F.flatten(column).cast("array<double>")))


def predict(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the probability of class 1 and nothing else."""
    if isinstance(model, PriorModel):
        return model.predict(df, out=out)
    scored = model.transform(df)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array("probability")[1].alias(out))


def evaluate(model, df: DataFrame, label: str = "ignited", key: str = "row_key") -> dict[str, float | None]:
    """pr_auc, roc_auc and top_10pct_capture as plain numbers.

    The scores are written first: the metrics read them several times, and the
    model should run once."""
    scored = materialize(predict(model, df).select(key, label, "score"), "scored")
    return score_card(scored, label, "score", key).first().asDict()

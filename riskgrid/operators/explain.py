"""Additive per-row attributions for forests.

Interventional Shapley values have a closed form per leaf.  For a row x and a
background row b, let A be the path features whose interval x meets and b does
not, B the reverse.  A leaf with a feature met by neither contributes nothing;
otherwise each feature of A gains v (|A|-1)! |B|! / (|A|+|B|)! and each of B
loses v |A|! (|B|-1)! / (|A|+|B|)!.  The mean over the background is the
attribution, in units of probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.operators.ranking import seeded_sample
from riskgrid.session import scratch_path

TOLERANCE = 1e-4


def leaf_table(spark: SparkSession, model: PipelineModel) -> pd.DataFrame:
    """(tree, leaf, feature, lo, hi, value): one row per leaf and path feature,
    repeated splits on a feature merged into one interval (lo, hi].

    The nodes come from the forest's own saved table; the walk covers the
    model, whose size does not depend on the data.
    """
    path = scratch_path(spark, "forest")
    model.stages[-1].write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    trees = nodes["treeID"].nunique()
    rows = []
    for tree, group in nodes.groupby("treeID"):
        by_id = {n.id: n for n in group.itertuples()}
        pending = [(0, {})]
        while pending:
            node_id, bounds = pending.pop()
            node = by_id[node_id]
            if node.leftChild < 0:
                value = float(node.impurityStats[1] / sum(node.impurityStats) / trees)
                spans = bounds or {0: (-np.inf, np.inf)}
                rows += [(int(tree), int(node_id), f, float(lo), float(hi), value) for f, (lo, hi) in spans.items()]
                continue
            feature, cut = node.split["featureIndex"], node.split["leftCategoriesOrThreshold"][0]
            lo, hi = bounds.get(feature, (-np.inf, np.inf))
            pending.append((node.leftChild, {**bounds, feature: (lo, min(hi, cut))}))
            pending.append((node.rightChild, {**bounds, feature: (max(lo, cut), hi)}))
    return pd.DataFrame(rows, columns=["tree", "leaf", "feature", "lo", "hi", "value"])


class _Leaf:
    """One leaf's intervals, and the patterns that background rows make there."""

    def __init__(self, rows: pd.DataFrame):
        self.features = rows["feature"].to_numpy()
        self.lo, self.hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
        self.value = rows["value"].iloc[0]
        self.bits = 1 << np.arange(len(rows))

    def pattern(self, columns: np.ndarray) -> np.ndarray:
        """Bits of the intervals that each row meets; `columns` has a row per feature."""
        out = np.zeros(columns.shape[1], dtype=np.int64)
        for f, lo, hi, bit in zip(self.features, self.lo, self.hi, self.bits):
            out += ((columns[f] > lo) & (columns[f] <= hi)) * bit
        return out

    def contributions(self, patterns: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        x, b = patterns[:, None], self.patterns[None, :]
        full = int(self.bits.sum())
        only_x = ((x & ~b)[..., None] & self.bits) > 0
        only_b = ((b & ~x)[..., None] & self.bits) > 0
        n_x, n_b = only_x.sum(-1), only_b.sum(-1)
        reached = ((x | b) == full) * self.share * self.value
        gain, loss = weights[0][n_x, n_b] * reached, weights[1][n_x, n_b] * reached
        return (only_x * gain[..., None] - only_b * loss[..., None]).sum(1)


def _weight_tables(depth: int) -> tuple[np.ndarray, np.ndarray]:
    gain, loss = np.zeros((depth + 1, depth + 1)), np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1 - a):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return gain, loss


def _leaves(table: pd.DataFrame) -> list[_Leaf]:
    return [_Leaf(group) for _, group in table.groupby(["tree", "leaf"], sort=True)]


def _with_background(leaves: list[_Leaf], vectors: DataFrame) -> tuple[list[_Leaf], int]:
    """The leaves with the patterns of all background rows, and the rows.

    Patterns are counted where the rows are and summed by leaf and pattern.  A
    leaf has two to the power of its depth at most, so what reaches the driver
    is bounded by the model, not by the background.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            columns = np.ascontiguousarray(np.array(batch["inputs"].tolist()).T)
            for k, leaf in enumerate(leaves):
                if len(batch):
                    n = np.bincount(leaf.pattern(columns))
                    seen.update({(k, int(p)): int(n[p]) for p in np.flatnonzero(n)})
        yield pd.DataFrame([(*at, n) for at, n in seen.items()], columns=["leaf", "pattern", "n"])

    found = vectors.mapInPandas(count, "leaf int, pattern long, n long").groupBy("leaf", "pattern").agg(F.sum("n").alias("n")).toPandas()
    rows = int(found.loc[found["leaf"] == 0, "n"].sum())
    if not rows:
        raise ValueError("the background has no rows")
    for k, group in found.sort_values(["leaf", "pattern"]).groupby("leaf"):
        leaves[k].patterns, leaves[k].share = group["pattern"].to_numpy(), group["n"].to_numpy() / rows
    return leaves, rows


def attributions(
    model: PipelineModel, rows: DataFrame, background: DataFrame, key: str = "row_key"
) -> DataFrame:
    """Long table (key, feature, value, contribution, base) for every row.

    The leaves with their pattern counts are sent to the workers once; rows and
    background stay distributed, whatever their number.  A row whose parts do
    not add up to its score stops the job.
    """
    spark = rows.sparkSession
    features = model.stages[0].getInputCols()
    base = float(model.transform(background).agg(F.avg(vector_to_array("probability")[1])).first()[0] or 0.0)
    leaves, _ = _with_background(_leaves(leaf_table(spark, model)), _inputs(model, background).select(vector_to_array("features").alias("inputs")))
    held = spark.sparkContext.broadcast(leaves)
    width = len(features)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = held.value
        weights = _weight_tables(max(len(p.features) for p in parts))
        # A leaf's contributions by pattern, of which it has two to the power of its depth at most.
        tables = [np.full((2 ** len(p.features), len(p.features)), np.nan) for p in parts]
        for batch in batches:
            x = np.array(batch["inputs"].tolist()).reshape(-1, width)
            columns, out = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
            for leaf, table in zip(parts, tables):
                at = leaf.pattern(columns)
                new = [p for p in np.flatnonzero(np.bincount(at)) if np.isnan(table[p, 0])]
                if new:
                    table[new] = leaf.contributions(np.array(new), weights)
                for i, f in enumerate(leaf.features):
                    out[f] += table[at, i]
            out = np.ascontiguousarray(out.T)
            off = np.abs(out.sum(1) + base - batch["score"].to_numpy())
            if len(off) and off.max() > TOLERANCE:
                raise ValueError(f"attributions miss the score by {off.max():.6f}")
            yield pd.DataFrame({key: batch[key], "inputs": batch["inputs"], "parts": list(out)})

    scored = model.transform(rows).select(
        key, vector_to_array("features").alias("inputs"), vector_to_array("probability")[1].alias("score")
    )
    key_type = dict(rows.dtypes)[key]
    wide = scored.mapInPandas(explain, f"{key} {key_type}, inputs array<double>, parts array<double>")
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("inputs").alias("value"), F.col("parts").alias("contribution"))
    return wide.select(key, F.inline(named)).toDF(key, "feature", "value", "contribution").withColumn("base", F.lit(base))


def _inputs(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.stages[0].transform(df)


def mean_abs(parts: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def conditional_mean_abs(parts: DataFrame, feature: str) -> DataFrame:
    """The same for one feature, where it is zero and where it is above."""
    one = parts.filter(F.col("feature") == feature)
    return one.groupBy((F.col("value") > 0).alias("nonzero")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs("contribution")).alias("mean_abs")
    )


def top_contributions(parts: DataFrame, n: int = 5, key: str = "row_key") -> DataFrame:
    """The n largest contributions of each row by size; a row has one entry
    per feature, so its window is as short as the feature list."""
    order = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def example_pool(df: DataFrame, label: str = "ignited", key: str = "row_key", negatives: int | None = None, seed: int = 0) -> DataFrame:
    """All positives and all negatives, or a seeded sample of so many negatives where a number is given."""
    if negatives is None:
        return df.filter(F.col(label).isin(0, 1))
    return df.filter(F.col(label) == 1).unionByName(seeded_sample(df.filter(F.col(label) == 0), negatives, key, seed))


def training_background(
    df: DataFrame, train_end: str = K.TRAIN_END, n: int = K.BACKGROUND_ROWS, key: str = "row_key", seed: int = 0
) -> DataFrame:
    """Seeded sample of season rows before `train_end`, at most `n`."""
    from riskgrid.operators.labels import season_rows

    return seeded_sample(season_rows(df).filter(F.col("date") < F.lit(train_end).cast("date")), n, key, seed)

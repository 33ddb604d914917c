"""A model stored with what scoring needs: inputs, metadata, calibrator."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.learn.models import predict
from riskgrid.operators.calibrate import apply_isotonic


@dataclass
class Bundle:
    model: PipelineModel
    feature_columns: list[str]
    metadata: dict[str, Any] = field(default_factory=dict)
    calibrator: IsotonicRegressionModel | None = None

    def score(self, df: DataFrame, out: str = "score", calibrated: str = "calibrated") -> DataFrame:
        """Add the raw and the calibrated probability; the latter is NULL
        without a calibrator."""
        scored = predict(self.model, df, out)
        if self.calibrator is None:
            return scored.withColumn(calibrated, F.lit(None).cast("double"))
        return apply_isotonic(scored, self.calibrator, out, calibrated)


def save_bundle(bundle: Bundle, path: str) -> None:
    spark = SparkSession.active()
    bundle.model.write().overwrite().save(f"{path}/model")
    if bundle.calibrator is not None:
        bundle.calibrator.write().overwrite().save(f"{path}/calibrator")
    record = json.dumps(
        {"feature_columns": list(bundle.feature_columns), "metadata": bundle.metadata, "calibrated": bundle.calibrator is not None}
    )
    spark.createDataFrame([(record,)], "record string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    record = json.loads(spark.read.parquet(f"{path}/metadata").first()["record"])
    calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if record["calibrated"] else None
    return Bundle(PipelineModel.load(f"{path}/model"), record["feature_columns"], record["metadata"], calibrator)

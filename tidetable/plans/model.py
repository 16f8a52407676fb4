"""Delay model: boosted trees on absolute error, with intervals from held-out residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import interval_clamp, lead_bucket
from ..operators.metrics import errors, intervals
from . import baselines


def train(rows: DataFrame, *, rounds: int = 60, depth: int = 5, rate: float = 0.1, late_weight: float = 1.0, validation: str | None = None, target: str = "delay_seconds") -> PipelineModel:
    """rows: a feature table with its target. validation: a boolean column of rows that only decide when to stop."""
    coded = baselines.encode(rows).withColumn("_weight", baselines.sample_weight(target, late_weight))
    inputs = [c for c in coded.columns if c.startswith("x_")]
    trees = GBTRegressor(featuresCol="x", labelCol=target, weightCol="_weight", lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=7, predictionCol="predicted_delay_seconds")
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="x"), trees]).fit(coded)


def residual_quantiles(scored: DataFrame, quantiles: Sequence[float] = (0.1, 0.9), target: str = "delay_seconds") -> DataFrame:
    """Per lead bucket, quantiles of what held-out predictions were off by (a row for each bucket)."""
    off = F.col(target) - F.col("predicted_delay_seconds")
    rows = scored.withColumn("lead_bucket", F.coalesce(lead_bucket("prediction_lead_minutes"), F.lit("none")))
    return rows.groupBy("lead_bucket").agg(F.percentile(off, F.lit(min(quantiles))).alias("_low"), F.percentile(off, F.lit(max(quantiles))).alias("_high"))


def predict(model: PipelineModel, rows: DataFrame, residuals: DataFrame | None = None) -> DataFrame:
    """predicted_delay_seconds, and its interval where residuals are given (never without the point in it)."""
    out = model.transform(baselines.encode(rows)).drop("x", "rawPrediction")
    out = out.drop(*(c for c in out.columns if c.startswith("x_")))
    if residuals is None:
        return out
    p = F.col("predicted_delay_seconds")
    out = out.withColumn("lead_bucket", F.coalesce(lead_bucket("prediction_lead_minutes"), F.lit("none"))).join(F.broadcast(residuals), "lead_bucket", "left")  # a row for each of six buckets
    lower, upper = interval_clamp(p, p + F.coalesce("_low", F.lit(0.0)), p + F.coalesce("_high", F.lit(0.0)))
    return out.withColumns({"predicted_delay_lower_seconds": lower, "predicted_delay_upper_seconds": upper}).drop("_low", "_high")


def importance(model: PipelineModel) -> list[tuple[str, float]]:
    """What share of the trees' gain each input has, the largest first."""
    names = model.stages[0].getInputCols()
    return sorted(zip((n.removeprefix("x_") for n in names), map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, residuals: DataFrame | None, root: str, *, overwrite: bool = False) -> None:
    """The model, and the residual quantiles of its intervals, under one folder."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(f"{root}/model")
    if residuals is not None:
        residuals.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/residuals")  # a row for each lead bucket


def load(spark: SparkSession, root: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{root}/model"), spark.read.parquet(f"{root}/residuals")


def evaluation(scored: DataFrame, target: str = "delay_seconds") -> dict[str, dict[str, float]]:
    """Errors on rows with a prediction, and where the rows have one of the feed's own; coverage where there are intervals."""
    told = {"model": "predicted_delay_seconds", "feed": "feed_delay_seconds"}
    out = {name: scored.where(F.col(c).isNotNull() & F.col(target).isNotNull()).agg(*errors(c, target)).first().asDict() for name, c in told.items() if c in scored.columns}
    if "predicted_delay_lower_seconds" in scored.columns:
        out["interval"] = scored.agg(*intervals("predicted_delay_lower_seconds", "predicted_delay_upper_seconds", target)).first().asDict()
    return out


def report(found: dict[str, dict[str, float]], gains: Sequence[tuple[str, float]], n: int = 20) -> str:
    """The evaluation as text: a section for each part, then the n most important inputs."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [line for name, values in found.items() for line in (f"## {name}", "", *(f"- {k}: {cell(v)}" for k, v in values.items()), "")]
    return "\n".join([*lines, "## importance", "", *(f"- {name}: {share:.4f}" for name, share in gains[:n]), ""])

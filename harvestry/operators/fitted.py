"""R1–R8 with the models that training produced.

The what-if operators of ``scoring`` take any object with ``predict(features) ->
Column``. ``load_scorer`` makes one of a saved model:

* a linear pipeline becomes a ``LinearModel`` of its coefficients: one generated
  expression, whose SQL twin is ``predict_sql``;
* saved trees become a ``TreeScorer``: the 36 features of each exploded candidate
  go to the trees in Arrow batches. The candidates are made and ranked by the same
  generators and aggregates as with a linear model, so plans keep their shuffles.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.operators.scoring import LinearModel, scenario_features
from harvestry.operators.trees import StoredForest, TreeModel


class TreeScorer:
    """Fitted trees as a scoring model over the named features, in training order."""

    def __init__(self, model: TreeModel, features: list[str] | None = None):
        self.model, self.features = model, features or D.FEATURES

    def predict(self, feats: dict[str, Column], clip: bool = True) -> Column:
        p = self.model.score([feats[f] for f in self.features])
        return F.greatest(p, F.lit(0.0)) if clip else p


def linear_of(model: PipelineModel, features: list[str] | None = None) -> LinearModel:
    """A fitted linear pipeline (with or without a standard scaler before it) as coefficients on the raw features."""
    names, last = features or D.FEATURES, model.stages[-1]
    if not hasattr(last, "coefficients"):
        raise ValueError(f"{type(last).__name__} is not a linear model; save tree models with TreeModel.save")
    means, stds = [0.0] * len(names), [1.0] * len(names)
    for stage in model.stages[:-1]:
        if hasattr(stage, "getWithMean"):
            means = list(stage.mean) if stage.getWithMean() else means
            stds = [s or 1.0 for s in stage.std] if stage.getWithStd() else stds
    rows = [(f, float(m), float(s), float(c)) for f, m, s, c in zip(names, means, stds, last.coefficients)]
    return LinearModel(rows, float(last.intercept))


def save_model(spark: SparkSession, model, path: str) -> None:
    """A fitted pipeline or tree model under ``path``, replacing what is there."""
    if isinstance(model, (TreeModel, StoredForest)):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """What ``save_model`` wrote."""
    try:
        spark.read.parquet(f"{path}/trees").schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return PipelineModel.load(path)
    return TreeModel.load(spark, path)


def load_scorer(spark: SparkSession, path: str, features: list[str] | None = None):
    """A saved model ready for the what-if operators."""
    model = load_model(spark, path)
    return TreeScorer(model, features) if isinstance(model, TreeModel) else linear_of(model, features)


def candidate_vectors(scenarios: DataFrame, keep: list[str]) -> DataFrame:
    """The serving features of (conditions, crop) rows as an assembled table, for ``transform`` of any fitted model."""
    from harvestry.operators.models import assemble

    feats = scenario_features(F.col("crop"))
    named = scenarios.select(*keep, *[feats[f].alias(f"_{f}") for f in D.FEATURES])
    named = named.select(F.struct(*keep).alias("_key"), *[F.col(f"_{f}").alias(f) for f in D.FEATURES], F.lit(0.0).alias(D.TARGET))
    return assemble(named, "_key").select("_key.*", "features")

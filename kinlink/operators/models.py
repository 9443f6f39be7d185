"""Gradient-boosted trees over pair features: assembly, fit with early stopping, scores, importances.

MLlib's trees know no missing values, so every feature stands with a flag that
tells whether it was null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators.reports import score_metrics
from kinlink.sources.tables import contract


@dataclass(frozen=True)
class Settings:
    """Of the boosted trees. MLlib bounds a tree by depth alone and stops early by the loss on the tuning rows."""

    rounds: int = 200
    rate: float = 0.05
    depth: int = 6
    least_rows: int = 100
    bins: int = 64
    tolerance: float = 0.0005
    seed: int = 42


@dataclass(frozen=True)
class Model:
    trees: GBTClassificationModel
    features: tuple[str, ...]

    def save(self, path: str) -> None:
        """The trees as Spark stores them, and beside them their columns; an existing model of other columns is refused."""
        contract(f"{path}.json", {"features": list(self.features)})
        self.trees.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> Model:
        model = Model(GBTClassificationModel.load(path), tuple(json.loads(Path(f"{path}.json").read_text(encoding="utf-8"))["features"]))
        if model.trees.numFeatures != 2 * len(model.features):
            raise ValueError(f"{path}: {model.trees.numFeatures} inputs for {len(model.features)} features")
        return model


def assemble(frame: DataFrame, features: tuple[str, ...], output: str = "features") -> DataFrame:
    """Add the vector of ``features`` in their order: each value (0 for null or NaN), then each null flag."""
    value = lambda c: F.col(c).cast("double")
    lost = lambda c: value(c).isNull() | F.isnan(value(c))
    columns = [F.when(lost(c), 0.0).otherwise(value(c)).alias(f"_v{k}") for k, c in enumerate(features)] + [lost(c).cast("double").alias(f"_m{k}") for k, c in enumerate(features)]
    names = [f"_v{k}" for k in range(len(features))] + [f"_m{k}" for k in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol=output).transform(frame.select("*", *columns)).drop(*names)


def fit(train: DataFrame, tune: DataFrame, features: tuple[str, ...], label: str = "label", weight: str | None = None, s: Settings = Settings()) -> Model:
    """Boosted trees on the rows of ``train``, stopped where the rows of ``tune`` gain no more."""
    rows = lambda df, held: df.select(*dict.fromkeys((*features, label)), (F.col(weight) if weight and not held else F.lit(1.0)).cast("double").alias("_w"), F.lit(held).alias("_held"))
    both = assemble(rows(train, False).unionByName(rows(tune, True)), features).withColumn("_y", F.col(label).cast("double"))
    trees = GBTClassifier(
        featuresCol="features", labelCol="_y", weightCol="_w", validationIndicatorCol="_held", maxIter=s.rounds, stepSize=s.rate, maxDepth=s.depth, minInstancesPerNode=s.least_rows,
        maxBins=s.bins, validationTol=s.tolerance, seed=s.seed, cacheNodeIds=True, checkpointInterval=10,
    ).fit(both.select("features", "_y", "_w", "_held"))
    return Model(trees, features)


def predict(model: Model, frame: DataFrame, name: str = "p") -> DataFrame:
    """Add each row's probability of a true link as ``name``; raises at run time where it isn't a number from 0 to 1."""
    made = model.trees.transform(assemble(frame, model.features, "_features").withColumnRenamed("_features", "features"))
    p = vector_to_array("probability")[1]
    sound = F.when(~F.isnan(p) & (p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("a score is not from 0 to 1")).cast("double"))
    return made.withColumn(name, sound).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: Model) -> list[tuple[str, float]]:
    """Share of the gain that each feature, its null flag included, accounts for; largest first."""
    n = len(model.features)
    gains = model.trees.featureImportances.toArray()
    return sorted(((f, float(gains[k] + gains[n + k])) for k, f in enumerate(model.features)), key=lambda x: (-x[1], x[0]))


def evaluate(model: Model, frame: DataFrame, label: str = "label") -> DataFrame:
    """One row: pairs, logloss and AUC of the model on ``frame``."""
    return score_metrics(predict(model, frame, "_p"), "_p", label)


def second_stage(train: DataFrame, tune: DataFrame, base: tuple[str, ...], support: tuple[str, ...], weight: str | None = None, s: Settings = Settings()) -> tuple[Model, Model]:
    """The support model (first-stage features and the support's), and its control (first-stage features and p1) on the same rows."""
    return fit(train, tune, (*base, *support), weight=weight, s=s), fit(train, tune, (*base, "p1"), weight=weight, s=s)

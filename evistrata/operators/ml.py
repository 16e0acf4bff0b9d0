"""Feature selection, model grids on a fixed validation split, scores and importances with spark.ml."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evistrata.operators.ranking import auc_scores, confusion

#: Model families and the settings that the grid tries.
GRIDS = {
    "logistic": (LogisticRegression, {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5], "maxIter": [50]}),
    "forest": (RandomForestClassifier, {"numTrees": [20], "maxDepth": [3, 5], "seed": [42]}),
    "boosted": (GBTClassifier, {"maxIter": [10], "maxDepth": [2], "seed": [42]}),
}


def prepared(train: DataFrame, features: list[str], n_features: int):
    """Median imputation, scaling and the best features by ANOVA F, fitted on the training rows."""
    filled = [f"{c}__f" for c in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="__raw"),
            StandardScaler(withMean=True, inputCol="__raw", outputCol="__scaled"),
            UnivariateFeatureSelector(featuresCol="__scaled", labelCol="label", outputCol="features", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(n_features, len(features))),
        ]
    ).fit(train)


def balanced(df: DataFrame) -> DataFrame:
    """Add ``weight``, which makes the classes weigh alike."""
    n = F.count("*").over(Window.partitionBy("label"))
    both = df.agg(F.count("*").alias("__n"), F.count_distinct("label").alias("__k"))
    return df.withColumn("__c", n).crossJoin(F.broadcast(both)).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")  # one row


def _scored(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("split", "label", vector_to_array("probability")[1].alias("score"), (F.col("prediction") == 1).alias("predicted"))


def train_and_score(df: DataFrame, features: list[str], n_features: int = 20, grids: dict | None = None) -> DataFrame:
    """One row a model and split: AUC, precision, recall, F1, with the settings that validate best.

    ``df`` has label (0/1), split (train, validation, test) and the features. Settings are chosen
    by the validation AUC, which is what a fixed split asks for.
    """
    train = df.filter("split = 'train'")
    ready = prepared(train, features, n_features).transform(df).select("split", "label", "features").cache()
    weighted = balanced(ready.filter("split = 'train'"))
    out = None
    for name, (kind, grid) in (grids or GRIDS).items():
        best = None
        for values in product(*grid.values()):
            setting = dict(zip(grid, values))
            model = kind(featuresCol="features", labelCol="label", weightCol="weight", **setting).fit(weighted)
            auc = auc_scores(_scored(model, ready.filter("split = 'validation'")), "score", "label").first()
            value = (auc["roc_auc"] if auc else None) or 0.0
            if best is None or value > best[0]:
                best = (value, setting, model)
        scored = _scored(best[2], ready)
        rates = confusion(scored.withColumn("actual", F.col("label") == 1), "predicted", "actual", ["split"])
        rows = auc_scores(scored, "score", "label", ["split"]).join(rates, "split").select(F.lit(name).alias("model"), F.lit(str(best[1])).alias("settings"), "split", "roc_auc", "average_precision", "precision", "recall", "f1")
        out = rows if out is None else out.unionByName(rows)
    return out


def save(prepare: PipelineModel, model, path: str) -> None:
    """Write what prepares the features and the model on them as one pipeline."""
    PipelineModel([*prepare.stages, model]).write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A pipeline that ``save`` has written."""
    return PipelineModel.load(path)


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Feature importances of trees, or absolute coefficients, largest first."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))


def best_clusters(df: DataFrame, features: list[str], most: int = 10, seed: int = 42) -> tuple[int, DataFrame]:
    """K-means with the number of clusters that has the best silhouette."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df).cache()
    best = None
    for k in range(2, most + 1):
        found = KMeans(k=k, seed=seed).fit(rows).transform(rows)
        if found.select("prediction").distinct().count() < 2:
            continue
        score = ClusteringEvaluator().evaluate(found)
        if best is None or score > best[0]:
            best = (score, k, found)
    return (best[1], best[2].withColumnRenamed("prediction", "cluster")) if best else (1, df.withColumn("cluster", F.lit(0)))

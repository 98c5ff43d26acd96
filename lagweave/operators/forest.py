"""Random forests on feature columns: ``pyspark.ml``, and ``bagging`` where a tree's rows are bounded."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagging
from . import evaluation as ev


def fill(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Nulls become 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in features}).withColumn(label, F.col(label).cast("double"))


def assemble(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Nulls become 0; classes are weighted so that both count alike."""
    return VectorAssembler(inputCols=features, outputCol="__x").transform(fill(df, features, label))


def balanced(train: DataFrame, label: str = "label") -> DataFrame:
    row = train.agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("pos")).first()
    if not row.n or not row.pos or row.pos == row.n:
        raise ValueError("both classes are needed to fit a model")
    return train.withColumn("__weight", F.when(F.col(label) == 1, row.n / (2 * row.pos)).otherwise(row.n / (2 * (row.n - row.pos))))


def fit_forest(train: DataFrame, features: list[str], label: str = "label", trees: int = 50, depth: int = 10, leaf: int = 2, most_rows: int | None = None, seed: int = 42):
    """With ``most_rows`` a tree's bootstrap has so many rows at most, and grows in a task of its own."""
    if most_rows is not None:
        return bagging.fit(fill(train, features, label), features, label, trees, depth, leaf, most_rows, seed)
    data = balanced(assemble(train, features, label), label)
    return RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(data)


def forest_auc(model, df: DataFrame, features: list[str], label: str = "label") -> float:
    if isinstance(model, bagging.SampledForest):
        scored = bagging.scored(model, fill(df, features, label), features, label).persist()  # read by several jobs
        auc = ev.roc_auc(scored, "label", "score").first()[0]
        scored.unpersist()
        return auc
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction").evaluate(model.transform(assemble(df, features, label)))


def importances(model, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, importance, deviation across trees)."""
    if isinstance(model, bagging.SampledForest):
        mean = model.shares.mean(axis=0)
        return [(name, float(m), float(d)) for name, m, d in zip(features, mean / max(mean.sum(), 1e-300), model.shares.std(axis=0), strict=True)]
    trees = [t.featureImportances.toArray() for t in model.trees]
    out = []
    for i, name in enumerate(features):
        each = [t[i] for t in trees]
        mean = sum(each) / len(each)
        out.append((name, float(model.featureImportances[i]), float((sum((v - mean) ** 2 for v in each) / len(each)) ** 0.5)))
    return out

"""A boosted-tree classifier over feature vectors, in pyspark.ml: labels, scaling, one tree ensemble for each class."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Settings of the ensemble.
TREES, DEPTH, STEP, SEED, HELD_OUT = 200, 5, 0.05, 42, 0.2


def with_vectors(rows: DataFrame, features: str = "embedding") -> DataFrame:
    """Rows whose features are all there, as vectors; the others are left out."""
    whole = F.col(features).isNotNull() & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.where(whole).withColumn("raw", array_to_vector(F.col(features).cast("array<double>")))


def split(rows: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out ones: a fifth of each label, by a hash of the key."""
    rank = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1000)) < int(1000 * HELD_OUT)
    return rows.where(~rank), rows.where(rank)


def train(rows: DataFrame, label: str = "genre", features: str = "embedding", trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    booster = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, seed=SEED, featuresCol="scaled", labelCol="target")
    index = StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc")
    names = index.fit(rows).labels
    stages = [index, StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), OneVsRest(classifier=booster, featuresCol="scaled", labelCol="target", predictionCol="found"), IndexToString(inputCol="found", outputCol="predicted", labels=names)]
    return Pipeline(stages=stages).fit(with_vectors(rows, features))


def accuracy(model: PipelineModel, rows: DataFrame, label: str = "genre", features: str = "embedding") -> float:
    got = model.transform(with_vectors(rows, features)).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()["a"]
    return float("nan") if got is None else got

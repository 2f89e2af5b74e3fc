"""Families of signals by their glyph vectors: fitted once, saved, and told for new signals."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(vectors: DataFrame, k: int = 3, seed: int = 7) -> KMeansModel:
    """Model of vectors(sid, vector); null vectors teach nothing. It is saved by `write().save(path)` and read by `KMeansModel.load(path)`."""
    return KMeans(k=k, seed=seed).fit(_features(vectors))


def assign(model: KMeansModel, vectors: DataFrame) -> DataFrame:
    """(sid, cluster) of vectors(sid, vector), seen by the model or new; null vectors are left out."""
    return model.transform(_features(vectors)).select("sid", F.col("prediction").alias("cluster"))


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.where("vector is not null").select("sid", array_to_vector(F.col("vector")).alias("features"))

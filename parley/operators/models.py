"""Clusterings, topics and classifiers on MLlib."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, CountVectorizer, HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import _unit


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans(df: DataFrame, vec: str = "vec", k: int = 4, seed: int = 1) -> DataFrame:
    f = _features(df, vec)
    return KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(f).transform(f).drop("_f")


def gaussian_mixture(df: DataFrame, vec: str = "vec", k: int = 2, seed: int = 1) -> DataFrame:
    f = _features(df, vec)
    return GaussianMixture(k=k, seed=seed, featuresCol="_f", predictionCol="cluster", probabilityCol="_p", maxIter=30).fit(f).transform(f).drop("_f", "_p")


def pca(df: DataFrame, vec: str = "vec", k: int = 2) -> DataFrame:
    f = _features(df, vec)
    return PCA(k=k, inputCol="_f", outputCol="_o").fit(f).transform(f).withColumn("pca", vector_to_array("_o")).drop("_f", "_o")


def lda(df: DataFrame, text: str = "text", k: int = 3, rounds: int = 20, seed: int = 1, vocabulary: int = 5000) -> DataFrame:
    """Topic mixture of each text over ``k`` topics of its words without stop-words."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern="[^a-z]+", minTokenLength=4)
    stop = StopWordsRemover(inputCol="_w", outputCol="_s")
    counts = CountVectorizer(inputCol="_s", outputCol="_c", vocabSize=vocabulary)
    model = Pipeline(stages=[words, stop, counts, LDA(k=k, maxIter=rounds, seed=seed, featuresCol="_c", topicDistributionCol="_t")]).fit(df)
    return model.transform(df).withColumn("topics", vector_to_array("_t")).drop("_w", "_s", "_c", "_t")


def text_classifier(train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """A fitted pipeline that scores texts: logistic regression on hashed words."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern="\\s+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), LogisticRegression(featuresCol="_f", labelCol=label, probabilityCol="_p", maxIter=30, regParam=0.01)]
    return Pipeline(stages=stages).fit(train)


def classified(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("probability", vector_to_array("_p")[1]).drop("_w", "_f", "_p", "rawPrediction", "prediction")


def summaries(sentences: DataFrame, key: str, ratio: float = 0.3, rounds: int = 20) -> DataFrame:
    """``(key, pos, text)``: of each text max(1, n * ratio) sentences, each nearest to a centroid of its vectors and used once."""
    kind = sentences.schema[key].dataType.simpleString()

    def run(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        x = _unit(pdf["vec"])
        k = max(1, int(len(x) * ratio))
        at = np.linspace(0, len(x) - 1, k).round().astype(int)
        centre = x[at]
        for _ in range(rounds):
            near = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[near == c].mean(0) if (near == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        chosen: list[int] = []
        for c in range(k):
            order = ((x - centre[c]) ** 2).sum(1).argsort(kind="stable")
            chosen.append(next(int(i) for i in order if int(i) not in chosen))
        out = pdf.loc[sorted(chosen), ["pos", "text"]]
        out.insert(0, key, of[0])
        return out

    return sentences.groupBy(key).applyInPandas(run, f"{key} {kind}, pos int, text string")

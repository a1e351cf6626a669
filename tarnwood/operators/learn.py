"""Classic classifiers on top of pyspark.ml, and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAYES = ("gaussian", "multinomial", "bernoulli", "complement")


def naive_bayes(df: DataFrame, features: str, label: str, kind: str = "complement"):
    """A fitted model; bernoulli sees features as present or not. Save with model.write().overwrite().save(path)."""
    if kind not in BAYES:
        raise ValueError(f"unknown model {kind!r}")
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import Binarizer

    nb = NaiveBayes(featuresCol="_b" if kind == "bernoulli" else features, labelCol=label, modelType=kind)
    return Pipeline(stages=[Binarizer(inputCol=features, outputCol="_b", threshold=0.0), nb] if kind == "bernoulli" else [nb]).fit(df)


def text_classifier(docs: DataFrame, label: str, text: str = "text", width: int = 1 << 12):
    """Hashed word counts, idf and logistic regression as one pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[\p{L}']+", gaps=False), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=width), IDF(inputCol="_tf", outputCol="features"), LogisticRegression(labelCol=label, maxIter=10)]
    return Pipeline(stages=stages).fit(docs)


def accuracy(df: DataFrame, predicted: str = "prediction", label: str = "label", rounded: bool = False) -> DataFrame:
    """(accuracy); rounded: to a whole number, half to even."""
    a = F.avg((F.col(predicted) == F.col(label)).cast("double"))
    return df.agg((F.bround(a, 0) if rounded else a).alias("accuracy"))

"""A trainable text classifier on Spark ML, as the baseline a language model is compared with."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.operators.labels import encode_classes


# 256 MB of doubles.
MODEL_WEIGHTS = 1 << 25


def train_classifier(train: DataFrame, text: str, label: str, vocab: DataFrame,
                     features: int = 1 << 16, method: str = "bayes"):
    """Fit on rows whose label is a class name; ``method`` is ``bayes`` or ``logistic``.

    The driver holds a weight for every class and feature: at most ``MODEL_WEIGHTS`` of them.
    """
    classes = vocab.where(F.col("label_name") == label).count()
    if classes * features > MODEL_WEIGHTS:
        raise ValueError(f"{classes} classes of {features} features are more than {MODEL_WEIGHTS} weights")
    rows = encode_classes(train.select(F.col(text).alias("text"), F.col(label)), label, vocab)
    rows = rows.withColumnRenamed(label, "label")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=features),
        NaiveBayes() if method == "bayes" else LogisticRegression(maxIter=20),
    ]
    return Pipeline(stages=stages).fit(rows.dropna())


def classify(model, df: DataFrame, text: str, names: list[str], keep=()) -> DataFrame:
    """Predictions in the form of model responses, so that every metric applies to them."""
    scored = model.transform(df.withColumn("text", F.col(text)))
    zero = F.lit(0).cast("int")
    response = F.struct(
        F.get(F.lit(names), F.col("prediction").cast("int")).alias("text"),
        zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens"),
        F.lit(0.0).alias("latency"), F.lit(None).cast("string").alias("reasoning"),
        F.lit(None).cast("string").alias("error"),
    )
    return scored.select(*keep, "text", response.alias("response"))

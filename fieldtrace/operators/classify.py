"""A linear text classifier on 1- and 2-gram TF-IDF, trained and applied in Spark."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, StringIndexer
from pyspark.sql import DataFrame, functions as F

from fieldtrace.functions import text

FEATURES = 20_000
MIN_DF = 2


def with_grams(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``grams``: words and pairs of words of a text column."""
    words = text.word_list(F.coalesce(F.col(column), F.lit("")))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - 1)), lambda i: F.array_join(F.slice("__w", i, F.lit(2)), " "))
    none = F.array().cast("array<string>")
    return rows.withColumn("__w", words).withColumn("grams", F.concat("__w", F.when(F.size("__w") > 1, pairs).otherwise(none))).drop("__w")


def fit(train: DataFrame, column: str, label: str, iterations: int = 12) -> PipelineModel | None:
    """Balanced multinomial logistic regression; rows without a label are left out.

    None if the rest has fewer than two classes.
    """
    rows = with_grams(train.filter(F.col(label).isNotNull()), column)
    per = rows.groupBy(label).agg(F.count("*").alias("__n"))  # one row per class
    total, classes = per.agg(F.sum("__n"), F.count("*")).first()
    if classes < 2:
        return None
    weighted = rows.join(per, label).withColumn("weight", F.lit(float(total)) / (F.lit(float(classes)) * F.col("__n"))).drop("__n")
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(weighted)
    stages = [
        index, CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=FEATURES, minDF=MIN_DF), IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="weight", predictionCol="chosen_index", maxIter=iterations, regParam=0.001),
        IndexToString(inputCol="chosen_index", outputCol="chosen", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(weighted)


def predict(model: PipelineModel, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the chosen class; labels unknown to the model are kept."""
    ready = with_grams(rows, column)
    for stage in model.stages[1:]:
        ready = stage.transform(ready)
    return ready.drop("grams", "counts", "features", "rawPrediction", "probability", "chosen_index")

"""Aspect or sentiment classifiers trained with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_classifier(
    df: DataFrame,
    text_col: str,
    label_col: str,
    n_features: int = 1 << 16,
    max_iter: int = 20,
    weight_decay: float = 0.01,
) -> PipelineModel:
    """Fit a multinomial logistic regression on hashed, IDF-weighted words.

    Hashing keeps the model size fixed whatever the number of distinct words.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(text_col), F.col(label_col).cast("string").alias(label_col)
    )
    indexer = StringIndexer(
        inputCol=label_col, outputCol="_label", stringOrderType="frequencyDesc"
    ).fit(rows)
    stages = [
        indexer,
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=n_features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol="_label",
            predictionCol="_class",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            family="multinomial",
            maxIter=max_iter,
            regParam=weight_decay,
        ),
        IndexToString(inputCol="_class", outputCol="predicted", labels=indexer.labelsArray[0]),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict_class(df: DataFrame, model: PipelineModel, text_col: str, out: str = "predicted") -> DataFrame:
    """Add the predicted label of each text; labels need not be present."""
    indexer = model.stages[0]
    prepared = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    scored = PipelineModel(stages=[stage for stage in model.stages if stage is not indexer]).transform(prepared)
    return scored.select(*df.columns, F.col("predicted").alias(out))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

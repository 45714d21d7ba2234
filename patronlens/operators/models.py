"""Splits, classifiers, two-stage models, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.expressions import draw
from patronlens.functions.order_stats import smallest_by_hash
from patronlens.operators.clustering import dummies
from patronlens.operators.sessions import PERSON
from patronlens.session import spread, tasks

HISTORY = [
    "orders_count", "last_score", "last_payment", "last_days_between_orders", "mean_score", "mean_payment",
    "mean_days_between_orders",
]
ORDER_NUMERIC = ["distance", "payment_value", "review_score", "time_delta"]
ONE_ORDER = ["review_score", "payment_value", "days_after_order"]
CATEGORIES = [*C.CATEGORY_TREE, C.MISSING_CATEGORY]
ABSENT = -1.0

# --- splits ------------------------------------------------------------------------------------


def _bucket(column: str, seed: int, size: int) -> Column:
    return draw(F.col(column), seed) % size


def stratified_split(df: DataFrame, label: str, share: float = 0.8, id_col: str = PERSON, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly ``floor(share * n)`` rows of every label for training, the rest for testing."""
    train = smallest_by_hash(df, id_col, F.floor(F.col("_size") * F.lit(share)), [label], seed)
    return train, df.join(train.select(id_col), id_col, "left_anti")


def random_split(df: DataFrame, share: float = 0.8, id_col: str = PERSON, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """About ``share`` of the rows and the rest; a row's side depends on its id alone."""
    inside = _bucket(id_col, seed, 1_000_000) < int(share * 1_000_000)
    return df.where(inside), df.where(~inside)


def group_folds(df: DataFrame, folds: int = 4, id_col: str = PERSON, seed: int = 1) -> DataFrame:
    """``part`` per row: fold 0 is held out and halved into valid and test; a person has one part."""
    held = _bucket(id_col, seed, folds) == 0
    half = F.when(_bucket(id_col, seed + 1, 2) == 0, "valid").otherwise("test")
    return df.withColumn("part", F.when(held, half).otherwise("train"))


# --- classifiers -------------------------------------------------------------------------------


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles with a sentinel for what a short history cannot have."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(ABSENT)) for c in columns})


def _in_order(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores and sorted by its values: trees draw rows by their place, and files are listed in no fixed order."""
    rows = spread(df)
    return rows.repartition(tasks(df.sparkSession), *rows.columns).sortWithinPartitions(*rows.columns)


def _fit(df: DataFrame, columns: Sequence[str], classifier) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return Pipeline(stages=[assembler, classifier]).fit(_in_order(filled(df, columns).select(*columns, classifier.getLabelCol())))


DEPTH, BINS = 5, 32


def retention_forest(df: DataFrame, trees: int = 100, seed: int = 1, depth: int = DEPTH, bins: int = BINS) -> PipelineModel:
    """A forest of ``trees`` trees of at most ``depth`` levels over ``bins`` value ranges a column."""
    return _fit(df, HISTORY, RandomForestClassifier(labelCol="retention", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed))


def retention_boosting(df: DataFrame, rounds: int = 100, seed: int = 0) -> PipelineModel:
    columns = [c for c in HISTORY if c != "mean_days_between_orders"]
    return _fit(df, [*columns, "days_after_order"], GBTClassifier(labelCol="retention", maxIter=rounds, maxDepth=3, seed=seed))


def predict(model: PipelineModel, df: DataFrame, columns: Sequence[str], alias: str = "prediction") -> DataFrame:
    """``df`` with the predicted label and the probability of label 1; its columns stay as they are, nulls too."""
    scored = model.transform(filled(df.withColumn("_given", F.struct(*df.columns)), columns))
    return scored.select(
        "_given.*", F.col("prediction").cast("int").alias(alias),
        vector_to_array("probability")[1].alias("probability"),
    )


def _scaled_regression(df: DataFrame, columns: Sequence[str], label: str, inverse_penalty: float = 1.0) -> PipelineModel:
    """Logistic regression with a squared penalty of weight 1 / ``inverse_penalty`` against the summed loss."""
    filled_rows = _in_order(filled(df, columns).select(*columns, label))
    rows = max(1, filled_rows.count())
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, regParam=1.0 / (inverse_penalty * rows), elasticNetParam=0.0),
    ]).fit(filled_rows)


@dataclass
class SeveralOrdersModel:
    """Forest on the history, then a scaled regression on its probability and the age."""

    forest: PipelineModel
    regression: PipelineModel
    STAGE_TWO = ["days_after_order", "rfc"]

    @classmethod
    def fit(cls, train: DataFrame, valid: DataFrame, trees: int = 100, seed: int = 1) -> SeveralOrdersModel:
        forest = retention_forest(train, trees, seed)
        return cls(forest, _scaled_regression(cls._stage_one(forest, valid), cls.STAGE_TWO, "retention"))

    @staticmethod
    def _stage_one(forest: PipelineModel, df: DataFrame) -> DataFrame:
        return predict(forest, df, HISTORY, "_forest").withColumnRenamed("probability", "rfc").drop("_forest")

    def transform(self, df: DataFrame) -> DataFrame:
        staged = self._stage_one(self.forest, df)
        return predict(self.regression, staged, self.STAGE_TWO).drop("rfc")

    def save(self, folder: str) -> None:
        self.forest.write().overwrite().save(f"{folder}/forest")
        self.regression.write().overwrite().save(f"{folder}/regression")

    @classmethod
    def load(cls, folder: str) -> SeveralOrdersModel:
        return cls(PipelineModel.load(f"{folder}/forest"), PipelineModel.load(f"{folder}/regression"))


def one_order_regression(df: DataFrame) -> PipelineModel:
    return _scaled_regression(df, ONE_ORDER, "retention")


def coefficients(model: PipelineModel, columns: Sequence[str]) -> dict[str, float]:
    return dict(zip(columns, [float(x) for x in model.stages[-1].coefficients]))


def order_columns(categories: Sequence[str] = CATEGORIES) -> list[str]:
    return [*ORDER_NUMERIC, *[f"upper_category_{c}" for c in categories]]


def cluster_forest(orders: DataFrame, categories: Sequence[str] = CATEGORIES, trees: int = 100, seed: int = 1, depth: int = DEPTH, bins: int = BINS) -> PipelineModel:
    """Forest from order features (with dummies of a fixed category list) to ``cluster``."""
    encoded = dummies(orders, "upper_category", categories)
    return _fit(encoded, order_columns(categories), RandomForestClassifier(labelCol="cluster", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed))


def predict_clusters(model: PipelineModel, orders: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    encoded = dummies(orders.withColumn("_given", F.struct(*orders.columns)), "upper_category", categories)
    scored = model.transform(filled(encoded, order_columns(categories)))
    return scored.select("_given.*", F.col("prediction").cast("int").alias("predicted"))


def share_regression(predicted: DataFrame, shares: DataFrame, label: str = "class") -> PipelineModel:
    """Second stage on the predicted cluster's share and the age of the last order."""
    return _scaled_regression(with_share(predicted, shares), ["time_delta", "rfc"], label)


def with_share(predicted: DataFrame, shares: DataFrame) -> DataFrame:
    named = shares.select(F.col("cluster").alias("predicted"), F.col("probability").alias("rfc"))
    return predicted.join(named, "predicted", "left")


def score_one_order(model: PipelineModel, orders: DataFrame, cluster_table: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Person, predicted cluster, its chance of another purchase and its note."""
    notes = cluster_table.select(F.col("cluster").alias("predicted"), "probability", "note")
    scored = predict_clusters(model, orders, categories).join(notes, "predicted", "left")
    return scored.select(PERSON, F.col("predicted").alias("cluster"), "probability", "note")


def cluster_table(shares: DataFrame) -> DataFrame:
    """Clusters with their share and, at the two ends, a word on when these people last bought."""
    share = F.col("probability")
    # The notes of the shipped cluster table.
    note = F.when(share >= 0.9, "недавно покупал").when(share < 0.1, "давно не покупал").otherwise("")
    return shares.select("cluster", "probability", note.alias("note"))


# --- evaluation --------------------------------------------------------------------------------


def accuracy(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return predicted.agg(F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"))


def confusion(predicted: DataFrame, label: str, prediction: str, values: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows per true label, one column per predicted label."""
    wide = predicted.groupBy(label).pivot(prediction, list(values)).agg(F.count(F.lit(1)))
    return wide.select(F.col(label).alias("label"), *[F.coalesce(str(v), F.lit(0)).alias(f"predicted_{v}") for v in values])

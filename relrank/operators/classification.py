"""Classification metrics and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions.hashing import hash_position
from relrank.functions.logits import log_softmax, logit, predict


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.agg(
        *[F.count_if((F.col(label) == y) & (F.col(prediction) == p)).alias(name) for name, (y, p) in cells.items()]
    )


def _over(value: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(value, whole), F.lit(0.0))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; 0 where nothing can be divided."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, label, prediction).select(
        _over(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        _over(tp, tp + fp).alias("precision"),
        _over(tp, tp + fn).alias("recall"),
        _over(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _loss(logits: str, label: str) -> Column:
    return -logit(log_softmax(logits), F.col(label))


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    return df.agg(F.avg(_loss(logits, label)).alias("loss"))


def batched_loss(
    df: DataFrame, keys: Sequence[str], batch_size: int = 32, seed: int = 0, logits: str = "logits", label: str = "label"
) -> DataFrame:
    """Mean of the batch means of the loss, and accuracy. Batches are cut from the rows in hash order."""
    batch = F.floor(F.col("position") / batch_size)
    batches = (
        hash_position(df, keys, seed)
        .groupBy(batch.alias("batch"))
        .agg(
            F.avg(_loss(logits, label)).alias("_loss"),
            F.count_if(predict(logits) == F.col(label)).alias("_right"),
            F.count("*").alias("_rows"),
        )
    )
    return batches.agg(F.avg("_loss").alias("loss"), (F.sum("_right") / F.sum("_rows")).alias("accuracy"))

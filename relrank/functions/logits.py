"""Arithmetic on the two logits (logit0, logit1) of a classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(values: str | Column) -> Column:
    """Softmax of an array, with its maximum subtracted first."""
    top = F.array_max(values)
    exps = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def log_softmax(values: str | Column) -> Column:
    """Log of the softmax by log-sum-exp, so that it never underflows to minus infinity."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(values, lambda x: x - top - F.log(total))


def logit(logits: str | Column, label: int | Column) -> Column:
    return F.get(_col(logits), F.lit(label) if isinstance(label, int) else label)


def predict(logits: str | Column) -> Column:
    """1 where logit1 is the larger one; a tie is 0."""
    return F.when(logit(logits, 1) > logit(logits, 0), 1).otherwise(0)


def relevance_score(logits: str | Column, kind: int = 1) -> Column:
    """Kind 0: logit1. Kind 1: logit1 - logit0."""
    if kind not in (0, 1):
        raise ValueError(f"kind must be 0 or 1, not {kind!r}")
    return logit(logits, 1) if kind == 0 else logit(logits, 1) - logit(logits, 0)

"""Annotation mixes: which annotations the documents predicted relevant or non-relevant carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relrank.operators.candidates import head_per_query
from relrank.schemas import require_columns

CLASSES = {"relevant": 1, "non-relevant": 0}


def _counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group and annotation. Null annotations are dropped, the group is kept."""
    require_columns(df, "prediction", "annotation")
    typed = df.withColumn("prediction", F.col("prediction").cast("int")).withColumn(
        "annotation", F.col("annotation").cast("int")
    )
    return typed.groupBy(*by, "annotation").agg(F.count("annotation").alias("rows"))


def mix_rows(df: DataFrame, by: Sequence[str] = ("prediction",)) -> DataFrame:
    """Long form: group, annotation, its rows, the group's total and the fraction."""
    counts = _counts(df, by).where(F.col("annotation").isNotNull())
    total = F.sum("rows").over(Window.partitionBy(*by))
    return counts.withColumn("total", total).withColumn("fraction", F.col("rows") / F.col("total"))


def annotation_mix(df: DataFrame, predicted: str) -> DataFrame:
    """One row: the number of annotated documents of a predicted class and the fraction of each annotation."""
    if predicted not in CLASSES:
        raise ValueError(f"predicted must be one of {sorted(CLASSES)}, not {predicted!r}")
    chosen = _counts(df, ["prediction"]).where(F.col("prediction") == CLASSES[predicted])
    return _fold(chosen, [], [("total", "fractions", F.lit(True))])


def _fold(counts: DataFrame, by: Sequence[str], parts: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Totals and fraction maps from the counts; each part is (total name, map name, condition).

    The maps hold one entry per distinct annotation, whatever the number of rows.
    """
    aggregates = []
    for total, fractions, chosen in parts:
        wanted = chosen & F.col("annotation").isNotNull()
        entry = F.when(wanted, F.struct("annotation", "rows"))
        aggregates.append(F.coalesce(F.sum(F.when(wanted, F.col("rows"))), F.lit(0)).alias(total))
        aggregates.append(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(fractions))
    folded = counts.groupBy(*by).agg(*aggregates)
    shares = [
        column
        for total, fractions, _ in parts
        for column in (F.col(total), _shares(fractions, total).alias(fractions))
    ]
    return folded.select(*by, *shares)


def _shares(fractions: str, total: str) -> Column:
    return F.transform_values(fractions, lambda _, rows: rows / F.col(total))


def _both(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return _fold(
        counts,
        by,
        [
            ("total_rel_annotation_count", "relevant_frac_annotation", F.col("prediction") == 1),
            ("total_non_annotation_count", "non_relevant_frac_annotation", F.col("prediction") == 0),
        ],
    )


def fairness_report(df: DataFrame) -> DataFrame:
    """One row: total and mix of the documents predicted relevant, and of the others."""
    return _both(_counts(df, ["prediction"]), [])


def fairness_by_query(df: DataFrame) -> DataFrame:
    """The same per query; a class without annotated documents has total 0 and an empty map."""
    by = [c for c in ("qid", "query") if c in df.columns]
    return _both(_counts(df, [*by, "prediction"]), by)


def fairness_at_k(df: DataFrame, k: int) -> DataFrame:
    """Per query, over its first k documents by rank."""
    return fairness_by_query(head_per_query(df, k))

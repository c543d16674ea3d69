"""Ranking metrics by the trec_eval definitions.

Inside a query documents count in the order of ``evaluation_order``. Per-query results have one row per
query of the run; ``corpus_mean`` averages them. Of repeated judgments the highest counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relrank.operators.candidates import join_qrels, judgments
from relrank.operators.ordering import PIECE_ROWS, evaluation_order, head_of_group, running_totals
from relrank.session import checkpoint

CUTOFFS = (1, 5, 10, 100)


def _ranked(
    run: DataFrame, qrels: DataFrame, depth: int | None, min_rel: int = 1, piece_rows: int | None = PIECE_ROWS
) -> DataFrame:
    """The run with label, rnk and hits, the relevant documents up to and including this one."""
    run = run.select("qid", "docid", "score")
    relevant = (F.col("label") >= min_rel).cast("int")
    if depth is None:
        judged = join_qrels(run, qrels)
        return running_totals(
            judged, ["qid"], evaluation_order(), {"rnk": F.lit(1), "hits": relevant}, piece_rows
        )
    top = join_qrels(head_of_group(run, ["qid"], evaluation_order(), depth, "rnk"), qrels)
    return running_totals(top, ["qid"], ["rnk"], {"hits": relevant}, piece_rows=None)  # depth rows at most


def _with_ideal(values: DataFrame, ideal: DataFrame) -> DataFrame:
    return values.join(ideal, "qid", "left")


def _relevant_counts(qrels: DataFrame, min_rel: int = 1) -> DataFrame:
    return judgments(qrels).groupBy("qid").agg(F.count_if(F.col("label") >= min_rel).alias("relevant"))


def _ratio(value: Column, whole: Column | str) -> Column:
    """0 where there is nothing to divide by."""
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(value, whole), F.lit(0.0))


def _hits_within(k: int, min_rel: int = 1) -> Column:
    return F.count_if((F.col("rnk") <= k) & (F.col("label") >= min_rel))


def _precision_sum(min_rel: int = 1, hits: str = "hits", depth: int | None = None) -> Column:
    """Sum, over the relevant documents down to ``depth``, of the precision at their place."""
    counted = F.col("label") >= min_rel
    if depth is not None:
        counted &= F.col("rnk") <= depth
    return F.sum(F.when(counted, F.col(hits) / F.col("rnk")).otherwise(0.0))


def _gain(k: int) -> Column:
    """Discounted gain of the first k; negative labels count 0."""
    gain = F.greatest("label", F.lit(0)) / F.log2(F.col("rnk") + 1)
    return F.sum(F.when(F.col("rnk") <= k, gain).otherwise(0.0))


def _ideal_gains(qrels: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    best = head_of_group(judgments(qrels), ["qid"], ["-label"], max(cutoffs), "rnk")
    return best.groupBy("qid").agg(*[_gain(k).alias(f"_ideal_{k}") for k in cutoffs])


def precision_at(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    ranked = _ranked(run, qrels, k)
    return ranked.groupBy("qid").agg((_hits_within(k) / F.lit(k)).alias("value"))


def recall_at(run: DataFrame, qrels: DataFrame, k: int = 1000) -> DataFrame:
    found = _ranked(run, qrels, k).groupBy("qid").agg(_hits_within(k).alias("_found"))
    return _with_ideal(found, _relevant_counts(qrels)).select("qid", _ratio(F.col("_found"), "relevant").alias("value"))


def average_precision(
    run: DataFrame, qrels: DataFrame, min_rel: int = 1, depth: int | None = None, piece_rows: int | None = PIECE_ROWS
) -> DataFrame:
    """Average precision per query. ``depth`` looks at the first documents only; the divisor stays the
    number of relevant documents in the judgments."""
    qrels = checkpoint(judgments(qrels))
    ranked = _ranked(run, qrels, depth, min_rel, piece_rows)
    sums = ranked.groupBy("qid").agg(_precision_sum(min_rel).alias("_sum"))
    return _with_ideal(sums, _relevant_counts(qrels, min_rel)).select(
        "qid", _ratio(F.col("_sum"), "relevant").alias("value")
    )


def ndcg_at(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    gains = _ranked(run, qrels, k).groupBy("qid").agg(_gain(k).alias("_gain"))
    return _with_ideal(gains, _ideal_gains(qrels, [k])).select(
        "qid", _ratio(F.col("_gain"), f"_ideal_{k}").alias("value")
    )


def corpus_mean(per_query: DataFrame, qrels: DataFrame | None = None, column: str = "value") -> DataFrame:
    """Mean over the queries of ``qrels``, absent ones counting 0; without it over the rows given."""
    if qrels is not None:
        judged = qrels.select("qid").distinct()
        per_query = judged.join(per_query, "qid", "left").withColumn(column, F.coalesce(column, F.lit(0.0)))
    return mean_metric(per_query, column)


def mean_metric(df: DataFrame, column: str = "value") -> DataFrame:
    """The mean of a column, 0 for an empty table."""
    return df.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"))


def evaluate_by_query(
    run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, piece_rows: int | None = PIECE_ROWS
) -> DataFrame:
    """precision@10, map and nDCG at 1, 5, 10 and 100 per query, from one ranking of the run."""
    values = _all_values(run, checkpoint(judgments(qrels)), piece_rows).drop("AP(rel=2)@100")
    if queries is None:
        return values
    with_text = values.join(queries.select("qid", "query"), "qid", "left")
    return with_text.select("qid", "query", *values.columns[1:])


def _all_values(run: DataFrame, qrels: DataFrame, piece_rows: int | None) -> DataFrame:
    """Every reported metric per query, from one ranking of the run and one of the judgments, which is read four times."""
    grades = {"hits": 1, "hits_2": 2}
    judged = join_qrels(run.select("qid", "docid", "score"), qrels)
    totals = {"rnk": F.lit(1), **{name: (F.col("label") >= g).cast("int") for name, g in grades.items()}}
    ranked = running_totals(judged, ["qid"], evaluation_order(), totals, piece_rows)
    values = ranked.groupBy("qid").agg(
        (_hits_within(10) / F.lit(10)).alias("precision@10"),
        _precision_sum().alias("_sum"),
        _precision_sum(2, "hits_2", 100).alias("_sum_2"),
        *[_gain(k).alias(f"_gain_{k}") for k in CUTOFFS],
    )
    relevant = judgments(qrels).groupBy("qid").agg(
        *[F.count_if(F.col("label") >= g).alias(f"_relevant_{g}") for g in grades.values()]
    )
    values = _with_ideal(_with_ideal(values, _ideal_gains(qrels, CUTOFFS)), relevant)
    return values.select(
        "qid",
        _ratio(F.col("_sum_2"), "_relevant_2").alias("AP(rel=2)@100"),
        F.col("precision@10"),
        _ratio(F.col("_sum"), "_relevant_1").alias("map"),
        *[_ratio(F.col(f"_gain_{k}"), f"_ideal_{k}").alias(f"nDCG@{k}") for k in CUTOFFS],
    )


def evaluate(run: DataFrame, qrels: DataFrame, denominator: str = "qrels", piece_rows: int | None = PIECE_ROWS) -> DataFrame:
    """One row of corpus means: AP(rel=2)@100, P@10, map, nDCG at 1, 5, 10, 100.

    ``denominator`` is 'qrels' (every judged query counts) or 'run' (every query of the run).
    """
    if denominator not in ("qrels", "run"):
        raise ValueError(f"denominator must be 'qrels' or 'run', not {denominator!r}")
    qrels = checkpoint(judgments(qrels))
    values = _all_values(run, qrels, piece_rows)
    names = values.columns[1:]
    if denominator == "qrels":
        values = qrels.select("qid").distinct().join(values, "qid", "left")
    return values.agg(*[F.avg(F.coalesce(n, F.lit(0.0))).alias(n) for n in names])


# Metrics on a set of true ids and a list of predicted ones: tables (qid, docid) and (qid, docid, rank).


def _set_hits(true: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """The first k predictions with ``hit`` and ``found``, the distinct true ids met so far."""
    top = head_of_group(predicted.select("qid", "docid", "rank"), ["qid"], ["rank", "docid"], k, "at")
    truth = true.select("qid", "docid").distinct().withColumn("_true", F.lit(1))
    first = F.row_number().over(Window.partitionBy("qid", "docid").orderBy("at")) == 1
    hits = top.join(truth, ["qid", "docid"], "left").withColumn("hit", F.col("_true").isNotNull())
    hits = hits.withColumn("_new", (F.col("hit") & first).cast("int"))
    return running_totals(hits, ["qid"], ["at"], {"found": F.col("_new")}, piece_rows=None)  # k rows at most


def _per_true_query(true: DataFrame, values: DataFrame, value: Column) -> DataFrame:
    sizes = true.select("qid", "docid").distinct().groupBy("qid").agg(F.count("*").alias("relevant"))
    return sizes.join(values, "qid", "left").select("qid", value.alias("value"))


def set_precision_at(true: DataFrame, predicted: DataFrame, k: int = 12) -> DataFrame:
    """Distinct true ids among the first k predictions, over k."""
    found = _set_hits(true, predicted, k).groupBy("qid").agg(F.max("found").alias("_found"))
    return _per_true_query(true, found, F.coalesce(F.col("_found"), F.lit(0)) / F.lit(k))


def rel_at(true: DataFrame, predicted: DataFrame, k: int = 12) -> DataFrame:
    """1 if the k-th prediction is true, else 0; null when there are fewer predictions."""
    kth = _set_hits(true, predicted, k).where(F.col("at") == k).select("qid", "hit")
    return _per_true_query(true, kth, F.col("hit").cast("double"))


def set_ap_at(true: DataFrame, predicted: DataFrame, k: int = 12) -> DataFrame:
    """Precision at each true place among the first k, summed, over min(k, number of true ids)."""
    hits = _set_hits(true, predicted, k)
    sums = hits.groupBy("qid").agg(F.sum(F.when(F.col("hit"), F.col("found") / F.col("at")).otherwise(0.0)).alias("_sum"))
    return _per_true_query(true, sums, F.coalesce("_sum", F.lit(0.0)) / F.least(F.lit(k), F.col("relevant")))


def set_map_at(true: DataFrame, predicted: DataFrame, k: int = 10) -> DataFrame:
    return mean_metric(set_ap_at(true, predicted, k))


def ndcg_tied(df: DataFrame, gain: str, prediction: str, k: int = 10) -> DataFrame:
    """nDCG at k where documents of equal prediction share their mean gain.

    Rows are first summed per distinct prediction; the first k of those cover the first k places.
    """
    discount = [0.0]
    for place in range(1, k + 1):
        discount.append(discount[-1] + 1 / math.log2(place + 1))
    upto = F.array(*[F.lit(d) for d in discount])  # sum of the discounts of the first 0 … k places

    def sum_to(place: Column) -> Column:
        return F.get(upto, F.least(place, F.lit(k)).cast("int"))

    ties = df.groupBy("qid", prediction).agg(F.avg(gain).alias("_mean"), F.count("*").alias("_rows"))
    ties = head_of_group(ties, ["qid"], [f"-{prediction}"], k)
    ties = running_totals(ties, ["qid"], ["_at"], {"_end": F.col("_rows")}, piece_rows=None)  # k rows at most
    gains = ties.groupBy("qid").agg(
        F.sum(F.col("_mean") * (sum_to(F.col("_end")) - sum_to(F.col("_end") - F.col("_rows")))).alias("_gain")
    )
    best = head_of_group(df.select("qid", gain), ["qid"], [f"-{gain}"], k)
    ideal = best.groupBy("qid").agg(F.sum(F.col(gain) / F.log2(F.col("_at") + 1)).alias("_ideal"))
    return gains.join(ideal, "qid").select("qid", _ratio(F.col("_gain"), "_ideal").alias("value"))


def ap_from_scores(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ("qid",), piece_rows: int | None = PIECE_ROWS
) -> DataFrame:
    """Average precision of binary labels: the gain in recall at each distinct score times the precision there."""
    by = list(by)
    steps = df.groupBy(*by, prediction).agg(F.sum(label).alias("_true"), F.count("*").alias("_rows"))
    steps = running_totals(
        steps, by, [f"-{prediction}"], {"_true_upto": F.col("_true"), "_upto": F.col("_rows")}, piece_rows
    )
    area = F.sum(F.col("_true") * F.col("_true_upto") / F.col("_upto"))
    return steps.groupBy(*by).agg(_ratio(area, F.sum("_true")).alias("value"))

"""Ranking by comparing documents of a query two at a time.

All candidates of a query that are given are compared, n(n-1)/2 comparisons for n of them. Cap the run before it is
mapped to text (``head_per_query``, ``map_top_k``), or give a k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relrank.functions.logits import logit, predict
from relrank.functions.text import first_chunk
from relrank.operators.candidates import pair_candidates, positions
from relrank.operators.scoring import LexicalScorer, Scorer


def score_doc_pairs(mapped: DataFrame, scorer: Scorer | None = None, k: int | None = None) -> DataFrame:
    """Logits of every pair among the documents of a query, or among its first k. ``mapped`` has qid, docid, query, doc, rank.

    Texts are cut to their first chunk and prepared before they are paired. Cap the run before mapping it
    to text where it is longer than k.
    """
    scorer = scorer or LexicalScorer()
    short = mapped.withColumns({c: scorer.prepare(first_chunk(c)) for c in ("query", "doc")})
    pairs = pair_candidates(short, k, carry=["query", "doc"]).withColumnRenamed("query_a", "query").drop("query_b")
    return scorer.pair(pairs).drop("query", "doc_a", "doc_b")


def _per_document(pairs: DataFrame, value_a: Column, value_b: Column) -> DataFrame:
    """The sum, per document, of what each comparison gives it."""
    sides = F.array(
        F.struct(F.col("docid_a").alias("docid"), value_a.alias("value")),
        F.struct(F.col("docid_b").alias("docid"), value_b.alias("value")),
    )
    return pairs.select("qid", F.inline(sides)).groupBy("qid", "docid").agg(F.sum("value").alias("value"))


def rank_by_wins(run: DataFrame, pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Documents by comparisons won, equal ones in their old order."""
    won = predict("logits")
    wins = _per_document(pairs, won, 1 - won)
    order = Window.partitionBy("qid").orderBy(F.desc("wins"), "pos")  # as many rows as were compared
    return (
        positions(run, k)
        .select("qid", "docid", "pos")
        .join(wins, ["qid", "docid"], "left")
        .select("qid", "docid", "pos", F.coalesce("value", F.lit(0)).alias("wins"))
        .withColumn("rank", F.row_number().over(order))
    )


def win_probability(wins: DataFrame) -> DataFrame:
    """Softmax of the wins inside each query, to two decimals."""
    query = Window.partitionBy("qid")
    weight = F.exp(F.col("wins") - F.max("wins").over(query))
    return wins.withColumn("_weight", weight).select(
        *wins.columns, F.bround(F.col("_weight") / F.sum("_weight").over(query), 2).alias("probability")
    )


def rank_by_mean_logit(run: DataFrame, pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Documents by their mean logit over all comparisons. A single document has none: its score is null."""
    sums = _per_document(pairs, logit("logits", 1), logit("logits", 0))
    query = Window.partitionBy("qid")
    order = query.orderBy(F.desc_nulls_last("score"), "pos")  # as many rows as were compared
    return (
        positions(run, k)
        .select("qid", "docid", "pos")
        .join(sums, ["qid", "docid"], "left")
        .withColumn("score", F.try_divide("value", F.count("*").over(query) - 1))
        .withColumn("rank", F.row_number().over(order))
        .drop("value")
    )

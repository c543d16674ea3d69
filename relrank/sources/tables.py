"""Search-collection views over the sample tables: docs, queries, judgments, run, fairness rows, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.functions.text import words
from relrank.operators.ordering import evaluation_order, head_of_group

RUN_DEPTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on a small input of one or two row groups.

    Spark makes as many splits as there are cores of anything above 4 MB per core; that is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _docid(doc_id: str) -> Column:
    return F.concat(F.lit("D"), F.col(doc_id).cast("string"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        _docid("doc_id").alias("docid"),
        F.col("source").alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query")
    )


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is judged for a query when it holds the passage; its label is 1 or 2.

    A passage inside a text shares all its inner words with it, so pairs are found by joining on the longest
    inner word and then checked on the text itself.
    """
    text = documents(spark, sf_dir).select("doc_id", "text")
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    parts = F.split("passage", " ")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchors = passages.select(
        "item_id",
        F.when(F.size(inner) > 0, longest)
        .otherwise(F.raise_error(F.lit("a passage needs at least three words")).cast("string"))
        .alias("word"),
    )
    word_rows = text.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    near = word_rows.join(anchors, "word").select("doc_id", "item_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        near.join(passages, "item_id")
        .join(text, "doc_id")
        .where(F.contains("text", "passage"))
        .select("doc_id", "item_id")
        .join(labels, "doc_id", "left")
        .select(
            F.col("item_id").cast("string").alias("qid"),
            F.lit("Q0").alias("iter"),
            _docid("doc_id").alias("docid"),
            (F.lit(1) + F.coalesce("quality", F.lit(0))).cast("int").alias("label"),
        )
        .distinct()
    )


def run(spark: SparkSession, sf_dir: str, depth: int = RUN_DEPTH) -> DataFrame:
    """The top documents of each query, 100 unless said otherwise, by the number of its words they share."""
    query_words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words("text")).alias("word"))
    doc_words = documents(spark, sf_dir).select("doc_id", F.explode(words("text")).alias("word"))
    shared = doc_words.join(query_words, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    scored = shared.select(
        F.col("item_id").cast("string").alias("qid"), _docid("doc_id").alias("docid"), F.col("n").cast("double").alias("score")
    )
    return head_of_group(scored, ["qid"], evaluation_order(), depth, "rank").select(
        "qid", F.lit("Q0").alias("iter"), "docid", "rank", "score", F.lit("lex").alias("tag")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query words found (logit1) and not found (logit0) in each document of the run."""
    total = queries(spark, sf_dir).select("qid", F.size(words("query")).cast("double").alias("n"))
    return run(spark, sf_dir).join(total, "qid").select(
        "qid", "docid", "rank", F.array(F.col("n") - F.col("score"), F.col("score")).alias("logits")
    )


def fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return documents(spark, sf_dir).join(labels, "doc_id").select(
        F.col("source").alias("qid"),
        _docid("doc_id").alias("docid"),
        F.concat(F.lit("topic "), F.col("source")).alias("query"),
        F.col("text").alias("doc"),
        F.col("quality").alias("relevance"),
        F.col("toxic").alias("annotation"),
        F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("prediction"),
        F.col("n_chars").cast("double").alias("score"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's answer."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    answered = talk.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("doc")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "query", "doc"
    )

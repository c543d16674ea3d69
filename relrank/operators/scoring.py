"""Scoring (query, document) pairs and re-ranking by the scores.

A scorer has three parts. ``prepare`` turns a query or document text into what the scorer compares; it can
run before texts are joined to the pairs that share them. ``point`` adds a column ``logits`` = (logit0,
logit1) to a table with the prepared columns query and doc, ``pair`` to one with query, doc_a and doc_b.
Three scorers are given: word overlap, any model called on batches of prompts, and a classifier trained
with Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.functions.logits import predict, relevance_score
from relrank.functions.text import WORD, pair_prompt, point_prompt, words
from relrank.operators.candidates import map_run
from relrank.operators.ordering import PIECE_ROWS, rerank_order, running_totals
from relrank.schemas import require_columns
from relrank.session import checkpoint


class Scorer(Protocol):
    def prepare(self, text: Column) -> Column: ...

    def point(self, df: DataFrame) -> DataFrame: ...

    def pair(self, df: DataFrame) -> DataFrame: ...


class LexicalScorer:
    """Counts query words. Point: found in the document against not found. Pair: found in a against in b."""

    def prepare(self, text: Column) -> Column:
        return words(text)

    @staticmethod
    def _found(doc: str) -> Column:
        return F.size(F.array_intersect(doc, "query")).cast("double")  # hashes the shorter one

    def point(self, df: DataFrame) -> DataFrame:
        found = self._found("doc")
        return df.withColumn("logits", F.array(F.size("query") - found, found))

    def pair(self, df: DataFrame) -> DataFrame:
        return df.withColumn("logits", F.array(self._found("doc_b"), self._found("doc_a")))


SLICES = 1 << 16  # parts of the rows whose costs are summed before they are dealt out


def deal_evenly(df: DataFrame, cost: Column, tasks: int) -> DataFrame:
    """``df`` in ``tasks`` partitions of about equal total cost, each in order of cost.

    Rows are stored under a random slice number; the slices' prefix sums of cost say which task a slice goes to. Only the
    sums are ordered in one task, and broadcast.
    """
    rows = checkpoint(df.withColumns({"_cost": cost.cast("double"), "_slice": (F.rand(0) * SLICES).cast("int")}))
    sums = rows.groupBy("_slice").agg(F.sum("_cost").alias("_sum"))
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (F.sum("_sum").over(upto) - F.col("_sum") / 2) / F.sum("_sum").over(Window.partitionBy())
    placed = sums.select("_slice", F.least(F.floor(middle * tasks), F.lit(tasks - 1)).cast("int").alias("_task"))
    dealt = rows.join(F.broadcast(placed), "_slice").repartitionById(tasks, "_task")
    return dealt.sortWithinPartitions("_cost").select(*df.columns)


class PromptScorer:
    """Calls a model on batches of prompts.

    ``load`` runs once per task and returns the model: a function from a list of texts to an (n, 2) array.
    A few megabytes of text can be hours of work for a model, and Spark sizes its tasks by bytes: so the prompts are
    stored, and dealt out to ``tasks`` tasks of equal text length, by default four per core. A batch has prompts of
    like length.
    """

    def __init__(
        self, load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32, tasks: int | None = None
    ):
        self.load, self.batch_size, self.tasks = load, batch_size, tasks

    def prepare(self, text: Column) -> Column:
        return text

    def _call(self, df: DataFrame, prompt: Column) -> DataFrame:
        load, size = self.load, self.batch_size

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                parts = [model(texts.iloc[i : i + size].tolist()) for i in range(0, len(texts), size)]
                yield pd.Series([row for part in parts for row in np.asarray(part, dtype="float64")])

        tasks = self.tasks or 4 * df.sparkSession.sparkContext.defaultParallelism
        return deal_evenly(df.withColumn("_prompt", prompt), F.length("_prompt") + 1, tasks).withColumn("logits", logits("_prompt")).drop("_prompt")

    def texts(self, df: DataFrame) -> DataFrame:
        """Score a table of prompts in the column ``text``."""
        return self._call(df, F.col("text"))

    def point(self, df: DataFrame) -> DataFrame:
        return self._call(df, point_prompt("query", "doc"))

    def pair(self, df: DataFrame) -> DataFrame:
        return self._call(df, pair_prompt("query", "doc_a", "doc_b"))


class TrainedScorer:
    """A fitted pipeline of ``fit_pair_scorer``."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def prepare(self, text: Column) -> Column:
        return text

    def texts(self, df: DataFrame) -> DataFrame:
        """Score a table of prompts in the column ``text``."""
        scored = self.model.transform(df)
        return scored.select(*df.columns, vector_to_array("rawPrediction").alias("logits"))

    def point(self, df: DataFrame) -> DataFrame:
        return self.texts(df.withColumn("text", point_prompt("query", "doc"))).drop("text")

    def pair(self, df: DataFrame) -> DataFrame:
        return self.texts(df.withColumn("text", pair_prompt("query", "doc_a", "doc_b"))).drop("text")


def fit_pair_scorer(train: DataFrame, features: int = 4096, iterations: int = 20, penalty: float = 0.01) -> TrainedScorer:
    """Logistic regression on prompts (text, label): hashed words, and how many query words each document has."""
    require_columns(train, "text", "label")
    # The prompt without its labels: the query, then one or two documents.
    parts = r"split(text, '\\nDocu[a-z]+( [12])?:')"

    def found(i: int) -> str:
        shared = f"size(array_intersect(_query, regexp_extract_all(lower(coalesce(get(_parts, {i}), '')), '{WORD}', 0)))"
        return f"cast({shared} as double) / greatest(size(_query), 1) as _found_{i}"

    stages = [
        SQLTransformer(statement=f"select *, {parts} as _parts from __THIS__"),
        SQLTransformer(
            statement="select *, array_distinct(regexp_extract_all(lower(substr(_parts[0], 7)), "
            f"'{WORD}', 0)) as _query, regexp_extract_all(lower(text), '{WORD}', 0) as _words from __THIS__"
        ),
        SQLTransformer(statement=f"select *, {found(1)}, {found(2)} from __THIS__"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features, binary=True),
        VectorAssembler(inputCols=["_counts", "_found_1", "_found_2"], outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="label", maxIter=iterations, regParam=penalty),
    ]
    return TrainedScorer(Pipeline(stages=stages).fit(train.select("text", "label")))


def text_shape(text: str | Column) -> list[Column]:
    """Two dense features of a text: the share of letters a-z in its characters, and of distinct words in its words."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))
    letters = F.length(F.regexp_replace(F.lower(text), "[^a-z]", ""))
    return [letters / F.greatest(F.length(text), F.lit(1)), F.size(F.array_distinct(found)) / F.greatest(F.size(found), F.lit(1))]


@dataclass(frozen=True)
class LogisticScorer:
    """Weights of ``fit_logistic``: a constant, then one for each of ``features``. Logits are 0 and their sum."""

    weights: tuple[float, ...]
    features: Callable[[str | Column], list[Column]] = text_shape

    def prepare(self, text: Column) -> Column:
        return text

    def texts(self, df: DataFrame) -> DataFrame:
        """Score a table of texts in the column ``text``."""
        first, *rest = self.weights
        total = sum((F.lit(w) * x for w, x in zip(rest, self.features("text"))), F.lit(first))
        return df.withColumn("logits", F.array(F.lit(0.0), total))

    def point(self, df: DataFrame) -> DataFrame:
        return self.texts(df.withColumn("text", point_prompt("query", "doc"))).drop("text")

    def pair(self, df: DataFrame) -> DataFrame:
        return self.texts(df.withColumn("text", pair_prompt("query", "doc_a", "doc_b"))).drop("text")


def fit_logistic(
    train: DataFrame, features: Callable[[str | Column], list[Column]] = text_shape, steps: int = 6, penalty: float = 0.1
) -> LogisticScorer:
    """Logistic regression of ``label`` on a few dense features of ``text``, by Newton steps.

    The features are computed once and stored. A step is one pass: the map tasks add up the gradient and the products of
    the features (their Gram matrix, weighted), a row of d (d + 3) / 2 numbers for d weights, and the driver solves for the
    new weights. ``penalty`` holds back all weights but the constant. Rows without a label count for nothing.
    """
    require_columns(train, "text", "label")
    columns = features("text")
    names = ["x_0", *(f"x_{i}" for i in range(1, len(columns) + 1))]
    rows = train.where("label is not null").select(
        F.col("label").cast("double").alias("y"), F.lit(1.0).alias("x_0"), *[c.cast("double").alias(n) for c, n in zip(columns, names[1:])]
    )
    rows = checkpoint(rows)
    weights, size = np.zeros(len(names)), len(names)
    held = penalty * np.diag([0.0] + [1.0] * (size - 1))
    for _ in range(steps):
        chance = 1 / (1 + F.exp(-sum((F.lit(float(w)) * F.col(n) for w, n in zip(weights[1:], names[1:])), F.lit(float(weights[0])))))
        placed = rows.withColumns({"_p": chance})
        gradient = [F.sum((F.col("y") - F.col("_p")) * F.col(n)) for n in names]
        gram = [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(names[i]) * F.col(names[j])) for i in range(size) for j in range(i + 1)]
        sums = np.array([v or 0.0 for v in placed.agg(*[c.alias(f"_{k}") for k, c in enumerate(gradient + gram)]).first()])
        curve = np.zeros((size, size))
        curve[np.tril_indices(size)] = sums[size:]
        curve = curve + np.tril(curve, -1).T + held
        weights = weights + np.linalg.lstsq(curve, sums[:size] - held @ weights, rcond=None)[0]
    return LogisticScorer(tuple(float(w) for w in weights), features)


def score_pairs(df: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Add the logits and drop the document text, so that later shuffles do not carry it."""
    scorer = scorer or LexicalScorer()
    require_columns(df, "query", "doc")
    ready = df.withColumns(
        {"_text": F.col("query"), "query": scorer.prepare(F.col("query")), "doc": scorer.prepare(F.col("doc"))}
    )
    scored = scorer.point(ready).withColumn("query", F.col("_text"))
    return scored.select(*[c for c in df.columns if c != "doc"], "logits")


def score_run(
    run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Scorer | None = None, k: int | None = None
) -> DataFrame:
    """The logits of every run row: ``map_run`` and ``score_pairs`` in one, preparing each text once."""
    scorer = scorer or LexicalScorer()
    return scorer.point(map_run(run, queries, docs, k, prepare=scorer.prepare)).drop("query", "doc")


def classify(scored: DataFrame, kind: int = 1) -> DataFrame:
    """Replace the logits by prediction and score."""
    return scored.select(
        *[c for c in scored.columns if c not in ("logits", "prediction", "score")],
        predict("logits").alias("prediction"),
        relevance_score("logits", kind).alias("score"),
    )


def rerank(df: DataFrame, piece_rows: int | None = PIECE_ROWS) -> DataFrame:
    """Rank 1 … n inside each query by score, highest first; NaN counts as missing and comes last."""
    require_columns(df, "qid", "docid", "score")
    scored = df.drop("rank").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    ranked = running_totals(scored, ["qid"], rerank_order(), {"rank": F.lit(1)}, piece_rows)
    return ranked.withColumn("rank", F.col("rank").cast("int"))


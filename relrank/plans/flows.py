"""The workflows, each a composition of operators. What is read more than once is stored in between."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.functions.logits import predict
from relrank.functions.text import point_prompt
from relrank.operators.candidates import build_fair, head_per_query, project_run, to_qrels
from relrank.operators.classification import class_metrics, confusion, cross_entropy
from relrank.operators.fairness import fairness_by_query, fairness_report
from relrank.operators.metrics import evaluate, evaluate_by_query, ndcg_tied
from relrank.operators.pairwise import rank_by_mean_logit, rank_by_wins, score_doc_pairs, win_probability
from relrank.operators.sampling import (
    balanced_ids, negative_ids, positive_ids, sample_negative, sample_positive, shuffle, split_train_test, with_text,
)
from relrank.operators.scoring import PromptScorer, Scorer, TrainedScorer, classify, fit_pair_scorer, rerank, score_pairs, score_run
from relrank.schemas import FAIR, require_columns
from relrank.session import checkpoint
from relrank.sources.readers import read_fair_tree, read_prompts, read_tsv
from relrank.sources.writers import write_qrels, write_run, write_tsv


def training_pairs(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, k: int = 5, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The relevant and the non-relevant (query, document) pairs: one of each per query."""
    return (
        sample_positive(run, queries, qrels, docs, seed),
        sample_negative(run, queries, qrels, docs, k, seed),
    )


def training_prompts(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, n: int | None = None, k: int = 5, seed: int = 0
) -> DataFrame:
    """n prompts of each class, by default as many as the scarcer class has.

    Ids are drawn once and stored; text joins only those that are sampled.
    """
    run = checkpoint(run.select("qid", "docid", "rank"))
    relevant = checkpoint(positive_ids(run, queries, qrels, docs, seed))
    non_relevant = checkpoint(negative_ids(run, relevant, docs, k, seed))
    drawn = balanced_ids(relevant, non_relevant, n, seed)
    prompts = with_text(drawn, queries, docs).select("qid", "docid", point_prompt("query", "doc").alias("text"), "label")
    return shuffle(prompts, ["qid", "docid", "label"], seed)


@dataclass
class Trained:
    scorer: TrainedScorer
    scored_test: DataFrame
    metrics: DataFrame


def train(
    prompts: DataFrame, test_size: float = 0.2, seed: int = 0, iterations: int = 20, keys: Sequence[str] | None = None
) -> Trained:
    """Fit on the training part of the prompts and judge on the rest; both are stored.

    Rows are split by ``keys``: qid, docid and label if they are there, else the prompt itself.
    """
    ids = [c for c in ("qid", "docid", "label") if c in prompts.columns]
    keys = keys or (ids if len(ids) == 3 else ["text", "label"])
    parts = checkpoint(split_train_test(require_columns(prompts, "text", "label"), keys, test_size, seed))
    scorer = fit_pair_scorer(parts.where(F.col("part") == "train"), iterations=iterations)
    test = parts.where(F.col("part") == "test")
    scored = checkpoint(scorer.texts(test).withColumn("prediction", predict("logits")))
    share = scored.agg(F.avg("label")).scalar()
    metrics = class_metrics(scored).withColumns(
        {"loss": cross_entropy(scored).scalar(), "majority": F.greatest(share, 1 - share)}  # what a constant answer reaches
    )
    return Trained(scorer, scored, metrics)


def score_and_rerank(mapped: DataFrame, scorer: Scorer | None = None, kind: int = 1, fair: bool = False) -> DataFrame:
    """Score (query, document) rows and rank them inside each query."""
    return project_run(rerank(classify(checkpoint(score_pairs(mapped, scorer)), kind)), fair)


def rerank_run(
    run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Scorer | None = None, k: int | None = None, kind: int = 1
) -> DataFrame:
    """The same from a run. The scores are stored before they are ranked, so that no row is scored twice."""
    return project_run(rerank(classify(checkpoint(score_run(run, queries, docs, scorer, k)), kind)))


@dataclass
class Report:
    overall: DataFrame
    by_query: DataFrame
    fairness: DataFrame | None = None
    fairness_by_query: DataFrame | None = None


def judge(
    scored: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, k: int | None = None, fairness: bool = False
) -> Report:
    """Ranking metrics, overall and per query, and the annotation mixes if wanted. ``k`` cuts the lists first."""
    if k is not None:
        scored = head_per_query(scored, k)
    scored, qrels = checkpoint(scored), checkpoint(qrels)
    report = Report(evaluate(scored, qrels), evaluate_by_query(scored, qrels, queries))
    if fairness:
        require_columns(scored, "annotation", "prediction")
        report.fairness = fairness_report(scored)
        report.fairness_by_query = fairness_by_query(scored)
    return report


def evaluate_classifier(spark: SparkSession, path: str, scorer: TrainedScorer | PromptScorer) -> DataFrame:
    """Judge a classifier on a labelled prompt file (text, label): one row of accuracy, precision, recall, f1, the cells
    of the confusion matrix, and the loss. The prompts are scored once and the scores stored."""
    scored = scorer.texts(read_prompts(spark, path)).select("label", "logits", predict("logits").alias("prediction"))
    scored = checkpoint(scored)
    one = lambda df, names: {c: df.select(c).scalar() for c in names}
    cells = confusion(scored)
    return class_metrics(scored).withColumns({**one(cells, cells.columns), "loss": cross_entropy(scored).scalar()})


def fair_dataset(spark: SparkSession, root: str, path: str, qrels_path: str) -> DataFrame:
    """From the fairness folders to the data set file and its judgment file; returns the data set as it was written."""
    docs, annotations = read_fair_tree(spark, root)
    write_tsv(build_fair(docs, annotations).select(*FAIR.names), path)
    written = read_tsv(spark, path, FAIR, multi_line=True)
    write_qrels(to_qrels(written), qrels_path)
    return written


def rank_pairwise(mapped: DataFrame, scorer: Scorer | None = None, k: int | None = None, method: str = "wins") -> DataFrame:
    """Rank the documents of each query, or its first k, by comparing them, by 'wins' or by 'mean_logit'.

    ``mapped`` is read twice; store it first when it is costly.
    """
    pairs = score_doc_pairs(mapped, scorer, k)
    if method == "wins":
        return win_probability(rank_by_wins(mapped, pairs, k))
    if method == "mean_logit":
        return rank_by_mean_logit(mapped, pairs, k)
    raise ValueError(f"method must be 'wins' or 'mean_logit', not {method!r}")


def evaluate_pairwise(mapped: DataFrame, scorer: Scorer | None = None, k: int = 10) -> DataFrame:
    """nDCG at k per query of the ranking by wins, whose gains are 10 + the score of the run (``mean_metric`` averages
    them). ``mapped`` has qid, docid, query, doc, rank and score, and all its documents are compared; it is read three
    times."""
    ranked = rank_pairwise(mapped, scorer)
    gains = mapped.select("qid", "docid", (F.lit(10) + F.col("score")).alias("gain"))
    return ndcg_tied(ranked.join(gains, ["qid", "docid"]), "gain", "probability", k)


def submit_pairwise(mapped: DataFrame, run_id: str, path: str, scorer: Scorer | None = None) -> None:
    """Append the ranking by mean logits to a run file. A query's only document has no comparison and is left out."""
    ranked = rank_pairwise(mapped, scorer, method="mean_logit").where(F.col("score").isNotNull())
    write_run(ranked, run_id, path)

"""Scorers, re-ranking, pairwise ranking, whole workflows."""

import numpy as np
import pytest
from conftest import SMALL, table
from pyspark.sql import functions as F

from relrank.operators import pairwise as p
from relrank.operators import scoring as sc
from relrank.plans import flows
from relrank.sources import tables


@pytest.fixture(scope="module")
def length_model():
    return lambda: lambda prompts: np.array([(0.0, len(x)) for x in prompts])


@pytest.fixture(scope="module")
def mapped(frame):
    rows = [("q", f"d{i}", "some words here", "words " * i + "other", i) for i in range(1, 5)] + [("r", "d1", "none", "text", 1)]
    return frame(rows, "qid string, docid string, query string, doc string, rank int")


def test_lexical(mapped):
    logits = {(r["qid"], r["docid"]): r["logits"] for r in sc.score_pairs(mapped).collect()}
    assert logits[("q", "d1")] == [2.0, 1.0] and logits[("r", "d1")] == [1.0, 0.0]
    assert sc.score_pairs(mapped).columns == ["qid", "docid", "query", "rank", "logits"]


@pytest.mark.parametrize("batch", [1, 2, 32])
def test_prompts_reach_the_model(mapped, length_model, batch):
    scored = sc.score_pairs(mapped, sc.PromptScorer(length_model, batch, tasks=2))
    got = {(r["qid"], r["docid"]): r["logits"][1] for r in scored.collect()}
    want = {(r["qid"], r["docid"]): len(f"Query:{r['query']}\nDocument:{r['doc']}") for r in mapped.collect()}
    assert got == want


@pytest.mark.parametrize("piece_rows", [None, 2])
def test_rerank(frame, piece_rows):
    rows = [("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0), ("q", "n", None), ("q", "m", float("nan")), ("r", "x", 0.0)]
    ranked = sc.rerank(frame(rows, "qid string, docid string, score double"), piece_rows)
    assert table(ranked.where("qid = 'q'").select("docid", "rank"), "docid") == {"c": 1, "a": 2, "b": 3, "m": 4, "n": 5}
    assert dict(ranked.dtypes)["rank"] == "int"


def test_tasks_cost_the_same(frame):
    """Text is dealt out by its length, also where a few rows have most of it or a third of the rows are equal."""
    rows = [(i, "x" * (20 if i % 3 else 1 + i * 7919 % 300)) for i in range(6000)]
    dealt = sc.deal_evenly(frame(rows, "i int, text string"), F.length("text"), 10)
    assert dealt.columns == ["i", "text"] and sorted(r["i"] for r in dealt.collect()) == list(range(6000))
    costs = [r["cost"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("cost")).collect()]
    assert len(costs) == 10 and max(costs) <= 1.2 * min(costs)
    parts = dealt.withColumn("n", F.length("text")).select("n").rdd.glom().collect()
    assert all([r["n"] for r in part] == sorted(r["n"] for r in part) for part in parts)


def test_columns_are_checked(mapped):
    with pytest.raises(ValueError, match="score"):
        sc.rerank(mapped)
    with pytest.raises(ValueError, match="doc"):
        sc.score_pairs(mapped.drop("doc"))


@pytest.fixture(scope="module")
def compared(frame):
    run = frame([("q", d, i) for i, d in enumerate("abc", 1)] + [("one", "x", 1)], "qid string, docid string, rank int")
    rows = [("q", "a", "b", [0.0, 2.0]), ("q", "a", "c", [0.5, 1.0]), ("q", "b", "c", [0.0, 1.0])]
    return run, frame(rows, "qid string, docid_a string, docid_b string, logits array<double>")


def test_wins(compared):
    wins = p.rank_by_wins(*compared)
    got = {(r["qid"], r["docid"]): (r["wins"], r["rank"]) for r in wins.collect()}
    assert got == {("q", "a"): (2, 1), ("q", "b"): (1, 2), ("q", "c"): (0, 3), ("one", "x"): (0, 1)}
    probability = {(r["qid"], r["docid"]): r["probability"] for r in p.win_probability(wins).collect()}
    assert probability == {("q", "a"): 0.67, ("q", "b"): 0.24, ("q", "c"): 0.09, ("one", "x"): 1.0}


def test_equal_wins_keep_their_order(frame):
    run = frame([("q", d, i) for i, d in enumerate("zyx", 1)], "qid string, docid string, rank int")
    rows = [("q", "z", "y", [0.0, 1.0]), ("q", "z", "x", [1.0, 0.0]), ("q", "y", "x", [0.0, 1.0])]
    pairs = frame(rows, "qid string, docid_a string, docid_b string, logits array<double>")
    assert table(p.rank_by_wins(run, pairs).select("docid", "rank"), "docid") == {"z": 1, "y": 2, "x": 3}


def test_mean_logit(compared):
    got = {(r["qid"], r["docid"]): (r["score"], r["rank"]) for r in p.rank_by_mean_logit(*compared).collect()}
    assert got == {("q", "a"): (1.5, 1), ("q", "b"): (0.5, 2), ("q", "c"): (0.25, 3), ("one", "x"): (None, 1)}


def test_pair_counts_and_texts(mapped, length_model):
    pairs = p.score_doc_pairs(mapped, sc.PromptScorer(length_model, tasks=2), k=4)
    assert pairs.count() == 6
    assert p.score_doc_pairs(mapped, k=2).count() == 1


def test_pairwise_flow(mapped):
    for method in ("wins", "mean_logit"):
        assert flows.rank_pairwise(mapped, k=4, method=method).count() == 5
    with pytest.raises(ValueError):
        flows.rank_pairwise(mapped, method="votes")


def test_training_beats_the_majority(frame):
    rows = []
    for i in range(120):
        topic = ("apple", "river", "stone", "cloud")[i % 4]
        doc = f"about {topic} and more" if i % 2 else "about nothing at all"
        rows.append((f"Query:find {topic} number{i}\nDocument:{doc} item{i}", i % 2))
    trained = flows.train(frame(rows, "text string, label int"))
    metrics = trained.metrics.first()
    assert metrics["accuracy"] > 0.9 and metrics["loss"] < 0.5
    again = trained.scorer.texts(frame(rows[:3], "text string, label int"))
    assert all(len(r["logits"]) == 2 and r["logits"][0] == -r["logits"][1] for r in again.collect())


def test_newton_steps(frame, mapped):
    """Weights at the optimum: with them, no direction makes the penalised likelihood better."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        letters, signs = rng.integers(1, 40), rng.integers(1, 40)
        chance = 1 / (1 + np.exp(-8 * (letters / (letters + signs) - 0.5)))
        rows.append(("x" * int(letters) + "%" * int(signs), int(rng.random() < chance)))
    df = frame(rows + [("unlabelled", None)], "text string, label int")
    scorer = sc.fit_logistic(df, steps=8, penalty=0.5)
    x = np.array([[1.0, t.count("x") / len(t), 1.0] for t, _ in rows])
    y, w = np.array([v for _, v in rows]), np.array(scorer.weights)
    p_ = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p_) - 0.5 * np.array([0, 1, 1]) * w).max() < 1e-6
    right = [(r["logits"][1] > 0) == (r["label"] == 1) for r in scorer.texts(df.where("label is not null")).collect()]
    assert np.mean(right) > max(y.mean(), 1 - y.mean()) + 0.1
    assert flows.score_and_rerank(mapped, scorer).count() == 5
    assert sc.fit_logistic(df.where("false")).weights == (0.0, 0.0, 0.0)


def test_trained_scorer_reranks(frame, mapped):
    rows = [(f"Query:words\nDocument:{'words' if i % 2 else 'nothing'} n{i}", i % 2) for i in range(40)]
    scorer = sc.fit_pair_scorer(frame(rows, "text string, label int"))
    assert flows.score_and_rerank(mapped, scorer).count() == 5
    assert p.score_doc_pairs(mapped, scorer, k=3).count() == 3


def test_judge(spark):
    scored = sc.rerank(tables.fair(spark, SMALL))
    qrels = scored.selectExpr("qid", "docid", "relevance as label")
    queries = scored.select("qid", "query").distinct()
    report = flows.judge(scored, qrels, queries, k=10, fairness=True)
    assert report.overall.count() == 1
    assert report.by_query.columns[:3] == ["qid", "query", "precision@10"]
    for row in report.fairness_by_query.collect():
        for name in ("relevant_frac_annotation", "non_relevant_frac_annotation"):
            assert row[name] == {} or sum(row[name].values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="annotation"):
        flows.judge(scored.drop("annotation"), qrels, fairness=True)


def test_rerank_run_equals_two_steps(spark):
    run, queries, docs = tables.run(spark, SMALL), tables.queries(spark, SMALL), tables.docs(spark, SMALL)
    from relrank.operators.candidates import map_run

    one = flows.rerank_run(run, queries, docs)
    two = flows.score_and_rerank(map_run(run, queries, docs))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert one.agg(F.max("rank")).first()[0] == 100

"""Worked examples of the ranking metrics, and brute force on random runs."""

import math
import random

import pytest
from conftest import table

from relrank.operators import metrics as m
from relrank.operators.candidates import join_qrels

RUN = "qid string, docid string, score double"
QRELS = "qid string, docid string, label int"


@pytest.fixture(scope="module")
def example(frame):
    run = frame([("q", d, s) for d, s in (("a", 0.9), ("b", 0.8), ("c", 0.8), ("d", 0.1))], RUN)
    qrels = frame([("q", "a", 0), ("q", "b", 2), ("q", "c", 1), ("q", "z", 1)], QRELS)
    return run, qrels


def value(df):
    return df.first()["value"]


def test_worked_example(example):
    assert value(m.precision_at(*example)) == pytest.approx(0.2)
    assert value(m.average_precision(*example)) == pytest.approx(0.388889, abs=1e-6)
    assert value(m.average_precision(*example, min_rel=2, depth=100)) == pytest.approx(0.333333, abs=1e-6)
    assert value(m.ndcg_at(*example, k=1)) == 0
    assert value(m.ndcg_at(*example, k=10)) == pytest.approx(0.520909, abs=1e-6)
    assert value(m.recall_at(*example)) == pytest.approx(0.666667, abs=1e-6)


def test_table_agrees_with_single_metrics(example):
    row = m.evaluate(*example).first()
    assert row["AP(rel=2)@100"] == pytest.approx(0.333333, abs=1e-6)
    assert row["map"] == pytest.approx(0.388889, abs=1e-6)
    assert row["nDCG@10"] == pytest.approx(0.520909, abs=1e-6)


def brute(run, qrels, k):
    """P@k, AP, nDCG@k of one query."""
    order = [d for d, _ in sorted(run.items(), key=lambda x: (x[1], x[0]), reverse=True)]
    labels = [qrels.get(d, 0) for d in order]
    found, ap = 0, 0.0
    for i, label in enumerate(labels, 1):
        if label >= 1:
            found += 1
            ap += found / i
    relevant = sum(v >= 1 for v in qrels.values())
    gain = sum(max(v, 0) / math.log2(i + 1) for i, v in enumerate(labels[:k], 1))
    ideal = sum(max(v, 0) / math.log2(i + 1) for i, v in enumerate(sorted(qrels.values(), reverse=True)[:k], 1))
    return (
        sum(v >= 1 for v in labels[:k]) / k,
        ap / relevant if relevant else 0.0,
        gain / ideal if ideal else 0.0,
    )


@pytest.mark.parametrize("piece_rows", [None, 1000, 5])
def test_against_brute_force(frame, piece_rows):
    rng = random.Random(3)
    runs = {f"q{i}": {f"d{j}": rng.choice([1.0, 2.0, 3.5, rng.random()]) for j in range(size)}
            for i, size in enumerate((1, 4, 9, 40, 120))}
    judged = {q: {f"d{j}": rng.choice([-1, 0, 1, 2]) for j in rng.sample(range(130), 20)} for q in runs}
    run = frame([(q, d, s) for q, r in runs.items() for d, s in r.items()], RUN)
    qrels = frame([(q, d, v) for q, r in judged.items() for d, v in r.items()], QRELS)
    got = table(m.evaluate_by_query(run, qrels, piece_rows=piece_rows), "qid")
    assert set(got) == set(runs)
    for q in runs:
        p10, ap, ndcg10 = brute(runs[q], judged[q], 10)
        assert got[q][0] == pytest.approx(p10)
        assert got[q][1] == pytest.approx(ap)
        assert got[q][4] == pytest.approx(ndcg10)
        assert got[q][5] == pytest.approx(brute(runs[q], judged[q], 100)[2])
        assert all(0 <= v <= 1 + 1e-12 for v in got[q])


def test_ideal_order_gives_one(frame):
    qrels = frame([("q", f"d{i}", i % 3) for i in range(30)], QRELS)
    run = qrels.selectExpr("qid", "docid", "cast(label as double) score")
    assert value(m.ndcg_at(run, qrels, 10)) == pytest.approx(1.0)


def test_means_count_absent_queries(frame):
    run = frame([("a", "x", 1.0), ("c", "x", 1.0)], RUN)
    qrels = frame([("a", "x", 1), ("b", "x", 1)], QRELS)
    p1 = m.precision_at(run, qrels, 1)
    assert m.corpus_mean(p1, qrels).first()["mean"] == 0.5  # a: 1, b: absent
    assert m.corpus_mean(p1).first()["mean"] == 0.5  # a: 1, c: unjudged
    assert m.evaluate(run, qrels, "run").first()["map"] == 0.5
    with pytest.raises(ValueError):
        m.evaluate(run, qrels, "all")


def test_unjudged_is_zero(example):
    labels = table(join_qrels(*example).select("docid", "label"), "docid")
    assert labels == {"a": 0, "b": 2, "c": 1, "d": 0}


def test_empty_inputs(frame):
    run, qrels = frame([], RUN), frame([], QRELS)
    assert m.evaluate_by_query(run, qrels).count() == 0
    assert m.mean_metric(m.precision_at(run, qrels)).first()["mean"] == 0


def sets(frame, true, predicted):
    truth = frame([("q", str(d)) for d in true], "qid string, docid string")
    guess = frame([("q", str(d), i) for i, d in enumerate(predicted, 1)], "qid string, docid string, rank int")
    return truth, guess


def test_set_metrics(frame):
    inputs = sets(frame, [1, 2, 3], [1, 9, 2, 8])
    assert value(m.set_ap_at(*inputs, k=4)) == pytest.approx(0.555556, abs=1e-6)
    assert value(m.set_precision_at(*inputs, k=4)) == 0.5
    assert [value(m.rel_at(*inputs, k=k)) for k in (1, 2, 3, 4, 5)] == [1.0, 0.0, 1.0, 0.0, None]
    assert m.set_map_at(*inputs, k=4).first()["mean"] == pytest.approx(0.555556, abs=1e-6)


def test_repeated_prediction_counts_once_in_precision(frame):
    inputs = sets(frame, [1, 2], [1, 1, 2])
    assert value(m.set_precision_at(*inputs, k=3)) == pytest.approx(2 / 3)
    # Places 1, 2, 3 are all true; precision there is 1, 1/2, 2/3.
    assert value(m.set_ap_at(*inputs, k=3)) == pytest.approx((1 + 1 / 2 + 2 / 3) / 2)


def test_tied_ndcg(frame):
    df = frame([("q", 13.0, 0.5), ("q", 11.0, 0.5), ("q", 12.0, 0.0)], "qid string, gain double, p double")
    assert value(m.ndcg_tied(df, "gain", "p", 10)) == pytest.approx(0.980822, abs=1e-6)


def test_tied_ndcg_when_a_tie_crosses_the_cutoff(frame):
    df = frame([("q", float(g), 1.0) for g in (3, 2, 1, 0)], "qid string, gain double, p double")
    discounts = 1 + 1 / math.log2(3)
    assert value(m.ndcg_tied(df, "gain", "p", 2)) == pytest.approx(1.5 * discounts / (3 + 2 / math.log2(3)))


@pytest.mark.parametrize("piece_rows", [None, 3])
def test_average_precision_from_scores(frame, piece_rows):
    rows = [("q", 1, 0.9), ("q", 0, 0.8), ("q", 1, 0.8), ("q", 0, 0.3), ("q", 1, 0.1), ("p", 0, 0.5)]
    df = frame(rows, "qid string, label int, score double")
    got = table(m.ap_from_scores(df, "label", "score", piece_rows=piece_rows), "qid")
    assert got["q"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert got["p"] == 0

"""Published confusion matrices, losses, annotation mixes."""

import math

import pytest

from relrank.operators import classification as cl
from relrank.operators import fairness as fa


@pytest.mark.parametrize(
    "matrix, expected, printed",
    [
        ([[249, 1], [7, 243]], (0.984, 0.995902, 0.972, 0.983806), (0.98, 1.00, 0.97, 0.98)),
        ([[780, 220], [154, 846]], (0.813, 0.793621, 0.846, 0.818974), (0.81, 0.79, 0.85, 0.82)),
        ([[796, 204], [163, 837]], (0.8165, 0.804035, 0.837, 0.820186), (0.82, 0.80, 0.84, 0.82)),
    ],
)
def test_published_matrices(frame, matrix, expected, printed):
    rows = [(y, p) for y in (0, 1) for p in (0, 1) for _ in range(matrix[y][p])]
    df = frame(rows, "label int, prediction int")
    assert tuple(cl.confusion(df).first()) == (*matrix[0], *matrix[1])
    got = tuple(cl.class_metrics(df).first())
    assert got == pytest.approx(expected, abs=1e-6)
    assert all(abs(a - b) < 0.0051 for a, b in zip(got, printed))


def test_empty_class(frame):
    df = frame([(0, 0)], "label int, prediction int")
    assert tuple(cl.class_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)


def test_cross_entropy(frame):
    df = frame([([0.0, 2.0], 1), ([1.0, 0.0], 1)], "logits array<double>, label int")
    assert cl.cross_entropy(df).first()["loss"] == pytest.approx(0.720095, abs=1e-6)


def test_cross_entropy_does_not_underflow(frame):
    df = frame([([0.0, 5000.0], 0)], "logits array<double>, label int")
    assert cl.cross_entropy(df).first()["loss"] == pytest.approx(5000.0)


def test_batched_loss(frame):
    rows = [(str(i), [0.0, float(i % 5)], i % 2) for i in range(70)]
    df = frame(rows, "id string, logits array<double>, label int")
    one = cl.batched_loss(df, ["id"], batch_size=70).first()
    assert one["loss"] == pytest.approx(cl.cross_entropy(df).first()["loss"])
    right = sum((i % 5 > 0) == (i % 2 == 1) for i in range(70))
    assert one["accuracy"] == pytest.approx(right / 70)
    # Batches of 32, 32 and 6 weigh the same.
    import hashlib

    order = sorted(range(70), key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest())
    losses = [math.log(1 + math.exp(i % 5)) - (i % 5) * (i % 2) for i in order]
    means = [sum(losses[a:b]) / (b - a) for a, b in ((0, 32), (32, 64), (64, 70))]
    assert cl.batched_loss(df, ["id"]).first()["loss"] == pytest.approx(sum(means) / 3)


@pytest.fixture(scope="module")
def predictions(frame):
    rows = [("q", "t", "a", 1, 1, 1), ("q", "t", "b", 2, 1, 1), ("q", "t", "c", 3, 1, 0), ("q", "t", "d", 4, 0, None)]
    return frame(rows, "qid string, query string, docid string, rank int, prediction int, annotation int")


def test_mix(predictions):
    row = fa.annotation_mix(predictions, "relevant").first()
    assert row["total"] == 3
    assert row["fractions"] == pytest.approx({0: 1 / 3, 1: 2 / 3})
    empty = fa.annotation_mix(predictions, "non-relevant").first()
    assert (empty["total"], empty["fractions"]) == (0, {})
    with pytest.raises(ValueError):
        fa.annotation_mix(predictions, "other")


def test_report_and_by_query(predictions):
    for df in (fa.fairness_report(predictions), fa.fairness_by_query(predictions)):
        row = df.first()
        assert row["total_rel_annotation_count"] == 3
        assert row["relevant_frac_annotation"] == pytest.approx({0: 1 / 3, 1: 2 / 3})
        assert (row["total_non_annotation_count"], row["non_relevant_frac_annotation"]) == (0, {})


def test_depth_cut(predictions):
    row = fa.fairness_at_k(predictions, 2).first()
    assert (row["total_rel_annotation_count"], row["relevant_frac_annotation"]) == (2, {1: 1.0})


def test_missing_annotation_column(predictions):
    with pytest.raises(ValueError, match="annotation"):
        fa.fairness_by_query(predictions.drop("annotation"))

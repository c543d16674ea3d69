import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relrank.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from tests.llm.conftest import HARD


def brute(rows):
    groups = {}
    for i, t in rows:
        plain = (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(plain, []).append((-len(t or ""), i is None, i or 0, i))
    found = []
    for plain, own in groups.items():
        keep = min(own)[3]
        found += [(i, keep, len(own), i == keep, hashlib.sha256(plain.encode()).hexdigest()) for *_, i in own]
    return sorted(found, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(draw, n):
    texts = [" ".join(draw.choice("ab\té") for _ in range(draw.randrange(6))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


def test_against_all_groups(documents):
    draw = random.Random(1)
    rows = rows_of(draw, 400) + [(1000 + i, f"alone {i}") for i in range(300)]
    draw.shuffle(rows)
    assert result(exact_dedup(documents(rows))) == brute(rows)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 10])
def test_ranges_change_nothing(spark, documents, bits):
    """One range or eight; the texts are read once for the decision, and once on each way for the rows."""
    rows = rows_of(random.Random(2), 300) + [(1000 + i, f"alone {i}") for i in range(200)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = documents(rows).withColumn("text", counted("text"))
    assert result(exact_dedup(docs, most_bits=bits)) == brute(rows)
    assert read.value == len(rows)
    kept = drop_exact_duplicates(docs, most_bits=bits)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, k, _ in brute(rows) if k)
    assert read.value <= 5 * len(rows)


def test_smallest_id(documents):
    least = -(1 << 63)
    assert result(exact_dedup(documents([(least, "a"), (5, "a"), (least, "b b"), (6, "bb")]))) == brute([(least, "a"), (5, "a"), (least, "b b"), (6, "bb")])


def test_hard_cases(hard):
    assert result(exact_dedup(hard)) == brute(HARD)
    kept = drop_exact_duplicates(hard)
    assert kept.columns == hard.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _, k, _ in brute(HARD) if k)
    assert exact_dedup(hard.where("false")).count() == 0
    assert drop_exact_duplicates(hard.where("false")).count() == 0


def test_ids_that_stand_on_several_texts(spark, documents):
    from relrank.llm.decontamination import drop_leaks

    rows = [(3, "A"), (5, "A"), (5, "B"), (7, "B"), (None, "C"), (2, "C"), (None, "D"), (None, "D"), (8, "E e"), (8, "Ee"), (9, "F")]
    kept = drop_exact_duplicates(documents(rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("3", "A"), ("5", "B"), ("2", "C"), ("None", "D"), ("8", "E e"), ("9", "F")]
    )
    passage = "seventeen quiet otters carried the brass lantern across a frozen harbour while nobody watched them go"
    rows = [(None, passage), (None, "clean"), (4, "clean too"), (4, passage + " again")]
    kept = drop_leaks(documents(rows), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == ["clean", "clean too"]

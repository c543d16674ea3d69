import random

import numpy as np
import pytest

from relrank.llm import decontamination as d
from relrank.llm.queries import QUERIES
from tests.llm.conftest import HARD

SMALL = "/root/testdata/sf0.001"
UPPER = {c: c - 32 for c in range(97, 123)}


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    draw = random.Random(2)
    for _ in range(300):
        a = np.array([draw.randrange(6) for _ in range(draw.randrange(1, 80))], np.uint64)
        b = np.array([draw.randrange(7) for _ in range(draw.randrange(80))], np.uint64)
        assert d.common_subsequence(a, b) == plain_subsequence(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def sample(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    return docs, items


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_every_planted_passage_is_found_and_nothing_else(spark, sample):
    docs, items = sample
    want = {(i, j) for i, t in docs for j, x in items if x in t}
    assert want and found(QUERIES["op7_decontamination"](spark, SMALL)) == want


def test_against_all_pairs_of_windows(spark, sample, documents):
    """Recall and precision without the cosine search: every window of every document meets every passage."""
    draw, (docs, items) = random.Random(4), sample
    rows = [(i, t) for i, t in docs if not any(x in t for _, x in items)][:40]
    clean = {i for i, _ in rows}
    other = [w for _, t in docs for w in t.split()]
    for j, x in items:  # paraphrases: none to three tenths of the words replaced, case and punctuation changed
        own = x.split()
        for k in draw.sample(range(len(own)), len(own) * (j % 4) // 10):
            own[k] = draw.choice(other)
        around = draw.sample(other, 120)
        rows.append((10_000 + j, " ".join(around[:60] + [w.translate(UPPER) + ";" for w in own] + around[60:])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = found(d.find_leaks(documents(rows), benchmark))

    idf = d.weights(*d.document_frequencies(d.texts(documents(rows))))
    index = d.Index.of(d.texts(benchmark, "item_id", "text"), idf)
    want = set()
    for key, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _, _ = d._words(data, np.array([0, len(data)]))
        for begin in range(0, len(hashes), d.STEP):
            for p, item in enumerate(index.ids):
                reach = len(index.words[p])
                common, answer = index.confirm(hashes[max(begin - reach, 0) : begin + 2 * d.STEP + reach], p)
                if common >= d.COMMON and answer >= d.ANSWER:
                    want.add((key, item))
    assert got <= want and len(got) >= 0.9 * len(want) >= 0.9 * 28
    assert not clean & {i for i, _ in got}


def test_blocks_and_hard_cases(spark, hard, sample, documents, monkeypatch):
    _, items = sample
    benchmark = spark.createDataFrame([*items[:9], (None, None), (50, ""), (51, " .,"), (52, items[0][1])], "item_id long, text string")
    docs = documents([(100 + j, "some words " + x) for j, x in items[:9]]).unionByName(hard.select("doc_id", "text", "lang", "source", "n_chars"))
    want = {(100 + j, j) for j, _ in items[:9]} | {(100 + items[0][0], 52)}
    assert found(d.find_leaks(docs, benchmark)) == want
    monkeypatch.setattr(d, "BLOCK", 1)
    many = d.find_leaks(docs, benchmark)
    assert found(many) == want
    plan = many._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow scan(") == 1  # one reading of the documents for all blocks
    monkeypatch.setattr(d, "BLOCKS_AT_ONCE", 4)
    assert found(d.find_leaks(docs, benchmark)) == want
    kept = d.drop_leaks(hard.withColumn("item_id", hard.doc_id), benchmark)
    assert kept.count() == len(HARD) and "item_id" in kept.columns
    assert d.find_leaks(hard.where("false"), benchmark).count() == 0
    assert d.find_leaks(hard, benchmark.where("false")).count() == 0


def test_long_and_many_passages(spark, documents):
    """260 passages of 15 to 600 words, whole and with a fifth of their words replaced, inside longer texts."""
    draw = random.Random(8)
    vocabulary = [f"w{int(draw.paretovariate(0.5)) % 20_000}" for _ in range(100_000)]
    items = [(j, " ".join(draw.choices(vocabulary, k=15 + 585 * (j % 20) // 19))) for j in range(260)]
    rows = []
    for j, x in items:
        around = draw.choices(vocabulary, k=200)
        at = draw.randrange(200)
        own = x.split()
        for k in draw.sample(range(len(own)), len(own) // 5 if j % 2 else 0):
            own[k] = draw.choice(vocabulary)
        rows.append((j, " ".join([*around[:at], *own, *around[at:]])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = found(d.find_leaks(documents(rows), benchmark))
    assert {(j, j) for j, _ in items if j % 2 == 0} <= got

    index = d.Index.of(d.texts(benchmark.where("item_id % 2 = 1"), "item_id", "text"), d.weights(*d.document_frequencies(d.texts(documents(rows)))))
    want = set()
    for p, j in enumerate(index.ids):  # the paraphrases that meet the conditions around some window
        data = np.frombuffer(rows[j][1].encode(), np.uint8)
        hashes, _, _ = d._words(data, np.array([0, len(data)]))
        reach = len(index.words[p])
        for begin in range(0, len(hashes), 2 * d.STEP):
            common, answer = index.confirm(hashes[max(begin - reach, 0) : begin + 2 * d.STEP + reach], p)
            if common >= d.COMMON and answer >= d.ANSWER:
                want.add((j, j))
                break
    assert len(want) > 100
    assert want <= got

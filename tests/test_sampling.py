"""Pairs, triples, splits and hash order, against brute force and on skewed tables."""

import hashlib

import pytest
from conftest import table
from pyspark.sql import functions as F

from relrank.functions.hashing import first_by_hash, hash_cutoff, hash_position
from relrank.operators import sampling as s


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def collection(frame):
    run = frame(
        [("q1", "d1", 1), ("q1", "d2", 2), ("q1", "d3", 3), ("q2", "d4", 1), ("q3", "d5", 1), ("q4", "d6", 1)],
        "qid string, docid string, rank int",
    )
    queries = frame([(f"q{i}", f" query {i}\n") for i in (1, 2, 3)], "qid string, query string")
    qrels = frame([("q1", "d2", 1), ("q2", "d4", 1), ("q3", "d9", 1), ("q1", "d1", 2)], "qid string, docid string, label int")
    docs = frame([(f"d{i}", "u", f"t{i}", f"body {i}\n") for i in range(1, 7)], "docid string, url string, title string, body string")
    return run, queries, qrels, docs


def test_pairs(collection):
    positive = table(s.sample_positive(*collection), "qid")
    assert positive == {
        "q1": ("d2", "query 1", "Title: t2, Context: body 2"),
        "q2": ("d4", "query 2", "Title: t4, Context: body 4"),
    }
    negative = table(s.sample_negative(*collection), "qid")
    assert set(negative) == {"q1"} and negative["q1"][0] in ("d1", "d3")
    assert negative["q1"][0] == min(("d1", "d3"), key=lambda d: md5(0, "q1", d))
    status = table(s.pair_stats(*collection), "status")
    assert status == {"kept": 1, "missing_docs": 2, "missing_data": 1}


def test_excluding_judged(collection, frame):
    run, queries, _, docs = collection
    qrels = frame([("q1", "d2", 1), ("q1", "d3", 1)], "qid string, docid string, label int")
    for seed in range(4):
        row = s.sample_negative(run, queries, qrels, docs, seed=seed, exclude="judged").first()
        assert row["docid"] == "d1"
    with pytest.raises(ValueError):
        s.sample_negative(run, queries, qrels, docs, exclude="none")


def test_draws_do_not_depend_on_partitioning(collection):
    run, queries, qrels, docs = collection
    a = s.sample_negative(run, queries, qrels, docs, seed=7).collect()
    b = s.sample_negative(run.repartition(7), queries, qrels.repartition(3), docs.repartition(5), seed=7).collect()
    assert sorted(a) == sorted(b)


def test_first_by_hash_is_exact(spark):
    df = spark.range(5000).withColumn("id", F.col("id").cast("string"))
    want = sorted((str(i) for i in range(5000)), key=lambda i: md5(3, i))[:1234]
    got = [r[0] for r in first_by_hash(df, 1234, ["id"], 3).collect()]
    assert sorted(got) == sorted(want)
    assert first_by_hash(df, 9999, ["id"], 3).count() == 5000
    assert first_by_hash(df, 0, ["id"], 3).count() == 0


def test_strict_sample(spark):
    df = spark.range(10)
    assert s.sample_n(df, 10, ["id"]).count() == 10
    with pytest.raises(Exception, match="cannot sample 11 rows"):
        s.sample_n(df, 11, ["id"]).count()


def test_samples_are_exact_where_keys_repeat(frame):
    df = frame([("k", "a", i % 2) for i in range(6)] + [("k", "b", 0)], "id string, v string, n int")
    for n in range(1, 8):
        assert s.sample_n(df, n, ["id"]).count() == n
    with pytest.raises(Exception, match="cannot sample 8 rows"):
        s.sample_n(df, 8, ["id"]).count()
    with pytest.raises(Exception, match="cannot sample 5 rows"):
        s.sample_n(df.where("false"), 5, ["id"]).count()
    texts = frame([("same",)] * 90 + [(f"t{i}",) for i in range(10)], "text string")
    parts = s.split_train_test(texts, ["text"], 0.2)
    assert table(parts.groupBy("part").count(), "part") == {"test": 20, "train": 80}


def test_default_is_the_scarcer_class(frame):
    schema = "qid string, docid string, query string, doc string"
    many, few = (frame([(str(i), "d", f"q{i}", "t") for i in range(n)], schema) for n in (9, 4))
    prompts = s.balanced_prompts(many, few)
    assert prompts.columns == ["qid", "docid", "text", "label"]
    assert table(s.label_counts(prompts), "label") == {0: 4, 1: 4}


def test_cutoff_with_a_third_of_copies(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, "same").otherwise(F.col("id").cast("string")).alias("id"))
    rows = ["same"] * 1000 + [str(i) for i in range(1000, 3000)]
    hashes = sorted(md5(0, r) for r in rows)
    for n in (1, 500, 1500, 2500, 3000):
        assert hash_cutoff(df, n, ["id"], 0).first()[0] == hashes[n - 1]


def test_hash_position(spark):
    df = spark.range(2000).withColumn("id", F.col("id").cast("string"))
    want = {i: n for n, i in enumerate(sorted(map(str, range(2000)), key=lambda i: md5(5, i)))}
    assert table(hash_position(df, ["id"], 5), "id") == want


@pytest.mark.parametrize("rows, test_size, test", [(10, 0.2, 2), (11, 0.2, 3), (15, 0.1, 2), (1, 0.2, 1), (0, 0.2, 0)])
def test_split_sizes(spark, rows, test_size, test):
    parts = s.split_train_test(spark.range(rows), ["id"], test_size)
    assert parts.where("part = 'test'").count() == test
    assert parts.count() == rows


def test_split_by_hash_is_about_right(spark):
    parts = s.split_train_test(spark.range(5000), ["id"], 0.2, exact=False)
    assert 850 < parts.where("part = 'test'").count() < 1150


def test_balanced_prompts(frame):
    pairs = frame([(str(i), "d", f"q{i}", f"t{i}") for i in range(8)], "qid string, docid string, query string, doc string")
    prompts = s.balanced_prompts(pairs, pairs, 5)
    assert table(s.label_counts(prompts), "label") == {0: 5, 1: 5}
    assert all(r["text"].startswith("Query:q") and "\nDocument:t" in r["text"] for r in prompts.collect())
    with pytest.raises(ValueError, match="query"):
        s.balanced_prompts(pairs.drop("query"), pairs, 5)


def rank_of(qid, seed=0, ranks=100):
    return 1 + int(md5(seed, qid)[:8], 16) % ranks


def test_triples(frame):
    qids = [f"q{i}" for i in range(6)]
    run = frame([(q, f"d{r}", r) for q in qids for r in range(1, 101)], "qid string, docid string, rank int")
    queries = frame([(q, f"text {q}") for q in qids[:5]], "qid string, query string")
    at = {q: f"d{rank_of(q)}" for q in qids}
    # q0 collides, q1 has no judgment, q5 no query; the drawn positive of q2 has no text.
    judged = [("q0", at["q0"], 1), ("q2", "none", 1), ("q3", "p3", 1), ("q4", "p4", 1), ("q5", "p3", 1)]
    qrels = frame(judged, "qid string, docid string, label int")
    names = sorted({f"d{r}" for r in range(1, 101)} | {"p3", "p4"})
    docs = frame([(n, "u", "t", f"b {n}") for n in names], "docid string, url string, title string, body string")
    got = {r["qid"]: (r["pos"]["docid"], r["neg"]["docid"]) for r in s.make_triples(run, queries, qrels, docs).collect()}
    assert got == {"q3": ("p3", at["q3"]), "q4": ("p4", at["q4"])}
    assert table(s.triple_stats(run, queries, qrels, docs), "status") == {
        "skipped": 594, "docid_collision": 1, "missing_data": 3, "kept": 2,
    }
    assert s.make_triples(run, queries, qrels, docs, n=1).count() == 1


def test_pair_prompts_both_ways(frame):
    side = "struct<docid:string,url:string,title:string,body:string>"
    triples = frame([("q", "ask", ("p", "u", "t", "good"), ("n", "u", "t", "bad"))], f"qid string, query string, pos {side}, neg {side}")
    assert {tuple(r) for r in s.pair_prompts(triples).collect()} == {
        ("Query:ask\nDocument 1:good\nDocuemt 2:bad", 1),
        ("Query:ask\nDocument 1:bad\nDocuemt 2:good", 0),
    }


def brute_negative(qid, docs, relevant, seed):
    ring = sorted(docs, key=lambda d: md5(seed, d))
    start = int(md5(seed, qid)[:8], 16) % len(ring)
    for step in range(len(ring)):
        doc = ring[(start + step) % len(ring)]
        if doc not in relevant:
            return doc
    return None


@pytest.mark.parametrize("seed", [0, 1])
def test_random_negatives(frame, seed):
    docs = [f"d{i}" for i in range(60)]
    # A few relevant, nearly all, all: the search must go round the ring.
    relevant = {f"q{i}": set(docs[:size]) for i, size in enumerate((1, 5, 30, 58, 59, 60, 2, 59))}
    relevant["q9"] = {"unknown", "d1"}
    qrels = frame([(q, d, 1) for q, r in relevant.items() for d in r], "qid string, docid string, label int")
    collection = frame([(d,) for d in docs], "docid string")
    got = table(s.qrels_negative_ids(qrels, collection, top_k=20, max_pos=1, seed=seed), "qid")
    first = min(relevant, key=lambda q: md5(seed, q))
    want = {q: brute_negative(q, docs, r, seed) for q, r in relevant.items() if q != first}
    assert got == {q: d for q, d in want.items() if d is not None}


def test_qrels_pairs(frame):
    qrels = frame([(f"q{i}", f"d{j}", 1) for i in range(6) for j in range(i, i + 3)], "qid string, docid string, label int")
    queries = frame([(f"q{i}", f"text {i}") for i in range(3)], "qid string, query string")
    docs = frame([(f"d{i}", "u", "t", "" if i == 4 else f" b{i} ") for i in range(12)], "docid string, url string, title string, body string")
    rows = s.qrels_pairs(qrels, queries, docs, top_k=3, max_pos=4).collect()
    positive = [r for r in rows if r["relevance"] == 1]
    negative = [r for r in rows if r["relevance"] == 0]
    order = sorted((f"q{i}" for i in range(6)), key=lambda q: md5(0, q))
    assert len(positive) == 4 and {r["qid"] for r in positive} <= set(order[:3])
    assert {r["qid"] for r in negative} <= set(order[3:])
    assert all(r["doc"] == r["docid"].replace("d", "b") for r in rows)
    assert all(r["query"] == (f"text {r['qid'][1]}" if r["qid"] < "q3" else "Query not found") for r in rows)
    with pytest.raises(Exception, match="cannot sample 7 rows"):
        s.qrels_positives(qrels, queries, docs, top_k=7, max_pos=9).count()

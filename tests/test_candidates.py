"""Caps, joins to text and set operations, with missing data and one huge group."""

import random

import pytest
from conftest import table
from pyspark.sql import Window
from pyspark.sql import functions as F

from relrank.operators import candidates as c
from relrank.operators import ordering
from relrank.operators.ordering import head_of_group, running_totals
from relrank.session import checkpoint

RUN = "qid string, docid string, rank int"


def test_cap_by_rank_and_by_runs(frame):
    lines = frame(
        [("q1", "d1", 1, 1), ("q1", "d2", 2, 2), ("q2", "d3", 1, 3), ("q1", "d4", 3, 4)], RUN + ", line int"
    )
    assert sorted(r["docid"] for r in c.head_per_query(lines, 1).collect()) == ["d1", "d3"]
    assert sorted(r["docid"] for r in c.head_per_query(lines, 1, mode="runs").collect()) == ["d1", "d3", "d4"]
    with pytest.raises(ValueError):
        c.head_per_query(lines, 1, mode="file")
    with pytest.raises(ValueError, match="line"):
        c.head_per_query(lines.drop("line"), 1, mode="runs")


def test_cap_prunes_before_the_shuffle(frame):
    plan = c.head_per_query(frame([("q", "d", 1)], RUN), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_deep_cap(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 5 as string)) qid", "id")
    for k in (3, 1200):
        top = head_of_group(df, ["qid"], ["id"], k, piece_rows=500)
        counts = table(top.groupBy("qid").count(), "qid")
        sizes = table(df.groupBy("qid").count(), "qid")
        assert counts == {q: min(k, n) for q, n in sizes.items()}
        assert dict(top.dtypes)["_at"] == "int"


def test_bucketed_docs_are_not_shuffled(spark, collection):
    from relrank.sources.readers import store_bucketed

    run, _, docs = collection
    stored = store_bucketed(docs, "docs_by_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = run.select("qid", "docid").join(stored, "docid")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the run's
        assert joined.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table docs_by_id")


@pytest.mark.parametrize("piece_rows", [None, 10_000, 50, 7, 1])
def test_running_totals_with_a_hot_group(frame, piece_rows):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"q{i % 17}", f"d{i:04}", rng.choice([1.0, 2.0, rng.random()])) for i in range(900)]
    df = frame(rows, "qid string, docid string, score double")
    order = ["-score", "docid"]
    got = running_totals(df, ["qid"], order, {"n": F.lit(1), "sum": F.length("docid")}, piece_rows)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    want = df.withColumn("n", F.row_number().over(w)).withColumn("sum", F.lit(5) * F.row_number().over(w))
    assert got.columns == ["qid", "docid", "score", "n", "sum"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pieces_of_wide_rows(frame, monkeypatch):
    """Few rows of long texts are cut by their bytes, those of arrays and maps too."""
    stored = []
    monkeypatch.setattr(ordering, "checkpoint", lambda df: stored.append(checkpoint(df)) or stored[-1])
    for kind, value in (("string", "x" * 10_000), ("array<string>", ["x" * 10_000]), ("map<string,string>", {"k": "x" * 10_000}), ("binary", b"x" * 10_000)):
        stored.clear()
        df = frame([("q", f"d{i:03}", value if i else None) for i in range(100)], f"qid string, docid string, wide {kind}")
        got = running_totals(df, ["qid"], ["docid"], {"n": F.lit(1)}, piece_bytes=100_000)
        assert [r["n"] for r in got.orderBy("docid").collect()] == list(range(1, 101))
        rows = [r["count"] for r in stored[1].groupBy("_piece").count().collect()]
        assert len(rows) >= 8 and max(rows) <= 25


@pytest.mark.parametrize("piece_rows", [None, 10])
def test_running_totals_over_everything(spark, piece_rows):
    got = running_totals(spark.range(100), [], ["-id"], {"n": F.lit(1)}, piece_rows)
    assert {r["id"]: r["n"] for r in got.collect()} == {i: 100 - i for i in range(100)}


def test_running_totals_with_nulls_and_nan(frame):
    rows = [(q, v, i) for i, (q, v) in enumerate((q, v) for q in ("a", None) for v in (None, float("nan"), 1.0, -2.0, None, 1.0))]
    df = frame(rows, "qid string, v double, id int")
    for order, columns in ((["-v", "id"], [F.desc("v"), F.col("id")]), (["v", "-id"], [F.asc("v"), F.desc("id")])):
        got = running_totals(df, ["qid"], order, {"n": F.lit(1)}, 1)
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*columns)))
        assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())


def test_the_input_is_read_once(spark, frame):
    """A run that is costly to make is made once, however often an operator needs it."""
    from relrank.operators import metrics as m
    from relrank.operators.scoring import rerank

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        made.add(1)
        return float(i % 7)

    run = frame([(f"q{i % 3}", f"d{i}", i) for i in range(20)], "qid string, docid string, rank int").withColumn("score", score("rank"))
    qrels = frame([("q1", "d1", 1), ("q1", "d1", 2)], "qid string, docid string, label int")
    texts = frame([("q1", "ask")], "qid string, query string"), frame([("d1", "t", "b")], "docid string, title string, body string")
    judge = [lambda f=f: f(run, qrels) for f in (m.average_precision, m.evaluate, m.evaluate_by_query)]
    for make in (lambda: rerank(run), *judge, lambda: c.map_run(run, *texts)):
        make().collect()
        assert made.value == 20
        made.value = 0


@pytest.mark.parametrize("piece_rows", [1, 7, 1000])
def test_running_totals_in_pieces(frame, piece_rows):
    from relrank.operators.ordering import running_totals

    rows = [(None if i % 5 == 0 else "big" if i % 3 else "small", i * 37 % 101, None if i % 11 == 0 else float(i % 4), i) for i in range(100)]
    df = frame(rows, "g string, v int, s double, i int")
    for by in (["g"], []):
        got = running_totals(df, by, ["-s", "i"], {"n": F.lit(1), "upto": F.col("v")}, piece_rows)
        assert got.columns == ["g", "v", "s", "i", "n", "upto"]
        found, seen = {r["i"]: (r["n"], r["upto"]) for r in got.collect()}, {}
        for g, v, _, i in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[3])):
            n, upto = seen.get(g if by else 0, (0, 0))
            seen[g if by else 0] = n + 1, upto + v
            assert found[i] == (n + 1, upto + v)


def test_pairs_in_blocks(frame):
    run = frame([("q", f"d{i}", i) for i in range(50)] + [("r", "x", 1), ("s", "y", 1), ("s", "z", 2)], "qid string, docid string, rank int")
    pairs = c.pair_candidates(run, block=7)
    got = [(r.qid, r.pos_a, r.docid_a, r.pos_b, r.docid_b) for r in pairs.collect()]
    want = {("q", i, f"d{i}", j, f"d{j}") for i in range(50) for j in range(i + 1, 50)} | {("s", 0, "y", 1, "z")}
    assert len(got) == len(want) and set(got) == want

def test_repeated_judgments_count_once(frame):
    from relrank.operators import metrics as m

    run = frame([("q", "d1", 1.0), ("q", "d2", 0.5)], "qid string, docid string, score double")
    qrels = frame([("q", "d1", 1), ("q", "d1", 2), ("q", "d1", 2)], "qid string, docid string, label int")
    assert m.precision_at(run, qrels).first().value == 0.1
    assert c.join_qrels(run, qrels).count() == 2
    values = m.evaluate_by_query(run, qrels).first()
    assert (values["precision@10"], values["map"], values["nDCG@10"]) == (0.1, 1.0, 1.0)


@pytest.fixture(scope="module")
def collection(frame):
    run = frame(
        [("1", "a", 1, 5.0), ("1", "b", 2, 4.0), ("2", "b", 1, 3.0), ("2", "x", 2, 2.0), ("9", "a", 1, 1.0)],
        RUN + ", score double",
    )
    queries = frame([("1", " one "), ("2", None)], "qid string, query string")
    docs = frame([("a", "u", "ta", "ba\r\n"), ("b", "u", "tb", "bb")], "docid string, url string, title string, body string")
    return run, queries, docs


def test_map_run(collection):
    rows = {(r["qid"], r["docid"]): (r["query"], r["doc"], r["run_score"]) for r in c.map_run(*collection).collect()}
    assert rows == {
        ("1", "a"): ("one", "Title: ta, Context: ba", 5.0),
        ("1", "b"): ("one", "Title: tb, Context: bb", 4.0),
        ("2", "b"): ("", "Title: tb, Context: bb", 3.0),
    }
    assert tuple(c.map_stats(*collection).first()) == (3, 2)


def test_cap_limits_documents_not_rows(collection):
    run, queries, docs = collection
    # b is past the cap of query 1 but within that of query 2.
    rows = {(r["qid"], r["docid"]) for r in c.map_run(run, queries, docs, k=1).collect()}
    assert rows == {("1", "a"), ("1", "b"), ("2", "b")}
    assert {r[0] for r in c.required_docs(run, 1).collect()} == {"a", "b"}


def test_mapped_run_file_and_top(collection):
    run, queries, docs = collection
    assert c.mapped_run_file(c.map_run(run, queries, docs)).columns == ["qid", "docid", "query", "doc", "rank", "relevance"]
    assert c.map_top_k(run, queries, docs, 1).select("doc_content").distinct().count() == 2


def test_fetch_docs(collection, frame):
    ids = frame([("a",), ("x",)], "docid string")
    assert table(c.fetch_docs(ids, collection[2]), "docid") == {"a": "ba"}
    with pytest.raises(Exception, match="no document x"):
        c.fetch_docs(ids, collection[2], strict=True).collect()


def test_skip_queries(collection):
    run = collection[0]
    assert {r["qid"] for r in c.skip_queries(run, 1).collect()} == {"2", "9"}
    assert c.skip_queries(run, 0).count() == 5
    assert c.skip_queries(run, 10).count() == 0


def test_pairs_of_a_query(frame):
    run = frame([("q", f"d{i:02}", i) for i in range(1, 25)] + [("single", "d", 1)], RUN)
    assert c.pair_candidates(run, 10).count() == 45
    assert c.pair_candidates(run, 24).where("pos_a >= pos_b").count() == 0


def test_fair_takes_the_first_annotation(frame):
    docs = frame([("s", "ask", "a", "t", "b"), ("s", "ask", "z", "t", "b")], "stem string, query string, docid string, title string, body string")
    notes = frame([("s", "a", "0, 1", 2), ("s", "a", "1,0", 1), ("r", "a", "0,0", 0)], "stem string, docid string, mapped_annotation string, pos int")
    assert [tuple(r) for r in c.build_fair(docs, notes).collect()] == [("1", "a", "ask", "Title: t, Context: b", 1, 0)]
    assert c.unannotated(docs, notes).first()[0] == 1


def test_set_operations(frame):
    a, b = frame([("1",), ("2",), ("2",)], "docid string"), frame([("2",), ("3",)], "docid string")
    assert sorted(r[0] for r in c.union_ids(a, b).collect()) == ["1", "2", "3"]
    assert [r[0] for r in c.common_ids(a, b, ["docid"]).collect()] == ["2"]
    assert [r[0] for r in c.minus(a, b, ["docid"]).collect()] == ["1"]
    assert c.union_aligned(a, b).count() == 5


def test_docno(frame):
    assert c.with_docno(frame([("a",)], "docid string")).first()["docno"] == "a"
    assert c.with_docno(frame([("a", "n")], "docid string, docno string")).first()["docno"] == "n"

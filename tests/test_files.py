"""Readers and writers on files with quotes, line breaks, repeated ids and short lines."""

import gzip
import json

import pytest
from conftest import table

from relrank import schemas
from relrank.operators.candidates import build_fair, head_per_query
from relrank.operators.fairness import fairness_by_query
from relrank.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        with gzip.open(path, "wt", encoding="utf8") as f:
            f.write(text)
    else:
        path.write_text(text, encoding="utf8")
    return str(path)


@pytest.mark.parametrize("name", ["q.tsv", "q.tsv.gz"])
def test_queries(spark, tmp_path, name):
    path = put(tmp_path / name, '1\t"a ""b"" c"\n2\tx "y" z\n3\t"p\nq"\n2\tlast wins\nshort\n4\t\n')
    assert table(readers.read_queries(spark, path, multi_line=True), "qid") == {"1": 'a "b" c', "2": "last wins", "3": "p\nq", "4": ""}


def test_qrels_and_run(spark, tmp_path):
    qrels = readers.read_qrels(spark, put(tmp_path / "qrels.gz", "1 0 D1 2\n1 0  D2 1 \nbad line\n"))
    assert [tuple(r) for r in qrels.collect()] == [("1", "0", "D1", 2), ("1", "0", "D2", 1)]
    path = put(tmp_path / "run.gz", "1 Q0 D1 1 -5.25 x\n1 Q0 D2 2 -6 x\n2 Q0 D3 1 1 x\n1 Q0 D4 3 0.5 x\nshort 1 2\n")
    run = readers.read_run(spark, path)
    assert run.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.RUN]
    assert [r["score"] for r in run.collect()] == [-5.25, -6.0, 1.0, 0.5]
    lines = readers.read_run(spark, path, with_line=True)
    kept = head_per_query(lines, 1, mode="runs")
    assert sorted(r["docid"] for r in kept.collect()) == ["D1", "D3", "D4"]


def test_docs(spark, tmp_path):
    path = put(tmp_path / "docs.tsv.gz", 'D1\thttp://u\tthe "title\tthe body\nD2\ttitle\tbody\nD3\n')
    rows = readers.read_docs(spark, path).orderBy("docid").collect()
    assert [tuple(r) for r in rows] == [("D1", "http://u", 'the "title', "the body"), ("D2", None, "title", "body")]
    stored = readers.to_parquet(readers.read_docs(spark, path), str(tmp_path / "docs.parquet"))
    assert stored.count() == 2


def test_tsv_round_trip(spark, frame, tmp_path):
    rows = [("1", ' lead "q" \t tab'), ("2", "line\nbreak\r\nmore"), ("3", ""), ("4", "\\back \\\" slash"), ("5", None)]
    df = frame(rows, "qid string, query string")
    for header in (True, False):
        path = str(tmp_path / f"h{header}.tsv")
        writers.write_tsv(df, path, header=header)
        got = table(readers.read_tsv(spark, path, schemas.QUERIES, header=header, multi_line=True), "qid")
        assert got == {**dict(rows), "3": None}  # an empty field is a missing one


def test_whole_numbers_written_as_floats(spark, tmp_path):
    path = put(tmp_path / "n.tsv", "_c0\t_class\tlabel\n0\tx\t1.0\n1\ty\t\n2\tz\t3\n")
    schema = schemas.struct(_class=schemas.STR, label=schemas.INT)
    assert [tuple(r) for r in readers.read_tsv(spark, path, schema).collect()] == [("x", 1), ("y", None), ("z", 3)]
    path = put(tmp_path / "f.tsv", "label\n1.5\n")
    with pytest.raises(Exception, match="no whole number"):
        readers.read_tsv(spark, path, schemas.struct(label=schemas.INT)).collect()


def test_the_last_line_of_a_docid_counts(spark, tmp_path):
    path = put(tmp_path / "d.tsv", "a\tu\told\told\nb\tu\tt\tb\na\tv\tnew\tnew\n")
    assert {tuple(r) for r in readers.read_docs(spark, path).collect()} == {("a", "v", "new", "new"), ("b", "u", "t", "b")}


def test_of_equal_stems_the_last_path_counts(spark, tmp_path):
    for folder, text in (("a/x", "first"), ("b/y", "last")):
        (tmp_path / folder).mkdir(parents=True)
        put(tmp_path / folder / "same.json", '{"%s": [{"docid": "d", "title": "t", "body": "b"}]}' % text)
        put(tmp_path / folder / "same.csv", 'docid,mapped_annotation\nd,"%d,0"\n' % (text == "last"))
    docs, annotations = readers.read_fair_tree(spark, str(tmp_path))
    assert [r["query"] for r in docs.collect()] == ["last"]
    assert [r["mapped_annotation"] for r in annotations.collect()] == ["1,0"]


def test_index_columns_are_dropped(spark, tmp_path):
    path = put(tmp_path / "x.tsv", "\tUnnamed: 0.1\tlabel\textra\ttext\n0\t7\t1\te\thello\n")
    got = readers.read_tsv(spark, path, schemas.PROMPTS)
    assert got.columns == ["text", "label"] and tuple(got.first()) == ("hello", 1)
    with pytest.raises(ValueError, match="docid"):
        readers.read_tsv(spark, path, schemas.PAIRS)


def test_prompts_must_be_tsv(spark, tmp_path):
    with pytest.raises(ValueError, match="tsv"):
        readers.read_prompts(spark, str(tmp_path / "x.csv"))
    path = put(tmp_path / "x.tsv", "text\tlabel\n\"Query:a\nDocument:b\"\t1\n")
    assert tuple(readers.read_prompts(spark, path).first()) == ("Query:a\nDocument:b", 1)


def test_written_lines(spark, frame, tmp_path):
    df = frame([("q", "d", 1, 0.123456, 1)], "qid string, docid string, rank int, score double, label int")
    writers.write_run(df, "mine", str(tmp_path / "run"))
    writers.write_run(df, "again", str(tmp_path / "run"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "run")).collect())
    assert lines == ["q, Q0, d, 1, 0.1235, again", "q, Q0, d, 1, 0.1235, mine"]
    writers.write_qrels(df, str(tmp_path / "qrels"))
    assert spark.read.text(str(tmp_path / "qrels")).first()[0] == "q Q0 d 1"


def test_maps_become_json(spark, frame, tmp_path):
    df = frame([("q", 1, 1), ("q", 1, 0), ("q", 1, 1)], "qid string, prediction int, annotation int")
    path = str(tmp_path / "fair.tsv")
    writers.write_tsv(fairness_by_query(df), path)
    row = spark.read.csv(path, sep="\t", header=True, escape='"').first()
    assert json.loads(row["relevant_frac_annotation"]) == {"0": pytest.approx(1 / 3), "1": pytest.approx(2 / 3)}


def test_triples(spark, frame, tmp_path):
    side = "struct<docid:string,url:string,title:string,body:string>"
    df = frame([("q", "ask", ("p", "u", "t", "b\nb"), ("n", None, 't "x"', "c"))], f"qid string, query string, pos {side}, neg {side}")
    path = str(tmp_path / "triples.tsv")
    writers.write_triples(df, path)
    got = readers.read_tsv(spark, path, schemas.TRIPLES, header=False, multi_line=True).first()
    assert tuple(got) == ("q", "ask", "p", "u", "t", "b\nb", "n", None, 't "x"', "c")


def test_fair_tree(spark, tmp_path):
    one = {"ask one?": [{"docid": "a", "title": "t", "body": "b\nb"}, {"docid": "b", "title": "u", "body": "c"}], "other": []}
    two = {"ask two?": [{"docid": "a", "title": "v", "body": "d"}]}
    put(tmp_path / "x/1/Topic One.json", json.dumps(one, indent=1))
    put(tmp_path / "x/1/topic one.csv", 'docid,mapped_annotation\na,"1,0"\nb,"0,2"\na,"0,0"\n')
    put(tmp_path / "y/2/two.json", json.dumps(two))
    put(tmp_path / "y/3/TWO.csv", 'docid,mapped_annotation\na,"1,1"\n')
    put(tmp_path / "y/2/.DS_Store", "junk")
    docs, notes = readers.read_fair_tree(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in build_fair(docs, notes).collect())
    assert rows == [
        ("1", "a", "ask one?", "Title: t, Context: b\nb", 1, 0),
        ("1", "b", "ask one?", "Title: u, Context: c", 0, 2),
        ("2", "a", "ask two?", "Title: v, Context: d", 1, 1),
    ]


def test_written_fair_tree(spark, frame, tmp_path):
    docs = [("x", "One + two.5%", "ask one?", "a", "t", "b\nb"), ("x", "One + two.5%", "ask one?", "b", None, "c"), ("y", "two=2", "ask two?", "a", "v", "d")]
    notes = [("x", "One + two.5%", "a", "1,0", 2), ("x", "One + two.5%", "b", "0,2", 1), ("x", "One + two.5%", "a", "5,5", 3), ("y", "two=2", "a", "1,1", 1)]
    root = str(tmp_path / "tree")
    writers.write_fair_tree(
        frame(docs, "folder string, stem string, query string, docid string, title string, body string"),
        frame(notes, "folder string, stem string, docid string, mapped_annotation string, pos int"),
        root,
    )
    found = readers.read_fair_tree(spark, root)
    assert {r["stem"] for r in found[0].collect()} == {"one + two.5%", "two=2"}
    assert sorted(tuple(r) for r in build_fair(*found).collect()) == [
        ("1", "a", "ask one?", "Title: t, Context: b\nb", 1, 0),
        ("1", "b", "ask one?", "Title: , Context: c", 0, 2),
        ("2", "a", "ask two?", "Title: v, Context: d", 1, 1),
    ]


def test_many_small_topics(spark, frame, tmp_path):
    """The files of a tree are written by many tasks, however few bytes they have, and read once, listed by few tasks."""
    docs = [("x", f"t{i:03}", f"ask {i}?", "a", "t", "b") for i in range(200)]
    notes = [("x", f"t{i:03}", "a", "1,0", 1) for i in range(200)]
    root = str(tmp_path / "tree")
    tracker = spark.sparkContext.statusTracker()

    def tasks(group, work):
        spark.sparkContext.setJobGroup(group, group)
        try:
            result = work()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return result, [s.numTasks for s in stages if s is not None and s.numCompletedTasks]

    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    _, ran = tasks("write", lambda: writers.write_fair_tree(
        frame(docs, "folder string, stem string, query string, docid string, title string, body string"),
        frame(notes, "folder string, stem string, docid string, mapped_annotation string, pos int"),
        root,
    ))
    assert ran.count(int(spark.conf.get("spark.sql.shuffle.partitions"))) == 2  # one job a kind of file, none in one task
    found, ran = tasks("read", lambda: readers.read_fair_tree(spark, root))
    assert max(ran) < 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    _, ran = tasks("build", lambda: build_fair(*found).collect())
    assert sum(ran) < 100  # from what is stored, not from 400 files
    assert not [f for f in found[0].inputFiles() + found[1].inputFiles() if "/tree/" in f]
    with pytest.raises(FileExistsError):
        writers.write_fair_tree(frame(docs, "folder string, stem string, query string, docid string, title string, body string"), None, root)

import hashlib

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from relrank.llm.queries import byte_vocabulary
from tests.llm.conftest import HARD
from tests.llm.test_near_dedup import brute

SMALL = "/root/testdata/sf0.01"


def blank_free(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def plain_stages(docs, passages, rejected):
    """Rows (doc_id, text) that each stage keeps, by the definitions."""
    docs = [r for r in docs if r[0] not in rejected]
    yield docs
    best = {}
    for i, t in docs:
        best.setdefault(blank_free(t), []).append((-len(t or ""), i))
    keep = {min(group)[1] for group in best.values()}
    docs = [r for r in docs if r[0] in keep]
    yield docs
    docs = [r for r in docs if brute_of(docs)[r[0]] == r[0]]
    yield docs
    docs = [(i, t) for i, t in docs if not any(p in (t or "") for p in passages)]
    yield docs


_BRUTE = {}


def brute_of(docs):
    key = tuple(i for i, _ in docs)
    if key not in _BRUTE:
        _BRUTE[key] = {i: c for i, (_, c) in brute(docs, 80).items()}
    return _BRUTE[key]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passages = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = list(plain_stages(rows, passages, rejected=set()))  # every sample document has a language
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"
    ]
    for number, ((_, stage), kept) in enumerate(zip(corpus_pipeline.STAGES, want)):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.columns == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(kept)
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 500

    vocabulary = byte_vocabulary(spark)
    own = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in last} == {i for i, _ in want[3]}
    texts = dict(want[3])
    for r in last:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_hard_cases(spark, hard, tmp_path):
    labelled = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = hard.unionByName(labelled, True)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    found = {r.doc_id for r in docs.collect()}
    assert not {1, 2, 3} & found and {7, 8} <= found  # without letters: no language
    assert len(HARD) and len(found) < 70
    empty = hard.where("false")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

import corpus_pipeline
from relrank.llm import byte_bpe, queries
from relrank.llm.common import BATCH_ROWS
from relrank.llm.queries import byte_vocabulary
from tests.conftest import SMALL
from tests.llm.conftest import HARD


@pytest.fixture(scope="module")
def vocabulary(spark):
    return byte_vocabulary(spark)


def plain(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={})


def test_stitching_gives_the_pre_tokens_of_the_whole_text():
    pattern, draw = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        letters = draw.choice(["ab '", "a1 \n\t'!re", "é ñ's ll 've x  \r", "    a"])
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 400)))
        size, overlap = draw.randrange(1, 60), draw.randrange(17, 40)
        places = range(0, len(text), size)
        parts = [text[p : p + size + overlap] for p in places]
        chunks = ((p, t, byte_bpe.starts(t, pattern), p == places[-1]) for p, t in zip(places, parts))
        assert [x for pieces in byte_bpe.stitch(chunks, pattern) for x in pieces] == pattern.findall(text)


@pytest.mark.parametrize("chunk, overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (50, 17)])
def test_ids_are_those_of_the_whole_text_and_decode_to_it(documents, vocabulary, chunk, overlap):
    rows = [r for r in HARD if chunk > 1000 or len(r[1] or "") < 2000]
    docs = documents(rows)
    own = plain(vocabulary)
    want = sorted((str(i), own.encode_ordinary(t or "")) for i, t in rows)
    encoded = byte_bpe.encode(docs, vocabulary, chunk=chunk, overlap=overlap)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
    back = encoded.select("doc_id", byte_bpe.decoded("ids", vocabulary).alias("raw")).collect()
    assert {(r.doc_id, bytes(r.raw)) for r in back} == {(i, (t or "").encode()) for i, t in rows}
    trip = byte_bpe.round_trip(docs, vocabulary, chunk=chunk, overlap=overlap)
    found = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in trip.collect()}
    sizes = {(i, len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert found == sizes and trip.count() == len(rows)


def test_empty_table_and_clashing_columns(hard, vocabulary):
    assert byte_bpe.encode(hard.where("false"), vocabulary).count() == 0
    assert byte_bpe.encode(hard, vocabulary).count() == len(HARD)


def test_query_against_the_library(spark, vocabulary):
    from relrank.llm.queries import QUERIES

    own = plain(vocabulary)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in QUERIES["op9_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = own.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch is bounded however many rows a task has, in the query and in the pipeline's stage."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({"doc_id": [n], "n_tokens": [n], "ids_sha256": [""], "decoded_sha256": [""]})

    monkeypatch.setattr(byte_bpe, "round_trip", lambda *_: spark.range(5000, numPartitions=1).mapInArrow(sizes, byte_bpe.DIGESTS))
    for found in (corpus_pipeline.encoded(spark, None, SMALL), queries.op9_byte_bpe(spark, SMALL)):
        rows = [r["n_tokens"] for r in found.collect()]
        assert sum(rows) == 5000 and max(rows) <= BATCH_ROWS
    assert spark.conf.get(key) == before

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relrank.llm.queries import QUERIES
from relrank.llm.suffix_dedup import suffix_dedup
from tests.llm.conftest import HARD


def brute(rows, length):
    """{id: (spans, kept)} by the definition."""
    seen, result = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data, gone = (text or "").encode(), set()
        own = []
        for i in range(len(data) - length + 1):
            window = hashlib.md5(data[i : i + length]).digest()
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        for i in sorted(gone):
            if own and own[-1][1] == i:
                own[-1][1] = i + 1
            else:
                own.append([i, i + 1])
        result[key] = ([tuple(s) for s in own], bytes(c for i, c in enumerate(data) if i not in gone))
    return result


def found(df):
    return {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("length", [30, 100])
def test_against_every_window(documents, length):
    draw = random.Random(length)
    pieces = ["".join(draw.choice("ab é") for _ in range(draw.randrange(5, 3 * length))) for _ in range(12)]
    rows = [(i, " ".join(draw.choice(pieces) for _ in range(draw.randrange(0, 9)))) for i in range(60)]
    rows += [(100, "a" * 500), (101, "a" * length), (102, "a" * (length - 1)), (103, None), (None, rows[3][1])]
    assert found(suffix_dedup(documents(rows), length=length)) == brute(rows, length)


def test_hard_cases(hard):
    rows = list(dict.fromkeys(HARD))
    result = suffix_dedup(hard)
    assert result.count() == len(HARD)
    assert found(result) == brute(rows, 100)
    assert suffix_dedup(hard.where("false")).count() == 0


def test_rows_of_one_id(documents):
    long = "".join(chr(97 + i % 23) + chr(98 + i % 19) for i in range(200))
    rows = suffix_dedup(documents([(1, long), (1, long), (2, "x" + long), (2, "no repeat")])).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.kept)) for r in rows) == [(1, 400, 400), (1, 400, 400), (2, 9, 9), (2, 401, 1)]


def test_query_against_every_window(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute(docs, 100)
    rows = QUERIES["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        spans, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_many_texts_of_one_id(documents):
    """Texts without an id, many of which repeat parts of others, are judged text by text, in the order of their hashes."""
    draw = random.Random(6)
    parts = ["".join(draw.choice("abcdef ") for _ in range(draw.randrange(60, 260))) for _ in range(400)]
    rows = [(None, t) for t in sorted({draw.choice(parts) + draw.choice(parts) for _ in range(3000)})]
    docs = documents([*rows, (5, rows[0][1])])
    ordered = [r.text for r in docs.where("doc_id is null").select("text", F.xxhash64("text").alias("mark")).orderBy("mark").collect()]
    want = brute([*enumerate(ordered), (10_000, rows[0][1])], 100)
    got = suffix_dedup(docs).collect()
    assert sorted(bytes(r.kept) for r in got) == sorted(kept for _, kept in want.values())
    assert [bytes(r.kept) for r in got if r.doc_id == 5] == [want[10_000][1]]

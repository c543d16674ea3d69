import math
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from relrank.llm.queries import QUERIES
from relrank.llm.token_counts import Counter, Unigram, count_tokens
from tests.llm.conftest import HARD

PATH = public_tokenizers.path("piece_bpe_32k.model")
BYTES = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]


@pytest.fixture(scope="module")
def model():
    return Unigram.load(PATH)


def library(model):
    """The same pieces in a public unigram tokenizer."""
    made = Tokenizer(models.Unigram(BYTES + list(model.pieces), 0, True))
    made.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return made


def brute(pieces, text):
    """Best score of all segmentations; of equal ones the last piece that starts first, then what is before it."""
    scores, text = dict(pieces), "▁" + text.replace(" ", "▁")
    unknown = min(scores.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(end):
            part = text[start:end]
            own, n = (scores[part], 1) if part in scores else (unknown, len(part.encode())) if len(part) == 1 else (None, 0)
            if own is not None and (found is None or best[start][0] + own > found[0]):
                found = (best[start][0] + own, best[start][1] + n)
        best.append(found)
    return best[-1][1], best[-1][0]


def words(draw, size):
    alphabets = ["ab the  in", "é ñ你好🙂 \n", "a1 \n\t'!re", "ing ed  ▁ the"]
    return "".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.randrange(size)))


def test_against_all_segmentations_with_many_ties():
    draw = random.Random(6)
    for _ in range(60):
        pieces = {"".join(draw.choice("ab▁\n" if draw.random() < 0.3 else "ab▁") for _ in range(draw.randrange(1, 5))) for _ in range(15)}
        pieces = tuple((p, float(-draw.randrange(4))) for p in sorted(pieces))
        counter = Counter(Unigram(pieces))
        for _ in range(40):
            text = "".join(draw.choice("aabb \nx") for _ in range(draw.randrange(1, 25)))
            assert counter.whole(text) == brute(pieces, text), (pieces, text)


def test_against_the_library(model):
    draw, counter, public = random.Random(7), Counter(model), library(model)
    for _ in range(1500):
        text = words(draw, 80)
        assert counter.whole(text)[0] == len(public.encode(text).ids if text else []), text


def test_log_scores_against_the_library(model):
    """A unigram model as they are: scores are logarithms of shares, and so are their sums."""
    draw = random.Random(8)
    own = Unigram(tuple((text, math.log(draw.paretovariate(0.6) / 1e6)) for text, _ in model.pieces))
    counter, public = Counter(own), library(own)
    docs = [words(draw, 120) for _ in range(800)] + ["the " * 500 + "end of a long text, " * 300]
    for text in docs:
        assert counter.whole(text)[0] == len(public.encode(text).ids if text else []), text
    assert not counter  # nothing is remembered


def test_fractional_scores_against_all_segmentations():
    draw = random.Random(9)
    for _ in range(30):
        pieces = {"".join(draw.choice("ab▁") for _ in range(draw.randrange(1, 5))) for _ in range(15)}
        pieces = tuple((p, -draw.random()) for p in sorted(pieces))
        counter = Counter(Unigram(pieces))
        for _ in range(40):
            text = "".join(draw.choice("aabb \nx") for _ in range(draw.randrange(1, 25)))
            assert counter.whole(text) == brute(pieces, text), (pieces, text)


def test_query_against_the_library(spark, model):
    public = library(model)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op1_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(public.encode(t).ids) for i, t in docs.items()}


def test_hard_cases(hard, model):
    rows = count_tokens(hard, model).collect()
    counter = Counter(model)
    assert sorted((str(r.doc_id), r.n_tokens, r.score) for r in rows) == sorted((str(i), *counter.whole(t or "")) for i, t in HARD)
    assert {(r.n_tokens, r.score) for r in rows if r.doc_id in (1, 2)} == {(0, 0.0)}
    assert count_tokens(hard.where("false"), model).count() == 0

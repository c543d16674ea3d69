"""Prompts, chunks, annotations, logits."""

import random

import pytest
from pyspark.sql import functions as F

from relrank.functions import logits as lg
from relrank.functions import text as t


def split(text, size, separators=(*t.SEPARATORS, "")):
    """All chunks by the recursive rule, written out plainly (without overlap)."""
    separator, rest = "", ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            separator, rest = s, separators[i + 1 :]
            break
    if separator:
        head, *tail = text.split(separator)
        pieces = [p for p in [head, *[separator + p for p in tail]] if p]
    else:
        pieces = list(text)
    chunks, held = [], ""

    def flush():
        if held.strip():
            chunks.append(held.strip())

    for piece in pieces:
        if len(piece) >= size:
            flush()
            held = ""
            chunks.extend(split(piece, size, rest) if rest else [piece])
        elif len(held) + len(piece) > size:
            flush()
            held = piece
        else:
            held += piece
    flush()
    return chunks


def random_text(rng, longest):
    alphabet = ["a", "b", "é", " ", ".", ",", "!", "?", "\n", "\n\n"]
    weights = [rng.choice([0, 1, 5]) for _ in alphabet[3:]]
    return "".join(rng.choices(alphabet, [20, 20, 5, *weights], k=rng.randint(0, longest)))


@pytest.mark.parametrize("size", [5, 12, 40])
def test_first_chunk(frame, size):
    rng = random.Random(size)
    texts = [random_text(rng, 4 * size) for _ in range(600)] + ["", " ", "x" * size, "x" * (size + 1), None]
    df = frame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r["i"]: r["c"] for r in df.select("i", t.first_chunk("x", size).alias("c")).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        chunks = split(text, size)
        if text != text.lstrip() and len(text) > size:
            assert got[i] == got[i].strip() and len(got[i]) <= size and got[i] in text
            assert got[i] != "" or not text[: 2 * size].strip()
        else:
            assert got[i] == (chunks[0] if chunks else ""), repr(text)


def test_first_chunk_after_blanks(frame):
    texts = ["\n" + "a" * 30, "\n\n  b c d e f g h i j k", " " * 9 + "word word word", "\n\n\n\nab\n\ncdefghijkl mn"]
    rows = frame([(x,) for x in texts], "x string").select(t.first_chunk("x", 10).alias("c")).collect()
    assert [r["c"] for r in rows] == [split(x, 10)[0] for x in texts]


def test_templates(frame):
    df = frame([("q", "d", None)], "q string, d string, n string")
    row = df.select(
        t.point_prompt("q", "d"), t.point_prompt("q", "n"), t.doc_text("q", "d"),
        t.pair_prompt("q", "d", "q"), t.pair_prompt("q", "d", "q", "train"),
    ).first()
    assert tuple(row) == (
        "Query:q\nDocument:d", "Query:q\nDocument:", "Title: q, Context: d",
        "Query: q\nDocument 1: d\nDocument 2: q", "Query:q\nDocument 1:d\nDocuemt 2:q",
    )
    with pytest.raises(ValueError):
        t.pair_prompt("q", "d", "q", "other")


def test_clean_strips_what_python_strips(frame):
    text = "　\xa0 \t\n\x1c x y \r "
    assert frame([(text,)], "x string").select(t.clean("x")).first()[0] == text.strip()


def test_annotation_and_stem(frame):
    df = frame([("1,0", "/a/b.d/Topic One.v2.JSON/"), (" 0 , 1 ", "x.csv")], "a string, p string")
    rows = df.select(*t.parse_annotation("a"), t.file_stem("p")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "topic one"), (0, 1, "x")]


def test_logits(frame):
    df = frame([([1.0, 1.0],), ([0.0, 1000.0],)], "l array<double>")
    rows = df.select(lg.softmax("l"), lg.log_softmax("l"), lg.predict("l"), lg.relevance_score("l", 0), lg.relevance_score("l")).collect()
    assert rows[0][0] == [0.5, 0.5] and rows[1][1] == [-1000.0, 0.0]
    assert [r[2] for r in rows] == [0, 1] and [r[3] for r in rows] == [1.0, 1000.0] and [r[4] for r in rows] == [0.0, 1000.0]
    with pytest.raises(ValueError):
        lg.relevance_score("l", 2)


def test_words(frame):
    df = frame([("Some words, some WORDS and añot",)], "x string")
    assert df.select(F.sort_array(t.words("x"))).first()[0] == ["some", "words"]

import zlib

import numpy as np

from relrank.llm import language_id
from relrank.llm.queries import QUERIES
from tests.llm.conftest import HARD

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in tested)
    assert right >= 0.99 * len(tested) > 200


def test_filter_against_plain_sets():
    """Without false positives the shares are those of plain sets of n-grams."""
    texts = ["the cat and the dog", "der Hund und die Katze", "", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    codes, first, last = language_id.grams(data, offsets)
    pieces = [[codes[i] for i in range(a, b)] for a, b in zip(first, last)]
    assert [len(p) for p in pieces] == [len(t) + 2 - 3 if len(t) > 1 else 0 for t in texts]
    want = [int.from_bytes(f" {texts[0]} ".encode()[i : i + 4], "little") for i in range(len(texts[0]) - 1)]
    assert pieces[0] == want
    model = language_id.LanguageModel.of({"en": np.array(pieces[0]), "de": np.array(pieces[1])})
    shares = model.shares(data, offsets)
    both = set(pieces[0]) & set(pieces[1])
    exact = [[1, np.mean([c in both for c in pieces[0]])], [np.mean([c in both for c in pieces[1]]), 1], [0, 0], [0, 0]]
    assert np.allclose(shares, exact, atol=1e-6)


def test_more_languages_than_bits(spark, documents):
    """70 labels, each with an alphabet of its own, and a few mistyped ones."""
    rows = []
    for lang in range(70):
        letters = [chr(0x4E00 + 40 * lang + k) for k in range(40)]
        for i in range(12):
            words = ["".join(letters[(i * 7 + j * 3 + k) % 40] for k in range(5)) for j in range(20)]
            rows.append((lang * 100 + i, " ".join(words), f"l{lang:02}"))
    docs = documents([(i, t) for i, t, _ in rows]).drop("lang").join(spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, lang string"), "doc_id")
    model = language_id.learn(docs)
    assert len(model.names) == 70 and model.masks.shape[0] == 2
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert found == {i: x for i, _, x in rows}


def plain_predictions(model, profiles, rows):
    """{id: (language, score)} from sets of n-grams instead of the filter."""
    found = {}
    for key, text in rows:
        if not any(map(str.isalpha, text or "")):
            found[key] = ("und", 0.0)
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        codes, first, last = language_id.grams(data, np.array([0, len(data)]))
        own = codes[first[0] : last[0]].tolist()
        shares = [sum(c in profiles[name] for c in own) / max(len(own), 1) for name in model.names]
        best = max(range(len(shares)), key=lambda i: (shares[i], -i))
        found[key] = (model.names[best], shares[best])
    return found


def test_query_against_plain_sets(spark, monkeypatch):
    """The query's predictions are those of sets of the same n-grams; what chance adds to the filter is taken off."""
    kept = {}
    build = language_id.LanguageModel.of.__func__
    monkeypatch.setattr(language_id.LanguageModel, "of", classmethod(lambda cls, profiles: kept.update(profiles) or build(cls, profiles)))
    rows = QUERIES["op6_language_id"](spark, SMALL).collect()
    model = language_id.LanguageModel.of(dict(kept))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_predictions(model, {n: set(np.asarray(c).tolist()) for n, c in kept.items()}, docs)
    assert all(abs(r.score - want[r.doc_id][1]) < 0.02 for r in rows)
    assert sum(r.lang_pred == want[r.doc_id][0] for r in rows) >= 0.998 * len(rows)


def test_hard_cases(spark, hard):
    model = language_id.learn(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = language_id.predict(hard, model).collect()
    assert len(rows) == len(HARD)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[7].lang_pred in model.names and by[9].lang_pred in model.names
    kept = language_id.keep_identified(hard, model)
    assert kept.columns == hard.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    nothing = language_id.learn(hard.where("false"))
    assert nothing.names == ()
    assert {r.lang_pred for r in language_id.predict(hard, nothing).collect()} == {"und"}

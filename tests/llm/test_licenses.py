import random
import re

import pytest

from relrank.llm import licenses
from relrank.llm.licenses import Automaton, Template, scan_licenses
from relrank.llm.queries import QUERIES
from tests.llm.conftest import HARD

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    own = words(text)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(own), len(places), min(starts, default=None), max(starts, default=None), labels


def test_base_places(documents):
    draw = random.Random(3)
    tokens = "under the MIT License, apache license Version 2.0 cc by-nc cc by nc é x".split()
    rows = [(i, draw.choice([" ", "\n", "-- "]).join(draw.choice(tokens) for _ in range(draw.randrange(40)))) for i in range(300)]
    rows += [(i + 1000, f"{draw.choice(tokens)} UNDER the  mit license. Apache License, Version 2 (cc by-nc)" * draw.randrange(1, 4)) for i in range(50)]
    rows += HARD
    found = licenses.summary(scan_licenses(documents(rows))).collect()
    key = lambda t: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in t)
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found], key=key)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=key)
    for r in found:
        own, base = set(filter(None, r.labels.split(","))), set(filter(None, r.base_labels.split(",")))
        assert base <= own and 0 <= r.score <= 1 and (r.score > 0) == bool(own)


@pytest.mark.parametrize(
    "markup, yes, no",
    [
        ("a <<beginOptional>>b c<<endOptional>> d", ["a d", "A, b c d"], ["a b d", "a c d", "a x d", "ad"]),
        ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", ["a d", "a b d", "a b c d"], ["a c d"]),
        ("a <<var;name=x;match=.{1,3}>> d", ["a 1 d", "a 1 2 3 d", "a d d"], ["a d", "a 1 2 3 4 d"]),
        ("a <<var;name=x;match=.{0,2}>>", ["a"], ["b"]),
    ],
)
def test_markup(markup, yes, no):
    scanner = licenses.Scanner([Template("l", markup)])
    import numpy as np

    for text in yes + no:
        data = np.frombuffer(text.encode(), np.uint8)
        _, found = scanner.scan(data, np.array([0, len(data)]))
        assert bool(found[0]) == (text in yes), text


def test_against_a_regex(documents):
    """Each template against a pattern made from its markup, on mutated wordings."""
    draw, rows = random.Random(8), []
    for template in licenses.TEMPLATES:
        markup = re.sub(r"<<var[^>]*\{(\d+),(\d+)\}>>", lambda m: " ".join("any thing at all".split()[: int(m[2])]), template.markup)
        for i in range(12):
            own = words(re.sub("<<.*?>>", lambda m: "" if draw.random() < 0.8 else " extra ", markup))
            if i % 3 == 2:
                del own[draw.randrange(len(own))]
            rows.append((len(rows), "before " + " ".join(own) + " after"))

    def pattern(markup):
        out = re.sub(r"<<beginOptional>>", " (?: ", markup)
        out = re.sub(r"<<endOptional>>", " )? ", out)
        parts = re.findall(r"\(\?:|\)\?|<<var[^>]*>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z](?![^<]*>>)", lambda m: m[0].lower(), out))
        made = [p if p in ("(?:", ")?") else re.sub(r".*\{(\d+),(\d+)\}>>", r"(?:\\S+ ){\1,\2}", p) if p[0] == "<" else f"{p} " for p in parts]
        return re.compile("(?:^| )" + "".join(made))

    patterns = [(t.label, pattern(t.markup)) for t in licenses.TEMPLATES]
    found = {r.doc_id: r.labels for r in licenses.summary(scan_licenses(documents(rows))).collect()}
    for i, text in rows:
        line = " ".join(words(text)) + " "
        assert found[i] == ",".join(sorted({label for label, p in patterns if p.search(line)})), text


def plain(template):
    """A text of the template: optional regions left in, replaceable ones filled."""
    return re.sub("<<var.*?>>", "the people of Example", re.sub("<<(begin|end)Optional>>", " ", template.markup))


def test_a_changed_late_clause_is_no_license(documents):
    by_label = {t.label: t for t in licenses.TEMPLATES if len(words(t.markup)) > 60}
    assert set(by_label) == {"mit", "isc", "bsd-2", "bsd-3", "bsd-4", "zlib"}
    rows, want = [], {}
    for label, template in by_label.items():
        text = plain(template)
        own = text.split()
        for variant in (text, text.replace("this software", "this program"), " ".join(own[: len(own) // 2]), " ".join(own[:-3] + ["never", *own[-3:]])):
            want[len(rows)] = label if variant == text else ""
            rows.append((len(rows), f"Copyright 2020 some holder.\n\n{variant}\n\nMore words."))
    found = {r.doc_id: (r.labels, r.score) for r in licenses.summary(scan_licenses(documents(rows))).collect()}
    assert {i: labels for i, (labels, _) in found.items()} == want  # the first text has no such words to change
    assert all(found[i][1] > 0.8 for i, w in want.items() if w)


def test_bad_markup_and_empty_table(hard):
    for markup in ("<<endOptional>> a", "<<beginOptional>> a", "<<beginOptional>>a<<endOptional>>", ""):
        with pytest.raises(ValueError):
            Automaton.of(markup, {})
    assert scan_licenses(hard.where("false")).count() == 0
    assert scan_licenses(hard).count() == len(HARD)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: brute(t) for i, t in docs.items()}
    assert any(r.n_base for r in rows)

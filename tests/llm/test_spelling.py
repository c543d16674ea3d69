import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relrank.llm import common, spelling
from relrank.llm.common import BATCH_ROWS
from relrank.llm.queries import QUERIES
from tests.llm.conftest import HARD


def brute(rows):
    """{word: (form, root, n, n_near, form_n)} by definition; near words from deletion neighbourhoods."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    holders = {}
    for w in words:
        for i in range(len(w)):
            holders.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (_, short), own in holders.items():
        for w in own:
            near[w] |= own - {w}
        if short in words:
            for w in own:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def result(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def variants():
    """Documents full of words and their variants, with chains of forms, anagrams and ties."""
    draw = random.Random(3)
    letters = "abcdeilnorstéÉ×ÿ"
    rows, pool = [], []
    for _ in range(60):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(5, 12)))
        pool += [word] * 150
        for _ in range(8):
            i, c = draw.randrange(len(word)), draw.choice(letters)
            other = draw.choice([word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:]])
            pool += [other] * draw.choice([5, 6, 25, 30])
            i = draw.randrange(len(other))
            pool += [other[:i] + draw.choice(letters) + other[i:]] * 5
        mixed = list(word)
        draw.shuffle(mixed)
        pool += ["".join(mixed)] * 7
    pool += ["aaaaab"] * 5 + ["aaaaba"] * 5 + ["aaaaaa"] * 30 + ["aaaaac"] * 30 + ["AAAAAAA"] * 200
    draw.shuffle(pool)
    for i in range(0, len(pool), 40):
        rows.append((i, ", ".join(pool[i : i + 40])))
    return rows


def test_against_brute_force(documents, variants):
    found, want = result(spelling.spelling_variants(documents(variants))), brute(variants)
    assert found == want
    assert sum(f is not None and r != f for f, r, *_ in want.values()) > 10  # chains
    assert sum(near > 3 for *_, near, _ in want.values()) > 50


def test_many_cells_and_parts(documents, variants, monkeypatch):
    want = brute(variants)
    for name, value in {"SAMPLE": 300, "CELL": 20, "PART": 8, "LEAF": 3, "QUERIES": 5, "WORDS_PER_TASK": 50, "RUNS_AT_ONCE": 20}.items():
        monkeypatch.setattr(spelling, name, value)
    words = spelling.vocabulary(documents(variants)).collect()
    trees = spelling._coarse([r.word for r in words][::4], 0.25)
    assert max(len(t.nodes) for t in trees.values()) > 5
    assert result(spelling.spelling_variants(documents(variants))) == want


def test_tree_finds_all():
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abcdà") for _ in range(6)) for _ in range(3000)})
    held = spelling._Classes(words)
    tree = spelling.Tree(held.points, 4)
    asking = spelling._Classes(words[:300])
    found = {(words[x], words[y]) for x, y in spelling._pairs(tree, held, asking, spelling.SAME)}
    want = {(a, b) for a in words[:300] for b in words if sum(x != y for x, y in zip(a, b)) == 1}
    assert found == want and len(want) > 500
    open_tree = spelling.Tree(held.points[::10], 8, open=True)
    leaf = open_tree.leaf_of(held.points)
    near = {(row, number) for number, rows in open_tree.leaves_near(held.points, 0) for row in rows.tolist()}
    assert near == set(enumerate(leaf.tolist()))


def test_hard_cases(hard, documents):
    docs = hard.unionByName(documents([(50 + i, "Grüßes x×yzabc " + "b" * 40_000) for i in range(6)]), True)
    rows = HARD + [(50 + i, "Grüßes x×yzabc " + "b" * 40_000) for i in range(6)]
    assert result(spelling.spelling_variants(docs)) == brute(rows)
    assert spelling.spelling_variants(hard.where("false")).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01")
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert result(found) == brute(rows)


def test_texts_are_read_and_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch is bounded however many rows a task has, in the Parquet reader too; the session's settings are put back."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, during, store = [spark.conf.get(k) for k in keys], [], common.stored

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"word": ["bounded" if batch.num_rows <= BATCH_ROWS else "unbounded"], "n": [batch.num_rows]})

    def stored(df):
        during.append([int(spark.conf.get(k)) for k in keys])
        return store(df)

    monkeypatch.setattr(spelling, "_count", sizes)
    monkeypatch.setattr(common, "stored", stored)
    docs = spark.range(5000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert result(spelling.spelling_variants(docs)) == {"bounded": (None, "bounded", 5000, 0, None)}
    assert during and all(n <= BATCH_ROWS for rows in during for n in rows)
    assert [spark.conf.get(k) for k in keys] == before

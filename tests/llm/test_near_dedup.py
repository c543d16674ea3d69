import random
import re

from pyspark.sql import functions as F

from relrank.llm import near_dedup
from relrank.llm.common import BATCH_ROWS, BATCH_SETTINGS
from relrank.llm.graph import components
from relrank.llm.near_dedup import drop_near_duplicates, near_duplicates
from relrank.llm.queries import QUERIES
from tests.llm.conftest import HARD


def sets(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    """{id: (n_shingles, component_id)} from all pairs."""
    found = {i: sets(t) for i, t in rows}
    parent = {i: i for i in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(found)
    holders = {}
    for i in ids:
        for s in found[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k]}
    for a, b in pairs:
        both = len(found[a] & found[b])
        if 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(found[i]), root(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(draw, size, start, words=120):
    """A text and copies with a few words changed, some more than a link allows."""
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(words)]
    rows = [(start, " ".join(base))]
    for i in range(1, size):
        own = list(base if i % 3 or not rows else rows[draw.randrange(len(rows))][1].split())
        for _ in range(draw.randrange(0, 8)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        rows.append((start + i, " ".join(own[: draw.randrange(words * 8 // 10, words + 1)])))
    return rows


def test_against_all_pairs(documents):
    draw = random.Random(5)
    rows = [r for k in range(4) for r in family(draw, 60, 1000 * k)]
    rows += [(9000, "A b c d"), (9001, "a B c\td "), (9002, "a b c"), (9003, "a b c d e"), (9004, "A\x0bb c d e")]
    draw.shuffle(rows)
    found = near_duplicates(documents(rows))
    assert result(found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_hard_cases(hard):
    rows = {r[0]: r[1] for r in HARD}
    found = near_duplicates(hard).collect()
    assert len(found) == len(HARD)
    by = {r.doc_id: r for r in found}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by[1].component_id == 1 and by[1].kept
    assert by[8].n_shingles == 1 and by[5].component_id is None and not by[5].kept and by[None].kept
    assert by[7].n_shingles == len(sets(rows[7]))
    assert near_duplicates(hard.where("false")).count() == 0


def test_other_similarities(documents):
    """Families whose members stand just around the bound, most of them apart from their leader."""
    draw = random.Random(9)
    rows = [r for k in range(3) for r in family(draw, 80, 1000 * k, words=60)]
    for percent in (80, 95):
        want = brute(rows, percent)
        assert result(near_duplicates(documents(rows), percent=percent)) == want
        assert len({c for _, c in want.values()}) > 20


def test_rows_of_one_id(documents):
    """What stays is a matter of rows, not of ids: no text is lost because another of its id goes."""
    one, two, three = ("".join(f"{w}{i} " for i in range(50)) for w in "abc")
    rows = [(3, one), (5, one + "x"), (5, two), (None, two + "y"), (7, three), (7, three), (None, ""), (8, None)]
    kept = drop_near_duplicates(documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(3, one), (None, two + "y"), (7, three), (7, three), (None, ""), (8, None)], key=repr)


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(7, 3), (3, 9), (9, 7), (5, 5)] + [(100, 100 + i) for i in range(1, 50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 20 for i in range(20, 61)}, 3: 3, 7: 3, 9: 3, **{i: 100 for i in range(100, 150)}}


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert result(QUERIES["op2_minhash_near_dedup"](spark, "/root/testdata/sf0.01")) == brute(docs)


def test_texts_are_read_and_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch is bounded however many rows a task has, in every round; the session's settings are put back."""

    def bounded(work):
        def checked(batches):
            def each():
                for batch in batches:
                    if batch.num_rows > BATCH_ROWS:
                        raise ValueError(f"a batch of {batch.num_rows} rows")
                    yield batch

            return work(each())

        return checked

    rounds, during, store = [], [], near_dedup.stored_by_small_batches
    for name in ("_sketch", "_confirm", "_keys"):
        make = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda x, name=name, make=make: rounds.append(name) or bounded(make(x)))
    monkeypatch.setattr(near_dedup, "_listed", bounded(near_dedup._listed))
    monkeypatch.setattr(near_dedup, "stored_by_small_batches", lambda df: during.append(df.columns) or store(df))
    before = [spark.conf.get(k) for k in BATCH_SETTINGS]
    # A chain: each text is linked with the next ones only.
    text = F.concat_ws(" ", F.transform(F.sequence("doc_id", F.col("doc_id") + 60), lambda n: F.concat(F.lit("w"), n.cast("string"))))
    docs = spark.range(600, numPartitions=1).toDF("doc_id").withColumn("text", text)
    assert result(near_duplicates(docs)) == {i: (57, 0) for i in range(600)}
    assert set(rounds) == {"_sketch", "_confirm", "_keys"} and ["node", "text"] in during
    assert [spark.conf.get(k) for k in BATCH_SETTINGS] == before

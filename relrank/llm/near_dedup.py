"""MinHash near-duplicates by tensored banding.

Two small collections of band keys are computed for a set; a table is a pair of one key of each, so ``bands`` ** 2
tables cost 2 * ``bands`` * ``ROWS`` minhashes instead of 2 * ``bands`` ** 2 * ``ROWS``. Candidates of the tables are
confirmed on the full sets, first with one set of each table; what that does not join is confirmed in pairs that share
rare shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relrank.llm.common import BLANKS, LOWER, Rolling, mix, slices, stored, stored_by_small_batches, texts, words
from relrank.llm.graph import components

WORDS = 5
PERCENT = 85  # links have 100 * |A & B| >= PERCENT * |A | B|
ROWS = 3  # minhashes of a band
MISSED = 1.2e-5  # chance that two sets just alike enough share no band of one collection
NULL_ID = -(1 << 63)
SKETCH = "doc_id long, mark long, n long, set1 long, set2 long, left array<long>, right array<long>"


def _bands(percent: int) -> int:
    """Bands of a collection: 12 at 85 %, 16 at 80 %."""
    return 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def _numbers(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = _numbers(11, WORDS)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and len + 1 offsets into them.

    A text of fewer than WORDS words has its whole word sequence as its only shingle.
    """
    starts, ends, text = words(data, offsets, BLANKS)
    hashes = Rolling(LOWER[data], 1).of(starts, ends) if len(data) else np.zeros(0, np.uint64)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    with np.errstate(over="ignore"):
        size = max(len(hashes) - WORDS + 1, 0)
        found = np.zeros(size, np.uint64)
        for j in range(WORDS):
            found += hashes[j : j + size] * _PLACE[j]
        whole = text[:size] == text[WORDS - 1 :] if size else np.zeros(0, bool)
        found, owner = mix(found[whole]), text[:size][whole]
        few = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(few):
            first = np.cumsum(counts) - counts
            short = np.array([mix((hashes[first[i] : first[i] + counts[i]] * _PLACE[: counts[i]]).sum(keepdims=True) + np.uint64(counts[i]))[0] for i in few], np.uint64)
            found, owner = np.concatenate([found, short]), np.concatenate([owner, few])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[fresh], owner[fresh]
    return found, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))]).astype(np.int64)


def _sketch(bands: int):
    factor, shift = _numbers(12, 2 * bands * ROWS), _numbers(13, 2 * bands * ROWS)

    def sketch(batches):
        for batch, data, offsets in slices(batches):
            found, at = shingles(data, offsets)
            full = np.flatnonzero(np.diff(at))
            begin = at[:-1][full]
            keys = np.zeros((2 * bands, len(full)), np.uint64)
            total = np.zeros((2, batch.num_rows), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    for i in range(2 * bands * ROWS):
                        least = np.minimum.reduceat(found * factor[i] + shift[i], begin)
                        keys[i // ROWS] = mix(keys[i // ROWS] * _PLACE[0] + least)
                    total[0, full] = np.add.reduceat(found, begin)
                    total[1, full] = np.add.reduceat(mix(found ^ _PLACE[1]), begin)
                    keys = mix(keys + np.arange(2 * bands, dtype=np.uint64)[:, None])  # the band is part of its key
            ends = np.zeros(batch.num_rows + 1, np.int32)
            ends[1:] = np.cumsum(np.where(np.diff(at) > 0, bands, 0))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(half.T.reshape(-1).view(np.int64))) for half in (keys[:bands], keys[bands:])]
            own = [batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(at))]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(total[0].view(np.int64)), pa.array(total[1].view(np.int64)), *lists], ["doc_id", "mark", "n", "set1", "set2", "left", "right"]
            )

    return sketch


LEADER, MEMBER = 0, 1


def _confirm(percent: int):
    """Texts of each family, its leader's first, become (a, b) of those members b that make a link with their leader a.

    Holds the leader's set and one slice of texts, however large the family.
    """

    def confirm(batches):
        family, first = None, None
        for batch, data, offsets in slices(batches):
            found, at = shingles(data, offsets)
            one, two = [], []
            for i, (a, part, kind, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "kind", "b")))):
                own = found[at[i] : at[i + 1]]
                if kind == LEADER:
                    family, first = (a, part), own
                    continue
                both = len(np.intersect1d(own, first, assume_unique=True))
                if family == (a, part) and 100 * both >= percent * (len(own) + len(first) - both):
                    one.append(a)
                    two.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return confirm


FAMILY = 256  # members that meet a copy of their leader in one task


def _links(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs of a leader a and a member b that make a link; large families are cut into parts."""
    sizes = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAMILY).alias("parts")))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(MEMBER).alias("kind"), "b")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    heads = sizes.select("a", part, F.lit(LEADER).alias("kind"), F.col("a").alias("b"))
    dealt = heads.unionByName(members).join(held.withColumnRenamed("node", "b"), "b").select("a", "part", "kind", "b", "text")
    ordered = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "kind", "b")
    return stored_by_small_batches(ordered.mapInArrow(_confirm(percent), "a long, b long"))


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b): the node that shares most tables of each table (key, node), and each of the table's others."""
    several = rows.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1")
    live = stored(rows.join(several, "key"))
    popular = F.sum("nodes").over(Window.partitionBy("node"))  # over a node's tables, of which there are bands ** 2 at most
    heads = live.withColumn("popular", popular).groupBy("key").agg(F.max_by("node", F.struct("popular", "node")).alias("a"))
    return live.join(stored(heads), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _tables(classes: DataFrame) -> DataFrame:
    """(key, node): the tables of every set, a pair of a left and a right band. Bands that no other set has are left
    out before the pairs are formed, as their tables hold one set."""
    bands = classes.select("node", F.explode(F.concat("left", "right")).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("nodes")).where("nodes > 1").select("band")
    mine = bands.join(shared, "band").groupBy("node").agg(F.collect_set("band").alias("bands"))  # two collections at most
    halves = classes.join(mine, "node").select("node", F.array_intersect("left", "bands").alias("left"), F.array_intersect("right", "bands").alias("right"))
    one = halves.select("node", "right", F.explode("left").alias("l"))
    return one.select("node", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "node")


# Pairs by rare shingles. All sets have their shingles in one order, by the number of sets that hold them: two sets that
# make a link share one among the first few of each.


def _listed(batches):
    """(node, n, shingle) of all shingles of each text."""
    for batch, data, offsets in slices(batches):
        found, at = shingles(data, offsets)
        each = np.repeat(np.arange(batch.num_rows), np.diff(at))
        columns = [batch.column("node").take(pa.array(each)), pa.array(np.diff(at)[each]), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "shingle"])


def _step(n: float) -> int:
    """Sizes within a twentieth of each other are mostly one step."""
    return math.floor(math.log(n) / math.log(20 / 19)) if n >= 1 else -1


ASKED = "key long, node long, n long, rest long, small boolean"


def _keys(percent: int):
    """(key, node, n, rest, small): the places where a set meets others, from its shingles that other sets share.

    Of two linked sets, sizes n <= m, the first shingle that both have leaves at least percent * (n + m) / (100 + percent)
    of either from there on (``rest``). So the smaller one is found under few shingles, and only there where its size is
    one that the larger one can be linked with; a set too much of which is its own is found nowhere.
    """
    total = 100 + percent

    def keys(batches):
        for batch in batches:
            out = []
            for node, n, listed in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("shingles")):
                rests, known = len(listed), listed.values.field("shingle").to_pylist()
                low = -(-percent * n // 100)
                for rest in range(rests, low - 1, -1):
                    shingle = known[rests - rest]
                    if rest * total >= 2 * percent * n:
                        out.append((shingle, _step(n), node, n, rest, True))
                    high = min(n, rest * total // percent - n)
                    if high >= low:
                        out += [(shingle, step, node, n, rest, False) for step in range(_step(low), _step(high) + 1)]
            if out:
                shingle, step, node, n, rest, small = zip(*out)
                key = mix(np.array(shingle, np.int64).view(np.uint64) + np.array(step, np.int64).view(np.uint64) * _PLACE[2])
                columns = [pa.array(key.view(np.int64)), *map(pa.array, (node, n, rest, small))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "rest", "small"])

    return keys


def _rare_pairs(texts_: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of ``texts_`` (node, text) that can be linked and are not joined yet.

    Under each key the nodes outside its largest component are strangers; a pair has one of them at least.
    """
    listed = stored_by_small_batches(texts_.mapInArrow(_listed, "node long, n long, shingle long"))
    common = listed.groupBy("shingle").agg(F.count("*").alias("nodes")).where("nodes > 1")
    # The list is one text's own, in the order of all.
    shared = listed.join(common, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("nodes", "shingle"))).alias("shingles"))
    rows = shared.mapInArrow(_keys(percent), ASKED).join(joined, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    rows = stored_by_small_batches(rows)  # a row is all of a text's shingles
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
    keys = parts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    live = stored(rows.join(keys.select("key", F.col("main.component").alias("main")), "key").withColumn("stranger", F.col("component") != F.col("main")))
    small = live.where("small").select("key", *[F.col(c).alias(f"small_{c}") for c in ("node", "n", "rest", "component", "stranger")])
    large = live.where("not small").drop("small", "main")
    near = (F.col("small_n") <= F.col("n")) & ((100 + percent) * F.least("small_rest", "rest") >= percent * (F.col("small_n") + F.col("n")))
    found = [
        one.join(two, "key").where(near & (F.col("small_component") != F.col("component"))).select(F.least("small_node", "node").alias("a"), F.greatest("small_node", "node").alias("b"))
        for one, two in ((small.where("small_stranger"), large), (small.where("not small_stranger"), large.where("stranger")))
    ]
    return found[0].unionByName(found[1]).distinct()


def _classified(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, first): of each row its id, a hash of its text (``mark``), its size, and the least (doc_id, mark)
    of its group; null ids are NULL_ID."""
    narrow = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sketches = stored_by_small_batches(narrow.mapInArrow(_sketch(_bands(percent)), SKETCH))
    # Sums of the map tasks: a huge group of equal texts is one row of each.
    sets = sketches.where("n > 0").groupBy("set1", "set2")
    sets = sets.agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.first("left").alias("left"), F.first("right").alias("right"))
    classes = stored(sets.withColumn("node", F.monotonically_increasing_id()))  # stored, so the numbers stay
    rows = stored(_tables(classes))
    wanted = classes.join(rows.select("node").distinct(), "node").select("node", "first.doc_id", "first.mark")
    # A hash join: a task holds the narrow rows of its texts and sorts no texts for it.
    of_nodes = narrow.join(wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("node", "text")
    held = stored_by_small_batches(of_nodes.dropDuplicates(["node"]))
    pairs = stored(_stars(rows))
    links = _links(pairs, held, percent)
    joined = components(links)
    # Leaders with members that did not join them: any two of their members may still be linked.
    of = lambda name: joined.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = placed.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a").distinct()
    live = pairs.join(apart, "a").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    more = _links(stored(_rare_pairs(held.join(live, "node"), joined, percent)), held, percent)
    joined = components(links.unionByName(more))
    groups = classes.join(joined, "node", "left").select("set1", "set2", "first", F.coalesce("component", "node").alias("component"))
    groups = stored(groups)
    least = groups.groupBy("component").agg(F.min("first").alias("first"))
    of_set = groups.drop("first").join(least, "component").select("set1", "set2", "first")
    found = sketches.select("doc_id", "mark", F.col("n").alias("n_shingles"), "set1", "set2").join(of_set, ["set1", "set2"], "left")
    return found.select("doc_id", "mark", "n_shingles", F.coalesce("first", F.struct("doc_id", "mark")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Groups of texts whose word shingles overlap: a row for each row of ``docs`` with doc_id, n_shingles,
    component_id (the smallest id that is reachable over links) and kept (it is its own).

    Texts with equal sets are one node. Nodes that share a table are compared with one of them, the leader; the members of
    leaders that some did not join are compared with each other where they share rare shingles. So no link of a table is
    lost, and no pair but a leader's is formed unless its sizes and the places of what it shares allow a link.

    A text without words, and null, has 0 shingles and no links. A null id counts as smaller than all others. Rows that
    repeat an id are told apart by their texts; their ids decide about ``kept``. An empty table gives an empty result.
    """
    found = _classified(docs, id_col, text_col, percent)
    real = lambda c: F.when(c != NULL_ID, c)
    component = F.col("first.doc_id")
    return found.select(
        real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of ``near_duplicates``, that of the smallest id. Rows that repeat an id are
    documents of their own if their texts differ; rows that repeat id and text are one and stay or go together."""
    found = _classified(docs, id_col, text_col, percent)
    kept = stored(found.where(F.col("first") == F.struct("doc_id", "mark")).select("doc_id", "mark").distinct())
    other = kept.toDF("_llm_id", "_llm_mark")
    mine = F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(other, (mine[0] == other["_llm_id"]) & (mine[1] == other["_llm_mark"]), "left_semi")

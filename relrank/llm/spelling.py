"""Spelling variants: frequent words and the rarer ones that are one edit away.

A word is a point, the counts of its letters. One replaced letter moves it by exactly 2 (L1 distance), one inserted or
deleted letter by exactly 1. For every pair of lengths, equal or one apart, a k-d tree over the points is searched for
those that near; only their letters' order is compared. A coarse tree deals points and queries out to tasks, each of which
builds a tree of its own points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import stored, stored_by_small_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = 26 + 64  # a-z, and U+00C0 to U+00FF
TYPO = 199  # a run whose number this divides loses a letter
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
_LOWER = {c: c + 32 for c in range(65, 91)}

SAMPLE = 100_000  # words at most that the coarse tree is fitted on; all words are indexed
CELL = 1 << 14  # words in a cell of it, about
PART = 1 << 15  # words of a cell that one task holds
LEAF = 24  # points in a leaf of a task's tree
QUERIES = 4096  # words that search a tree at once
WORDS_PER_TASK = 30_000
RUNS_AT_ONCE = 100_000


def _runs(text: str):
    """The lower-cased runs of a text and how often each occurs, in pieces of RUNS_AT_ONCE runs."""
    found = (m[0] for m in RUN.finditer(text.translate(_LOWER)))
    while piece := Counter(islice(found, RUNS_AT_ONCE)):
        yield piece


def _written(doc_id: int | None, run: str) -> str:
    """The run as it counts for this document: now and then a letter is missing."""
    number = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if number % TYPO:
        return run
    at = number % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches):
    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    total: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            for piece in _runs(text.as_py() or ""):
                for run, n in piece.items():
                    word = _written(doc_id, run)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            if len(total) > RUNS_AT_ONCE:
                yield out(total)
                total = Counter()
    if total:
        yield out(total)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of LEAST_LENGTH letters that occur LEAST_COUNT times, counted over all texts."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = narrow.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: list[str]) -> np.ndarray:
    """(words, LETTERS): how often each letter occurs in each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    letter = np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)
    counts = np.bincount(row * LETTERS + letter, minlength=len(words) * LETTERS).reshape(-1, LETTERS)
    return counts.astype(np.int16 if counts.size == 0 or counts.max() < 1 << 14 else np.int32)


def _outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of points from a box."""
    return (np.maximum(low - points, 0) + np.maximum(points - high, 0)).sum(axis=1)


@dataclass
class Tree:
    """A k-d tree: every node has a box, every leaf the numbers of its points.

    With ``open`` boxes the leaves cover the whole space, so that points the tree was not built from have a leaf too;
    otherwise a box is as small as its points allow.
    """

    points: np.ndarray
    leaf: int
    open: bool = False
    nodes: list = field(default_factory=list)  # (low, high, letter, cut, left, right) or (low, high, rows)

    def __post_init__(self):
        far = np.full(LETTERS, 1 << 29, np.int32)
        self._grow(np.arange(len(self.points)), np.zeros(LETTERS, np.int32), far)

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
        own = self.points[rows]
        number = len(self.nodes)
        if not self.open and len(rows):
            low, high = own.min(axis=0), own.max(axis=0)
        self.nodes.append((low, high, rows))
        if len(rows) <= self.leaf:
            return number
        letter = int(np.argmax(own.var(axis=0)))
        column = own[:, letter]
        most = int(column.max())
        if most == column.min():
            return number  # equal points
        cut = min(int(np.median(column)), most - 1)
        below, above = high.copy(), low.copy()
        below[letter], above[letter] = cut, cut + 1
        left = self._grow(rows[column <= cut], low, below)
        right = self._grow(rows[column > cut], above, high)
        self.nodes[number] = (low, high, letter, cut, left, right)
        return number

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf of each point."""
        found = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            number, rows = stack.pop()
            node = self.nodes[number]
            if len(node) == 3:
                found[rows] = number
                continue
            _, _, letter, cut, left, right = node
            first = points[rows, letter] <= cut
            stack += [(left, rows[first]), (right, rows[~first])]
        return found

    def leaves_near(self, points: np.ndarray, radius: int):
        """(number of a leaf, rows of ``points`` that have its box within ``radius``)."""
        stack = [(0, np.arange(len(points)))]
        while stack:
            number, rows = stack.pop()
            node = self.nodes[number]
            rows = rows[_outside(points[rows], node[0], node[1]) <= radius]
            if not len(rows):
                continue
            if len(node) == 3:
                yield number, rows
            else:
                stack += [(node[4], rows), (node[5], rows)]

    def near(self, points: np.ndarray, distance: int):
        """(row of ``points``, number of a point of the tree) at exactly this distance."""
        for number, rows in self.leaves_near(points, distance):
            own = self.nodes[number][2]
            apart = np.abs(points[rows][:, None, :] - self.points[own][None, :, :]).sum(axis=2)
            one, two = np.nonzero(apart == distance)
            yield rows[one], own[two]


def _coarse(sample: list[str], share: float) -> dict[int, Tree]:
    """A tree for each length of word in the sample, whose leaves hold about CELL words of all."""
    by_length = defaultdict(list)
    for word in sample:
        by_length[len(word)].append(word)
    leaf = max(8, round(CELL * share))
    return {length: Tree(letter_counts(words), leaf, open=True) for length, words in by_length.items()}


POINT, SAME, SHORTER = 0, 1, 2  # a word of a cell; one that looks for words of its length, or one letter longer
DEALT = "length int, cell long, kind int, word string, n long"


def _deal(trees):
    """Every word as a point of its cell, and as a query of all cells that may hold a word near it."""

    def deal(batches):
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            counts = letter_counts(words)
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                found = []  # (length, cell, kind, rows)
                mine, longer = trees.value.get(length), trees.value.get(length + 1)
                if mine is None:  # a length that the sample does not have is one cell
                    found += [(length, np.zeros(len(own), np.int64), POINT, own), (length, np.zeros(len(own), np.int64), SAME, own)]
                else:
                    found.append((length, mine.leaf_of(counts[own]), POINT, own))
                    for cell, rows in mine.leaves_near(counts[own], 2):
                        found.append((length, np.full(len(rows), cell), SAME, own[rows]))
                if longer is None:
                    found.append((length + 1, np.zeros(len(own), np.int64), SHORTER, own))
                else:
                    for cell, rows in longer.leaves_near(counts[own], 1):
                        found.append((length + 1, np.full(len(rows), cell), SHORTER, own[rows]))
                for at, cell, kind, rows in found:
                    columns = [
                        pa.array(np.full(len(rows), at, np.int32)),
                        pa.array(cell),
                        pa.array(np.full(len(rows), kind, np.int32)),
                        batch.column("word").take(pa.array(rows)),
                        pa.array(n[rows]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "kind", "word", "n"])

    return deal


class _Classes:
    """Words of equal letter counts, and their forms with one occurrence of a letter taken out or masked."""

    def __init__(self, words: list[str]):
        self.points, self.of = np.unique(letter_counts(words), axis=0, return_inverse=True)
        self.words = defaultdict(list)
        for at, own in enumerate(np.ravel(self.of).tolist()):
            self.words[own].append((words[at], at))
        self._known = {}

    def without(self, number: int, letter: int, mask: str) -> dict[str, list[int]]:
        """{form: numbers of the words}; a masked form keeps the place of what is missing."""
        key = number, letter, mask
        if key not in self._known:
            char, forms = chr(letter + 97 if letter < 26 else letter - 26 + 0xC0), defaultdict(list)
            for word, at in self.words[number]:
                for form in {word[:i] + mask + word[i + 1 :] for i, c in enumerate(word) if c == char}:
                    forms[form].append(at)
            self._known[key] = forms
        return self._known[key]


def _pairs(tree: Tree, held: _Classes, asking: _Classes, kind: int):
    """(word of ``asking``, word of ``held``), by number, that are one edit apart."""
    distance = 2 if kind == SAME else 1
    for one, two in tree.near(asking.points, distance):
        change = held.points[two] - asking.points[one]
        more, less = change.argmax(axis=1), change.argmin(axis=1)
        for a, b, gained, lost in zip(one.tolist(), two.tolist(), more.tolist(), less.tolist()):
            if kind == SAME:
                forms = asking.without(a, lost, "\0")
                other = held.without(b, gained, "\0")
            else:
                forms = {word: [at] for word, at in asking.words[a]}
                other = held.without(b, gained, "")
            for form in forms.keys() & other.keys():
                for x in forms[form]:
                    for y in other[form]:
                        yield x, y


def _search(batches):
    """Rows of a part of a cell, its points first, become (word, near, near_n): pairs of words one edit apart, from
    both sides. Holds the part's points and QUERIES words."""
    group, points, sizes, tree, held = None, [], [], None, None
    waiting = {SAME: [], SHORTER: []}

    def ask(kind):
        rows, waiting[kind] = waiting[kind], []
        nonlocal tree, held
        if not rows or not points:
            return
        if tree is None:
            held = _Classes(points)
            tree = Tree(held.points, LEAF)
        words = [w for w, _ in rows]
        found = list(_pairs(tree, held, _Classes(words), kind))
        # Words of one length find each other from both sides; a longer one does not look for the shorter.
        out = [(words[x], points[y], sizes[y]) for x, y in found]
        if kind == SHORTER:
            out += [(points[y], words[x], rows[x][1]) for x, y in found]
        if out:
            word, near, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(near), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for length, cell, part, kind, word, n in zip(*(batch.column(c).to_pylist() for c in ("length", "cell", "part", "kind", "word", "n"))):
            if group != (length, cell, part):
                for k in waiting:
                    yield from ask(k)
                group, points, sizes, tree = (length, cell, part), [], [], None
            if kind == POINT:
                points.append(word)
                sizes.append(n)
                continue
            waiting[kind].append((word, n))
            if len(waiting[kind]) >= QUERIES:
                yield from ask(kind)
    for k in waiting:
        yield from ask(k)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for any two words of ``words`` (word, n; distinct) that differ by one inserted, deleted or
    replaced letter, from both sides.

    ``words`` is read several times: store it first. The coarse tree is fitted on SAMPLE words at most, drawn by hash;
    a cell with more than PART words is cut into parts that every query of the cell visits.
    """
    spark = words.sparkSession
    count = words.count()
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(-(-count // SAMPLE) or 1)) == 0).select("word")
    sample = [r.word for r in drawn.collect()]
    trees = spark.sparkContext.broadcast(_coarse(sample, len(sample) / max(count, 1)))
    dealt = stored(words.select("word", "n").mapInArrow(_deal(trees), DEALT))
    cells = dealt.where(F.col("kind") == POINT).groupBy("length", "cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
    placed = dealt.join(cells, ["length", "cell"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    point = placed.where(F.col("kind") == POINT).withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    query = placed.where(F.col("kind") != POINT).withColumn("part", every)
    tasks = max(1, -(-count // WORDS_PER_TASK))
    ordered = point.unionByName(query).repartition(tasks, "length", "cell", "part").sortWithinPartitions("length", "cell", "part", "kind")
    return ordered.mapInArrow(_search, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms that starts at each word; every step doubles what is known of it.
    Chains are short, as each form is TIMES as frequent as the word before."""
    known = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        steps = stored(steps)
        known = steps.select("word", "root")
        if steps.where("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts and the forms that they are spelling variants of: word, form, root, n, n_near, form_n.

    Words are runs of letters (a-z after lower-casing A-Z, and U+00C0 to U+00FF as they are), some short of a letter as
    drawn by document, of at least LEAST_LENGTH letters and LEAST_COUNT occurrences (n). ``n_near`` words differ by one
    edit; the most frequent of them, of equal ones the first in code-point order, is the ``form`` if its ``form_n`` is at
    least TIMES n, otherwise both are null. ``root`` is the end of the chain of forms, without one the word itself.

    Null and empty texts have no words; a null id stands as '' in the draw. Repeated rows count singly, and rows that
    repeat an id are drawn alike. An empty table gives an empty result.
    """
    words = stored_by_small_batches(vocabulary(docs, id_col, text_col))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(found, "word", "left").withColumn("found", F.col("best.near_n") >= TIMES * F.col("n"))
    judged = stored(
        judged.select(
            "word", F.when(F.col("found"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("found"), F.col("best.near_n")).alias("form_n")
        )
    )
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

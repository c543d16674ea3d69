"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping windows of words, passages into parts that are no longer than a window. A basis of
the parts' TF-IDF rows, from a distributed randomised SVD whose rank is their number, embeds parts and windows; where a
window is near a part, the passage is checked by the longest common subsequence of its words and by its rarest words, its
answer. The statistics cover all documents, and every window of every document meets every part of every passage. Parts
come in blocks and blocks in rounds, so that what is broadcast has a bound; a round reads the documents once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import LOWER, Rolling, keep_ids, mix, slices, stored, texts, words
from relrank.llm.licenses import SEPARATORS

FEATURES = 1 << 18  # hashed words
STEP = 16  # words between windows; a window has two steps
BLOCK = 256  # parts of passages per basis, about
BLOCKS_AT_ONCE = 32  # that one reading of the documents meets; 100 MB or so
GROUP = 20  # parts of a block that are ruled out together, about
WINDOWS = 8192  # of a text, looked at together
OVERSAMPLE = 10  # a basis has a vector for every part, so that it keeps the parts whole
COSINE = 0.25  # or as large a share of the part, so that rare words around common ones hide nothing
COMMON = 0.6  # of a passage's words, in order, must stand in the text around the window
ANSWER_PART, ANSWER = 0.2, 0.6  # the rarest fifth of a passage's words is its answer; so much of it must be there


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, words per text, and the number of each text's first word."""
    lower = LOWER[data]
    starts, ends, text = words(lower, offsets, SEPARATORS)
    hashes = Rolling(lower, 1).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    return hashes, counts, np.cumsum(counts) - counts


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


def document_frequencies(narrow: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed word stands, and the number of texts; FEATURES numbers reach the driver."""

    def count(batches):
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch, data, offsets in slices(batches):
            hashes, counts, _ = _words(data, offsets)
            text = np.repeat(np.arange(len(counts)), counts)
            distinct = np.unique((text << 18) | _feature(hashes))
            total += np.bincount(distinct & (FEATURES - 1), minlength=FEATURES)
            rows += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["feature", "texts"])

    counted = narrow.select("text").mapInArrow(count, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts"))
    table = counted.toArrow()
    feature, texts_ = (table.column(c).to_numpy() for c in ("feature", "texts"))
    found = np.zeros(FEATURES, np.int64)
    found[feature[feature >= 0]] = texts_[feature >= 0]
    return found, int(texts_[feature < 0].sum())


def weights(frequencies: np.ndarray, rows: int) -> np.ndarray:
    return np.maximum(np.log((rows + 1) / (frequencies + 0.5)), 0.05).astype(np.float32)


def _normal(features: np.ndarray, width: int) -> np.ndarray:
    """Rows of a fixed random matrix, the same in every task."""
    with np.errstate(over="ignore"):
        cell = (features[:, None].astype(np.uint64) << np.uint64(16)) + np.arange(2 * width, dtype=np.uint64)
    uniform = ((mix(mix(cell + np.uint64(0x51ED270B))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.sqrt(-2 * np.log(uniform[:, :width])) * np.cos(2 * np.pi * uniform[:, width:])


def pieces(passages: DataFrame) -> DataFrame:
    """(doc_id, text, begin, end): each passage with the numbers of its parts, BLOCK at most in a row.

    A passage of n words has ceil(n / 32) parts of nearly the same length; none of a passage without words.
    """
    most = BLOCK

    def cut(batches):
        for batch, data, offsets in slices(batches):
            _, counts, _ = _words(data, offsets)
            parts = -(-counts // (2 * STEP))
            rows = [(i, at, min(at + most, n)) for i, n in enumerate(parts.tolist()) for at in range(0, n, most)]
            index, begin, end = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("text").take(index), begin, end], ["doc_id", "text", "begin", "end"]
            )

    return passages.select("doc_id", "text").mapInArrow(cut, "doc_id long, text string, begin long, end long")


def _part_rows(batches, idf: np.ndarray) -> Iterator[tuple[int | None, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(id, hashes of all words, (features, weights) of the TF-IDF row of each part, of length 1) of each row of ``pieces``."""
    for batch, data, offsets in slices(batches):
        hashes, counts, first = _words(data, offsets)
        for i, (key, begin, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "begin", "end")))):
            own, rows = hashes[first[i] : first[i] + counts[i]], []
            parts = -(-len(own) // (2 * STEP))
            for k in range(begin, end):
                at, times = np.unique(_feature(own[k * len(own) // parts : (k + 1) * len(own) // parts]), return_counts=True)
                row = times * idf[at]
                rows.append((at, row / max(np.sqrt((row**2).sum()), 1e-9)))
            yield key, own, rows


def basis(passages: DataFrame, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and their loadings (features, rank): the leading right singular vectors of the parts' TF-IDF matrix.

    Randomised: Y = A @ normal, Z = A.T @ Y summed over the tasks by feature, and an orthonormal basis of Z's columns.
    ``passages`` is a block of ``pieces``, so Z has at most FEATURES rows.
    """
    shared = passages.sparkSession.sparkContext.broadcast(idf)
    width = rank + OVERSAMPLE

    def lists(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
        values = pa.array(np.concatenate(list(rows.values())))
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.ListArray.from_arrays(ends, values)], ["feature", "z"])

    def sketch(batches):
        rows: dict[int, np.ndarray] = {}
        for _, _, parts in _part_rows(batches, shared.value):
            for at, row in parts:
                y = row @ _normal(at, width)
                for feature, weight in zip(at.tolist(), row.tolist()):
                    rows[feature] = rows.get(feature, 0) + weight * y
        if rows:
            yield lists(rows)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = batch.column("z").flatten().to_numpy().reshape(-1, width)
            for feature, row in zip(batch.column("feature").to_pylist(), z):
                sums[feature] = sums[feature] + row if feature in sums else row
        if sums:
            yield lists(sums)

    parts = passages.mapInArrow(sketch, "feature long, z array<double>")
    summed = parts.repartition("feature").mapInArrow(add, "feature long, z array<double>")
    table = summed.orderBy("feature").toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.float32)
    z = np.array(table.column("z").combine_chunks().flatten()).reshape(-1, width)
    left, size, _ = np.linalg.svd(z, full_matrices=False)
    rank = min(rank, int((size > 1e-9 * size[0]).sum()))
    return table.column("feature").to_numpy(), np.ascontiguousarray(left[:, :rank], np.float32)


def _grouped(vectors: np.ndarray) -> np.ndarray:
    """Parts (in columns) in groups of about GROUP alike ones: a few rounds of k-means on the sphere."""
    count = -(-vectors.shape[1] // GROUP)
    unit = vectors.T / np.maximum(np.linalg.norm(vectors, axis=0)[:, None], 1e-9)
    centres = unit[np.random.default_rng(5).choice(len(unit), count, replace=False)]
    for _ in range(10):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norms = np.linalg.norm(sums, axis=1)[:, None]
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centres)
    return (unit @ centres.T).argmax(axis=1)


@dataclass(frozen=True)
class Windows:
    """The steps of a slice of texts and its windows: a window is two steps, a text of one step a window of its own."""

    feature: np.ndarray  # of every word
    begin: np.ndarray  # first word of each step
    end: np.ndarray
    owner: np.ndarray  # text of each step
    step: np.ndarray  # first step of each window
    after: np.ndarray  # second one, or the first again
    both: np.ndarray  # 1.0 if there are two
    norm: np.ndarray  # of each window's TF-IDF row; every word counts singly

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, energy: np.ndarray) -> Windows:
        feature = _feature(hashes)
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        begin = np.flatnonzero((np.arange(len(hashes)) - first[text]) % STEP == 0)
        owner = text[begin]
        whole = np.add.reduceat(energy[feature], begin)
        paired = np.append(owner[1:] == owner[:-1], False)
        alone = ~paired & np.append(True, owner[1:] != owner[:-1])
        step = np.flatnonzero(paired | alone)
        after = np.where(paired[step], step + 1, step)
        both = paired[step].astype(np.float32)
        norm = np.sqrt(np.maximum(whole[step] + both * whole[after], 1e-9))
        return cls(feature, begin, np.append(begin[1:], len(hashes)), owner, step, after, both, norm)

    def words_of(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``steps``, word) of every word of these steps, in order."""
        sizes = self.end[steps] - self.begin[steps]
        row = np.repeat(np.arange(len(steps)), sizes)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - self.begin[steps], sizes)


def _sums(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of ``values`` of equal ``rows`` (rising)."""
    out = np.zeros((count, *values.shape[1:]), np.float32)
    if len(rows):
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[starts]] = np.add.reduceat(values, starts)
    return out


@dataclass(frozen=True)
class Index:
    """A block of passages in the latent space, about BLOCK parts."""

    ids: list[int | None]
    words: list[np.ndarray]  # hashes, in order
    answers: list[np.ndarray]  # hashes of the rarest words
    owner: np.ndarray  # the passage of each part
    vectors: np.ndarray  # (rank, parts)
    full: np.ndarray  # the product of each part with its own distinct words
    features: np.ndarray  # of all parts, rising
    loadings: np.ndarray  # (features, rank), times the feature's weight
    reach: np.ndarray  # (features, groups): the most that a feature adds to a window's product with a part of the group
    share: np.ndarray  # the same in parts of ``full``

    @classmethod
    def of(cls, passages: DataFrame, idf: np.ndarray) -> Index:
        """``passages`` are rows of ``pieces``, or of (doc_id, text), all of whose parts are taken."""
        block = passages if "begin" in passages.columns else pieces(passages)
        found = list(_part_rows(block.orderBy("doc_id", "text", "begin").toArrow().to_batches(), idf))  # about BLOCK parts
        features, loadings = basis(block, idf, max(1, sum(len(parts) for _, _, parts in found)))
        ids, own_words, answers, owner, vectors, full = [], [], [], [], [], []
        for key, own, parts in found:
            distinct = np.unique(own)
            order = np.lexsort((distinct, -idf[_feature(distinct)]))
            answers.append(distinct[order[: max(1, round(ANSWER_PART * len(distinct)))]])
            for at, row in parts:
                owner.append(len(ids))
                vectors.append(row.astype(np.float32) @ loadings[np.searchsorted(features, at)])
                full.append(float(row @ idf[at]))
            ids.append(key)
            own_words.append(own)
        stacked = np.array(vectors, np.float32).T if vectors else np.zeros((loadings.shape[1], 0), np.float32)
        whole, weight = np.array(full, np.float32), idf[features][:, None]
        reach, share = (np.zeros((len(features), 0), np.float32) for _ in range(2))
        if vectors:
            most, group = np.abs(loadings @ stacked) * weight, _grouped(stacked)
            held = [group == g for g in np.unique(group)]
            reach = np.stack([most[:, own].max(axis=1) for own in held], axis=1)
            share = np.stack([(most[:, own] / whole[own]).max(axis=1) for own in held], axis=1)
        return cls(ids, own_words, answers, np.array(owner, np.int64), stacked, whole, features, loadings * weight, reach, share)

    def candidates(self, windows: Windows, chosen: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
        """(first word, last word + 1, text, passage, cosine) of those ``chosen`` windows that are near a part of a
        passage, nearest first.

        A word that a step repeats counts once in the product. Near is a cosine of at least ``cosine``, or such a share of
        the part's product with itself: of two neighbouring windows that hold a verbatim part, one holds half of it,
        whatever stands around it.
        """
        step, after, both, norm = (x[chosen] for x in (windows.step, windows.after, windows.both, windows.norm))
        used = np.unique(np.append(step, after))
        row, word = windows.words_of(used)
        feature = windows.feature[word]
        place = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        mine = self.features[place] == feature
        cell = np.unique((row[mine] << 32) | place[mine])  # once per step
        embedded = _sums(cell >> 32, self.loadings[cell & 0xFFFFFFFF], len(used))
        vectors = embedded[np.searchsorted(used, step)] + both[:, None] * embedded[np.searchsorted(used, after)]
        product = vectors @ self.vectors
        row, part = np.nonzero(product >= cosine * np.minimum(norm[:, None], self.full))
        near = product[row, part] / norm[row]
        order = np.argsort(-near, kind="stable")
        _, once = np.unique((row[order] * len(self.ids)) + self.owner[part[order]], return_index=True)  # a window meets a passage once
        order = order[np.sort(once)]
        row, passage = row[order], self.owner[part[order]]
        return windows.begin[step[row]], windows.end[after[row]], windows.owner[step[row]], passage, near[order]

    def confirm(self, own: np.ndarray, passage: int) -> tuple[float, float]:
        """The part of the passage's words that stand in ``own`` in order, and the part of its answer that is there."""
        wanted = self.words[passage]
        return common_subsequence(wanted, own) / len(wanted), float(np.isin(self.answers[passage], own).mean())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


HITS = "doc_id long, item_id long, cosine double, common double, answer double"


class Sieve:
    """Which windows may be near a part of which block: for every word, the most that it adds for a group of parts.
    Windows whose words cannot add up to enough for any group of a block are not embedded for it."""

    def __init__(self, blocks: list[Index], idf: np.ndarray):
        self.energy = idf.astype(np.float32) ** 2
        features = np.unique(np.concatenate([b.features for b in blocks]))
        self.place = np.full(FEATURES, -1, np.int32)
        self.place[features] = np.arange(len(features))
        self.groups = np.cumsum([0, *(b.reach.shape[1] for b in blocks)])
        self.reach, self.share = (np.zeros((len(features), self.groups[-1]), np.float32) for _ in range(2))
        for block, low, high in zip(blocks, self.groups, self.groups[1:]):
            at = self.place[block.features]
            self.reach[at, low:high], self.share[at, low:high] = block.reach, block.share

    def chosen(self, windows: Windows, cosine: float):
        """(number of a block, windows to look at), WINDOWS at a time."""
        for start in range(0, len(windows.step), WINDOWS):
            some = np.arange(start, min(start + WINDOWS, len(windows.step)))
            step, after, both = windows.step[some], windows.after[some], windows.both[some]
            used = np.arange(step[0], after[-1] + 1)
            row, word = windows.words_of(used)
            place = self.place[windows.feature[word]]
            row, place = row[place >= 0], place[place >= 0]
            far = np.ones((len(some), self.groups[-1]), bool)
            for most, bound in ((self.reach, cosine * windows.norm[some][:, None]), (self.share, cosine)):
                sums = _sums(row, most[place], len(used))
                far &= 1.001 * (sums[step - step[0]] + both[:, None] * sums[after - step[0]]) < bound
            for number, (low, high) in enumerate(zip(self.groups, self.groups[1:])):
                near = some[~far[:, low:high].all(axis=1)]
                if len(near):
                    yield number, near


HITS = "doc_id long, item_id long, cosine double, common double, answer double"


def _scan(sieve, blocks: list, cosine: float):
    """``sieve`` and ``blocks`` are broadcast."""

    def scan(batches):
        for batch, data, offsets in slices(batches):
            hashes, counts, first = _words(data, offsets)
            if not len(hashes):
                continue
            windows = Windows.of(hashes, counts, sieve.value.energy)
            keys, best = batch.column("doc_id").to_pylist(), {}
            for number, chosen in sieve.value.chosen(windows, cosine):
                block: Index = blocks[number].value
                for begin, end, text, passage, near in zip(*(x.tolist() for x in block.candidates(windows, chosen, cosine))):
                    if best.get((text, number, passage), (0, 0, 0))[0] == 1:
                        continue  # nearer and whole: no other window is better
                    reach = len(block.words[passage])
                    low, high = max(begin - reach, int(first[text])), min(end + reach, int(first[text] + counts[text]))
                    common, answer = block.confirm(hashes[low:high], passage)
                    if common >= COMMON and answer >= ANSWER:
                        best[text, number, passage] = max(best.get((text, number, passage), (0, 0, 0)), (common, near, answer))
            rows = [(keys[t], blocks[n].value.ids[p], near, common, answer) for (t, n, p), (common, near, answer) in best.items()]
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "cosine", "common", "answer"])

    return scan


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    cosine: float = COSINE,
) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): the documents that hold a benchmark passage or a paraphrase of it.

    ``common`` is the part of the passage's words that the document has in order around the best window, ``answer``
    the part of its rarest words. Null and empty texts, and passages without words, match nothing. Repeated rows are
    reported once; null ids are reported as null. Passages with equal texts are all reported. Without documents or
    passages the result is empty.
    """
    spark = docs.sparkSession
    narrow = texts(docs, id_col, text_col)
    frequencies, rows = document_frequencies(narrow)
    idf = weights(frequencies, rows)
    items = stored(pieces(texts(benchmark, item_col, item_text).where("text <> ''").distinct()))
    parts = items.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] or 0
    blocks = max(1, -(-parts // BLOCK))
    # Blocks by a hash: of about equal size, whatever the ids.
    order = F.pmod(F.xxhash64("doc_id", "text", "begin"), F.lit(blocks))
    result = None
    for start in range(0, blocks, BLOCKS_AT_ONCE):
        own = [Index.of(items.where(order == number), idf) for number in range(start, min(start + BLOCKS_AT_ONCE, blocks))]
        sieve, shared = spark.sparkContext.broadcast(Sieve(own, idf)), [spark.sparkContext.broadcast(index) for index in own]
        found = narrow.mapInArrow(_scan(sieve, shared, cosine), HITS)
        result = found if result is None else result.unionByName(found)
    return result.groupBy("doc_id", "item_id").agg(
        F.max_by("cosine", F.struct("common", "cosine")).alias("cosine"), F.max("common").alias("common"), F.max("answer").alias("answer")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage or a paraphrase of it, whatever other rows have their id."""
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    leaks = stored(find_leaks(docs.select(key.alias("key"), text_col), benchmark, "key", text_col).select("doc_id").distinct())
    return keep_ids(docs.withColumn("_llm_row", key), leaks, "_llm_row", "left_anti").drop("_llm_row")

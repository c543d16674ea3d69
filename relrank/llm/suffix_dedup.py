"""Removal of repeated byte strings by prefix-free parsing.

Triggers (the smallest of the rolling hashes in each window) cut the texts into overlapping phrases. Every window of
``length`` bytes lies in exactly one phrase, and the same window always lies at the same place around an equal trigger.
The corpus becomes a dictionary of distinct phrases and a parse (where each phrase occurs, in corpus order):

1. An occurrence of a phrase that is not its first one repeats all its windows.
2. First occurrences can share windows only with other phrases of the same trigger and of equal bytes on one side of
   it. The suffixes of such phrases are put in suffix order, together with the place in the parse; of equal ones, all
   but the first are repeats. As only equal runs matter, the order is that of a 96-bit hash of a suffix's first
   ``length`` bytes.

Repetitive text costs little: it adds to the parse, and neither to the dictionary nor to its suffixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import Rolling, mix, settle, slices, stored, texts

LENGTH = 100
GRAM = 24  # bytes under a trigger's rolling hash
ROWS_AT_ONCE = 200_000
NULL_ID = -(1 << 63)
SPAN_BITS = 7  # a phrase has at most 2 ** SPAN_BITS windows
PLACED = "a long, b long, doc long, mark long, at long, seen boolean"
# A text is its id and a mark, which is 0 unless rows repeat the id. A place in it is one number: first byte, then the
# windows after the first one.


def _batch(a, b, doc, mark, at, seen) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(mark), pa.array(at), pa.array(seen)],
        ["a", "b", "doc", "mark", "at", "seen"],
    )


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """First and last window of every phrase, and the hashes of its trigger and of its bytes."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    at = np.arange(len(data) - GRAM + 1, dtype=np.int64)
    grams = Rolling(data, 1).of(at, at + GRAM)
    # High half: hash; low half: place. The smallest is the smallest hash, the leftmost of equals.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    want, have = length - GRAM + 1, 1
    while 2 * have <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < want:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = text[: len(trigger)] == text[length - 1 :]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (trigger[1:] != trigger[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (trigger[1:] != trigger[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, grams[trigger[lo]], Rolling(data, 2).of(lo, hi + length)


def _fold(a, b, doc, mark, at) -> pa.RecordBatch:
    """Map-side: of equal (a, b) only the first place goes on as such; the others are known to be repeats.

    Of ``b`` 32 bits go on, so that rows are small; 96 bits of hash still tell strings apart.
    """
    b = b & np.uint64(0xFFFFFFFF)
    order = np.lexsort((at, mark, doc, b, a) if mark.any() else (at, doc, b, a))
    a, b, doc, mark, at = a[order], b[order], doc[order], mark[order], at[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
    fresh = ~(same & (doc == doc[heads]) & (mark == mark[heads]) & (at == at[heads]))  # a repeated row is no repeat of itself
    spread = (doc * 0x9E3779B1 + mark + (at >> SPAN_BITS)).view(np.uint64)  # what is known goes anywhere
    return _batch(np.where(same, spread, a)[fresh], np.where(same, np.uint64(0), b)[fresh], doc[fresh], mark[fresh], at[fresh], same[fresh])


def _place(batch: pa.RecordBatch, index: np.ndarray, start: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    return batch.column("doc_id").to_numpy()[index], batch.column("mark").to_numpy()[index], (start << SPAN_BITS) | more


def _folded(parts):
    """Batches of (a, b, doc, mark, at) tuples, folded ROWS_AT_ONCE at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= ROWS_AT_ONCE:
            yield _fold(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield _fold(*map(np.concatenate, zip(*held)))


def _parse(length: int):
    def parse(batches):
        def parts():
            for batch, data, offsets in slices(batches):
                lo, hi, trigger, content = phrases(data, offsets, length)
                index = np.searchsorted(offsets, lo, "right") - 1
                yield trigger, content, *_place(batch, index, lo - offsets[index], hi - lo)

        yield from _folded(parts())

    return parse


def _contexts(length: int):
    """The bytes of the listed phrases, with hashes of what stands before and after the trigger, up to half of what a
    window has besides it. Every window that two phrases share has one of the two whole, at the same trigger."""
    half = (length - GRAM) // 2

    def contexts(batches):
        for batch, data, offsets in slices(batches):
            lists = batch.column("places")
            index = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            if not len(index):
                continue
            at = lists.flatten().to_numpy()
            lo = (at >> SPAN_BITS) + offsets[index]
            end = lo + (at & ((1 << SPAN_BITS) - 1)) + length
            grams = Rolling(data, 1)
            place = np.arange(len(data) - GRAM + 1, dtype=np.int64)
            order = (grams.of(place, place + GRAM) & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
            edges = np.stack([lo, end - GRAM + 1], axis=1).reshape(-1)
            trigger = np.minimum.reduceat(np.append(order, np.uint64((1 << 64) - 1)), edges)[::2] & np.uint64(0xFFFFFFFF)
            trigger = trigger.astype(np.int64)
            before, after = trigger - half, trigger + GRAM + half
            keys = (
                pa.array(grams.of(np.maximum(before, lo), trigger + GRAM).view(np.int64), mask=before < lo),
                pa.array(mix(grams.of(trigger, np.minimum(after, end))).view(np.int64), mask=after > end),
            )
            raw = data.tobytes()
            parts = pa.array([raw[i:j] for i, j in zip(lo.tolist(), end.tolist())], pa.binary())
            doc, mark = (batch.column(c).to_numpy()[index] for c in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(mark), pa.array(at), pa.array(trigger - lo), parts, *keys],
                ["doc_id", "mark", "at", "lead", "text", "before", "after"],
            )

    return contexts


def _suffixes(length: int):
    """The windows of the listed phrases: those that reach far before the trigger if ``before`` is set, the others if
    ``after`` is."""
    half = (length - GRAM) // 2

    def windows(batches):
        def parts():
            for batch, data, offsets in slices(batches):
                whole = np.diff(offsets) - length + 1
                middle = np.clip(batch.column("lead").to_numpy() - half + 1, 0, whole)
                first = np.where(batch.column("before").to_numpy(zero_copy_only=False), 0, middle)
                count = np.where(batch.column("after").to_numpy(zero_copy_only=False), whole, middle) - first
                index = np.repeat(np.arange(batch.num_rows), count)
                start = np.arange(len(index)) - np.repeat(np.cumsum(count) - count - first, count)
                where = start + offsets[index]
                one, two = Rolling(data, 3).of(where, where + length), Rolling(data, 4).of(where, where + length)
                lo = batch.column("at").to_numpy()[index] >> SPAN_BITS
                yield one, two, *_place(batch, index, lo + start, np.zeros(len(start), np.int64))

        yield from _folded(parts())

    return windows


def _repeats(batches):
    """Rows sorted by (a, b, doc, mark, at) become places: repeats (edge = false), and the first place of every (a, b)
    whose ``a`` has several ``b`` (edge = true). Holds one row, however many share a key."""
    group, first, classes, waiting = None, None, 0, None  # of the key seen last

    def out(doc, mark, at, edge):
        columns = [pa.array(c, pa.int64()) for c in (doc, mark, at)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), edge))], ["doc", "mark", "at", "edge"])

    for batch in batches:
        a, b, *place, seen = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if seen.any():
            yield out(*(c[seen] for c in place), False)
            a, b, *place = (c[~seen] for c in (a, b, *place))
        if not len(a):
            continue
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        goes_on = first is not None and (a[0], b[0]) == first[:2]
        new[0] = not goes_on
        heads = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        same = np.ones(len(a), bool)  # the first place itself, in a repeated row
        for i, column in enumerate(place):
            head = np.where(heads < 0, first[2 + i], column[heads]) if goes_on else column[heads]
            same &= column == head
        repeat = ~new & ~same
        yield out(*(c[repeat] for c in place), False)

        own = np.flatnonzero(new)  # one row per (a, b) that starts here
        if len(own):
            starts = np.flatnonzero(np.concatenate([[True], a[own][1:] != a[own][:-1]]))
            sizes = np.diff(np.append(starts, len(own)))
            if a[own[0]] == group:
                if classes == 1:
                    yield out(*([v] for v in waiting), True)
                classes += int(sizes[0])
                several = np.concatenate([[True], sizes[1:] > 1])
                last_classes = classes if len(sizes) == 1 else int(sizes[-1])
            else:
                several, last_classes = sizes > 1, int(sizes[-1])
            edge = own[np.repeat(several, sizes)]
            yield out(*(c[edge] for c in place), True)
            group, classes, waiting = a[own[-1]], last_classes, tuple(c[own[-1]] for c in place)
            first = (a[own[-1]], b[own[-1]], *waiting)


def _in_order(placed: DataFrame) -> DataFrame:
    ordered = placed.repartition("a").sortWithinPartitions("a", "b", "doc", "mark", "at")
    return ordered.mapInArrow(_repeats, "doc long, mark long, at long, edge boolean")


def _with_places(marked: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Texts with the places that belong to them; a text's own length bounds its list."""
    lists = places.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.collect_list("at").alias("places"))
    return marked.join(lists, ["doc_id", "mark"], how).select("doc_id", "mark", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"))


def _cut(length: int):
    def cut(batches):
        for batch, data, offsets in slices(batches):
            lists = batch.column("places")
            index = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = lists.flatten().to_numpy()
            lo = (at >> SPAN_BITS) + offsets[index]
            hi = lo + (at & ((1 << SPAN_BITS) - 1)) + length
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, lo, 1)
            np.subtract.at(cover, hi, 1)
            gone = np.zeros(len(data) + 2, bool)
            gone[1:-1] = np.cumsum(cover[:-1]) > 0
            rows = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                begin, end = offsets[i], offsets[i + 1]
                own = gone[begin + 1 : end + 1]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8))).tolist()
                rows["doc_id"].append(None if key == NULL_ID else key)
                rows["n_bytes"].append(int(end - begin))
                rows["spans"].append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
                rows["kept"].append(data[begin:end][~own].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["spans"], span), pa.array(rows["kept"], pa.binary())],
                list(rows),
            )

    return cut


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The bytes of each text that no repeated string of ``length`` bytes covers.

    A byte goes if it lies in a ``length``-byte string that also starts earlier: in a smaller doc_id, or earlier in the
    same text; overlaps count, texts are judged as given, and strings never cross texts. Returns a row for each row of
    ``docs``: doc_id, n_bytes, spans (the maximal removed runs), kept (binary). Null text is '' and loses nothing, as
    any shorter than ``length``. A null id comes before all others. Rows that repeat id and text are one document and
    share its result; rows of one id with different texts are documents in a fixed order. An empty table gives an
    empty result.
    """
    if not GRAM <= length <= GRAM + (1 << SPAN_BITS) - 1:
        raise ValueError(f"length must lie between {GRAM} and {GRAM + (1 << SPAN_BITS) - 1}")
    whole = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    repeated = stored(whole.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("again")))
    mark = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    marked = whole.join(repeated, "doc_id", "left").select("doc_id", mark.alias("mark"), "text")
    found = stored(_in_order(marked.mapInArrow(_parse(length), PLACED)))
    settle(docs.sparkSession)
    context = "doc_id long, mark long, at long, lead long, text binary, before long, after long"
    near = stored(_with_places(marked, found.where("edge"), "inner").mapInArrow(_contexts(length), context))
    settle(docs.sparkSession)
    keys = near.select("doc_id", "mark", "at", F.posexplode(F.array("before", "after")).alias("side", "key")).where("key is not null")
    common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sides = keys.join(common, "key").groupBy("doc_id", "mark", "at")
    alike = sides.agg(F.max(F.col("side") == 0).alias("before"), F.max(F.col("side") == 1).alias("after"))
    shared = near.drop("before", "after").join(alike, ["doc_id", "mark", "at"])
    suffixes = stored(_in_order(shared.mapInArrow(_suffixes(length), PLACED)).where("not edge"))
    places = found.where("not edge").unionByName(suffixes).drop("edge")
    settle(docs.sparkSession)
    result = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return _with_places(marked, places, "left").mapInArrow(_cut(length), result)

"""Exact deduplication in two passes over a Bloom filter.

The first pass counts, up to two, how many rows set each bit; the second asks the bits that were set twice. A row
with a bit that no other row has set is alone and passes straight through; only the rest are shuffled and grouped.

Fingerprints are stored once, in ranges of about as many rows as one filter serves; each range is read twice, for its filter
and to ask it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from relrank.llm.common import keep_ids, stage_path, stored, texts

BLANKS = " \t\n\x0b\x0c\r"  # the characters that do not count; fixed values
HASHES = 3
PIECE = 20  # a piece of the filter has 2 ** PIECE bits
ROWS_AT_ONCE = 500_000


def fingerprint(text: str | Column) -> Column:
    """SHA-256 of the text without white space, 32 bytes; null is ''."""
    column = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.coalesce(column, F.lit("")), BLANKS, "")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def _places(column: pa.Array, bits: int) -> np.ndarray:
    """(rows, HASHES) bit numbers: parts of the fingerprint."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u4").reshape(-1, 8)[:, 1 : 1 + HASHES].astype(np.int64) & (bits - 1)


def _emit(places: np.ndarray) -> list[pa.RecordBatch]:
    at, times = np.unique(places, return_counts=True)
    found = []
    pieces, starts = np.unique(at >> PIECE, return_index=True)
    for piece, start, stop in zip(pieces, starts, [*starts[1:], len(at)]):
        own = at[start:stop]
        found.append((int(piece), own.astype("<u4").tobytes(), own[times[start:stop] > 1].astype("<u4").tobytes()))
    return [
        pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))],
            ["piece", "once", "twice"],
        )
    ] if found else []


def _bits(prints: DataFrame, bits: int, twice_only: bool) -> bytes:
    """The filter of bits that a row has set, or two rows have, at most ``bits`` / 8 bytes: its pieces are merged by the
    executors."""

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            # Equal rows of a batch must count as two, the hashes of one row as one.
            own = np.sort(_places(batch.column(0), bits), axis=1)
            again = np.zeros(own.shape, bool)
            again[:, 1:] = own[:, 1:] == own[:, :-1]
            held.append(own[~again])
            size += len(own)
            if size >= ROWS_AT_ONCE:
                yield from _emit(np.concatenate(held))
                held, size = [], 0
        if held:
            yield from _emit(np.concatenate(held))

    def merge(batches):
        now, once, twice = None, None, None

        def done():
            packed = np.packbits(twice if twice_only else once).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for piece, first, second in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, once, twice = piece, np.zeros(1 << PIECE, bool), np.zeros(1 << PIECE, bool)
                at = np.frombuffer(first, "<u4") & ((1 << PIECE) - 1)
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(second, "<u4") & ((1 << PIECE) - 1)] = True
        if now is not None:
            yield done()

    pieces = (
        prints.select("print")
        .mapInArrow(gather, "piece int, once binary, twice binary")
        .repartition("piece")
        .sortWithinPartitions("piece")
        .mapInArrow(merge, "piece int, bits binary")
    )
    whole = bytearray(max(bits, 1 << PIECE) // 8)
    size = (1 << PIECE) // 8
    for piece, part in pieces.collect():
        whole[piece * size : (piece + 1) * size] = part
    return bytes(whole)


def _test(shared, bits: int):
    @arrow_udf("boolean")
    def repeated(column: pa.Array) -> pa.Array:
        marks = np.frombuffer(shared.value, np.uint8)
        at = _places(column, bits)
        return pa.array(((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return repeated


BITS_PER_ROW, MOST_BITS = 16, 1 << 28  # of a filter: 32 MB


def _flagged(docs: DataFrame, id_col: str, text_col: str, most_bits: int) -> DataFrame:
    """(doc_id, n_chars, print, again) of every row, stored: ``again`` if another row may have its fingerprint.

    One range after the other has its filter built and asked, so that one is broadcast at a time and none is larger than
    ``most_bits``."""
    spark = docs.sparkSession
    ranges = max(1, -(-docs.count() * BITS_PER_ROW // most_bits))
    narrow = texts(docs, id_col, text_col).select("doc_id", F.char_length("text").alias("n_chars"), fingerprint("text").alias("print"))
    number = F.pmod(F.conv(F.hex(F.substring("print", 1, 4)), 16, 10).cast("long"), F.lit(ranges)).cast("int")
    ranged = narrow.withColumn("range", number)
    prints = stored(ranged.hint("rebalance", "range") if ranges > 1 else ranged, ["range"])
    path = stage_path(spark)
    for at in range(ranges):
        own = prints.where(F.col("range") == at).drop("range")
        rows = own.count()
        bits = max(1 << PIECE, 1 << min(most_bits.bit_length() - 1, (rows * BITS_PER_ROW).bit_length()))
        shared = spark.sparkContext.broadcast(_bits(own, bits, twice_only=True))
        own.withColumn("again", _test(shared, bits)("print")).write.mode("append").partitionBy("again").parquet(path)
        shared.destroy()
    return spark.read.schema("doc_id long, n_chars int, print binary, again boolean").parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Which row stays of each group of texts that are equal but for white space.

    Returns a row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the text without
    white space). The row with the most code points stays, then the smallest doc_id. Null text is '' and equals every
    blank text. Rows that repeat an id belong together: they count singly in group_size and share ``kept``. A null id
    stays only if all ids of its group are null. An empty table gives an empty result.
    """
    return _decide(_flagged(docs, id_col, text_col, most_bits))


def _decide(flagged: DataFrame) -> DataFrame:
    rest, again = flagged.where(~F.col("again")), flagged.where("again")
    # Summed in the map tasks first; stored, so that the join below shuffles both sides and AQE can split a hot group.
    groups = stored(
        again.groupBy("print").agg(
            F.max_by("doc_id", F.struct("n_chars", F.bitwise_not("doc_id").alias("order"))).alias("keep_id"),
            F.count("*").alias("group_size"),
        )
    )
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")]
    columns.append(F.lower(F.hex("print")).alias("text_sha256"))
    single = rest.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).select(*columns)
    return again.join(groups, "print").select(*columns).unionByName(single)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row of ``docs`` of each group of ``exact_dedup``, the one that it keeps; of rows that repeat its id the one with
    the most code points. A filter of the fingerprints that groups have, of ``most_bits`` at most, tells the rows that
    may be in one; the others are not shuffled."""
    # Id and fingerprint: an id may stand on several texts.
    row = F.xxhash64("doc_id", F.unhex("text_sha256")).alias("row")
    grouped = _decide(_flagged(docs, id_col, text_col, most_bits)).where("group_size > 1")
    decided = grouped.select(row, "kept", "text_sha256").groupBy("row", "kept").agg(F.count("*").alias("count"), F.first("text_sha256").alias("text_sha256"))
    decided = stored(decided)
    dropped, several = decided.where("not kept").select("row"), decided.where("kept and count > 1").select("row")
    prints = stored(decided.select(F.unhex("text_sha256").alias("print")).distinct())
    bits = max(1 << PIECE, 1 << min(most_bits.bit_length() - 1, (prints.count() * BITS_PER_ROW).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(prints, bits, twice_only=False))
    grouped_too = _test(shared, bits)(fingerprint(text_col))
    key = F.xxhash64(F.col(id_col).cast("long"), fingerprint(text_col))
    first = F.row_number().over(Window.partitionBy("_llm_row").orderBy(F.char_length(text_col).desc_nulls_last()))
    asked = keep_ids(docs.where(grouped_too).withColumn("_llm_row", key), dropped, "_llm_row", "left_anti")
    one = keep_ids(asked, several, "_llm_row", "left_anti")
    of_several = keep_ids(asked, several, "_llm_row").withColumn("_llm_first", first).where("_llm_first = 1").drop("_llm_first")
    return docs.where(~grouped_too).unionByName(one.unionByName(of_several).drop("_llm_row"))

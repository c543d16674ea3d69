"""What the operators share: tables, stored stages, text batches as byte arrays."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.session import stage_folder

BATCH_ROWS = 256  # rows of an Arrow batch, and of one of the Parquet reader, where whole texts go to Python
BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
SLICE_BYTES = 1 << 19  # text handled at once by vectorised code; one longer text is a slice of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns of any name never meet the operators' own. Null text is ''."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _stage_dir(spark: SparkSession) -> str:
    return f"{stage_folder(spark)}/llm"


def stage_path(spark: SparkSession) -> str:
    """A new place in the shared folder; ``release`` removes what is written there."""
    return f"{_stage_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs its own tasks, never an earlier stage. ``release`` removes the files.
    """
    path = stage_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by_small_batches(df: DataFrame) -> DataFrame:
    """``stored``, with at most BATCH_ROWS rows in an Arrow batch and in one of the Parquet reader. Spark's 10,000 rows of
    whole texts are some 30 MB, more with longer texts, and stand several times in an executor: in the JVM's vectors and
    streams and in its workers. The reader's 4,096 rows are one array of the heap, which grows by copies of twice the size."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in BATCH_SETTINGS}
    try:
        for key, rows in before.items():
            conf.set(key, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        return stored(df)
    finally:
        for key, rows in before.items():
            conf.set(key, rows)


def settle(spark: SparkSession) -> None:
    """Free the shuffle files of finished stages, before one that needs much disk. Spark removes them once the driver has
    found that nothing refers to them; left alone, that can take half an hour, and the disks hold every stage till then.
    Listeners hold the last query for a moment, so this waits for them."""
    time.sleep(1)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def release(spark: SparkSession) -> None:
    """Remove every stage this application has stored; call it when all results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose id stands in the only column of ``ids`` (``left_anti``: does not); null equals null."""
    other = ids.toDF("_llm_kept_id")
    return docs.join(other, docs[id_col].eqNullSafe(other["_llm_kept_id"]), how)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and len + 1 offsets into them; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose texts have ``limit`` bytes together (or one longer row), with their bytes and offsets."""
    for batch in batches:
        data, offsets = _bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            at = offsets[start : stop + 1]
            yield batch.slice(start, stop - start), data[at[0] : at[-1]], at - at[0]
            start = stop


def byte_table(members: bytes) -> np.ndarray:
    """A table of 256 flags."""
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = byte_table(b" \t\n\x0b\x0c\r")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any substrings of a byte array from one running sum: sum of code[byte] * base ** position, mod 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = (int(np.random.default_rng(seed).integers(1 << 62)) << 2) | 5
        codes = np.random.default_rng(seed + 1000).integers(1, 1 << 63, 256, dtype=np.uint64)
        power, self._inverse = self._tables(seed, base, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(codes[data] * power[: len(data)], out=self._sums[1:])

    @classmethod
    def _tables(cls, seed: int, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(seed)
        if have is None or len(have[0]) < size:
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                column = np.full(max(size, SLICE_BYTES + 1), b, np.uint64)
                column[0] = 1
                with np.errstate(over="ignore"):
                    made.append(np.cumprod(column))
            if size > 4 * SLICE_BYTES:
                return made[0], made[1]
            cls._powers[seed] = have = (made[0], made[1])
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64) * _GOLD)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes that are no separators, inside one text), and its text's index."""
    inside = ~separators[data]
    edge = np.empty(len(data) + 1, bool)  # a word can start here
    edge[1:] = True
    edge[1:-1] = ~inside[:-1]
    edge[0] = True
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    last = np.empty(len(data) + 1, bool)  # a word can end here
    last[:-1] = ~inside
    last[-1] = True
    last[offsets] = True
    ends = np.flatnonzero(inside & last[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1

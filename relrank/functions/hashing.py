"""Hash order: a reproducible stand-in for random draws and shuffles.

Rows are ordered by ``md5(seed|key columns)``. The hash is uniform, so its first hex digits cut a table of
any size into equal slices: positions and cut-offs come from one small count per slice, and no task ever
sees more than one slice. The key columns must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DIGITS = 4  # 65,536 slices; their counts are the only thing broadcast or sorted in one task


def hash_key(seed: int | str, *columns: str | Column) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(seed: int | str, *columns: str | Column) -> Column:
    """A bigint in [0, 2^32) taken from the hash."""
    return F.conv(F.substring(hash_key(seed, *columns), 1, 8), 16, 10).cast("bigint")


def _sliced(df: DataFrame, keys: Sequence[str], seed: int | str) -> DataFrame:
    return df.withColumn("_hash", hash_key(seed, *keys)).withColumn(
        "_slice", F.substring("_hash", 1, SLICE_DIGITS)
    )


def _slice_counts(sliced: DataFrame) -> DataFrame:
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_rows"))
    everything = Window.partitionBy()
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(
        "_slice",
        "_rows",
        F.sum("_rows").over(upto).alias("_upto"),
        F.sum("_rows").over(everything).alias("_total"),
    )


def hash_cutoff(
    df: DataFrame, n: int | Column | Callable[[Column], Column], keys: Sequence[str], seed: int | str
) -> DataFrame:
    """One row: the n-th smallest hash of ``df``, and how many rows of that hash are among the first n (no row when
    there are fewer).

    ``n`` may be a column without rows of its own, such as a scalar subquery, or be computed from the total row count.
    """
    sliced = _sliced(df.select(*keys), keys, seed).select("_hash", "_slice")
    want = n(F.col("_total")) if callable(n) else n if isinstance(n, Column) else F.lit(n)
    cut = (
        _slice_counts(sliced)
        .withColumn("_want", want.cast("bigint"))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_rows") < F.col("_want")))
        .select("_slice", (F.col("_want") - F.col("_upto") + F.col("_rows")).alias("_need"))
    )
    # Equal keys are counted together before they are ordered.
    hashes = sliced.join(F.broadcast(cut), "_slice").groupBy("_slice", "_need", "_hash").agg(F.count("*").alias("_rows"))
    upto = Window.partitionBy("_slice").orderBy("_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hashes.withColumn("_upto", F.sum("_rows").over(upto))
        .where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_rows") < F.col("_need")))
        .select("_hash", (F.col("_need") - F.col("_upto") + F.col("_rows")).alias("_left"))
    )


def mark_first(df: DataFrame, n, keys: Sequence[str], seed: int | str, name: str) -> DataFrame:
    """``df`` with a boolean: is the row among the n of smallest hash? Exactly n are, also where keys repeat: rows of
    the last hash count in the order of their columns. Of fewer than n rows none is marked."""
    return _mark_before(df, _cut(df, n, keys, seed), keys, seed, name)


def _cut(df: DataFrame, n, keys: Sequence[str], seed: int | str) -> Column:
    """``hash_cutoff`` as one value, null when there are fewer than n rows."""
    return hash_cutoff(df, n, keys, seed).select(F.struct("_hash", "_left")).scalar()


def _mark_before(df: DataFrame, cut: Column, keys: Sequence[str], seed: int | str, name: str) -> DataFrame:
    last, left = cut["_hash"], cut["_left"]
    hashed = df.withColumn("_hash", hash_key(seed, *keys))
    apart = hashed.where(F.coalesce(F.col("_hash") != last, F.lit(True)))
    apart = apart.withColumn(name, F.coalesce(F.col("_hash") < last, F.lit(False)))
    at = F.row_number().over(Window.partitionBy("_hash").orderBy(*[F.to_json(F.struct(F.col(c).alias("c"))) for c in df.columns]))
    tied = hashed.where(F.col("_hash") == last).withColumn("_at", at)
    return apart.drop("_hash").unionByName(tied.withColumn(name, F.col("_at") <= left).drop("_at", "_hash"))


def first_by_hash(
    df: DataFrame, n: int | Column, keys: Sequence[str], seed: int | str, strict: bool = False
) -> DataFrame:
    """The n rows of smallest hash: two narrow counting passes, then a plain filter of ``df``.

    With ``strict`` a table of fewer than n rows is an error, otherwise all of it is returned.
    """
    if not isinstance(n, Column) and n <= 0:
        return df.where(F.lit(False))
    wanted = n if isinstance(n, Column) else F.lit(n)
    cut = _cut(df, wanted, keys, seed)
    enough = cut.isNotNull() | (wanted <= 0)
    marked = _mark_before(df, cut, keys, seed, "_first").where(F.col("_first") | ~enough).drop("_first")
    if not strict:
        return marked
    # One row that is never there, but asks; so an empty table fails too.
    message = F.concat(F.lit("cannot sample "), wanted.cast("string"), F.lit(" rows: the table has fewer"))
    fails = F.when(enough, F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    return marked.unionByName(df.sparkSession.range(1).where(fails).select(*empty))


def hash_position(df: DataFrame, keys: Sequence[str], seed: int | str, name: str = "position") -> DataFrame:
    """Number all rows 0, 1, … in hash order, slice by slice."""
    sliced = _sliced(df, keys, seed)
    starts = _slice_counts(_sliced(df.select(*keys), keys, seed)).select(
        "_slice", (F.col("_upto") - F.col("_rows")).alias("_start")
    )
    in_slice = Window.partitionBy("_slice").orderBy("_hash")
    return (
        sliced.withColumn("_at", F.row_number().over(in_slice))
        .join(F.broadcast(starts), "_slice")  # at most 16^SLICE_DIGITS rows
        .withColumn(name, F.col("_start") + F.col("_at") - 1)
        .drop("_hash", "_slice", "_at", "_start")
    )

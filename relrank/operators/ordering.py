"""Orders used by the operators, and running totals that survive one huge group.

An order is a list of column names, those with a minus in front descending. Nulls come first going up, last going down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.session import checkpoint

PIECE_ROWS = 1 << 20  # rows of a piece that one task sums up, about
PIECE_BYTES = 1 << 27  # of wide rows fewer
GROUP_LIMIT = 1000  # up to here Spark drops rows past k in the map tasks


# Tie rules differ by place; each has a name.
def run_order() -> list[str]:
    return ["rank", "docid"]


def rerank_order() -> list[str]:
    return ["-score", "docid"]


def evaluation_order() -> list[str]:
    return ["-score", "-docid"]


def _columns(order: Sequence[str]) -> list[Column]:
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def _names(order: Sequence[str]) -> list[str]:
    return [name.removeprefix("-") for name in order]


def _cumulate(df: DataFrame, by: Sequence[str], order: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(value).over(upto).alias(name) for name, value in totals.items()])


def _width(df: DataFrame) -> Column:
    """The bytes of a row, about."""
    wide = [c.name for c in df.schema if not isinstance(c.dataType, T.NumericType | T.BooleanType | T.DatetimeType)]
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide]
    return sum(sizes, F.lit(8 * len(df.columns)).cast("long"))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    piece_rows: int | None = PIECE_ROWS,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Add the running sum of each column of ``totals`` inside every ``by`` group, in ``order``.

    ``F.lit(1)`` as a total gives the row number; ``order`` should end in a unique column. A prefix scan in two passes:
    the rows are stored, in ranges of about ``piece_rows``, fewer where these have more than ``piece_bytes``, of the order by
    group and place; each piece of a group is summed up by a task of its own, and shifted by the sums of the group's earlier
    pieces. So ``df`` is read once, and one group of any size costs as much as many small ones. ``piece_rows=None`` leaves
    groups whole, where a cap already bounds them, and stores nothing.
    """
    by = list(by)
    if piece_rows is None:
        return _cumulate(df, by, order, totals)

    rows = checkpoint(df)
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(_width(rows)), F.lit(0))).first()
    pieces = max(-(-count // piece_rows), -(-size // piece_bytes), 1)
    place = [F.asc(c) for c in by] + _columns(order)
    ranged = checkpoint(rows.repartitionByRange(pieces, *place).withColumn("_piece", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_piece").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # pieces, not rows
    shifts = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_piece").alias("_shift_at"), *[F.sum(f"_sum_{n}").over(earlier).alias(f"_shift_{n}") for n in totals])
    shifts = shifts.where(F.col(f"_shift_{next(iter(totals))}").isNotNull())  # only groups of several pieces
    same = F.col("_piece") == F.col("_shift_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    summed = _cumulate(ranged, [*by, "_piece"], order, totals).join(shifts, same, "left")
    return summed.select(*df.columns, *[(F.col(n) + F.coalesce(f"_shift_{n}", F.lit(0))).alias(n) for n in totals])


def head_of_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    k: int,
    name: str = "_at",
    piece_rows: int | None = PIECE_ROWS,
) -> DataFrame:
    """The first k rows of each group. Map tasks drop the others before the shuffle; where k is too large for
    that, groups are ranked in pieces."""
    if k > GROUP_LIMIT:
        ranked = running_totals(df, by, order, {name: F.lit(1)}, piece_rows).where(F.col(name) <= k)
        return ranked.withColumn(name, F.col(name).cast("int"))
    at = Window.partitionBy(*by).orderBy(*_columns(order))
    return df.withColumn(name, F.row_number().over(at)).where(F.col(name) <= k)

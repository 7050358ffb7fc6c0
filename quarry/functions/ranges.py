"""Dense positions by range: one exchange of the rows, counts of keys only.

``repartitionByRange`` deals the rows into ascending ranges of the whole order key (a hot
group is cut wherever its rows are many), a sort inside each range fixes the order, and
``monotonically_increasing_id`` names range and row. From then on the rows stay where they lie:
a position is the rows of the group in earlier ranges (a prefix sum over one row per (range,
group)) plus the row's place inside its range. Nothing is looked up in a list of cut points, so no
literal grows with the data, and there is no limit on the number of ranges.

The ranges of one execution are not those of another, so the ranged rows are kept once:
``persist`` (recomputed from the same shuffle if an executor is lost) or a written table. The
order key should be total; rows equal in all of it are interchangeable.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that :func:`ranged` adds: number of the range, row inside it.
PART, ROW = "_part", "_row"
_ROW_BITS = 33  # of monotonically_increasing_id


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks (recomputable). Kept rows may be as many as the corpus: in memory their blocks fill
    the heap beside the rows that tasks hold, in chunks of 1 MB that take two regions each of a heap under 4 GB, so that
    twice the storage Spark counts is gone."""
    return df.persist(StorageLevel.DISK_ONLY)


def with_place(df: DataFrame, part: str = PART, row: str = ROW) -> DataFrame:
    """Add the number of the task's partition and the row's place in it, as they come."""
    at = "__place"
    return (df.withColumn(at, F.monotonically_increasing_id())
              .withColumns({part: F.shiftright(at, _ROW_BITS).cast("int"), row: F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)})
              .drop(at))


def ranged(df: DataFrame, by: list[str | Column], keep: Callable[[DataFrame], DataFrame] | None = kept) -> DataFrame:
    """``df`` in ascending ranges of ``by`` with ``_part`` and ``_row``, kept by ``keep``
    (``None``: the caller keeps what it derives without moving rows). Null keys come first."""
    out = with_place(df.repartitionByRange(*by).sortWithinPartitions(*by))
    return keep(out) if keep else out


def same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality of columns (an equi-join key)."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def bases(rows: DataFrame, groups: list[str], count: Column | None = None, part: str = PART, row: str = ROW) -> DataFrame:
    """(part, groups..., _base): what to add to a row's place in its range for its position in the group.
    ``rows`` is one row per (range, group) after partial aggregation."""
    s = rows.groupBy(part, *groups).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_least"))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return s.select(part, *groups, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_least")).alias("_base"))


def positions(rows: DataFrame, groups: list[str], out: str, part: str = PART, row: str = ROW,
              small: bool = False) -> DataFrame:
    """``rows`` (of :func:`ranged`, ordered by groups first) with ``out``, the 0-based position in
    the group. ``small``: the caller knows the groups to be few (a catalog, shards), so that the
    bases, at most ranges + groups rows, are broadcast."""
    b = bases(rows, groups, part=part, row=row)
    b = b.select(*[F.col(c).alias(f"__{c}") for c in (part, *groups)], F.col("_base").alias("__base"))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (part, *groups)])
    got = rows.join(F.broadcast(b) if small else b, on)
    return got.select(*[F.col(c) for c in rows.columns], (F.col("__base") + F.col(row)).alias(out))

"""One segmented scan for everything that depends on the order of rows inside a group.

Rows are range-partitioned by group and order, sorted and written, so a group of any size lies in as many pieces as it
needs and a small one in one or two. A scan has four parts: a local window inside each (group, piece); a summary of the
groups at the edges of a piece; a scan of those summaries along the pieces of a group, which gives each piece what the
pieces before or behind it add (its carry); and the merge of local value and carry.

Only the first and the last group of a piece can go on in another one. So summaries and carries are at most two rows
per range, whatever the number of groups, and joining them back is a broadcast bounded by the number of ranges. The number of
ranges follows the input's size, and results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from evispark.session import cut_lineage

#: Stored bytes of the input for a range, and the most ranges: what is broadcast is two rows per range.
RANGE_BYTES, MOST_RANGES = 4 << 20, 100_000
#: A leaf of this size or more has no known size.
_UNKNOWN = 1 << 60

#: Columns of the rows in their ranges: the range, the place in it, and (in summaries) the last place in it.
PIECE, AT, LAST = "_piece", "_at", "_last"


def input_bytes(df: DataFrame) -> int | None:
    """Stored bytes of the tables a plan reads, from its statistics; None if one has no known size. Runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def range_count(df: DataFrame) -> int:
    """Ranges for an input: one per ``RANGE_BYTES``. Without a known size it is the shuffle setting."""
    size = input_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_RANGES, 1 + size // RANGE_BYTES)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows by key in ``tasks`` tasks, so that a task does not grow with the input; if the shuffle setting is higher, in so many."""
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > setting else df.repartition(*keys)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of key columns where null equals null; ``right`` has them with a ``_j_`` before the name."""
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_j_{k}"])
    return same


class Segments:
    """A table in ranges by group and order. ``order`` must settle every tie; rows that tie stay in one piece."""

    def __init__(self, df: DataFrame, part: Sequence[str], order: Sequence[str], ranges: int | None = None):
        self.part = list(part)
        keys = [*self.part, *[o for o in order if o not in self.part]]
        self.ranges = ranges or range_count(df)
        ranged = df.repartitionByRange(self.ranges, *keys).sortWithinPartitions(*keys)
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        self.rows = cut_lineage(ranged.withColumn(PIECE, F.spark_partition_id()).withColumn(AT, within))
        #: The rows of a group in a piece, in order.
        self.inside = Window.partitionBy(*self.part, PIECE).orderBy(AT)
        #: The pieces of a group, in order; for the summaries.
        self.along = Window.partitionBy(*self.part).orderBy(PIECE)

    def _keyed(self, df: DataFrame, *others: str | Column) -> DataFrame:
        return F.broadcast(df.select(*[F.col(k).alias(f"_j_{k}") for k in [*self.part, PIECE]], *others))

    def carries(self, summary: Mapping[str, Column], carry: Mapping[str, Column]) -> DataFrame:
        """Summaries of the groups at the edges of a piece, scanned: a row per such group and piece."""
        ends = self.rows.groupBy(PIECE).agg(F.max(AT).alias(LAST))
        ends = F.broadcast(ends.withColumnRenamed(PIECE, "_j_piece"))  # a row per range
        rows = self.rows.join(ends, F.col(PIECE) == F.col("_j_piece")).drop("_j_piece")
        if self.part:
            edge = rows.filter((F.col(AT) == 0) | (F.col(AT) == F.col(LAST))).select(*self.part, PIECE)
            edge = self._keyed(edge.distinct())
            rows = rows.join(edge, same_keys(rows, edge, [*self.part, PIECE]), "left_semi")
        tops = rows.groupBy(*self.part, PIECE).agg(*[c.alias(n) for n, c in summary.items()])
        return tops.select(*self.part, PIECE, *[c.alias(n) for n, c in carry.items()])

    def scan(
        self, local: Mapping[str, Callable[[WindowSpec], Column]], summary: Mapping[str, Column],
        carry: Mapping[str, Callable[[WindowSpec], Column]], merged: Mapping[str, Column], windows: bool = True,
    ) -> DataFrame:
        """The rows with the ``merged`` columns, which are made of ``local`` values and ``carry`` ones.

        Rows are dealt by group and piece for the windows of ``local``; without ``windows`` it has none and they stay where they are.

        ``local`` are windows over the rows of a group in a piece, ``summary`` aggregates of such rows, ``carry`` windows
        over the summaries of a group's pieces. A carry is null where no other piece adds anything.
        """
        names = [c for c in self.rows.columns if c not in (PIECE, AT)]
        rows = (dealt(self.rows, self.ranges, *self.part, PIECE) if windows else self.rows).select("*", *[make(self.inside).alias(n) for n, make in local.items()])
        found = self._keyed(self.carries(summary, {n: make(self.along) for n, make in carry.items()}), *carry)
        joined = rows.join(found, same_keys(rows, found, [*self.part, PIECE]), "left")
        return joined.select(*[F.col(f"`{n}`") for n in names if n not in merged], *[c.alias(n) for n, c in merged.items()])


def earlier(window: WindowSpec) -> WindowSpec:
    """All rows before the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window: WindowSpec) -> WindowSpec:
    """The current row and all before it."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

"""Order-dependent operators that hold when one group has a large part of all rows.

All of them are segmented scans (``scan.py``): their results depend neither on the size of a group nor on the number
of ranges, and nothing is measured before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evispark.functions.text import matches
from evispark.operators.scan import AT, LAST, Segments, earlier, upto


def positions(df: DataFrame, part: Sequence[str], order: Sequence[str], out: str = "_pos", ranges: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group; ``order`` must settle every tie."""
    segments = Segments(df, part, order, ranges)
    before = {"_earlier": lambda along: F.sum("_n").over(earlier(along))}
    if part:
        local = {"_row": lambda inside: F.row_number().over(inside).cast("long") - 1}
    else:  # a piece is one group, its rows are numbered already
        local = {"_row": lambda inside: F.col(AT)}
    return segments.scan(local, {"_n": F.count("*")}, before, {out: F.col("_row") + F.coalesce("_earlier", F.lit(0))}, windows=bool(part))


def neighbor_context(
    df: DataFrame,
    part: str,
    order: Sequence[str],
    label: Column,
    searched: Column,
    pattern: str,
    k: int = 2,
    ranges: int | None = None,
) -> DataFrame:
    """Labels of the ``k`` rows before and after, and whether one of them matches.

    Adds ``neighbor_labels`` (in order), ``has_context`` and ``neighbor_context``.
    """
    near = _neighbors(df, part, order, F.struct(label.alias("label"), matches(searched, pattern).alias("hit")), k, ranges)
    prefix = F.when(F.col("has_context"), "tail_context").otherwise("no_tail_context")
    return (
        near.withColumn("neighbor_labels", F.transform("_near", lambda x: x["label"]))
        .withColumn("has_context", F.exists("_near", lambda x: x["hit"]))
        .withColumn(
            "neighbor_context",
            F.concat(
                prefix,
                F.lit("|"),
                F.when(F.size("neighbor_labels") == 0, "no_neighbors").otherwise(F.array_join("neighbor_labels", ";")),
            ),
        )
        .drop("_near")
    )


def has_neighbor(df: DataFrame, part: str, order: Sequence[str], hit: str, k: int = 2, ranges: int | None = None) -> DataFrame:
    """Add ``has_context``: whether one of the ``k`` rows before and after is a ``hit``. Only that flag of a neighbour moves."""
    near = _neighbors(df, part, order, F.col(hit), k, ranges)
    return near.withColumn("has_context", F.exists("_near", lambda x: x)).drop("_near")


def _neighbors(df: DataFrame, part: str, order: Sequence[str], item: Column, k: int, ranges: int | None) -> DataFrame:
    """Add ``_near``: the items of the ``k`` rows before and after, in order."""
    base = df.withColumn("_item", item)
    none = F.array().cast(base.select(F.array("_item").alias("a")).schema["a"].dataType)

    def end(arr: Column) -> Column:
        return F.slice(arr, F.greatest(F.size(arr) - F.lit(k - 1), F.lit(1)), F.lit(k))

    return Segments(base, [part], order, ranges).scan(
        {
            "_before": lambda inside: F.collect_list("_item").over(inside.rowsBetween(-k, -1)),
            "_after": lambda inside: F.collect_list("_item").over(inside.rowsBetween(1, k)),
        },
        # What a group shows its other pieces: up to k rows at the start and at the end of this one.
        {"_head": _in_order(F.col(AT) < k), "_tail": _in_order(F.col(AT) > F.col(LAST) - k)},
        {
            "_left": lambda along: end(F.flatten(F.collect_list("_tail").over(along.rowsBetween(-k, -1)))),
            "_right": lambda along: F.slice(F.flatten(F.collect_list("_head").over(along.rowsBetween(1, k))), 1, k),
        },
        {
            "_near": F.concat(
                end(F.concat(F.coalesce("_left", none), "_before")), F.slice(F.concat("_after", F.coalesce("_right", none)), 1, k)
            )
        },
    ).drop("_item")


def _in_order(chosen: Column) -> Column:
    """The items of the chosen rows, in order."""
    placed = F.struct(F.col(AT).alias("at"), F.col("_item").alias("item"))
    return F.transform(F.array_sort(F.collect_list(F.when(chosen, placed))), lambda x: x["item"])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Every task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank, limited in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def with_first(df: DataFrame, keys: Sequence[str], order: str, out: str = "_first_order") -> DataFrame:
    """Add the smallest order value among rows with the same key, null for keys seen once."""
    repeated = (
        df.groupBy(*keys).agg(F.min(order).alias(out), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    safe = repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], out)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(safe[f"_k{i}"])
    return df.join(safe, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """First row per key in the given order, and the repeated rows with the order of the one kept."""
    repeats = with_first(df, keys, order, "kept_order").filter(F.col(order) > F.col("kept_order"))
    return first_per_key(df, keys, [order]), repeats


def disambiguate(df: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key get ``|duplicate_<order>`` appended to it."""
    again = F.col(order) > F.col("_first_order")
    renamed = F.concat(F.col(key), F.lit("|duplicate_"), F.col(order).cast("string"))
    return (
        with_first(df, [key], order)
        .withColumn("is_duplicate", F.coalesce(again, F.lit(False)))
        .withColumn(key, F.when(F.col("is_duplicate"), renamed).otherwise(F.col(key)))
        .drop("_first_order")
    )


def first_occurrence(df: DataFrame, keys: Sequence[str], order: str, out: str = "first_row") -> DataFrame:
    """Order of the first row with the same key, on the rows that repeat it."""
    marked = with_first(df, keys, order, out)
    return marked.withColumn(out, F.when(F.col(order) > F.col(out), F.col(out)))


def previous_value(
    df: DataFrame, key: str, order: str, value: str, out: str, ranges: int | None = None
) -> DataFrame:
    """The value of the previous row with the same key; null keys have no previous row."""
    held = F.struct(F.col(value).alias("v"))
    return Segments(df, [key], [order], ranges).scan(
        {"_here": lambda inside: F.lag(held).over(inside)},
        {"_last": F.max_by(held, AT)},
        {"_there": lambda along: F.lag("_last").over(along)},
        {out: F.when(F.col(key).isNotNull(), F.coalesce("_here", "_there")["v"])},
    )


def group_counter(
    df: DataFrame, part: Sequence[str], order: Sequence[str], out: str = "counter", ranges: int | None = None
) -> DataFrame:
    """1-based running number inside each group."""
    return positions(df, part, order, out, ranges).withColumn(out, (F.col(out) + 1).cast("int"))


def ordinal_id(df: DataFrame, order: Sequence[str], prefix: str, width: int = 5, out: str = "id") -> DataFrame:
    """Dense numbered ids over the whole table in the given order, without a one-task window."""
    return positions(df, [], order, "_pos").withColumn(
        out, F.format_string(f"{prefix}%0{width}d", F.col("_pos") + 1)
    ).drop("_pos")


def priority_rank(df: DataFrame, order: Sequence[str], descending: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ranks 1..n by several keys; numeric keys named in ``descending`` sort high to low."""
    keyed = df
    names = []
    for i, c in enumerate(order):
        keyed = keyed.withColumn(f"_o{i}", -F.col(c) if c in descending else F.col(c))
        names.append(f"_o{i}")
    return positions(keyed, [], names, out).withColumn(out, F.col(out) + 1).drop(*names)


def rank_cutoff(df: DataFrame, rank: str, max_rank: int, worst: int = 999) -> DataFrame:
    """Rows up to a rank; an unreadable rank counts as the worst."""
    value = F.coalesce(F.col(rank).cast("string").try_cast("bigint"), F.lit(worst))
    return df.withColumn(rank, value).filter(F.col(rank) <= max_rank)


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def cap(arr: Column | str, k: int) -> Column:
    return F.slice(F.array_sort(arr), 1, k)


def ordered(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Sort for a sink."""
    return df.orderBy(*keys)


def running_last(
    df: DataFrame, part: Sequence[str], order: str, columns: Sequence[str], prefix: str = "running_", ranges: int | None = None
) -> DataFrame:
    """The last non-null value of each column up to and including the current row of its group."""

    def local(c: str):
        return lambda inside: F.last(c, ignorenulls=True).over(upto(inside))

    def carried(c: str):
        return lambda along: F.last(f"_e_{c}", ignorenulls=True).over(earlier(along))

    return Segments(df, part, [order], ranges).scan(
        {f"_l_{c}": local(c) for c in columns},
        {f"_e_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(AT))) for c in columns},
        {f"_c_{c}": carried(c) for c in columns},
        {prefix + c: F.coalesce(f"_l_{c}", f"_c_{c}") for c in columns},
    )

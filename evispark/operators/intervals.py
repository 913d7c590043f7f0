"""Closed integer intervals: union length and aligned-pair summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evispark.operators.scan import Segments, earlier


def merged_length(
    df: DataFrame, keys: Sequence[str], start: str, end: str, out: str = "merged_length", ranges: int | None = None
) -> DataFrame:
    """Positions covered by the union of a key's intervals; ends may come in either order.

    Only the longest interval per start matters, so rows are reduced to that before the
    shuffle. Each interval then adds what lies beyond everything seen before it.
    """
    lo, hi = F.least(start, end).cast("bigint"), F.greatest(start, end).cast("bigint")
    longest = (
        df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
        .select(*keys, lo.alias("_lo"), hi.alias("_hi"))
        .groupBy(*keys, "_lo")
        .agg(F.max("_hi").alias("_hi"))
    )
    placed = Segments(longest, keys, ["_lo"], ranges).scan(
        {"_local": lambda inside: F.max("_hi").over(earlier(inside))},
        {"_top": F.max("_hi")},
        {"_carry": lambda along: F.max("_top").over(earlier(along))},
        {"_seen": F.greatest("_local", "_carry")},  # skips nulls, so either side may be absent
    )
    floor_ = F.greatest(F.col("_lo") - 1, F.col("_seen"))
    added = F.greatest(F.col("_hi") - floor_, F.lit(0))
    return placed.groupBy(*keys).agg(F.sum(added).alias(out))


def canonical_pairs(hits: DataFrame, left: str, right: str) -> DataFrame:
    """Unordered pairs that share at least one hit, each once, without self pairs.

    Pairs come from the hit table, never from all combinations of ids.
    """
    return (
        hits.filter(F.col(left) != F.col(right))
        .select(F.least(left, right).alias("id_1"), F.greatest(left, right).alias("id_2"))
        .distinct()
    )


def summarise_hsps(hsps: DataFrame, lengths: DataFrame, min_len: int = 100, ranges: int | None = None) -> DataFrame:
    """Identity and coverage per pair from aligned segments.

    ``hsps``: ``query_id, subject_id, pident, length, qstart, qend, sstart, send``;
    ``lengths``: ``id, length``. Identity is weighted by length, coverage is the smaller
    of the two covered fractions; a pair without a long enough segment has zeros.
    """
    pair = ["query_id", "subject_id"]
    long_enough = F.col("length") >= min_len
    totals = hsps.groupBy(*pair).agg(
        F.coalesce(F.sum(F.when(long_enough, F.col("pident") * F.col("length"))), F.lit(0.0)).alias("_weighted"),
        F.coalesce(F.sum(F.when(long_enough, F.col("length"))), F.lit(0)).cast("bigint").alias("aligned_bp"),
    )
    sides = hsps.filter(long_enough).select(
        *pair,
        F.explode(
            F.array(
                F.struct(F.lit("q").alias("side"), F.col("qstart").alias("s"), F.col("qend").alias("e")),
                F.struct(F.lit("s").alias("side"), F.col("sstart").alias("s"), F.col("send").alias("e")),
            )
        ).alias("x"),
    ).select(*pair, "x.side", "x.s", "x.e")
    covered = merged_length(sides, [*pair, "side"], "s", "e", ranges=ranges).groupBy(*pair).agg(
        F.max(F.when(F.col("side") == "q", F.col("merged_length"))).alias("_q"),
        F.max(F.when(F.col("side") == "s", F.col("merged_length"))).alias("_s"),
    )
    q_len = lengths.select(F.col("id").alias("query_id"), F.col("length").alias("_ql"))
    s_len = lengths.select(F.col("id").alias("subject_id"), F.col("length").alias("_sl"))

    def share(part: str, whole: str) -> F.Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(0.0))

    aligned = F.col("aligned_bp") > 0
    return (
        totals.join(covered, pair, "left")
        .join(q_len, "query_id", "left")
        .join(s_len, "subject_id", "left")
        .select(
            *pair,
            F.when(aligned, F.col("_weighted") / F.col("aligned_bp")).otherwise(F.lit(0.0)).alias("identity_percent"),
            F.when(aligned, F.least(share("_q", "_ql"), share("_s", "_sl"))).otherwise(F.lit(0.0)).alias("coverage_percent"),
            "aligned_bp",
        )
    )

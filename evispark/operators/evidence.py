"""Evidence as bits: one mask per entity, and metrics as tests of masks.

Every table says of its ids which bits they get. The tables are stacked and merged by ``bit_or``, which adds up before
the shuffle. Pairs then take the masks of their two ends in two joins, whatever the number of metrics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions.missing import present
from evispark.functions.numbers import evidence_state, fraction


@dataclass(frozen=True)
class Evidence:
    """Bits by name; a name's bit is its place in the list."""

    names: tuple[str, ...]

    def bit(self, name: str) -> int:
        return 1 << self.names.index(name)

    def has(self, mask: Column, name: str) -> Column:
        return F.coalesce(mask.bitwiseAND(F.lit(self.bit(name))) != 0, F.lit(False))

    def masks(self, sources: Sequence[tuple[DataFrame, str, Mapping[str, Column | bool]]]) -> DataFrame:
        """``id`` and ``mask`` from (table, id column, bits with the condition of each); missing ids are left out."""
        stacked = None
        for df, column, bits in sources:
            mask = F.lit(0).cast("bigint")
            for name, when in bits.items():
                holds = F.coalesce(when, F.lit(False)) if isinstance(when, Column) else F.lit(when)
                mask = mask.bitwiseOR(F.when(holds, F.lit(self.bit(name)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            ids = df.filter(present(F.col(column).cast("string"))).select(F.col(column).cast("string").alias("id"), mask.alias("mask"))
            stacked = ids if stacked is None else stacked.unionByName(ids)
        return stacked.groupBy("id").agg(F.bit_or("mask").alias("mask"))


@dataclass(frozen=True)
class Metric:
    """A metric of one side (``left``, ``right``) or of both: whether a row has the evidence, and whether it was looked for."""

    name: str
    side: str
    detected: Column
    assessed: Column


def mask_coverage(pairs: DataFrame, left: str, right: str, masks: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Coverage of each metric over the unique entities of its side and over all pairs.

    Metric columns are tests of ``left_mask`` and ``right_mask``, or of other columns of ``pairs``; those of side ``both`` are
    counted over pairs alone. Returns ``metric, entity_level, numerator, assessed, denominator, coverage_fraction,
    evidence_state``. Entities without an id are in no unique count.
    """
    sides = {"left": left, "right": right}
    tagged = pairs
    for side, column in sides.items():
        known = masks.select(F.col("id").alias(f"_{side}"), F.col("mask").alias(f"{side}_mask"))
        tagged = tagged.join(known, F.col(column).cast("string") == F.col(f"_{side}"), "left").drop(f"_{side}")
    tagged = tagged.fillna(0, ["left_mask", "right_mask"])

    def rows(df: DataFrame, level: str, chosen: Sequence[Metric]) -> DataFrame:
        counts = [F.struct(F.lit(m.name).alias("metric"), F.count_if(m.detected).alias("numerator"), F.count_if(m.assessed).alias("assessed")) for m in chosen]
        one = df.agg(F.count("*").alias("denominator"), F.array(*counts).alias("all"))
        return one.select(F.explode("all").alias("x"), "denominator").select("x.metric", F.lit(level).alias("entity_level"), "x.numerator", "x.assessed", "denominator")

    out = rows(tagged, "pair", metrics)
    for side, column in sides.items():
        chosen = [m for m in metrics if m.side == side]
        entities = tagged.filter(present(F.col(column).cast("string"))).groupBy(column).agg(F.max(f"{side}_mask").alias(f"{side}_mask"))
        out = out.unionByName(rows(entities, f"unique_{side}", chosen)) if chosen else out
    return out.withColumn("coverage_fraction", fraction("numerator", "denominator")).withColumn(
        "evidence_state", evidence_state("numerator", "assessed", "denominator")
    )

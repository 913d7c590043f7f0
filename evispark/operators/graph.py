"""Similarity edges, connected components and representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import MISSING, is_missing, present
from evispark.functions.numbers import to_double, to_int_or
from evispark.operators.validation import once
from evispark.operators.windows import first_per_key
from evispark.session import Scratch


def score_edges(
    edges: DataFrame,
    nodes: DataFrame,
    min_identity: float = R.SPECIES_IDENTITY_PERCENT,
    min_coverage: float = R.SPECIES_COVERAGE_PERCENT,
    left: str = "genome_id_1",
    right: str = "genome_id_2",
) -> DataFrame:
    """Mark edges that pass both thresholds and whose two ends are eligible.

    ``nodes`` holds the eligible ids in its first column. No edge is dropped; notes say why one is left out.
    """
    ids = nodes.select(F.col(nodes.columns[0]).alias("_id")).distinct()
    a = ids.select(F.col("_id").alias("_a"))
    b = ids.select(F.col("_id").alias("_b"))
    kinds = dict(edges.dtypes)

    def number(name: str) -> Column:
        value = F.col(name) if kinds[name] in ("double", "int", "bigint") else to_double(F.col(name).cast("string"))
        return F.nanvl(value.cast("double"), F.lit(None))

    numbers = {f"_{c}": number(c) for c in ("identity_percent", "coverage_percent")}
    parsed = once(edges, numbers)
    df = parsed.join(a, parsed[left] == a["_a"], "left").join(b, parsed[right] == b["_b"], "left")
    identity, coverage = F.col("_identity_percent"), F.col("_coverage_percent")
    passes = F.coalesce((identity >= min_identity) & (coverage >= min_coverage), F.lit(False))
    notes = F.array_compact(
        F.array(
            F.when(identity.isNull(), F.lit("invalid identity_percent")),
            F.when(coverage.isNull(), F.lit("invalid coverage_percent")),
            F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit("one or both ids are not eligible")),
        )
    )
    return (
        df.withColumn("passes_threshold", passes)
        .withColumn("included_in_clustering", passes & (F.size(notes) == 0))
        .withColumn("notes", F.when(F.size(notes) == 0, "OK").otherwise(F.array_join(notes, "; ")))
        .drop("_a", "_b", *numbers)
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest id around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    return (
        both.join(least, "u")
        .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _counted(rounds: Scratch, e: DataFrame) -> tuple[DataFrame, dict]:
    """Write a round's edges; their count and an order-free digest are taken on the way."""
    seen = Observation()
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    return rounds.table(e.observe(seen, F.count(F.lit(1)).alias("n"), digest)), seen.get


def connected_components(
    nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst", max_rounds: int = 100
) -> DataFrame:
    """Label every node with the smallest id it is connected to; nodes without edges keep their own.

    Large-star and small-star steps alternate until nothing changes. Each round is
    written to the shared checkpoint folder, so lost executors cost one round at most.
    Both steps reduce to one minimum per node before they join it back. A round's table is removed when the next
    one is written; the last one stays for the result. ``max_rounds`` is a guard that fails loudly: the rounds
    needed grow with the logarithm of the number of nodes.
    """
    rounds = Scratch(nodes.sparkSession)
    ordered = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e, state = _counted(rounds, ordered.filter(F.col("u") != F.col("v")).distinct())
    for _ in range(max_rounds if state["n"] else 0):
        e, after = _counted(rounds, _small_star(_large_star(e)))
        rounds.clear(keep=1)
        if after == state:
            break
        state = after
    else:
        if state["n"]:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("_u"), F.col("v").alias("_root"))
    return (
        nodes.join(stars, nodes[node] == stars["_u"], "left")
        .withColumn("component", F.coalesce("_root", node))
        .drop("_u", "_root")
    )


def representatives(members: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """One member per group by the preferences given; nothing else of the group is moved."""
    return first_per_key(members, [group], order)


def genome_preferences(node: str = "genome_id") -> list[Column]:
    """Checked sequence, local file, accession, source, length, then id."""
    return [
        F.when(F.coalesce(F.col("passes_sequence_qc").cast("string"), F.lit("")) == "true", 0).otherwise(1),
        F.when(F.coalesce(F.col("raw_sequence_exists").cast("string"), F.lit("")) == "true", 0).otherwise(1),
        F.when(is_missing("accession", MISSING), 1).otherwise(0),
        F.when(is_missing("source", MISSING), 1).otherwise(0),
        -to_int_or("genome_length", 0),
        F.col(node),
    ]


def genome_reason() -> Column:
    """Why a representative was chosen, as text."""
    parts = F.array_compact(
        F.array(
            F.when(F.col("passes_sequence_qc").cast("string") == "true", F.lit("local sequence QC passed")),
            F.when(F.col("raw_sequence_exists").cast("string") == "true", F.lit("local sequence exists")),
            F.when(present("accession", MISSING), F.lit("has accession")),
            F.when(present("source", MISSING), F.lit("has source metadata")),
            F.when(
                present(F.col("genome_length").cast("string"), MISSING),
                F.lit("longest or tied-longest genome after metadata priorities"),
            ),
        )
    )
    return F.when(F.size(parts) == 0, "lexicographic fallback").otherwise(F.array_join(parts, "; "))

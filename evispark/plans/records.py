"""Record tables: manifest, sequence checks, dereplication, sequence acquisition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import MISSING, is_missing, present, text
from evispark.functions.text import accession_kind, accession_list, sanitize_id
from evispark.operators.aggregates import packed_lists
from evispark.operators.gates import eligible
from evispark.operators.graph import connected_components, genome_preferences, genome_reason, representatives, score_edges
from evispark.operators.validation import (
    Rule, between, composition_by, one_of, positive_int, required, sequence_qc, split_status, unique, validate_rows, with_copies,
)
from evispark.operators.windows import ordinal_id
from evispark.session import cut_lineage


def with_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``_path``: the sequence path of a row if ``files`` lists it, else null.

    Rows without a path name no file. They are dealt out by their content, under keys that no path has, because one key for all
    of them would be one task.
    """
    known = files.select(F.col("path").alias("_path")).distinct()
    blank = F.coalesce(F.col("raw_sequence_path"), F.lit("")) == ""
    dealt = F.concat(F.lit("\0"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    keyed = df.withColumn("_at", F.when(blank, dealt).otherwise(F.col("raw_sequence_path")))
    return keyed.join(known, F.col("_at") == F.col("_path"), "left").drop("_at")


def build_manifest(samples: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated manifest, issues and excluded rows.

    ``files`` lists the sequence paths that exist in a ``path`` column.
    """
    df = samples
    for c in R.MANIFEST_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    if files is None:
        df = df.withColumn("raw_sequence_exists", F.lit(False))
    else:
        df = with_files(df, files).withColumn("raw_sequence_exists", F.col("_path").isNotNull()).drop("_path")
    df = df.withColumn("has_raw_sequence", present("raw_sequence_path", MISSING))
    rules = [
        required("genome_id"),
        unique("genome_id"),
        one_of("record_type", R.RECORD_TYPES),
        one_of("phage_lifestyle", R.LIFESTYLES, "warning", "phage_lifestyle should be virulent, temperate, ambiguous, or NA"),
        positive_int("genome_length"),
        between("gc_percent", 0, 100),
        Rule(
            "warning",
            "raw_sequence_path",
            "raw_sequence_path is provided but does not exist",
            F.col("has_raw_sequence") & ~F.col("raw_sequence_exists"),
        ),
    ]
    manifest, issues = validate_rows(with_copies(df, ["genome_id"]), rules, ["genome_id", "record_type"])
    return manifest, issues, split_status(manifest)[1]


def run_sequence_qc(seqs: DataFrame, manifest: DataFrame, limits: Mapping[str, float] = R.QC_LIMITS,
                    invalid: DataFrame | None = None) -> DataFrame:
    """QC rows for a manifest and its sequences (``genome_id, sequence``)."""
    return sequence_qc(manifest, composition_by(seqs, "genome_id", "sequence"), limits, invalid=invalid)


def dereplicate(
    manifest: DataFrame,
    qc: DataFrame | None,
    edges: DataFrame,
    min_identity: float = R.SPECIES_IDENTITY_PERCENT,
    min_coverage: float = R.SPECIES_COVERAGE_PERCENT,
    prefix: str = "kp_phage_species_",
) -> dict[str, DataFrame]:
    """Edges with verdicts, cluster membership and one representative per cluster."""
    nodes = cut_lineage(eligible(manifest, qc, R.PHAGE_LIKE))
    scored = score_edges(edges, nodes.select("genome_id"), min_identity, min_coverage)
    passing = scored.filter("included_in_clustering").select(
        F.col("genome_id_1").alias("src"), F.col("genome_id_2").alias("dst")
    )
    labelled = cut_lineage(connected_components(nodes, passing, "genome_id"))
    clusters = labelled.groupBy("component").agg(F.count("*").alias("cluster_size"))
    numbered = ordinal_id(clusters, ["component"], prefix, 5, "cluster_id")
    chosen = representatives(labelled, "component", genome_preferences()).select(
        "component", F.col("genome_id").alias("representative_id"), genome_reason().alias("representative_reason"),
        F.col("sequence_qc_status").alias("representative_sequence_qc_status"),
    )
    table = numbered.join(chosen, "component")
    any_edges = F.lit(not edges.isEmpty())
    basis = (
        F.when(F.col("cluster_size") > 1, "pairwise_similarity_threshold")
        .when(any_edges, "singleton_no_threshold_pairwise_link")
        .otherwise("singleton_no_pairwise_similarity")
    )
    members = labelled.select("genome_id", "record_type", "sequence_qc_status", "passes_sequence_qc", "component").join(
        table.select("component", "cluster_id", "representative_id", "cluster_size"), "component"
    ).withColumn("clustering_basis", basis).drop("component")
    return {
        "edges": scored,
        "clusters": members,
        "representatives": table.drop("component"),
    }


def cluster_member_lists(clusters: DataFrame) -> DataFrame:
    """Members of each cluster, in order and in pieces."""
    return packed_lists(clusters, ["cluster_id"], "genome_id")


def plan_sequences(manifest: DataFrame, files: DataFrame, raw_dir: str = "data/raw") -> DataFrame:
    """How each record gets its sequence: local, fetchable, by hand, or excluded."""
    df = with_files(manifest, files)
    exists = F.col("_path").isNotNull()
    first = F.get(accession_list("accession"), 0)
    has_path = present("raw_sequence_path")
    status = (
        F.when(F.col("validation_status") == "exclude", "excluded_manifest_record")
        .when(exists, "local_sequence_available")
        .when(has_path & first.isNotNull(), "configured_path_missing_fetchable")
        .when(has_path, "configured_path_missing_no_accession")
        .when(first.isNotNull(), "accession_ready_for_fetch")
        .otherwise("metadata_only_no_accession")
    )
    method = F.when(
        F.col("acquisition_status").isin("configured_path_missing_fetchable", "accession_ready_for_fetch"),
        F.when(accession_kind(first) == "assembly", "ncbi_datasets_genome")
        .when(accession_kind(first) == "reads", "sra_prefetch_fasterq")
        .when(accession_kind(first) == "biosample", "metadata_link_required")
        .otherwise("ncbi_edirect_nuccore"),
    )
    method = (
        F.when(F.col("acquisition_status").isin("excluded_manifest_record", "local_sequence_available"), "none")
        .when(F.col("acquisition_status") == "configured_path_missing_no_accession", "manual_sequence_file")
        .when(F.col("acquisition_status") == "metadata_only_no_accession", "manual_accession_or_sequence_required")
        .otherwise(method)
    )
    name = sanitize_id(F.when(is_missing("genome_id"), first).otherwise(text("genome_id")))
    name = F.when(name == "", "genome").otherwise(name)
    return (
        df.withColumn("raw_sequence_exists", exists)
        .withColumn("acquisition_status", status)
        .withColumn("acquisition_needed", ~F.col("acquisition_status").isin("excluded_manifest_record", "local_sequence_available"))
        .withColumn("retrieval_method", method)
        .withColumn(
            "expected_sequence_path", F.when(first.isNotNull(), F.concat(F.lit(raw_dir + "/"), name, F.lit(".fna"))).otherwise("")
        )
        .withColumn(
            "command_class",
            F.when(F.col("acquisition_status") == "local_sequence_available", "already_local")
            .when(F.col("acquisition_status") == "excluded_manifest_record", "excluded")
            .when(F.col("acquisition_status").isin("configured_path_missing_fetchable", "accession_ready_for_fetch"), "fetch_command")
            .otherwise("manual_curation"),
        )
        .drop("_path")
    )

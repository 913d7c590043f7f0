"""Feature tables, model comparison, coverage and summaries; figure tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import present, safe_value, text
from evispark.functions.numbers import count_bin, size_bin
from evispark.functions.text import split_values
from evispark.operators.aggregates import (
    assay_breadth, assessed_features, breadth_summary, coverage_gate, features_by_entity, freq, group_rate,
)
from evispark.operators.joins import last_rows, lookup_left
from evispark.operators.models import ablation, compare_feature_sets, sample_predictions, summarise_tests
from evispark.operators.windows import top_k
from evispark.session import cut_lineage


def source_group(source: Column | str) -> Column:
    value = safe_value(source)
    return F.when(value == "NA", "unknown_source").otherwise(F.translate(F.lower(value), " ", "_"))


def novelty_status(tiers: Column | str, count: Column | str) -> Column:
    """Status from the novelty tiers of an entity; null tiers mean it was not assessed."""
    tiers = F.col(tiers) if isinstance(tiers, str) else tiers
    items = split_values(tiers)
    return (
        F.when(tiers.isNull(), "not_assessed")
        .when(F.arrays_overlap(items, F.array(F.lit("tier_1"), F.lit("tier_2"))), "tier_1_or_2_rbp_candidate")
        .when(F.array_contains(items, "tier_3"), "known_family_rbp_candidate")
        .when(count > 0 if isinstance(count, Column) else F.col(count) > 0, "candidate_without_novelty_evidence")
        .otherwise("assessed_zero_detected")
    )


def three_state(count: Column, assessed: Column) -> Column:
    return (
        F.when(count > 0, "assessed_positive").when(F.coalesce(assessed, F.lit(False)), "assessed_zero_detected").otherwise("not_assessed")
    )


def build_samples(links: DataFrame, manifest: DataFrame, clusters: DataFrame, candidates: DataFrame, compat: DataFrame) -> DataFrame:
    """One feature row per phage-host link."""
    rbp = features_by_entity(
        candidates,
        "genome_id",
        {"rbp_module_clusters": "module_cluster_id", "rbp_enzyme_classes": "predicted_enzyme_class", "rbp_novelty_tiers": "novelty_tier"},
        F.col("is_high_confidence"),
        "rbp_candidate_count",
    ).drop("evidence_state").withColumnRenamed("genome_id", "phage_genome_id")
    about = last_rows(manifest, "genome_id", ["source", "phage_lifestyle"]).select(
        F.col("genome_id").alias("phage_genome_id"), "source", source_group("source").alias("source_group"), "phage_lifestyle"
    )
    sizes = last_rows(clusters, "genome_id", ["cluster_size"]).withColumnRenamed("genome_id", "phage_genome_id")
    pair = ["phage_genome_id", "host_genome_id"]
    facts = last_rows(compat, pair, [
        "host_defense_types", "host_defense_system_count", "phage_antidefense_targets", "phage_antidefense_count",
        "matched_counterdefense_count", "defense_metadata_available", "counterdefense_metadata_available", "compatibility_feature_status",
    ])
    df = lookup_left(lookup_left(lookup_left(lookup_left(links, about, "phage_genome_id"), sizes, "phage_genome_id"), rbp, "phage_genome_id"), facts, pair)

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    def binned(count: str, state: str) -> Column:
        return F.when(F.col(state) == "not_assessed", "not_assessed").otherwise(count_bin(n(count)))

    both = (F.col("host_defense_evidence_state") != "not_assessed") & (F.col("phage_antidefense_evidence_state") != "not_assessed")
    return (
        df.withColumn("sample_id", F.concat_ws("|", "phage_genome_id", "host_genome_id"))
        .withColumn("source_group", F.coalesce("source_group", F.lit("unknown_source")))
        .withColumn("species_cluster_size_bin", size_bin("cluster_size"))
        .withColumn("host_defense_evidence_state", three_state(n("host_defense_system_count"), F.col("defense_metadata_available")))
        .withColumn("phage_antidefense_evidence_state", three_state(n("phage_antidefense_count"), F.col("counterdefense_metadata_available")))
        .withColumn("matched_counterdefense_evidence_state", three_state(n("matched_counterdefense_count"), both))
        .withColumn("host_defense_system_count_bin", binned("host_defense_system_count", "host_defense_evidence_state"))
        .withColumn("phage_antidefense_count_bin", binned("phage_antidefense_count", "phage_antidefense_evidence_state"))
        .withColumn("matched_counterdefense_count_bin", binned("matched_counterdefense_count", "matched_counterdefense_evidence_state"))
        .withColumn("novel_rbp_status", novelty_status("rbp_novelty_tiers", n("rbp_candidate_count")))
        .withColumn("rbp_candidate_count_bin", F.coalesce("rbp_candidate_count_bin", F.lit("not_assessed")))
        .withColumn("rbp_module_clusters", F.coalesce("rbp_module_clusters", F.lit("")))
        .withColumn("rbp_enzyme_classes", F.coalesce("rbp_enzyme_classes", F.lit("")))
    )


def breadth_samples(assays: DataFrame, candidates: DataFrame, compat: DataFrame) -> DataFrame:
    """Assay breadth per phage panel with the features its association would be tested on."""
    spot = assays.filter((F.col("tested") == "true") & (F.col("assay_type") == "spot") & present("phage_id"))
    breadth = assay_breadth(spot, ["phage_id", "study_id", "panel_id", "assay_type"])
    rbp = features_by_entity(candidates, "genome_id", {}, None, "rbp_candidate_count").select(
        F.col("genome_id").alias("phage_id"), "rbp_candidate_count_bin"
    )
    anti = assessed_features(compat, "phage_genome_id", "phage_antidefense_count", "counterdefense_metadata_available").select(
        F.col("phage_genome_id").alias("phage_id"), F.col("count_bin").alias("phage_antidefense_count_bin")
    )
    df = lookup_left(lookup_left(breadth, rbp, "phage_id"), anti, "phage_id")
    for c in ("rbp_candidate_count_bin", "phage_antidefense_count_bin"):
        df = df.withColumn(c, F.coalesce(c, F.lit("not_assessed")))
    return df


def compare_models(samples: DataFrame, breadth: DataFrame, minima: Mapping[str, int] = R.H3_MINIMA) -> dict[str, DataFrame]:
    """All tests with their status rows, per-group rates, feature contributions, predictions and the summary."""
    # Every test reads these two tables, each a few columns of it.
    samples, breadth = cut_lineage(samples), cut_lineage(breadth)
    targets = ["K_type", "O_type"]
    grid = compare_feature_sets(samples, targets, R.K_O_FEATURE_SETS)
    columns = ["goal", "analysis_id", "target", "feature_set", "n_samples", "accuracy", "status"]
    models = grid.select(
        F.lit("H1").alias("goal"), F.concat_ws("_", "target", "feature_set").alias("analysis_id"), "target", "feature_set", "n_samples", "accuracy", "status"
    )
    spark = samples.sparkSession
    blocked = samples.agg(F.count("*").alias("n_samples")).select(
        F.lit("H4").alias("goal"),
        F.lit("productive_infection_receptor_defense_blocker").alias("analysis_id"),
        F.lit("productive_infection_result").alias("target"),
        F.lit("receptor_plus_defense_counterdefense").alias("feature_set"),
        "n_samples",
        F.lit(None).cast("double").alias("accuracy"),
        F.lit("blocked_no_productive_infection_labels").alias("status"),
    )
    models = models.unionByName(blocked)
    rates = spark.createDataFrame([], "goal string, analysis_id string, group_value string, total bigint, top_label string, top_fraction double")
    for goal, name, group, outcome in (
        ("H2", "record_type_vs_rbp_modules", "record_type", "rbp_module_clusters"),
        ("H5", "st_vs_defense_status", "ST", "host_defense_system_count_bin"),
        ("H6", "source_vs_rbp_novelty", "source_group", "novel_rbp_status"),
        ("H6", "cluster_size_vs_rbp_novelty", "species_cluster_size_bin", "novel_rbp_status"),
    ):
        groups, overall = group_rate(samples, group, outcome)
        rates = rates.unionByName(
            groups.select(F.lit(goal).alias("goal"), F.lit(name).alias("analysis_id"), "group_value", "total", "top_label", "top_fraction")
        )
        models = models.unionByName(
            overall.select(
                F.lit(goal).alias("goal"), F.lit(name).alias("analysis_id"), F.lit(outcome).alias("target"), F.lit(group).alias("feature_set"),
                "n_samples", F.lit(None).cast("double").alias("accuracy"), "status",
            )
        )
    described = breadth_summary(breadth).select(
        F.lit("H3").alias("goal"), F.lit("spot_breadth_descriptive").alias("analysis_id"), F.lit("spot_positive_fraction").alias("target"),
        F.lit("assay_panel").alias("feature_set"), "n_samples", F.lit(None).cast("double").alias("accuracy"), "status",
    )
    models = models.unionByName(described)
    for name, feature in (
        ("spot_breadth_vs_rbp_candidates", "rbp_candidate_count_bin"),
        ("spot_breadth_vs_counterdefense_candidates", "phage_antidefense_count_bin"),
    ):
        gate, _ = coverage_gate(breadth, feature, "positive_fraction", **minima)
        models = models.unionByName(
            gate.select(
                F.lit("H3").alias("goal"), F.lit(name).alias("analysis_id"), F.lit("spot_positive_fraction").alias("target"),
                F.lit(feature).alias("feature_set"), "n_samples", F.lit(None).cast("double").alias("accuracy"), "status",
            )
        )
    spec = spark.createDataFrame(
        [
            ("H1", "model", "rbp_depolymerase_modules", "taxonomy_only"),
            ("H2", "rate", None, None),
            ("H3", "rate", None, None),
            ("H4", "model", "receptor_plus_defense_counterdefense", "receptor_only"),
            ("H5", "rate", None, None),
            ("H6", "rate", None, None),
        ],
        "goal string, kind string, primary_set string, comparison_set string",
    )
    return {
        "models": models.select(*columns),
        "comparison": grid,
        "rates": rates,
        "importance": ablation(samples, "K_type", R.K_O_FEATURE_SETS),
        "predictions": sample_predictions(samples, "K_type", R.K_O_FEATURE_SETS, ["sample_id"]),
        "summary": summarise_tests(models, rates, spec),
    }


def figure_sources(
    manifest: DataFrame, clusters: DataFrame, gene_clusters: DataFrame, modules: DataFrame, candidates: DataFrame, links: DataFrame,
    compat: DataFrame, importance: DataFrame, novel: DataFrame,
) -> dict[str, DataFrame]:
    """Source tables of the six figures."""
    clustered = freq(clusters, "record_type").withColumnRenamed("count", "clustered_count")
    atlas = (
        freq(manifest, "record_type")
        .join(clustered, "category", "left")
        .select(F.lit("record_type_counts").alias("panel"), "category", "count", F.coalesce("clustered_count", F.lit(0)).alias("clustered_count"))
        .unionByName(
            freq(manifest, "phage_lifestyle").select(
                F.lit("lifestyle_counts").alias("panel"), "category", "count", F.lit(None).cast("bigint").alias("clustered_count")
            )
        )
    )
    pangenome = freq(gene_clusters, "module_hint").select(F.lit("module_hint_counts").alias("panel"), "category", "count").unionByName(
        freq(gene_clusters, "genome_count").select(F.lit("gene_cluster_genome_count_distribution").alias("panel"), "category", "count")
    )
    network = modules.select(
        "module_cluster_id", "representative_product", "candidate_count", "genome_count", "predicted_enzyme_classes", "novelty_tiers", "max_confidence_score"
    )
    return {
        "figure_1": atlas,
        "figure_2": pangenome,
        "figure_3": network,
        "figure_4": module_links(links, candidates),
        "figure_5": freq(compat, "compatibility_feature_status"),
        "figure_6": novelty_table(novel, links, importance),
    }


def module_links(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links per module, K type and O type; a phage without modules counts under one name."""
    has = candidates.filter(present("genome_id") & present("module_cluster_id")).select(
        F.col("genome_id").alias("phage_genome_id"), "module_cluster_id"
    ).distinct()
    # Links are counted per phage and types first, so a popular phage is multiplied after reduction.
    per = links.groupBy(
        "phage_genome_id",
        F.coalesce(F.nullif(text("K_type"), F.lit("")), F.lit("missing")).alias("K_type"),
        F.coalesce(F.nullif(text("O_type"), F.lit("")), F.lit("missing")).alias("O_type"),
    ).agg(F.count("*").alias("n"))
    return (
        per.join(has, "phage_genome_id", "left")
        .groupBy(F.coalesce("module_cluster_id", F.lit("missing_rbp_module")).alias("module_cluster_id"), "K_type", "O_type")
        .agg(F.sum("n").alias("phage_host_link_count"))
    )


def novelty_table(novel: DataFrame, links: DataFrame, importance: DataFrame, k: int = 20) -> DataFrame:
    """Novel candidates with the types of their last link, and the first feature signals.

    The last link is the one of the largest ``link_order``, or of the largest host id where links have no order.
    ``k`` makes the short list of the figure; the whole table of signals is ``importance``.
    """
    last = F.max_by(F.struct("K_type", "O_type"), F.struct(*[c for c in ("link_order", "host_genome_id") if c in links.columns]))
    types = links.groupBy(F.col("phage_genome_id").alias("genome_id")).agg(last.alias("l"))
    ranked = novel.join(types, "genome_id", "left").select(
        F.lit("novel_rbp_candidate").alias("priority_type"),
        F.col("candidate_id").alias("item_id"),
        "genome_id",
        F.coalesce("l.K_type", F.lit("")).alias("K_type"),
        F.coalesce("l.O_type", F.lit("")).alias("O_type"),
        F.col("confidence_score").cast("double").alias("score"),
        text("novelty_rationale").alias("rationale") if "novelty_rationale" in novel.columns else F.lit("").alias("rationale"),
    )
    signals = top_k(importance, ["feature_set", "feature"], k).select(
        F.lit("model_feature_signal").alias("priority_type"),
        F.col("feature").alias("item_id"),
        F.lit("").alias("genome_id"),
        F.lit("").alias("K_type"),
        F.lit("").alias("O_type"),
        F.col("delta_accuracy").alias("score"),
        F.col("feature_set").alias("rationale"),
    )
    return ranked.unionByName(signals)


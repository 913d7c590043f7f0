"""Host features, links, defense and counter-defense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import alias_coalesce, first_present, is_missing, null_if_missing, present, text
from evispark.functions.text import classify, classify_pair, hash_id, note_value, parent_id, prefix_filter, split_values
from evispark.operators.aggregates import packed_lists
from evispark.operators.joins import compatibility, last_rows, lookup_left, patch_merge, resolve_entities, shuffled, union_prefer
from evispark.operators.windows import first_per_key, ordinal_id, running_last
from evispark.session import cut_lineage

# Column names the typing and defense tools use.
SAMPLE_ID = [
    "host_genome_id", "genome_id", "sample", "Sample", "sample_id", "Sample ID", "strain", "Strain", "assembly",
    "Assembly", "isolate", "Isolate",
]
RESISTANCE_TYPING = {
    "host_species": ["species", "Species", "species_match", "species_complex", "Kleborate species"],
    "species_match": ["species_match", "species_match_confidence", "species", "Species"],
    "mlst_scheme": ["mlst_scheme", "MLST scheme", "scheme"],
    "ST": ["ST", "st", "MLST", "sequence_type", "Sequence type"],
    "virulence_score": ["virulence_score", "virulence score", "virulence", "virulence_score_Kp"],
    "resistance_score": ["resistance_score", "resistance score", "resistance"],
    "AMR_markers": ["AMR_markers", "AMR", "acquired_AMR_genes", "resistance_genes", "resistance_gene_count", "Resistance genes"],
    "virulence_markers": ["virulence_markers", "virulence_genes", "Virulence genes"],
    "ybt": ["ybt", "YbST", "yersiniabactin"],
    "iuc": ["iuc", "aerobactin"],
    "iro": ["iro", "salmochelin"],
    "rmpA": ["rmpA"],
    "rmpA2": ["rmpA2"],
}
SURFACE_TYPING = {
    "K_locus": ["K_locus", "K locus", "K_locus_best_match", "Best match locus", "Kaptive_K_locus"],
    "K_type": ["K_type", "K type", "K_locus_type", "Kaptive_K_type", "K"],
    "K_confidence": ["K_confidence", "K confidence", "K_locus_confidence", "Confidence", "Kaptive_K_confidence"],
    "O_locus": ["O_locus", "O locus", "O_locus_best_match", "O_best_match_locus", "Kaptive_O_locus"],
    "O_type": ["O_type", "O type", "O_locus_type", "Kaptive_O_type", "O"],
    "O_confidence": ["O_confidence", "O confidence", "O_locus_confidence", "Kaptive_O_confidence"],
}
#: Columns a host has from typing alone.
TYPED_ONLY = (
    "K_locus", "K_confidence", "O_locus", "O_confidence", "mlst_scheme", "virulence_score", "resistance_score",
    "ybt", "iuc", "iro", "rmpA", "rmpA2",
)
HOST_ID = ["host_genome_id", "genome_id", "sample", "Sample", "sample_id", "assembly", "host", "isolate", "Isolate"]
PHAGE_ID = ["phage_genome_id", "genome_id", "sample", "Sample", "phage_id", "contig_id", "isolate"]
HOST_DEFENSE = {
    "defense_system": ["defense_system", "system", "system_name", "name", "Defense system", "defence_system"],
    "defense_type": ["defense_type", "system_type", "type", "Defense type", "category"],
    "defense_subtype": ["defense_subtype", "subtype", "system_subtype", "subtype_name"],
    "gene_count": ["gene_count", "genes_count", "n_genes", "protein_count"],
    "genes": ["genes", "gene_names", "proteins", "protein_ids", "gene_ids"],
    "contig_id": ["contig_id", "contig", "sequence", "replicon"],
    "start": ["start", "start_pos", "begin"],
    "end": ["end", "end_pos", "stop"],
    "evidence_source": ["evidence_source", "tool", "source", "program"],
    "confidence": ["confidence", "score", "system_confidence"],
}
COUNTER_DEFENSE = {
    "candidate_id": ["candidate_id", "antidefense_candidate_id", "feature_id", "hit_id"],
    "annotation_gene_id": ["annotation_gene_id", "gene", "gene_id_full"],
    "gene_id": ["gene_id", "locus_tag", "protein_id"],
    "gene_cluster_id": ["gene_cluster_id", "cluster_id"],
    "product": ["product", "annotation", "description", "hit_name"],
    "antidefense_class": ["antidefense_class", "anti_defense_class", "class", "category"],
    "target_defense_system": ["target_defense_system", "target", "defense_target", "system_target"],
    "evidence_type": ["evidence_type", "evidence", "method"],
    "evidence_source": ["evidence_source", "tool", "source", "database"],
    "confidence_score": ["confidence_score", "score", "probability"],
}


def normalise_typing(table: DataFrame, aliases: dict[str, list[str]], order: str) -> DataFrame:
    """Tool rows with a host id, in canonical columns."""
    return table.select(
        F.coalesce(alias_coalesce(table, SAMPLE_ID), F.lit("")).alias("host_genome_id"),
        F.col(order),
        *[F.coalesce(alias_coalesce(table, names), F.lit("")).alias(c) for c, names in aliases.items()],
    ).filter(present("host_genome_id"))


def typing_from_notes(manifest: DataFrame) -> DataFrame:
    """Typing columns of host records read from their notes and marker lists."""
    markers = split_values("virulence_markers", distinct=False)
    hosts = manifest.filter((F.col("record_type") == "host") & present("genome_id"))
    return hosts.select(
        F.col("genome_id").alias("host_genome_id"),
        F.coalesce(F.nullif(note_value("notes", "species", "loose"), F.lit("")), text("host_species")).alias("species_match"),
        note_value("notes", "virulence_score", "loose").alias("virulence_score"),
        note_value("notes", "K_locus", "loose").alias("K_locus"),
        note_value("notes", "K_locus_confidence", "loose").alias("K_confidence"),
        note_value("notes", "O_locus", "loose").alias("O_locus"),
        *[F.array_join(prefix_filter(markers, p), ";").alias(p) for p in ("ybt", "iuc", "iro")],
    )


def relationship_columns(link_status: Column | str = "link_status") -> dict[str, Column]:
    status = F.col(link_status) if isinstance(link_status, str) else link_status
    known = (
        "source_matches_host_genome_id", "host_species_strain_exact_match", "metadata_only_host_no_genome",
        "ambiguous_host_species_strain_match",
    )
    kind = (
        F.when(F.col("record_type") == "prophage", "prophage_resident_host")
        .when(present("isolation_host"), "isolation_host")
        .when(status.isin(*known), "reported_host")
        .otherwise("predicted_host")
    )
    state = (
        F.when(status.isin("ambiguous_host_species_strain_match", "no_host_metadata") | is_missing("resolved_id"), "unresolved")
        .when(status == "source_matches_host_genome_id", "reviewed")
        .otherwise("inferred")
    )
    confidence = (
        F.when(state == "reviewed", "high")
        .when(status == "host_species_strain_exact_match", "medium")
        .when(state == "unresolved", "low")
        .otherwise("medium")
    )
    return {"relationship_type": kind, "relationship_status": state, "confidence": confidence}


def build_links(resolved: DataFrame, phage: str = "genome_id") -> DataFrame:
    """Relationship rows for records that resolve to a host or describe one."""
    columns = relationship_columns()
    df = resolved.filter(present("resolved_id") | (F.col("entity_label") != ""))
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df.select(
        hash_id(phage, "resolved_id", "relationship_type", "link_status", prefix="relationship_").alias("relationship_id"),
        F.col(phage).alias("phage_id"),
        F.col("resolved_id").alias("host_id"),
        "relationship_type",
        "relationship_status",
        F.col("link_status").alias("relationship_evidence"),
        F.coalesce(first_present("source", "accession", phage), F.lit("manifest")).alias("source_reference"),
        "confidence",
    )


def integrate_hosts(
    manifest: DataFrame, clusters: DataFrame, resistance: DataFrame | None = None, surface: DataFrame | None = None,
    order: str = "row_number",
) -> dict[str, DataFrame]:
    """Host table, phage-host links and relationships."""
    host_rows = manifest.filter((F.col("record_type") == "host") & present("genome_id"))
    base_columns = ["host_species", "host_strain", "source", "country", "year", "K_type", "O_type", "ST", "AMR_markers", "virulence_markers"]
    base = first_per_key(host_rows, ["genome_id"], [F.col(order).desc()]).select(
        F.col("genome_id").alias("host_genome_id"),
        *base_columns,
        F.col("host_species").alias("species_match"),
        *[F.lit("").alias(c) for c in TYPED_ONLY],
        F.lit("manifest_host_record").alias("host_record_source"),
    )
    hosts = base
    for table, aliases, flag, origin in (
        (resistance, RESISTANCE_TYPING, "kleborate_status", "kleborate_only"),
        (surface, SURFACE_TYPING, "kaptive_status", "kaptive_only"),
    ):
        if table is None:
            hosts = hosts.withColumn(flag, F.lit("not_supplied"))
            continue
        rows = normalise_typing(table, aliases, order)
        hosts = patch_merge(hosts, rows, "host_genome_id", list(aliases), order, flag)
        hosts = hosts.withColumn("host_record_source", F.coalesce("host_record_source", F.lit(origin)))
    phages = manifest.filter(F.col("record_type").isin(*R.PHAGE_LIKE))
    dim = last_rows(host_rows, "genome_id", ["host_species", "host_strain"], order).withColumnRenamed("genome_id", "host_genome_id")
    hosts = cut_lineage(hosts)
    resolved = cut_lineage(resolve_entities(phages, dim, hosts.select("host_genome_id")))
    made = F.col("link_status") == "metadata_only_host_no_genome"
    patched = {
        "host_species": F.coalesce(F.nullif(text("host_species"), F.lit("")), text("isolation_host")),
        **{c: text(c) for c in ("host_strain", "country", "year", "K_type", "O_type", "ST")},
    }
    state = resolved.select("*", *[null_if_missing(v).alias(f"s_{c}") for c, v in patched.items()])
    state = state.withColumn("link_order", F.col(order))
    made_rows = state.filter(made)
    final = made_rows.groupBy(F.col("resolved_id").alias("host_genome_id")).agg(
        *[F.max_by(f"s_{c}", F.when(F.col(f"s_{c}").isNotNull(), F.col(order))).alias(c) for c in patched]
    ).withColumn("host_record_source", F.lit("phage_host_metadata"))
    shown = ["host_species", "host_strain", "K_type", "O_type", "ST"]
    running = running_last(made_rows, ["resolved_id"], order, [f"s_{c}" for c in shown], "run_")
    cluster_ids = last_rows(clusters, "genome_id", ["cluster_id", "representative_id"], order).withColumnRenamed("cluster_id", "species_cluster_id")
    common = ["genome_id", "record_type", "resolved_id", "link_status", "entity_label", "link_order"]
    by_made = running.select(
        *common, *[F.coalesce(f"run_s_{c}", F.lit("")).alias(c) for c in shown], F.lit("").alias("AMR_markers"), F.lit("").alias("virulence_markers")
    )
    known = hosts.select(
        F.col("host_genome_id").alias("resolved_id"), F.lit(True).alias("_host"), *[F.col(c).alias(f"h_{c}") for c in [*shown, "AMR_markers", "virulence_markers"]]
    )
    by_host = state.filter(~made).join(shuffled(known), "resolved_id", "left").select(
        *common,
        *[
            F.when(F.col("_host"), text(f"h_{c}")).otherwise(text(c)).alias(c)
            for c in [*shown, "AMR_markers", "virulence_markers"]
        ],
    )
    links = lookup_left(by_host.unionByName(by_made), shuffled(cluster_ids), "genome_id").withColumnsRenamed(
        {"genome_id": "phage_genome_id", "resolved_id": "host_genome_id", "link_status": "host_link_status", "entity_label": "host_label"}
    )
    linked = links.filter(present("host_genome_id"))
    counts = linked.groupBy("host_genome_id").agg(
        F.countDistinct("phage_genome_id").alias("linked_phage_count"),
        F.countDistinct("species_cluster_id").alias("linked_species_cluster_count"),
    )
    table = lookup_left(hosts.unionByName(final, allowMissingColumns=True), shuffled(counts), "host_genome_id")
    return {
        "hosts": table,
        "links": links,
        "relationships": build_links(resolved),
    }


def linked_record_lists(links: DataFrame) -> DataFrame:
    """Records linked to each host, in order and in pieces."""
    linked = links.filter(present("host_genome_id")).select("host_genome_id", "phage_genome_id").distinct()
    return packed_lists(linked, ["host_genome_id"], "phage_genome_id")


def normalise_host_defense(table: DataFrame, hosts: DataFrame, label: str, order: str = "row_number",
                           rules: list[tuple[str, str]] = R.DEFENSE_RULES) -> DataFrame:
    """Defense rows with a host, a folded type, an id by row order, and a note when the host is unknown."""
    value = {c: F.coalesce(alias_coalesce(table, names), F.lit("")) for c, names in HOST_DEFENSE.items()}
    df = table.select(
        F.coalesce(alias_coalesce(table, HOST_ID), F.lit("")).alias("host_genome_id"), F.col(order), *[v.alias(c) for c, v in value.items()]
    ).filter(present("host_genome_id"))
    words = F.concat_ws(" ", "defense_system", "defense_type", "defense_subtype")
    own = F.coalesce(F.nullif(F.col("defense_type"), F.lit("")), F.nullif(F.col("defense_system"), F.lit("")), F.lit("unknown"))
    df = df.withColumn("defense_type", classify(words, rules, own))
    df = df.withColumn("defense_system", F.coalesce(F.nullif(F.col("defense_system"), F.lit("")), F.col("defense_type")))
    df = df.withColumn("evidence_source", F.coalesce(F.nullif(F.col("evidence_source"), F.lit("")), F.lit(label)))
    known = hosts.select(F.col("host_genome_id").alias("_h")).distinct()
    df = df.join(known, df["host_genome_id"] == known["_h"], "left").withColumn(
        "notes", F.when(F.col("_h").isNull(), "host not present in host_metadata").otherwise("OK")
    ).drop("_h")
    return ordinal_id(df, [order], "host_defense_", 6, "defense_system_id")


def normalise_antidefense(table: DataFrame, label: str, order: str = "row_number") -> DataFrame:
    """Stated counter-defense rows; class and target fall back to what the product says."""
    value = {c: F.coalesce(alias_coalesce(table, names), F.lit("")) for c, names in COUNTER_DEFENSE.items()}
    df = table.select(
        F.col(order), F.coalesce(alias_coalesce(table, PHAGE_ID), F.lit("")).alias("_phage"), *[v.alias(c) for c, v in value.items()]
    )
    df = df.withColumn("phage_genome_id", parent_id("_phage", "annotation_gene_id")).filter(present("phage_genome_id"))
    df = df.withColumn("_said", classify_pair("product", R.ANTIDEFENSE_RULES))

    def or_else(name: str, said: Column, last: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.nullif(said, F.lit("")), F.lit(last))

    return (
        df.withColumn("antidefense_class", or_else("antidefense_class", F.col("_said.label"), "unknown_counterdefense"))
        .withColumn("target_defense_system", or_else("target_defense_system", F.col("_said.target"), "unknown"))
        .withColumn("evidence_type", F.coalesce(F.nullif(F.col("evidence_type"), F.lit("")), F.lit("explicit_table")))
        .withColumn("evidence_source", F.coalesce(F.nullif(F.col("evidence_source"), F.lit("")), F.lit(label)))
        .drop("_said", "_phage")
    )


def infer_antidefense(annotations: DataFrame, order: str = "row_number") -> DataFrame:
    """Counter-defense candidates suggested by annotation text."""
    words = F.concat_ws(" ", text("product"), text("functional_category"), text("module_hint"))
    said = annotations.withColumn("_said", classify_pair(words, R.ANTIDEFENSE_RULES)).filter(F.col("_said.label") != "")
    return said.select(
        F.col(order),
        F.col("genome_id").alias("phage_genome_id"),
        "annotation_gene_id",
        "gene_id",
        text("product").alias("product"),
        F.col("_said.label").alias("antidefense_class"),
        F.col("_said.target").alias("target_defense_system"),
        F.lit("annotation_keyword_inference").alias("evidence_type"),
        F.lit("0.500").alias("confidence_score"),
    )


def integrate_defense(
    links: DataFrame, hosts: DataFrame, annotations: DataFrame, defense: DataFrame | None = None, anti: DataFrame | None = None,
    order: str = "row_number",
) -> dict[str, DataFrame]:
    """Defense rows, merged counter-defense rows and compatibility features of the links."""
    key = ["phage_genome_id", "annotation_gene_id", "antidefense_class", "target_defense_system"]
    inferred = infer_antidefense(annotations, order)
    if anti is None:
        merged = first_per_key(inferred, key, [order])
    else:
        merged = union_prefer(normalise_antidefense(anti, "antidefense_table", order), inferred, key, order)
    # Counts and lists of names are made of a few columns of these rows each; the texts are searched once for all.
    merged = cut_lineage(merged)
    spark = links.sparkSession
    if defense is None:
        found = spark.createDataFrame([], "host_genome_id string, defense_type string, defense_system string")
    else:
        found = normalise_host_defense(defense, hosts, "defense_table", order)
    return {"host_defense": found, "antidefense": merged, "compatibility": compatibility(links, found, merged)}

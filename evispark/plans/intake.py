"""Evidence, source and assay intake; dataset audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from evispark.functions.missing import alias_coalesce, fill_defaults, is_missing, present, text
from evispark.functions.numbers import gc_from, year_from
from evispark.functions.text import row_checksum, stable_id
from evispark.operators.gates import PHAGE_TERMS, filter_with_reason, reason_counts
from evispark.operators.joins import alias_map, map_stats, parity, reviewed_mapping
from evispark.operators.reshape import cell_result, import_records, tested_relationships, unpivot_matrix
from evispark.operators.validation import validate_assays, validate_hits, validate_imported
from evispark.operators.windows import keep_first, positions
from evispark.sources.delimited import resolve_headers

# Column names evidence tables use.
PROVENANCE = {
    "tool": ["tool"],
    "tool_version": ["tool_version", "tool-version", "version"],
    "database": ["database", "db", "profile_database", "template_database"],
    "database_version": [
        "database_version", "database-version", "db_version", "profile_database_version", "template_database_version",
    ],
    "command": ["command", "run_command"],
    "run_date": ["run_date", "date", "retrieved_at"],
    "input_checksum": ["input_checksum", "source_checksum"],
}
DOMAIN_ALIASES = {
    "annotation_gene_id": ["annotation_gene_id", "target_name", "target", "protein_id", "query", "qseqid"],
    "domain_id": ["domain_id", "hmm_id", "profile_id", "query_name", "domain", "sseqid"],
    "domain_name": ["domain_name", "hmm_name", "profile_name", "query_description", "description", "hit_name"],
    "start_aa": ["start_aa", "ali_from", "qstart", "start"],
    "end_aa": ["end_aa", "ali_to", "qend", "end"],
    "evalue": ["evalue", "i_evalue", "E-value", "eval"],
    "evidence_source": ["evidence_source", "tool", "source"],
    "notes": ["notes"],
}
STRUCTURAL_ALIASES = {
    "annotation_gene_id": ["annotation_gene_id", "query", "qseqid", "protein_id", "target_name"],
    "structural_hit_id": ["structural_hit_id", "target", "tseqid", "sseqid", "hit_id", "template", "fold", "pdb_hit", "phold_hit"],
    "structural_hit_name": ["structural_hit_name", "target_name", "hit_name", "description", "template_name", "product", "function"],
    "tm_score": ["tm_score", "alntmscore", "qtmscore", "ttmscore", "tmscore", "foldseek_tm_score"],
    "probability": ["probability", "prob", "confidence", "phold_probability"],
    "evidence_source": ["evidence_source", "tool", "source"],
    "notes": ["notes"],
}
KINDS = {
    "domain": (DOMAIN_ALIASES, "domain_id", "domain_name", ["annotation_gene_id", "domain_id", "start_aa", "end_aa"]),
    "structural": (STRUCTURAL_ALIASES, "structural_hit_id", "structural_hit_name", ["annotation_gene_id", "structural_hit_id"]),
}
ANNOTATION_IDS = ["annotation_gene_id", "protein_id", "gene_id", "id"]


def normalize_hits(
    table: DataFrame, kind: str, provenance: Mapping[str, str], annotations: DataFrame | None = None, order: str = "row_number"
) -> dict[str, DataFrame]:
    """Evidence hits in canonical columns with provenance, checked, mapped and deduplicated.

    What a row says about its origin wins over the provenance given for the whole table.
    """
    aliases, hit_id, hit_name, key = KINDS[kind]
    df = table.select(
        F.col(order),
        *[F.coalesce(alias_coalesce(table, names), F.lit("")).alias(c) for c, names in aliases.items()],
        *[
            F.coalesce(alias_coalesce(table, names), F.lit(provenance.get(c, ""))).alias(c)
            for c, names in PROVENANCE.items()
        ],
    ).filter(present("annotation_gene_id") | present(hit_id))
    df = df.withColumn(hit_name, F.coalesce(F.nullif(F.col(hit_name), F.lit("")), F.col(hit_id)))
    df = df.withColumn("evidence_source", F.coalesce(F.nullif(F.col("evidence_source"), F.lit("")), F.lit(provenance.get("evidence_source", ""))))
    df = df.withColumn("notes", F.coalesce(F.nullif(F.col("notes"), F.lit("")), F.lit(f"normalized reviewed {kind} evidence")))
    unknown = ambiguous = None
    if annotations is not None:
        known, ambiguous = alias_map(annotations, "annotation_gene_id", ANNOTATION_IDS)
        known = known.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
        df = df.join(known, df["annotation_gene_id"] == known["_alias"], "left")
        unknown = df.filter(F.col("_alias").isNull() & present("annotation_gene_id")).select("annotation_gene_id").distinct()
        df = df.filter(F.col("_alias").isNotNull() | is_missing("annotation_gene_id")).withColumn(
            "annotation_gene_id", F.coalesce("_canonical", "annotation_gene_id")
        ).drop("_alias", "_canonical")
    good, issues = validate_hits(df, kind)
    kept, repeats = keep_first(good, key, order)
    columns = [*aliases, *PROVENANCE]
    kept = kept.withColumn("output_checksum", row_checksum(columns))
    out = {"hits": kept, "issues": issues, "duplicates": repeats}
    if unknown is not None:
        out["unknown_ids"], out["ambiguous_ids"] = unknown, ambiguous
    return out


def import_source(
    table: DataFrame, spec: Mapping[str, object], aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, str], import_id: str,
    order: str = "row_number",
) -> dict[str, DataFrame]:
    """Records of one export after its filters, in the sample schema, first occurrence kept."""
    columns = [c for c in table.columns if c != order]
    reasoned = filter_with_reason(
        table,
        columns,
        require_term=spec.get("require_term"),
        any_terms=PHAGE_TERMS if spec.get("require_phage_keyword") else (),
        include_regex=spec.get("include_regex"),
        exclude_regex=spec.get("exclude_regex"),
        review_statuses=spec.get("required_note_review_statuses", ()),
    )
    kept = reasoned.filter(F.col("filter_reason") == "included").drop("filter_reason").withColumn("_order", F.col(order))
    shaped = fill_defaults(resolve_headers(kept, aliases, spec.get("column_map")), spec, defaults)
    shaped = shaped.withColumn("year", year_from("year")).withColumn("gc_percent", gc_from("gc_percent"))
    is_phage_name = F.lit(False)
    for t in PHAGE_TERMS:
        is_phage_name = is_phage_name | F.lower(text("host_species")).contains(t)
    better = F.when(present("isolation_host"), F.col("isolation_host")).otherwise("NA")
    shaped = shaped.withColumn(
        "host_species", F.when((F.col("record_type") != "host") & is_phage_name, better).otherwise(F.col("host_species"))
    )
    made = stable_id("record_type", "accession", import_id, F.col("_order"))
    shaped = shaped.withColumn("genome_id", F.when(is_missing("genome_id"), made).otherwise(F.col("genome_id")))
    rows, repeats = keep_first(shaped, ["genome_id"], "_order")
    return {"rows": rows, "duplicates": repeats, "reasons": reason_counts(reasoned)}


def intake_assays(
    cells: DataFrame, row_id: str, row_map: DataFrame, column_map: DataFrame, spec: Mapping[str, str], phages: DataFrame, hosts: DataFrame,
) -> dict[str, DataFrame]:
    """Assay rows from a matrix through both maps, with all issues and the relationships they imply."""
    usable_rows, row_issues = reviewed_mapping(row_map)
    usable_columns, column_issues = reviewed_mapping(column_map)
    assays, issues = unpivot_matrix(cells, row_id, usable_rows, usable_columns, spec)
    numbered = positions(assays, [], ["interaction_id"], "row_number").withColumn("row_number", F.col("row_number") + 2)
    return {
        "assays": assays,
        "matrix_issues": issues,
        "map_issues": row_issues.unionByName(column_issues),
        "assay_issues": validate_assays(numbered, phages, hosts),
        "relationships": tested_relationships(assays),
    }


def import_assays(table: DataFrame, spec: Mapping[str, object], aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, str],
                  import_id: str) -> dict[str, DataFrame]:
    """Assay export -> canonical rows, errors that block the write, and relationships."""
    rows = import_records(table, spec, aliases, defaults, import_id)
    errors = validate_imported(rows.withColumnRenamed("_row", "row_number"))
    return {"assays": rows, "issues": errors, "relationships": tested_relationships(rows)}


def audit_dataset(assays: DataFrame, cells: DataFrame, phages: DataFrame, hosts: DataFrame, phage_map: DataFrame, host_map: DataFrame,
                  phage_sources: DataFrame, host_sources: DataFrame) -> DataFrame:
    """Audit checks of an assay dataset as rows: parity with its matrix, coverage of both id maps, vocabulary."""
    compared = parity(assays, cells.withColumn("result", cell_result("matrix_value")), phages, hosts)
    tests = {
        "assay_matrix_parity": (F.col("parity_ok"), "rows"),
        "positive_parity": (F.col("positive") == F.col("matrix_positive"), "positive"),
        "negative_parity": (F.col("negative") == F.col("matrix_negative"), "negative"),
        "no_untested_rows": (F.col("tested_false") == 0, "tested_false"),
        "phage_ids_resolve": (F.col("unresolved_phage_ids") == 0, "unresolved_phage_ids"),
        "host_ids_resolve": (F.col("unresolved_host_ids") == 0, "unresolved_host_ids"),
        "unique_interactions": (F.col("duplicate_interaction_ids") == 0, "duplicate_interaction_ids"),
        "blank_cells_untested": (F.col("matrix_blank") > 0, "matrix_blank"),
    }
    rows = [
        F.struct(F.lit(name).alias("check_id"), ok.alias("ok"), F.col(seen).alias("observed")) for name, (ok, seen) in tests.items()
    ]
    checks = compared.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    for name, mapping, sources, canon in (("phage_map", phage_map, phage_sources, phages), ("host_map", host_map, host_sources, hosts)):
        stats = map_stats(mapping, sources, canon)
        checks = checks.unionByName(stats.select(F.lit(name).alias("check_id"), (~F.col("blocking")).alias("ok"), F.col("rows").alias("observed")))
    return checks.withColumn("status", F.when(F.col("ok"), "pass").otherwise("fail"))


"""Unpivot, unions into one schema, imports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import fill_defaults, is_missing, present, text
from evispark.functions.text import fold_vocab, joined_parts, sanitize_id, split_values
from evispark.operators.joins import map_ids
from evispark.operators.windows import first_occurrence, keep_first
from evispark.sources.delimited import resolve_headers


def unpivot_cells(df: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Matrix cells as (row id, column id, text value); columns without a name are left out."""
    columns = [c for c in df.columns if c != row_id and c not in keep and c.strip() not in R.MATRIX_SKIP]
    typed = df.select(row_id, *keep, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return typed.unpivot([row_id, *keep], columns, "column_id", "matrix_value")


def cell_result(
    value: Column | str,
    positive: Sequence[str] = R.MATRIX_POSITIVE,
    negative: Sequence[str] = R.MATRIX_NEGATIVE,
    skip: Sequence[str] = R.MATRIX_SKIP,
) -> Column:
    """positive, negative, blank (untested, never negative) or unsupported."""
    v = F.lower(text(value))
    return (
        F.when(v.isin(*[s.lower() for s in skip]), "blank")
        .when(v.isin(*[p.lower() for p in positive]), "positive")
        .when(v.isin(*[n.lower() for n in negative]), "negative")
        .otherwise("unsupported")
    )


def unpivot_matrix(
    cells: DataFrame,
    row_id: str,
    row_map: DataFrame,
    column_map: DataFrame,
    spec: Mapping[str, str],
    fallback: bool = False,
    fail_on_unresolved: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Assay rows and issues from matrix cells (``row_id, column_id, matrix_value, row_number``).

    Maps come from ``reviewed_mapping``. Blank cells emit nothing. An interaction that comes up
    twice is kept once and reported with the row where it first stood.
    """
    named = cells.filter(present(row_id)).withColumn("result", cell_result("matrix_value"))
    tested = named.filter(F.col("result").isin("positive", "negative"))
    tested = map_ids(map_ids(tested, row_map, row_id, "host_id", fallback), column_map, "column_id", "phage_id", fallback)
    resolved = (F.col("host_id") != "") & (F.col("phage_id") != "")
    study, panel = spec.get("study_id", "study"), spec.get("panel_id", "matrix_panel")
    kind = spec.get("assay_type", "spot").lower()
    interaction = sanitize_id(F.concat_ws("_", F.lit(study), F.lit(panel), "phage_id", "host_id", F.lit(kind)))
    good = tested.filter(resolved).withColumn("interaction_id", interaction)
    good = good.withColumn("_order", F.struct("row_number", "column_id"))
    marked = first_occurrence(good, ["interaction_id"], "_order", "_first")
    note = [
        F.concat(F.lit("source_host_id="), F.col(row_id).cast("string")),
        F.concat(F.lit("source_phage_id="), F.col("column_id")),
        F.concat(F.lit("matrix_value="), text("matrix_value")),
        F.lit("blank_cells_treated_as_untested"),
    ]
    unmeasured = F.lit("not_measured")
    rows = marked.filter(F.col("_first").isNull()).select(
        "interaction_id",
        "phage_id",
        "host_id",
        F.lit(study).alias("study_id"),
        F.lit(panel).alias("panel_id"),
        F.lit(kind).alias("assay_type"),
        F.lit("true").alias("tested"),
        unmeasured.alias("adsorption_result"),
        F.col("result").alias("spot_result"),
        unmeasured.alias("plaque_result"),
        unmeasured.alias("productive_infection_result"),
        F.lit("NA").alias("eop"),
        F.lit("NA").alias("eop_reference_host"),
        unmeasured.alias("growth_inhibition_result"),
        F.lit("NA").alias("moi"),
        F.lit("NA").alias("temperature_c"),
        F.lit("NA").alias("medium"),
        F.lit("NA").alias("replicate_count"),
        F.when(F.col("result") == "positive", spec.get("positive_outcome_tier", "initial_interaction"))
        .otherwise(spec.get("negative_outcome_tier", "tested_negative"))
        .alias("outcome_tier"),
        F.lit(spec.get("evidence_tier", "supplementary_matrix")).alias("evidence_tier"),
        F.lit(spec.get("reference", "source_reference_pending")).alias("reference"),
        F.concat_ws("; ", *note).alias("notes"),
    )

    def issue(df: DataFrame, severity: str, field: str, message: Column) -> DataFrame:
        return df.select(
            F.lit(severity).alias("severity"),
            "row_number",
            F.col(row_id).cast("string").alias("row_source_id"),
            "column_id",
            F.lit(field).alias("field"),
            message.alias("message"),
        )

    unresolved = F.concat(
        F.lit("tested cell skipped: host "), F.col("host_id_status"), F.lit(", phage "), F.col("phage_id_status")
    )
    issues = (
        issue(
            named.filter(F.col("result") == "unsupported"),
            "error",
            "matrix_value",
            F.concat(F.lit("Unsupported matrix value: "), text("matrix_value")),
        )
        .unionByName(
            issue(tested.filter(~resolved), "error" if fail_on_unresolved else "warning", "entity_mapping", unresolved)
        )
        .unionByName(
            issue(
                marked.filter(F.col("_first").isNotNull()),
                "error",
                "interaction_id",
                F.concat(F.lit("interaction also appears on row "), F.col("_first.row_number").cast("string")),
            )
        )
        .unionByName(
            issue(
                cells.filter(is_missing(F.col(row_id).cast("string")))
                .dropDuplicates(["row_number"])
                .withColumn("column_id", F.lit("NA")),
                "warning",
                "host_id",
                F.lit("matrix row has no host identifier; row skipped"),
            )
        )
    )
    return rows, issues


def explode_list(df: DataFrame, column: str, out: str | None = None, distinct: bool = False) -> DataFrame:
    """One row per list item; rows without items stay with null."""
    return df.withColumn(out or column, F.explode_outer(split_values(column, distinct)))


def requirement_matrix(needs: DataFrame, status: DataFrame, item: str, default: Mapping[str, str]) -> DataFrame:
    """Goal x item x role rows with the status of each item; items unknown to it get the defaults."""
    out = needs.join(status, item, "left")
    return out.na.fill(dict(default))


def build_canonical(
    sources: Sequence[tuple[DataFrame, Mapping[str, object]]],
    aliases: Mapping[str, Sequence[str]],
    defaults: Mapping[str, str],
    key: str,
    identity: Sequence[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union of differently shaped sources in one schema, first occurrence kept.

    Each source comes with its options (``source_id``, ``<column>_default``,
    ``source_label``, ``column_map``) and an ``_order`` column. Returns rows, repeats, and rows without any identity.
    """
    union = None
    for position, (df, spec) in enumerate(sources):
        shaped = resolve_headers(df, aliases, spec.get("column_map"))
        shaped = fill_defaults(shaped, spec, defaults)
        shaped = shaped.select(
            F.struct(F.lit(position).alias("s"), F.col("_order").alias("o")).alias("_order"),
            F.lit(str(spec.get("source_id", f"source_{position}"))).alias("import_source"),
            *defaults,
        )
        union = shaped if union is None else union.unionByName(shaped)
    identified = F.lit(False)
    for c in identity:
        identified = identified | present(c)
    kept, repeats = keep_first(union.filter(identified), [key], "_order")
    return kept, repeats, union.filter(~identified)


def import_records(df: DataFrame, spec: Mapping[str, object], aliases: Mapping[str, Sequence[str]],
                   defaults: Mapping[str, str], import_id: str, row_number: str = "_row") -> DataFrame:
    """Assay rows from an export: headers, defaults, vocabularies and ids in the canonical form.

    ``_row`` numbers the rows of the export.
    """
    shaped = fill_defaults(resolve_headers(df, aliases, spec.get("column_map")), spec, defaults)
    tested = fold_vocab("tested", R.BOOLEAN_WORDS)
    shaped = shaped.withColumn("tested", tested)
    for c in R.RESULT_COLUMNS:
        blank = F.when(F.col("tested") == "false", "not_tested").otherwise("not_measured")
        folded = fold_vocab(c, R.RESULT_WORDS, F.lower(F.col(c)))
        shaped = shaped.withColumn(c, F.when(is_missing(c), blank).otherwise(folded))
    for c in ("assay_type", "outcome_tier", "evidence_tier"):
        shaped = shaped.withColumn(c, F.lower(c))
    raw = joined_parts("study_id", "panel_id", "phage_id", "host_id", "assay_type", F.col(row_number).cast("string"))
    made = sanitize_id(raw)
    mark = F.lit(f"imported_from={import_id}")
    return (
        shaped.withColumn("interaction_id", F.when(is_missing("interaction_id"), made).otherwise(F.col("interaction_id")))
        .withColumn("notes", F.when(text("notes") == "", mark).otherwise(F.concat_ws("; ", "notes", mark)))
    )


def tested_relationships(assays: DataFrame) -> DataFrame:
    """One relationship per imported assay row; it records the test, not its outcome."""
    return assays.select(
        F.concat(F.lit("tested_"), F.col("interaction_id")).alias("relationship_id"),
        "phage_id",
        "host_id",
        F.lit("tested_assay_host").alias("relationship_type"),
        F.lit("reviewed").alias("relationship_status"),
        F.lit("curated_phage_host_assay_import").alias("relationship_evidence"),
        F.col("reference").alias("source_reference"),
        F.when(F.col("evidence_tier").isin(*R.EVIDENCE_TIERS[:4]), "high").otherwise("unknown").alias("confidence"),
        F.concat(F.lit("derived_from_interaction_id="), F.col("interaction_id")).alias("notes"),
    )


def entities_from_matrix(cells: DataFrame, column: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Entity rows for the distinct ids of one matrix axis, and a pending id map for review."""
    ids = cells.select(F.trim(F.col(column).cast("string")).alias("source_id")).filter(present("source_id")).distinct()
    entities = ids.select(
        F.concat(F.lit(prefix), sanitize_id("source_id")).alias("genome_id"),
        F.concat(F.lit("source_id="), F.col("source_id"), F.lit("; review_status=pending")).alias("notes"),
    )
    mapping = ids.select(
        "source_id",
        F.concat(F.lit(prefix), sanitize_id("source_id")).alias("canonical_id"),
        F.lit("pending").alias("review_status"),
    )
    return entities, mapping

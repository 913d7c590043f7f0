"""Small cases with known outcomes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evispark.functions import rules as R
from evispark.functions.missing import is_missing, strip
from evispark.functions.numbers import strict_number, to_int
from evispark.functions.text import classify_pair, note_value, split_values
from evispark.operators.gates import export_gate, filter_with_reason
from evispark.operators.joins import alias_map, propose_matches, reviewed_mapping
from evispark.operators.reshape import unpivot_cells, unpivot_matrix
from evispark.operators.validation import validate_assays, validate_relationships
from evispark.plans.genes import annotate, find_candidates
from evispark.plans.intake import normalize_hits
from evispark.plans.records import build_manifest, dereplicate

VALID = {c: "" for c in R.ASSAY_COLUMNS} | {
    "interaction_id": "i1", "phage_id": "p1", "host_id": "h1", "study_id": "s", "panel_id": "pa", "assay_type": "plaque", "tested": "true",
    "adsorption_result": "not_measured", "spot_result": "not_measured", "plaque_result": "positive", "productive_infection_result": "positive",
    "growth_inhibition_result": "not_measured", "eop": "0.5", "eop_reference_host": "h0", "outcome_tier": "productive_infection", "evidence_tier": "curated_assay", "reference": "doi",
}


def blocking(spark, *rows, phage="p1", host="h1"):
    schema = ", ".join(f"{c} string" for c in R.ASSAY_COLUMNS) + ", row_number int"
    df = spark.createDataFrame([tuple(r[c] for c in R.ASSAY_COLUMNS) + (i + 2,) for i, r in enumerate(rows)], schema)
    found = validate_assays(df, spark.createDataFrame([(phage,)], "id string"), spark.createDataFrame([(host,)], "id string"))
    return found.filter("blocking_issue").count()


def test_assay_rows(spark):
    negative = VALID | {"plaque_result": "negative", "productive_infection_result": "not_measured", "eop": "", "outcome_tier": "tested_negative"}
    assert blocking(spark, VALID) == 0 and blocking(spark, negative) == 0
    untested = VALID | {"tested": "false", "plaque_result": "negative", "productive_infection_result": "negative", "outcome_tier": "tested_negative", "eop": ""}
    assert blocking(spark, untested) == 5
    spot = VALID | {"assay_type": "spot", "spot_result": "positive", "plaque_result": "not_measured", "eop": ""}
    assert blocking(spark, spot) == 1
    assert blocking(spark, VALID | {"eop": "-0.1"}) == 1
    assert blocking(spark, VALID, VALID) == 2
    assert blocking(spark, VALID, phage="x", host="y") == 2
    assert blocking(spark, {c: "" for c in R.ASSAY_COLUMNS}) == 0


def test_relationship_rows(spark):
    columns = ["relationship_id", "phage_id", "host_id", "relationship_type", "relationship_status", "relationship_evidence", "source_reference", "confidence", "notes"]

    def run(*rows):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in columns) + ", row_number int")
        known = spark.createDataFrame([("p1",), ("h1",)], "id string")
        return validate_relationships(df, known, known).filter("blocking_issue").count()

    good = ("r1", "p1", "h1", "isolation_host", "reviewed", "x", "doi", "0.7", "")
    assert run(good) == 0
    assert run(good[:3] + ("susceptible_host",) + good[4:]) == 1
    assert run(good, good) == 2
    assert run(("r1", "p9", "h9") + good[3:]) == 2


def test_matrix_cells(spark):
    wide = spark.createDataFrame([("hostA", "1.0", "0.0", 2), ("hostB", "", "1.0", 3)], "host string, ph1 string, ph2 string, row_number int")
    cells = unpivot_cells(wide, "host", ["row_number"])

    def maps(*ids, status="reviewed"):
        return reviewed_mapping(spark.createDataFrame([(i, i.upper(), status) for i in ids], "source_id string, canonical_id string, review_status string"))[0]

    rows, issues = unpivot_matrix(cells, "host", maps("hostA", "hostB"), maps("ph1", "ph2"), {})
    assert sorted(r.spot_result for r in rows.collect()) == ["negative", "positive", "positive"] and issues.isEmpty()
    rows, issues = unpivot_matrix(cells, "host", maps("hostA"), maps("ph1", "ph2"), {})
    assert rows.count() == 2 and [r.field for r in issues.collect()] == ["entity_mapping"]
    bad = wide.withColumn("ph1", F.lit("maybe"))
    _, issues = unpivot_matrix(unpivot_cells(bad, "host", ["row_number"]), "host", maps("hostA", "hostB"), maps("ph1", "ph2"), {})
    assert issues.filter("severity = 'error'").count() == 2
    assert maps("hostA", status="pending").isEmpty()


def test_ambiguous_maps_are_errors(spark):
    m = spark.createDataFrame([("a", "x", ""), ("a", "y", "reviewed"), ("b", "z", "draft")], "source_id string, canonical_id string, review_status string")
    usable, issues = reviewed_mapping(m)
    assert usable.isEmpty()
    assert sorted((r.severity, r.source_id) for r in issues.collect()) == [("error", "a"), ("warning", "b")]
    dim = spark.createDataFrame([("g1", "p"), ("g2", "p")], "annotation_gene_id string, protein_id string")
    assert [r.alias for r in alias_map(dim, "annotation_gene_id", ["protein_id"])[1].collect()] == ["p"]


def test_match_proposals(spark):
    ids = spark.createDataFrame([("A-1",), ("b",), ("c.c",), ("zz",)], "id string")
    canon = spark.createDataFrame([("a1",), ("b",), ("cc",), ("c_c",)], "id string")
    existing = spark.createDataFrame([("zz", "q", "Reviewed")], "source_id string, canonical_id string, review_status string")
    got = {r.source_id: (r.candidate_status, r.proposed_canonical_id, r.map_action) for r in propose_matches(ids, canon, existing).collect()}
    assert got["A-1"] == ("normalized_unique_candidate", "a1", "added_pending_mapping_row")
    assert got["b"][0] == "exact_match" and got["c.c"][:2] == ("ambiguous_normalized_candidates", "")
    assert got["zz"][2] == "preserved_existing_mapping"


@pytest.mark.parametrize(
    ("change", "status"),
    [({}, "export_ready"), ({"year": "2024-01"}, "export_row_format_invalid"), ({"gc_percent": "150"}, "export_row_format_invalid"),
     ({"phage_lifestyle": "odd"}, "export_row_format_invalid"), ({"accession": "NA", "genome_id": ""}, "export_rows_missing_identity"), ({"notes": ""}, "export_ready")],
)
def test_export_gate_cases(spark, change, status):
    row = {"accession": "A1", "genome_id": "g1", "year": "2024", "genome_length": "40000", "gc_percent": "50.5", "phage_lifestyle": "virulent", "notes": "ok"} | change
    df = spark.createDataFrame([(*row.values(), 2)], ", ".join(f"{c} string" for c in row) + ", r int")
    got = export_gate(df, list(row), ["accession", "genome_id"], "r", ("virulent", "temperate", "ambiguous")).first()
    assert got.validation_status == status and got.provenance_warning_count == (change.get("notes") == "")


def test_review_status_filter(spark):
    df = spark.createDataFrame([("reviewed_phage", "review_status=reviewed"), ("draft", "review_status=draft")], "id string, notes string")
    out = filter_with_reason(df, ["id", "notes"], review_statuses=R.REVIEWED)
    assert {r.id: r.filter_reason for r in out.collect()} == {"reviewed_phage": "included", "draft": "skipped_review_status"}


def test_evidence_rows(spark):
    hits = spark.createDataFrame([(1, "p1", "PDB:1ABC", "0.73", "88.5", "foldseek 9"), (2, "p1", "PDB:1ABC", "0.5", "1", ""), (3, "p1", "PDB:2", "1.5", "", "")],
                                 "row_number int, query string, target string, alntmscore string, prob string, tool string")
    genes = spark.createDataFrame([("g1|a", "p1")], "annotation_gene_id string, protein_id string")
    out = normalize_hits(hits, "structural", {"tool": "given", "database": "pdb"}, genes)
    row = out["hits"].collect()
    assert len(row) == 1 and row[0].annotation_gene_id == "g1|a" and row[0].tm_score == 0.73 and row[0].probability == 0.885
    assert row[0].tool == "foldseek 9" and row[0].database == "pdb" and len(row[0].output_checksum) == 64
    assert out["issues"].count() == 1 and out["duplicates"].count() == 1


def test_scalars(spark):
    row = spark.range(1).select(
        strip(F.lit("\t x \n")).alias("s"),
        is_missing(F.lit(" - ")).alias("m"),
        is_missing(F.lit("Na")).alias("case"),
        to_int(F.lit("12.9")).alias("i"),
        to_int(F.lit("nan")).alias("nan"),
        strict_number(F.lit("inf"))["problem"].alias("inf"),
        strict_number(F.lit("-"))["problem"].alias("dash"),
        split_values(F.lit("b, a;b;")).alias("l"),
        note_value(F.lit("xkey=1; key=2 ;z"), "key").alias("n"),
        classify_pair(F.lit("Anti-CRISPR AcrIF1"), R.ANTIDEFENSE_RULES).alias("c"),
    ).first()
    assert (row.s, row.m, row.case, row.i, row.nan, row.inf, row.dash) == ("x", True, False, 12, None, "non_finite", None)
    assert row.l == ["a", "b"] and row.n == "2" and tuple(row.c) == ("anti_crispr", "CRISPR-Cas")


def test_manifest_to_candidates(spark):
    columns = ["genome_id", "record_type", "accession", "source", "genome_length", "gc_percent", "phage_lifestyle", "raw_sequence_path"]
    data = [("g1", "phage", "A", "s", "40000", "50", "virulent", ""), ("g2", "phage", "NA", "s", "50000", "50", "virulent", ""), ("g3", "phage", "B", "", "10", "50", "odd", ""), ("h1", "host", "", "", "-1", "50", "", "")]
    samples = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    manifest, issues, excluded = build_manifest(samples)
    assert [r.genome_id for r in excluded.collect()] == ["h1"] and issues.filter("severity = 'warning'").count() == 1
    edges = spark.createDataFrame([("g1", "g2", "96", "90"), ("g2", "g3", "94", "99"), ("g1", "zz", "99", "99"), ("g1", "g3", "nan", "99")],
                                  "genome_id_1 string, genome_id_2 string, identity_percent string, coverage_percent string")
    out = dereplicate(manifest, None, edges)
    assert [r.included_in_clustering for r in out["edges"].collect()].count(True) == 1
    reps = {r.cluster_id: (r.representative_id, r.cluster_size) for r in out["representatives"].collect()}
    assert reps == {"kp_phage_species_00001": ("g1", 2), "kp_phage_species_00002": ("g3", 1)}
    genes = spark.createDataFrame(
        [(2, "g1", "a", "tail fiber protein", "10", "200"), (3, "g1", "b", "hypothetical protein", "300", "400"), (4, "g1", "b", "terminase", "500", "600"), (5, "zz", "c", "x", "1", "2")],
        "row_number int, genome_id string, gene_id string, product string, start string, end string",
    )
    made = annotate(genes, manifest, out["clusters"])
    ids = sorted(r.annotation_gene_id for r in made["annotations"].collect())
    assert ids == ["g1|a", "g1|b", "g1|b|duplicate_4"] and made["issues"].count() == 1
    domains = spark.createDataFrame([("g1|b", "PF1", "tail spike", 5, "hmm")], "annotation_gene_id string, domain_id string, domain_name string, start_aa int, evidence_source string")
    found = find_candidates(made["annotations"], made["gene_clusters"], domains)
    got = {r.annotation_gene_id: (r.candidate_id, r.novelty_tier, r.confidence_score) for r in found["candidates"].collect()}
    assert got == {"g1|a": ("rbp_candidate_000001", "insufficient_novelty_evidence", 0.5), "g1|b": ("rbp_candidate_000002", "tier_1", 0.3)}

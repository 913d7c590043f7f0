"""Evidence masks and the coverage plan on a small case worked out by hand."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evispark.operators.evidence import Evidence, mask_coverage
from evispark.plans.coverage import assay_feature_coverage, coverage_metrics, evidence_of


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_masks_merge_tables_and_skip_missing_ids(spark):
    bits = Evidence(("a", "b", "c"))
    one = frame(spark, [("x", 1), ("x", 5), ("y", 1), (None, 9), ("NA", 9)], "id string, n int")
    two = frame(spark, [("y", None), ("z", 2)], "k string, n int")
    got = bits.masks([(one, "id", {"a": True, "b": F.col("n") > 3}), (two, "k", {"c": F.col("n") > 1})])
    assert {r.id: r.mask for r in got.collect()} == {"x": 3, "y": 1, "z": 4}


def test_coverage_of_a_small_assay(spark):
    assays = frame(
        spark,
        [("p1", "h1", "true", "spot", "positive", "positive"), ("p1", "h2", "true", "spot", "negative", ""), ("p2", "h1", "true", "spot", "positive", None),
         ("p3", "h9", "false", "spot", "positive", ""), ("p4", "h1", "true", "eop", "positive", ""), ("p5", "h1", "true", "spot", "not_tested", "")],
        "phage_id string, host_id string, tested string, assay_type string, spot_result string, productive_infection_result string",
    )
    tables = {
        # p1 failed its check although the manifest has its sequence; p2 is known from the manifest alone.
        "sequence_qc": frame(spark, [("p1", "true", "", 1), ("p1", "false", "fail", 2), ("h1", "", "PASS", 1)], "genome_id string, passes_sequence_qc string, sequence_qc_status string, row_number int"),
        "manifest": frame(spark, [("p1", "true", "x"), ("p2", "true", "x"), ("h2", "true", "NA")], "genome_id string, has_raw_sequence string, raw_sequence_path string"),
        "rbps": frame(spark, [("p1", "absent"), ("p2", "fiber")], "genome_id string, domain_hit string"),
        "domains": frame(spark, [("p1", "-")], "genome_id string, domain_hit string"),
        "hosts": frame(spark, [("h1", "K2", "", "not_assessed")], "host_genome_id string, K_type string, O_type string, ST string"),
        "host_defense": frame(spark, [("h1", "0", "retron"), ("h2", "0", "")], "host_genome_id string, host_defense_system_count string, host_defense_types string"),
        "counter_defense": frame(spark, [("p2", "3")], "phage_genome_id string, phage_antidefense_count string"),
    }
    got = {(r.metric, r.entity_level): (r.numerator, r.assessed, r.denominator, r.evidence_state) for r in assay_feature_coverage(assays, tables).collect()}
    assert len(got) == 11 + 15 + 3
    want = {
        ("phage_sequence_verified", "unique_phage"): (1, 2, 2, "assessed_positive"),
        ("phage_sequence_verified", "pair"): (1, 3, 3, "assessed_positive"),
        ("host_sequence_verified", "pair"): (2, 2, 3, "assessed_positive"),
        ("host_K_type", "unique_host"): (1, 1, 2, "assessed_positive"),
        ("host_ST", "pair"): (0, 0, 3, "not_assessed"),
        ("domain_evidence", "unique_phage"): (1, 1, 2, "assessed_positive"),
        ("structural_evidence", "pair"): (0, 0, 3, "not_assessed"),
        ("host_defense_evidence", "pair"): (2, 3, 3, "assessed_positive"),
        ("phage_counterdefense_evidence", "unique_phage"): (1, 1, 2, "assessed_positive"),
        ("receptor_layer_feature_completeness", "pair"): (2, 2, 3, "assessed_positive"),
        ("defense_counterdefense_feature_completeness", "pair"): (1, 1, 3, "assessed_positive"),
        ("productive_infection_outcomes", "pair"): (1, 1, 3, "assessed_positive"),
        ("tested_spot_pairs", "pair"): (3, 3, 3, "assessed_positive"),
        ("unique_assay_hosts", "unique_host"): (2, 2, 2, "assessed_positive"),
    }
    assert {k: got[k] for k in want} == want


def test_no_pairs_and_two_joins(spark):
    assays = frame(spark, [], "phage_id string, host_id string, productive_infection_result string")
    masks = evidence_of({"host_receptors": frame(spark, [("h",)], "host_genome_id string")})
    out = mask_coverage(assays, "phage_id", "host_id", masks, coverage_metrics())
    assert {r.evidence_state for r in out.collect()} == {"not_assessed"}
    pair_rows = out.filter("entity_level = 'pair'")
    assert len(re.findall(r"\bJoin ", pair_rows._jdf.queryExecution().analyzed().toString())) == 2 * 3  # two for each of the three levels

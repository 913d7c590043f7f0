"""Bound queries against their SQL on the smallest tables; EVI_ALL=1 runs every one."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "missing_and_informative_values", "slugs_and_ids_parts", "hash_ids_customers", "number_parsing_lineitem", "rule_cascades_parts",
    "bins_and_intervals_customers", "delimited_scan_customers", "fasta_scan_documents", "genbank_cds_lineitem", "table_commit_customers",
    "manifest_validation_orders", "assay_validation_events", "relationship_validation_orders", "lookup_last_wins_lineitem",
    "entity_resolution_orders", "patch_merge_suppliers", "compatibility_sets_events", "match_proposals_customers", "scorecard_documents",
    "neighbor_context_lineitem", "interval_union_suppliers", "dereplicate_documents", "group_rates_orders", "coverage_gate_events",
    "feature_set_grid_documents", "matrix_unpivot_events", "canonical_union_entities", "requirement_unlock_customers", "gene_clusters_lineitem",
]
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("EVI_ALL") else QUICK)
def test_query_matches_sql(spark, con, name):
    ok, said = compare(spark, con, SF, entry.queries()[name], SQL[name])
    assert ok, said


def test_entry_runs(spark):
    assert not entry.entry(spark).isEmpty()


def test_every_query_has_a_plain_name():
    assert all(n.replace("_", "").isalnum() and ("pipeline" not in n or n == "pipeline") for n in entry.queries())

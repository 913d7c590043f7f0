"""What the third round's findings named: each test failed before its fix."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from evispark.bindings.base import REGISTRY
import __spark_entry__  # noqa: F401  (fills the registry)


def sql(name: str, **tables: str) -> list[tuple]:
    """The SQL of a bound query over tables given as SQL."""
    con = duckdb.connect()
    for table, text in tables.items():
        con.execute(f"CREATE TABLE {table} AS {text}")
    return con.execute(REGISTRY[name][1]).fetchall()


def test_sql_numbers_wider_than_their_padding():
    parts = "SELECT i AS p_partkey, 'b' AS p_brand, 'n' AS p_name, 'PROMO' AS p_type, 1 AS p_size FROM range(1, {}) t(i)"
    ids = [r[1] for r in sql("ordinal_ids_parts", part=parts.format(100_003))]
    assert len(set(ids)) == len(ids) and {"part_00001", "part_99999", "part_100002"} <= set(ids)


def test_sql_numbers_of_clusters_wider_than_their_padding():
    n = 100_500
    orders = f"""SELECT (i * 8 + 1)::BIGINT AS o_orderkey, i::BIGINT AS o_custkey, 'F' AS o_orderstatus, 100.0::DOUBLE AS o_totalprice,
      TIMESTAMP '2020-01-01' AS o_orderdate, 'x' AS o_orderpriority FROM range({n * 2}) t(i) WHERE (i * 8 + 1) % 13 > 0 AND (i * 8 + 1) % 17 > 0 LIMIT {n}"""
    lines = "SELECT 0::BIGINT AS l_orderkey, 0::BIGINT AS l_partkey, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_quantity WHERE false"
    for name, at in (("dereplicated_clusters_orders", 1), ("dereplicated_representatives_orders", 0)):
        ids = [r[at] for r in sql(name, orders=orders, lineitem=lines)]
        assert len(set(ids)) == len(ids) == n and {"kp_phage_species_00001", "kp_phage_species_100500"} <= set(ids)


def test_sql_numbers_of_defense_rows_wider_than_their_padding():
    parts = "SELECT 19 * i + 1 AS p_partkey, 'NONE' AS p_type, 1 AS p_size FROM range(1000003) t(i)"
    ids = [r[0] for r in sql("host_defense_rows_parts", part=parts, supplier="SELECT 1 AS s_suppkey")]
    assert len(set(ids)) == len(ids) and {"host_defense_000001", "host_defense_1000003"} <= set(ids)


def test_sql_of_interval_union_leaves_no_tie_to_chance():
    """Every interval a thousand times: two windows over rows that tie may order them differently."""
    lines = "SELECT 1 + i % 3 AS l_suppkey, 1 + i % 2000 * 7 AS l_partkey, 2 AS l_linenumber, (1 + i % 5)::DOUBLE AS l_quantity FROM range({}) t(i)"
    once, often = (sorted(sql("interval_union_suppliers", lineitem=lines.format(n))) for n in (30_000, 3_000_000))
    assert once == often == [(1, 7050), (2, 7050), (3, 7050)]


def test_negative_values_that_round_to_zero_keep_their_sign(spark):
    from evispark.functions.numbers import fmt

    values = [-0.049, -0.04, 0.04, -0.06, 0.0, -0.0, -1.25, 2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", fmt("v", 1).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_annotations_carry_only_columns_in_use(spark):
    """The rows that are shuffled hold nothing the caller does not read; issues need no annotation at all."""
    from evispark.plans import genes as plan

    rows = [("r1", "G1", "g", "portal protein", "MK"), ("r2", "G1", "g", "capsule lyase", ""), ("r3", "G9", "g", "portal protein", "M"), ("r4", "", "g", "x", "")]
    genes = spark.createDataFrame(rows, "row_number string, genome_id string, gene_id string, product string, protein_sequence string")
    clusters = spark.createDataFrame([("G1", "C1", "R1")], "genome_id string, cluster_id string, representative_id string")
    manifest = spark.createDataFrame([("r", "G1", "phage")], "row_number string, genome_id string, record_type string")
    few = plan.annotate(genes, manifest, clusters, columns=["protein_length_aa"])["annotations"]
    whole = plan.annotate(genes, manifest, clusters)["annotations"]
    assert "protein_sequence" not in few.columns and "record_type" not in few.columns
    assert sorted(few.collect()) == sorted(whole.select(*few.columns).collect())
    assert [r.annotation_gene_id for r in few.orderBy("annotation_gene_id").collect()] == ["G1|g", "G1|g|duplicate_r2"]
    issues = plan.annotation_issues(genes, clusters)
    assert sorted(r.message for r in issues.collect()) == ["row without genome_id or gene_id", "skipped 1 rows whose genome is not clustered"]


def test_parsed_numbers_are_worked_out_once_per_row(spark):
    """The text of a parsed number stands once in the plan, not in every check that reads it."""
    from evispark.operators.validation import validate_hits

    df = spark.createDataFrame([("g", "PDB", "0.5", "88"), ("g", "PDB", "7", "high")], "annotation_gene_id string, structural_hit_id string, tm_score string, probability string")
    good, bad = validate_hits(df, "structural")
    assert [(r.tm_score, r.probability) for r in good.collect()] == [(0.5, 0.88)]
    assert sorted(r.message for r in bad.collect()) == ["probability: not_numeric: high", "tm_score: above_maximum: 7"]
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("try_cast") <= 4


def test_rows_without_a_path_are_dealt_out(spark):
    """Most records name no sequence file; they were one key of a join and so one task."""
    from evispark.plans.records import with_files

    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).when(F.col("id") % 2 == 0, "").alias("raw_sequence_path"))
    files = spark.createDataFrame([("p0",), ("p100",), ("",)], "path string")
    fixed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        out = with_files(rows, files).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == 2000 and sorted(r.id for r in out if r._path is not None) == [0, 100]
    sizes = [sum(r.at == i for r in out) for i in range(8)]
    assert max(sizes) < 500


def test_host_tables_do_not_pass_through_the_driver(spark):
    """Hosts take little room when stored and much in memory; their joins are shuffles at any stored size."""
    from evispark.plans.hosts import integrate_hosts

    names = ["genome_id", "record_type", "accession", "source", "isolation_host", "host_species", "host_strain", "country", "year", "K_type", "O_type", "ST", "AMR_markers", "virulence_markers"]
    rows = [(1, "G1", "host", "", "", "", "sp", "st", "", "", "K1", "", "", "", ""), (2, "G2", "phage", "", "G1", "", "", "", "", "", "", "", "", "", ""), (3, "G3", "phage", "", "", "", "sp", "st", "", "", "", "", "", "", "")]
    manifest = spark.createDataFrame(rows, "row_number long, " + ", ".join(f"{n} string" for n in names))
    clusters = spark.createDataFrame([("G2", "C1", "R1"), ("G3", "C1", "R1")], "genome_id string, cluster_id string, representative_id string")
    made = integrate_hosts(manifest, clusters)
    assert [(r.host_genome_id, r.linked_phage_count, r.linked_species_cluster_count) for r in made["hosts"].collect()] == [("G1", 2, 1)]
    plan = made["links"]._jdf.queryExecution().executedPlan().toString()
    held = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("resolved_id" in line or "genome_id" in line) and "_j_" not in line]
    assert not held


def test_words_of_a_document_are_split_once(spark):
    df = REGISTRY["split_values_documents"][0](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_numbers_of_edges_are_parsed_once(spark):
    """A percentage stood in the plan once per check and note that read it."""
    from evispark.operators.graph import score_edges

    rows = [("a", "b", "99", 90.0), ("a", "b", "n/a", 90.0), ("a", "z", "99", float("nan")), ("a", "b", "NaN", 10.0), ("a", "b", "inf", float("inf"))]
    edges = spark.createDataFrame(rows, "genome_id_1 string, genome_id_2 string, identity_percent string, coverage_percent double")
    out = score_edges(edges, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert out.columns == [*edges.columns, "passes_threshold", "included_in_clustering", "notes"]
    assert sorted((r.passes_threshold, r.included_in_clustering, r.notes) for r in out.collect()) == [
        (False, False, "invalid coverage_percent; one or both ids are not eligible"), (False, False, "invalid identity_percent"),
        (False, False, "invalid identity_percent"), (True, True, "OK"), (True, True, "OK"),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("try_cast") + out._jdf.queryExecution().optimizedPlan().toString().count(" RLIKE ") <= 4


def test_texts_of_annotations_are_searched_once(spark):
    """The module rules stood in the plan once per counter-defense rule; counts carried the columns of the gene clusters."""
    from evispark.functions import rules as R
    from evispark.plans import genes as plan
    from evispark.plans.hosts import infer_antidefense

    rows = [("r1", "G1", "g", "anti-CRISPR protein", "MK", "12.7"), ("r2", "G1", "h", "x", "M K", "-1"), ("r3", "G1", "i", "x", "", "-0.5"), ("r4", "G1", "j", "x", "MKL", "inf")]
    genes = spark.createDataFrame(rows, "row_number string, genome_id string, gene_id string, product string, protein_sequence string, protein_length_aa string")
    clusters = spark.createDataFrame([("G1", "C1", "R1")], "genome_id string, cluster_id string, representative_id string")
    manifest = spark.createDataFrame([("r", "G1", "phage")], "row_number string, genome_id string, record_type string")
    read = ["row_number", "genome_id", "annotation_gene_id", "gene_id", "product", "functional_category", "module_hint"]
    said = infer_antidefense(plan.annotation_rows(genes, manifest, clusters, columns=read))
    assert [r.annotation_gene_id for r in said.collect()] == ["G1|g"]
    assert said._jdf.queryExecution().optimizedPlan().toString().count(R.MODULE_RULES[0][1]) == 1
    made = plan.annotate(genes, manifest, clusters, columns=["protein_length_aa"], summary=False)
    assert "gene_clusters" not in made and not {"product", "module_hint", "gene_cluster_source"} & set(made["annotations"].columns)
    assert {r.annotation_gene_id: r.protein_length_aa for r in made["annotations"].collect()} == {"G1|g": 12, "G1|h": 2, "G1|i": 0, "G1|j": 3}
    whole = plan.annotate(genes, manifest, clusters)
    assert sorted(made["pangenome"].collect()) == sorted(whole["pangenome"].collect())


def test_genbank_text_is_staged_small(spark):
    """The flat file is many times as large as the rows it is made of."""
    df = REGISTRY["genbank_cds_lineitem"][0](spark, "/root/testdata/sf0.001")
    staged = [f for f in df.inputFiles() if "orders.gb" in f]
    assert staged and all(f.endswith(".gz") for f in staged)

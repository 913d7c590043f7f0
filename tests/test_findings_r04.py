"""What the fourth round's findings named: each test failed before its fix."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import DataFrame, functions as F

from evispark.bindings.base import REGISTRY, clusters, genes, manifest
from evispark.plans.genes import annotate, find_candidates
from evispark.session import Scratch, cut_lineage
import __spark_entry__  # noqa: F401  (fills the registry)


def against_sql(spark, folder, name: str, **tables: DataFrame) -> tuple[list, list]:
    """Rows of a bound query and of its SQL over the given tables, in order."""
    con = duckdb.connect()
    for table, df in tables.items():
        path = str(folder / f"{table}.parquet")
        df.write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    query, sql = REGISTRY[name]
    got = query(spark, str(folder))
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    return sorted(map(repr, map(tuple, got.select(*columns).collect()))), sorted(map(repr, want.fetchall()))


def test_composition_of_letters_that_upper_case_to_several(spark, tmp_path):
    """Every character on its own between two bases, and texts that read as missing values."""
    odd = ["", "NA", " na ", "-", "None", "\u00a0", " \t\n", "a b\u000bc", None, "acgtnACGTN", "stra\u00dfe STRA\u1e9eE", "\ufb01n \ufb06 \u1e97 \u0149"]
    one = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343").select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"), F.lit("n")).alias("text"))
    documents = one.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    got, want = against_sql(spark, tmp_path, "base_composition_documents", documents=documents)
    assert len(got) == 63487 + len(odd)
    assert got == want


def shuffle_blocks(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The disk holds what one step shuffles, not what all of them did."""
    before = shuffle_blocks(spark)
    with Scratch(spark) as scratch:
        for make in (cut_lineage, scratch.table):
            written = make(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count())
            assert written.agg(F.sum("count")).first()[0] == 10_000
    written = None
    for _ in range(50):  # files go in the background
        if shuffle_blocks(spark) <= before + 10:  # those of the two sums, which were only read
            break
        time.sleep(0.2)
    assert shuffle_blocks(spark) <= before + 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_candidates_are_the_same_when_only_columns_in_use_move(spark):
    sf = "/root/testdata/sf0.001"
    shown = ["candidate_id", "annotation_gene_id", "gene_cluster_id", "predicted_enzyme_class", "evidence_types", "confidence_score", "novelty_tier", "sequence_hit", "notes"]
    found = []
    for columns in (None, shown):
        made = annotate(genes(spark, sf), manifest(spark, sf), clusters(spark, sf))
        rows = made["annotations"] if columns is None else made["keyed"]
        hits = rows.filter("start % 9 = 0").select("annotation_gene_id", F.lit("PF1").alias("domain_id"), "product", F.lit(1).alias("start_aa"), F.lit("x").alias("evidence_source"))
        out = find_candidates(rows, made["gene_clusters"], hits.withColumnRenamed("product", "domain_name"), columns=columns)["candidates"]
        found.append(sorted(map(tuple, out.select(*shown).collect())))
    assert len(found[0]) > 500 and found[0] == found[1]


def test_counter_defense_texts_are_searched_once(spark):
    """Every count and list of names searched the texts of all genes again; a number was stripped six times before it was parsed."""
    from evispark.functions import rules as R
    from evispark.functions.numbers import to_int
    from evispark.plans.hosts import integrate_defense

    links = spark.createDataFrame([("G1", "H1", "K1", "")], "phage_genome_id string, host_genome_id string, K_type string, O_type string")
    rows = [("r1", "G1", "G1|g", "g", "anti-CRISPR protein", "", "other"), ("r2", "G1", "G1|h", "h", "portal protein", "", "other")]
    told = spark.createDataFrame(rows, "row_number string, genome_id string, annotation_gene_id string, gene_id string, product string, functional_category string, module_hint string")
    out = integrate_defense(links, links.select("host_genome_id"), told)["compatibility"]
    assert [(r.phage_antidefense_count, r.phage_antidefense_targets) for r in out.collect()] == [(1, "CRISPR-Cas")]
    assert R.ANTIDEFENSE_RULES[0][2] not in out._jdf.queryExecution().optimizedPlan().toString()
    texts = [" 12 ", "1e3", "-", "NA", None, "12d", "nan", "inf", "-0.9", "7.9"]
    numbers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", to_int("t").alias("n"))
    assert [r.n for r in numbers.orderBy("i").collect()] == [12, 1000, None, None, None, None, None, None, 0, 7]
    assert numbers._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 2

"""Readers, writers and file checks on texts that Spark writes from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import PRODUCTS, pick, register, sql_pick, table
from evispark.session import scratch_path
from evispark.sources.delimited import check_schema, read_delimited, read_domtblout, read_json_map, read_optional, read_records
from evispark.sources.files import drift_status, file_digests, inventory, list_files, table_drift, verify_files
from evispark.sources.sequences import extract_cds, fasta_problems, read_fasta, write_fasta
from evispark.sources.sinks import commit_tables, write_delimited


@register(
    "delimited_scan_customers",
    "SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer",
)
def _delimited(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(F.col("c_name"), F.lit("  ")).alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    path = scratch_path(spark, "customers.csv")
    padded.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_delimited(spark, path, with_order=True).drop("_order")


@register(
    "delimited_sink_orders",
    "SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS priority, '' AS note, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders",
)
def _sink(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.lit("dropped").alias("extra"),
    )
    path = scratch_path(spark, "orders")
    write_delimited(o, path, ["key", "priority", "note", "status"])
    return read_delimited(spark, path, "tab")


@register(
    "optional_scan_customers",
    "SELECT c_mktsegment AS segment, count(*) AS found_rows, 0::BIGINT AS absent_rows, 'warning' AS absent_severity FROM customer GROUP BY 1",
)
def _optional(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customers")
    write_delimited(table(spark, sf, "customer"), path, ["c_custkey", "c_mktsegment"])
    there, _ = read_optional(spark, path, ["c_custkey", "c_mktsegment"], delimiter="tab")
    absent, issues = read_optional(spark, path + "-absent", ["c_custkey", "c_mktsegment"], delimiter="tab")
    counts = there.withColumn("n", F.lit(1)).unionByName(absent.withColumn("n", F.lit(0)))
    severity = issues.first()["severity"]  # one row
    return (
        counts.groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.sum("n").alias("found_rows"), F.count_if(F.col("n") == 0).alias("absent_rows"))
        .withColumn("absent_severity", F.lit(severity))
    )


@register(
    "schema_gate_tables",
    """SELECT 'orders' AS table_name, count(*) AS rows, 'pass' AS schema_status, '' AS missing_columns FROM orders
    UNION ALL SELECT 'customer', count(*), 'fail', 'c_country;any_of:c_phone|c_email' FROM customer
    UNION ALL SELECT 'supplier', count(*), 'not_checked', '' FROM supplier""",
)
def _schema(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, all_of, any_of, checked in (
        ("orders", ["o_orderkey"], [["o_custkey", "o_clerk"]], True),
        ("customer", ["c_custkey", "c_country"], [["c_phone", "c_email"]], True),
        ("supplier", ["s_suppkey"], [], False),
    ):
        df = table(spark, sf, name)
        verdict = check_schema(df if checked else None, all_of, any_of, spark).withColumn("table_name", F.lit(name))
        rows = df.agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        part = rows.unionByName(verdict, allowMissingColumns=True)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table_name").agg(*[F.max(c).alias(c) for c in ("rows", "schema_status", "missing_columns")])


@register(
    "record_scan_events",
    """SELECT event_type, CASE WHEN event_type = 'error' THEN 'malformed' ELSE 'record' END AS kind, count(*) AS rows,
      CASE WHEN event_type <> 'error' THEN sum(user_id)::BIGINT END AS user_sum FROM events GROUP BY event_type""",
)
def _records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    fields = F.when(F.col("event_type") == "error", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type")).otherwise(
        F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    )
    path = scratch_path(spark, "events.txt")
    note = F.concat(F.lit("# event "), F.col("event_id").cast("string"))
    e.select(F.explode(F.array(note, fields)).alias("value")).write.text(path)
    good, bad = read_records(spark, path, ["event_id", "user_id", "event_type"], ["query", "target"])
    return (
        good.groupBy("event_type")
        .agg(F.count("*").alias("rows"), F.sum(F.col("user_id").cast("bigint")).alias("user_sum"))
        .withColumn("kind", F.lit("record"))
        .unionByName(
            bad.groupBy(F.substring_index("line", " ", -1).alias("event_type"))
            .agg(F.count("*").alias("rows"), F.lit(None).cast("bigint").alias("user_sum"))
            .withColumn("kind", F.lit("malformed"))
        )
    )


@register(
    "domtblout_scan_parts",
    """SELECT 'P' || p_partkey AS annotation_gene_id, CASE WHEN p_size % 2 = 0 THEN 'PF' || p_size ELSE p_type END AS domain_id, p_type AS domain_name,
      p_size::VARCHAR AS start_aa, (p_size + 90)::VARCHAR AS end_aa, '1e-' || p_size AS evalue, 'hmmsearch' AS mode FROM part
    UNION ALL SELECT p_type, 'P' || p_partkey, p_name, p_size::VARCHAR, (p_size + 90)::VARCHAR, '1e-' || p_size, 'hmmscan' FROM part""",
)
def _domtblout(spark: SparkSession, sf: str) -> DataFrame:
    p, size = table(spark, sf, "part"), F.col("p_size").cast("string")
    accession = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("PF"), size)).otherwise("-")
    filler = [F.lit("0")] * 6
    fields = [
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.lit("-"), F.lit("300"), F.col("p_type"), accession, *filler, F.lit("1"),
        F.concat(F.lit("1e-"), size), F.lit("9"), F.lit("0.1"), F.lit("1"), F.lit("90"), size, (F.col("p_size") + 90).cast("string"),
        F.lit("1"), F.lit("99"), F.lit("0.95"), F.col("p_name"),
    ]
    path = scratch_path(spark, "hits.domtblout")
    p.select(F.explode(F.array(F.lit("# target accession tlen"), F.concat_ws("   ", *fields))).alias("value")).write.text(path)
    out = None
    for mode in ("hmmsearch", "hmmscan"):
        hits, _ = read_domtblout(spark, path, mode)
        hits = hits.withColumn("mode", F.lit(mode))
        out = hits if out is None else out.unionByName(hits)
    return out


def _letters() -> F.Column:
    return F.regexp_replace("text", "[^A-Za-z]", "")


@register(
    "fasta_scan_documents",
    """SELECT 'doc' || doc_id || ' lang=' || lang AS header, length(s)::INT AS length, md5(s) AS digest, 0::BIGINT AS problem_files
    FROM (SELECT doc_id, lang, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents) WHERE s NOT IN ('', 'NA', 'na', 'None', 'none')""",
)
def _fasta(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("s", _letters())
    path = scratch_path(spark, "documents.fna")
    header = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" lang="), "lang")
    write_fasta(d, path, header, "s")
    problems = fasta_problems(spark, path).count()
    return read_fasta(spark, path).select(
        "header", F.length("sequence").alias("length"), F.md5(F.col("sequence").cast("binary")).alias("digest"), F.lit(problems).cast("bigint").alias("problem_files")
    )


@register(
    "fasta_sink_line_widths",
    """SELECT lang, count(*) AS headers, sum(ceil(length(s) / 80.0))::BIGINT AS sequence_lines, max(least(length(s), 80))::INT AS longest_line
    FROM (SELECT lang, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents) WHERE s NOT IN ('', 'NA', 'na', 'None', 'none') GROUP BY lang""",
)
def _fasta_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("s", _letters())
    path = scratch_path(spark, "by_lang")
    write_fasta(d, path, F.col("doc_id").cast("string"), "s", by="lang")
    lines = spark.read.text(path)
    head = F.col("value").startswith(">")
    out = lines.groupBy("lang").agg(
        F.count_if(head).alias("headers"),
        F.count_if(~head).alias("sequence_lines"),
        F.max(F.when(~head, F.length("value"))).alias("longest_line"),
    )
    return out


@register(
    "genbank_cds_lineitem",
    f"""SELECT contig_id, gene_id, greatest(s, rs) - rs + 1 AS "start", least(e, re) - rs + 1 AS "end", strand, product, functional_category, length(seq)::INT AS protein_length_aa
    FROM (SELECT 'L' || l_orderkey || '.' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || l_quantity::INT AS contig_id,
        'locus_' || l_suppkey AS gene_id, l_partkey + 1 AS s, l_partkey + 1 + l_quantity::BIGINT * 3 AS e, l_suppkey * 2 AS rs, l_suppkey * 2 + 900 AS re,
        CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, {sql_pick(PRODUCTS, 'l_partkey')} AS product, upper(md5(l_partkey::VARCHAR)) AS seq,
        CASE l_partkey % 16 WHEN 0 THEN 'rbp_depolymerase' WHEN 1 THEN 'rbp_depolymerase' WHEN 2 THEN 'structural' WHEN 3 THEN 'lysis' WHEN 4 THEN 'replication' WHEN 5 THEN 'lysogeny'
          WHEN 6 THEN 'defense_counterdefense' WHEN 7 THEN 'unknown' WHEN 8 THEN 'structural' WHEN 9 THEN 'rbp_depolymerase' WHEN 10 THEN 'defense_counterdefense' WHEN 14 THEN 'defense_counterdefense' ELSE 'other' END AS functional_category
      FROM lineitem) WHERE e >= rs AND s <= re""",
)
def _genbank(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")

    def txt(c: str) -> F.Column:
        return F.col(c).cast("string")

    contig = F.concat(
        F.lit("L"), txt("l_orderkey"), F.lit("."), txt("l_linenumber"), F.lit("_"), txt("l_partkey"), F.lit("_"), txt("l_suppkey"), F.lit("_"),
        F.col("l_quantity").cast("int").cast("string"),
    )
    start, end = (F.col("l_partkey") + 1).cast("string"), (F.col("l_partkey") + 1 + F.col("l_quantity").cast("bigint") * 3).cast("string")
    span = F.concat(start, F.lit(".."), end)
    place = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
    seq = F.upper(F.md5(txt("l_partkey").cast("binary")))
    pad = " " * 21
    record = F.concat(
        F.lit("LOCUS       x\nVERSION     "), contig, F.lit("\nFEATURES             Location/Qualifiers\n     source          1..9\n     CDS             "),
        place, F.lit(f'\n{pad}/locus_tag="locus_'), txt("l_suppkey"), F.lit(f'"\n{pad}/product="'), pick(PRODUCTS, F.col("l_partkey")),
        F.lit(f'"\n{pad}/translation="'), F.substring(seq, 1, 20), F.lit(f"\n{pad}"), F.substring(seq, 21, 40),
        F.lit('"\n     gene            1..5\nORIGIN\n        1 acgt\n//'),
    )
    path = scratch_path(spark, "orders.gb")
    # Flat files are mostly fixed text, and a compressed file is read whole by one task: many small ones.
    li.select(record.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(path)
    regions = li.select(contig.alias("contig_id"), (F.col("l_suppkey") * 2).alias("region_start"), (F.col("l_suppkey") * 2 + 900).alias("region_end"))
    cds = extract_cds(spark, path, regions)
    return cds.select("contig_id", "gene_id", "start", "end", "strand", "product", "functional_category", "protein_length_aa")


@register(
    "json_map_scan_events",
    """SELECT 'U' || user_id AS id, 0 AS item_no, event_type AS item FROM events UNION ALL SELECT 'U' || user_id, 2, 'k=' || json_extract_string(props, '$.k') FROM events""",
)
def _json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    items = F.array("event_type", F.lit("NA"), F.concat(F.lit(" k="), F.get_json_object("props", "$.k")))
    path = scratch_path(spark, "events.json")
    e.select(F.to_json(F.create_map(F.concat(F.lit("U"), F.col("user_id").cast("string")), items)).alias("value")).write.text(path)
    return read_json_map(spark, path, per_line=True)


@register(
    "table_commit_customers",
    """SELECT 'second' AS version, c_mktsegment AS segment, count(*) AS rows FROM customer GROUP BY 2
    UNION ALL SELECT 'kept', c_mktsegment, count(*) FROM customer WHERE c_acctbal < 0 GROUP BY 2""",
)
def _commit(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    a, b = scratch_path(spark, "customers"), scratch_path(spark, "debtors")
    commit_tables({a: c.limit(1), b: c.filter("c_acctbal < 0")}, {b: ["c_custkey", "c_mktsegment"]})
    commit_tables({a: c, b: c.filter("c_acctbal < -1e12")}, {b: ["c_custkey", "c_mktsegment"]}, keep_existing=True)
    second = spark.read.parquet(a).groupBy(F.lit("second").alias("version"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("rows"))
    kept = read_delimited(spark, b, "tab").groupBy(F.lit("kept").alias("version"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("rows"))
    return second.unionByName(kept)


@register(
    "file_integrity_documents",
    """SELECT lang, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, true AS all_verified, true AS all_mismatch_found FROM documents GROUP BY lang""",
)
def _integrity(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "documents")
    table(spark, sf, "documents").select("text", "lang").write.partitionBy("lang").text(root)
    files = list_files(spark, root).filter(F.col("path").contains("lang="))
    digests = file_digests(spark, root, files.select("path"))
    manifest = digests.select(
        F.explode(F.array(F.lit("good"), F.lit("bad"))).alias("kind"), "path", "observed_size", "observed_sha256"
    ).select(
        F.concat_ws(":", "kind", "path").alias("entity_id"),
        *[F.lit("x").alias(c) for c in ("accession", "database", "source_version", "retrieval_command")],
        F.lit("2024-01-31").alias("retrieved_at"),
        F.col("path").alias("expected_path"),
        F.col("observed_size").cast("string").alias("file_size"),
        F.when(F.col("kind") == "good", F.col("observed_sha256")).otherwise(F.sha2(F.lit("other"), 256)).alias("sha256"),
        F.lit("reviewed").alias("review_status"),
    )
    checked = verify_files(spark, manifest, root, "lang=")
    good = F.col("entity_id").startswith("good")
    return checked.groupBy(F.regexp_extract("expected_path", "lang=([^/]+)", 1).alias("lang")).agg(
        F.sum(F.when(good, F.col("observed_size"))).alias("bytes"),
        F.min(~good | (F.col("status") == "checksum_verified")).alias("all_verified"),
        F.min(good | (F.col("status") == "sha256_mismatch")).alias("all_mismatch_found"),
    )


@register("output_inventory_customers", "SELECT c_mktsegment AS segment, count(*) AS rows, false AS any_empty FROM customer GROUP BY 1")
def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "segments")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.partitionBy("c_mktsegment").csv(root, sep="\t", header=True)
    found = inventory(spark, root).filter(F.col("path").contains("c_mktsegment="))
    return found.groupBy(F.regexp_extract("path", "c_mktsegment=([^/]+)", 1).alias("segment")).agg(
        F.sum("row_count").alias("rows"), F.max("is_empty").alias("any_empty")
    )


_PERTURBED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 50 <> 3"""


@register(
    "table_drift_orders",
    f"""WITH p AS ({_PERTURBED}), u AS (SELECT o_orderkey, o_custkey, o_orderstatus, 1 AS e, 0 AS a FROM orders UNION ALL SELECT *, 0, 1 FROM p)
    SELECT o_orderkey, o_custkey, o_orderstatus, sum(e)::BIGINT AS expected_count, sum(a)::BIGINT AS actual_count FROM u GROUP BY 1, 2, 3 HAVING sum(e) <> sum(a)""",
)
def _drift(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return table_drift(o, _perturbed(o))


def _perturbed(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return o.filter(k % 50 != 3).withColumn("o_orderstatus", F.when(k % 100 == 7, "X").otherwise(F.col("o_orderstatus")))


@register(
    "table_drift_status_orders",
    f"""WITH p AS ({_PERTURBED}), u AS (SELECT o_orderkey, o_custkey, o_orderstatus, 1 AS e, 0 AS a FROM orders UNION ALL SELECT *, 0, 1 FROM p),
      d AS (SELECT 1 FROM u GROUP BY o_orderkey, o_custkey, o_orderstatus HAVING sum(e) <> sum(a))
    SELECT 'perturbed' AS import_id, 'manifest_drift' AS status, count(*) AS drift_rows FROM d
    UNION ALL SELECT 'same', 'in_sync', 0 UNION ALL SELECT 'absent', 'manifest_missing', NULL UNION ALL SELECT 'off', 'disabled_not_checked', NULL""",
)
def _drift_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = None
    for name, actual, enabled in (("perturbed", _perturbed(o), True), ("same", o, True), ("absent", None, True), ("off", o, False)):
        part = drift_status(o, actual, enabled).withColumn("import_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

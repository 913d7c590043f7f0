"""Driver tables and the tables derived from them, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

MISS = "('', 'NA', 'N/A', 'na', 'n/a', 'None', 'none', '-')"
BARE = "('', 'NA', 'N/A', 'na', 'n/a', 'None', 'none')"

# Product names that touch every rule of the rule tables.
PRODUCTS = [
    "tail fiber protein",
    "tailspike depolymerase",
    "portal protein",
    "endolysin",
    "DNA polymerase",
    "integrase",
    "anti-CRISPR protein AcrIF1",
    "hypothetical protein",
    "baseplate wedge",
    "capsule lyase",
    "restriction alleviation protein",
    "Rad52 recombinase",
    "toxin of a TA system",
    "retron reverse transcriptase",
    "Zorya nuclease",
    "unnamed gene product",
]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as it is stored."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(items: list[str], index: F.Column) -> F.Column:
    """An item by position, wrapping around."""
    return F.get(F.array(*[F.lit(i) for i in items]), (index % len(items)).cast("int"))


def sql_pick(items: list[str], index: str) -> str:
    quoted = ", ".join("'" + i + "'" for i in items)
    return f"([{quoted}])[({index}) % {len(items)} + 1]"


def line_order(lines: DataFrame) -> F.Column:
    """A text that orders line items and is unique: order, line, part, supplier, quantity, price."""
    return F.concat(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 10, "0"),
        F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0"),
    )


LINE_ORDER = (
    "lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 2, '0') || lpad(l_partkey::VARCHAR, 10, '0') "
    "|| lpad(l_suppkey::VARCHAR, 10, '0') || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0')"
)


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as genes: an order is a genome, a line a gene; repeated line numbers stay."""
    li = table(spark, sf, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        line_order(li).alias("row_number"),
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("genome_id"),
        F.concat(F.lit("g"), F.col("l_linenumber").cast("string")).alias("gene_id"),
        pick(PRODUCTS, part).alias("product"),
        part.cast("string").alias("start"),
        (part + F.col("l_quantity").cast("bigint")).cast("string").alias("end"),
        F.when(supp % 3 == 0, F.concat(F.lit("phrog_"), (supp % 40).cast("string"))).otherwise("NA").alias("phrog_id"),
        F.when(part % 5 == 0, "structural").otherwise("").alias("functional_category"),
        F.when(part % 4 != 0, F.upper(F.md5(part.cast("string").cast("binary")))).otherwise("").alias("protein_sequence"),
        F.when(part % 3 == 0, (F.col("l_quantity").cast("bigint") * 10).cast("string")).otherwise("NA").alias("protein_length_aa"),
    )


GENES = f"""genes AS (
  SELECT {LINE_ORDER} AS row_number, 'G' || l_orderkey AS genome_id, 'g' || l_linenumber AS gene_id,
    {sql_pick(PRODUCTS, 'l_partkey')} AS product, l_partkey::VARCHAR AS "start",
    (l_partkey + l_quantity::BIGINT)::VARCHAR AS "end",
    CASE WHEN l_suppkey % 3 = 0 THEN 'phrog_' || (l_suppkey % 40) ELSE 'NA' END AS phrog_id,
    CASE WHEN l_partkey % 5 = 0 THEN 'structural' ELSE '' END AS functional_category,
    CASE WHEN l_partkey % 4 <> 0 THEN upper(md5(l_partkey::VARCHAR)) ELSE '' END AS protein_sequence,
    CASE WHEN l_partkey % 3 = 0 THEN (l_quantity::BIGINT * 10)::VARCHAR ELSE 'NA' END AS protein_length_aa
  FROM lineitem)"""


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Open and pending orders are the clustered genomes, grouped by customer."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "F")
    return o.select(
        F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("genome_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cluster_id"),
        F.concat(F.lit("R"), F.col("o_custkey").cast("string")).alias("representative_id"),
    )


CLUSTERS = """clusters AS (
  SELECT 'G' || o_orderkey AS genome_id, 'C' || o_custkey AS cluster_id, 'R' || o_custkey AS representative_id
  FROM orders WHERE o_orderstatus <> 'F')"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records: type by status, host by customer, some fields missing or wrong."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    total = F.round("o_totalprice").cast("bigint")
    return o.select(
        k.alias("row_number"),
        F.when(F.col("o_orderstatus") == "F", "phage").when(F.col("o_orderstatus") == "O", "prophage").otherwise("host").alias("record_type"),
        F.concat(F.lit("G"), k.cast("string")).alias("genome_id"),
        F.when(k % 4 == 0, "NA").otherwise(F.concat(F.lit("ACC"), k.cast("string"))).alias("accession"),
        F.when(k % 6 == 0, F.concat(F.lit("G"), (k + 1).cast("string"))).when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("source"),
        F.when(k % 7 == 0, "Klebsiella").otherwise("NA").alias("isolation_host"),
        F.when(c % 9 == 0, "-").otherwise(F.concat(F.lit("species "), (c % 20).cast("string"))).alias("host_species"),
        F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("strain "), c.cast("string"))).alias("host_strain"),
        F.lit("").alias("country"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(k % 11 == 0, "unknown").when(k % 2 == 0, "virulent").otherwise("temperate").alias("phage_lifestyle"),
        F.when(k % 13 == 0, "-5").otherwise(total.cast("string")).alias("genome_length"),
        F.when(k % 17 == 0, "150").otherwise(F.concat((k % 100).cast("string"), F.lit(".5"))).alias("gc_percent"),
        F.when(c % 3 == 0, F.concat(F.lit("K"), (c % 8).cast("string"))).otherwise("").alias("K_type"),
        F.when(c % 4 == 0, F.concat(F.lit("O"), (c % 5).cast("string"))).otherwise("").alias("O_type"),
        F.when(c % 5 == 0, F.concat(F.lit("ST"), (c % 10).cast("string"))).otherwise("").alias("ST"),
        F.lit("").alias("AMR_markers"),
        F.lit("").alias("virulence_markers"),
        F.when(k % 3 == 0, F.concat(F.lit("raw/"), k.cast("string"), F.lit(".fna"))).otherwise("").alias("raw_sequence_path"),
        F.lit("").alias("notes"),
    )


MANIFEST = """manifest AS (
  SELECT o_orderkey AS row_number,
    CASE o_orderstatus WHEN 'F' THEN 'phage' WHEN 'O' THEN 'prophage' ELSE 'host' END AS record_type,
    'G' || o_orderkey AS genome_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'NA' ELSE 'ACC' || o_orderkey END AS accession,
    CASE WHEN o_orderkey % 6 = 0 THEN 'G' || (o_orderkey + 1) WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS source,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Klebsiella' ELSE 'NA' END AS isolation_host,
    CASE WHEN o_custkey % 9 = 0 THEN '-' ELSE 'species ' || (o_custkey % 20) END AS host_species,
    CASE WHEN o_custkey % 9 = 0 THEN '' ELSE 'strain ' || o_custkey END AS host_strain,
    '' AS country, year(o_orderdate)::VARCHAR AS year,
    CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'virulent' ELSE 'temperate' END AS phage_lifestyle,
    CASE WHEN o_orderkey % 13 = 0 THEN '-5' ELSE round(o_totalprice)::BIGINT::VARCHAR END AS genome_length,
    CASE WHEN o_orderkey % 17 = 0 THEN '150' ELSE (o_orderkey % 100) || '.5' END AS gc_percent,
    CASE WHEN o_custkey % 3 = 0 THEN 'K' || (o_custkey % 8) ELSE '' END AS K_type,
    CASE WHEN o_custkey % 4 = 0 THEN 'O' || (o_custkey % 5) ELSE '' END AS O_type,
    CASE WHEN o_custkey % 5 = 0 THEN 'ST' || (o_custkey % 10) ELSE '' END AS ST,
    CASE WHEN o_orderkey % 3 = 0 THEN 'raw/' || o_orderkey || '.fna' ELSE '' END AS raw_sequence_path
  FROM orders)"""


def sequence_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence paths that exist: those of low order keys in each block of ten."""
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderkey") % 10 < 6).select(
        F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string"), F.lit(".fna")).alias("path")
    )


FILES = "files AS (SELECT 'raw/' || o_orderkey || '.fna' AS path FROM orders WHERE o_orderkey % 10 < 6)"


def assays(spark: SparkSession, sf: str) -> DataFrame:
    """Events as spot tests: a user is a phage, the value picks one of forty hosts."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("row_number"),
        F.concat(F.lit("I"), F.col("event_id").cast("string")).alias("interaction_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("phage_id"),
        F.concat(F.lit("H"), (F.floor("value") % 40).cast("string")).alias("host_id"),
        F.lit("study").alias("study_id"),
        F.concat(F.lit("panel"), (F.col("user_id") % 3).cast("string")).alias("panel_id"),
        F.lit("spot").alias("assay_type"),
        F.when(kind == "signup", "false").otherwise("true").alias("tested"),
        F.when(kind.isin("purchase", "click"), "positive").when(kind == "signup", "not_tested").otherwise("negative").alias("spot_result"),
        F.lit("not_measured").alias("productive_infection_result"),
    )


ASSAYS = """assays AS (
  SELECT event_id AS row_number, 'I' || event_id AS interaction_id, 'U' || user_id AS phage_id,
    'H' || (floor(value)::BIGINT % 40) AS host_id, 'study' AS study_id, 'panel' || (user_id % 3) AS panel_id, 'spot' AS assay_type,
    CASE WHEN event_type = 'signup' THEN 'false' ELSE 'true' END AS tested,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'positive' WHEN event_type = 'signup' THEN 'not_tested' ELSE 'negative' END AS spot_result
  FROM events)"""

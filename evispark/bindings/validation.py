"""Row rules, gates and filters on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import FILES, MANIFEST, manifest, pick, register, sequence_files, sql_pick, table
from evispark.functions import rules as R
from evispark.operators.gates import (
    eligible, export_gate, filter_with_reason, intake_lint, preflight, reason_counts, rows_satisfying,
)
from evispark.operators.validation import (
    duplicates, validate_assays, validate_hits, validate_imported, validate_relationships,
)
from evispark.plans.records import build_manifest, run_sequence_qc

_LIFE = "phage_lifestyle NOT IN ('virulent', 'temperate', 'ambiguous', 'NA', '')"
_RULES = f"""[
  CASE WHEN copies > 1 THEN 'error:genome_id:genome_id must be unique' END,
  CASE WHEN {_LIFE} THEN 'warning:phage_lifestyle:phage_lifestyle should be virulent, temperate, ambiguous, or NA' END,
  CASE WHEN genome_length::BIGINT <= 0 THEN 'error:genome_length:genome_length must be a positive integer' END,
  CASE WHEN gc_percent::DOUBLE > 100 THEN 'error:gc_percent:gc_percent must be between 0 and 100' END,
  CASE WHEN raw_sequence_path <> '' AND NOT has_file THEN 'warning:raw_sequence_path:raw_sequence_path is provided but does not exist' END]"""
CHECKED = f"""{MANIFEST}, {FILES}, twice AS (SELECT * FROM manifest UNION ALL SELECT * FROM manifest WHERE record_type = 'host' AND accession = 'NA'),
  counted AS (SELECT t.*, count(*) OVER (PARTITION BY genome_id) AS copies, raw_sequence_path IN (SELECT path FROM files) AS has_file FROM twice t),
  checked AS (SELECT *, list_filter({_RULES}, lambda x: x IS NOT NULL) AS found FROM counted)"""


def _twice(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    return m.unionByName(m.filter((F.col("record_type") == "host") & (F.col("accession") == "NA")))


@register(
    "manifest_validation_orders",
    f"""WITH {CHECKED} SELECT genome_id, record_type, has_file AS raw_sequence_exists,
      CASE WHEN len(list_filter(found, lambda x: starts_with(x, 'error'))) > 0 THEN 'exclude' ELSE 'pass' END AS validation_status,
      CASE WHEN len(found) = 0 THEN 'OK' ELSE array_to_string(found, '; ') END AS validation_messages FROM checked""",
)
def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _ = build_manifest(_twice(spark, sf), sequence_files(spark, sf))
    return rows.select("genome_id", "record_type", "raw_sequence_exists", "validation_status", "validation_messages")


@register(
    "manifest_issue_rows_orders",
    f"""WITH {CHECKED} SELECT genome_id, split_part(x, ':', 1) AS severity, split_part(x, ':', 2) AS field, split_part(x, ':', 3) AS message
    FROM (SELECT genome_id, unnest(found) AS x FROM checked)""",
)
def _manifest_issues(spark: SparkSession, sf: str) -> DataFrame:
    return build_manifest(_twice(spark, sf), sequence_files(spark, sf))[1].select("genome_id", "severity", "field", "message")


@register(
    "manifest_excluded_orders",
    f"WITH {CHECKED} SELECT genome_id, genome_length, gc_percent FROM checked WHERE len(list_filter(found, lambda x: starts_with(x, 'error'))) > 0",
)
def _excluded(spark: SparkSession, sf: str) -> DataFrame:
    return build_manifest(_twice(spark, sf), sequence_files(spark, sf))[2].select("genome_id", "genome_length", "gc_percent")


@register(
    "duplicate_line_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_QC_LIMITS = {**R.QC_LIMITS, "min_genome_length_bp": 400, "max_genome_length_bp": 9000, "max_host_genome_length_bp": 20000,
              "min_gc_percent": 5, "max_gc_percent": 45, "max_n_percent": 8, "max_ambiguous_percent": 70}


@register(
    "sequence_qc_documents",
    """WITH s AS (SELECT doc_id, lang, n_chars, replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), ' ', '') AS q FROM documents),
    b AS (SELECT *, length(q)::BIGINT AS total, length(q) - length(translate(q, 'GC', '')) AS gc, length(q) - length(translate(q, 'ACGT', '')) AS acgt,
      length(q) - length(replace(q, 'N', '')) AS n FROM s),
    p AS (SELECT *, CASE WHEN acgt > 0 THEN 100.0::DOUBLE * gc / acgt END AS gcp, CASE WHEN total > 0 THEN 100.0::DOUBLE * n / total END AS np,
      CASE WHEN total > 0 THEN 100.0::DOUBLE * (total - acgt - n) / total END AS ap, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN total ELSE n_chars END AS said,
      CASE WHEN lang = 'en' THEN 20000 ELSE 9000 END AS hi FROM b),
    m AS (SELECT *, list_filter([CASE WHEN total = 0 THEN 'no sequences found in FASTA' END, CASE WHEN total < 400 THEN 'length below minimum 400' END,
      CASE WHEN total > hi THEN 'length above maximum ' || hi END, CASE WHEN gcp < 5 THEN 'GC below minimum 5' END, CASE WHEN gcp > 45 THEN 'GC above maximum 45' END,
      CASE WHEN np > 8 THEN 'N percent above maximum 8' END, CASE WHEN ap > 70 THEN 'ambiguous percent above maximum 70' END,
      CASE WHEN total <> said THEN 'sequence length does not match metadata' END, CASE WHEN abs(gcp - 40) > 1 THEN 'sequence GC does not match metadata' END], lambda x: x IS NOT NULL) AS msg FROM p)
    SELECT 'D' || doc_id AS genome_id, CASE WHEN doc_id % 10 = 0 THEN 'no_sequence_provided' WHEN doc_id % 10 = 1 THEN 'missing_sequence_file' WHEN len(msg) = 0 THEN 'pass' ELSE 'warn' END AS sequence_qc_status,
      CASE WHEN doc_id % 10 = 0 THEN 'no raw_sequence_path provided' WHEN doc_id % 10 = 1 THEN 'raw_sequence_path does not exist' WHEN len(msg) = 0 THEN 'OK' ELSE array_to_string(msg, '; ') END AS messages,
      CASE WHEN doc_id % 10 > 1 THEN round(gcp, 6) END AS gc_percent_observed, CASE WHEN doc_id % 10 > 1 THEN (total - said)::BIGINT END AS length_delta_bp FROM m""",
)
def _sequence_qc(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    genome = F.concat(F.lit("D"), k.cast("string")).alias("genome_id")
    records = d.select(
        genome,
        F.when(F.col("lang") == "en", "host").otherwise("phage").alias("record_type"),
        F.when(k % 10 == 0, "").otherwise("x.fna").alias("raw_sequence_path"),
        F.when(k % 4 == 0, "NA").when(k % 4 == 1, F.length(letters).cast("string")).otherwise(F.col("n_chars").cast("string")).alias("genome_length"),
        F.lit("40").alias("gc_percent"),
    )
    # Each text is split in two records, as a genome may have several.
    half = (F.length(letters) / 2).cast("int")
    seqs = d.filter(~(k % 10).isin(0, 1)).select(
        genome, F.explode(F.array(F.substring(letters, F.lit(1), half), letters.substr(half + 1, F.length(letters)))).alias("sequence")
    )
    out = run_sequence_qc(seqs, records, _QC_LIMITS)
    return out.select(
        "genome_id", "sequence_qc_status", F.col("sequence_qc_messages").alias("messages"),
        F.round("gc_percent_observed", 6).alias("gc_percent_observed"), "length_delta_bp",
    )


@register(
    "filter_reasons_pages",
    r"""SELECT CASE WHEN NOT contains(t, 'example') THEN 'skipped_required_term' WHEN NOT (contains(t, 'the') OR contains(t, 'que')) THEN 'skipped_keyword'
      WHEN NOT regexp_matches(t, '/(en|fr|de)/') THEN 'skipped_include_regex' WHEN regexp_matches(t, '#top|\.html') THEN 'skipped_exclude_regex'
      WHEN page_id % 3 = 0 THEN 'skipped_review_status' ELSE 'included' END AS filter_reason, count(*) AS rows
    FROM (SELECT page_id, lower(url) || ' ' || lower(html) AS t FROM pages) GROUP BY 1""",
)
def _filters(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("page_id") % 3 == 0, "pending").otherwise("Accepted")
    p = table(spark, sf, "pages").withColumn("notes", F.concat(F.lit("crawl=1; review_status="), status))
    out = filter_with_reason(
        p, ["url", "html"], require_term="example", any_terms=("the", "que"), include_regex="/(en|fr|de)/", exclude_regex=r"#top|\.html",
        review_statuses=R.REVIEWED,
    )
    return reason_counts(out)


@register(
    "eligible_records_orders",
    f"""WITH {MANIFEST}, q AS (SELECT 'G' || o_orderkey AS genome_id, CASE o_custkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'no_sequence_provided' END AS s FROM orders WHERE o_custkey % 4 < 3)
    SELECT genome_id, record_type, coalesce(s, 'not_provided') AS sequence_qc_status FROM manifest LEFT JOIN q USING (genome_id)
    WHERE record_type IN ('phage', 'prophage') AND genome_length <> '-5' AND coalesce(s, 'x') <> 'warn'""",
)
def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf).withColumn("validation_status", F.when(F.col("genome_length") == "-5", "exclude").otherwise("pass"))
    c = F.col("o_custkey") % 4
    qc = table(spark, sf, "orders").filter(c < 3).select(
        F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("genome_id"),
        F.when(c == 0, "pass").when(c == 1, "warn").otherwise("no_sequence_provided").alias("sequence_qc_status"),
        (c == 0).alias("passes_sequence_qc"),
    )
    return eligible(m, qc, R.PHAGE_LIKE).select("genome_id", "record_type", "sequence_qc_status")


@register(
    "export_gates_customers",
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 9 THEN 'NA' ELSE c_name END AS accession, 1700 + c_custkey % 300 AS yr FROM customer),
      f AS (SELECT c_custkey, yr FROM b WHERE yr < 1800), s AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 50 = 9) AS no_id FROM b)
    SELECT 'names' AS export, n AS export_row_count, no_id AS rows_missing_all_identity, 0 AS duplicate_identity_count, '' AS duplicate_identity_values,
      (SELECT count(*) FROM f) AS row_format_issue_count, (SELECT string_agg('row' || c_custkey || ':year:' || yr, ';' ORDER BY c_custkey) FROM (SELECT * FROM f ORDER BY c_custkey LIMIT 50)) AS row_format_issues,
      0 AS provenance_warning_count, 'export_rows_missing_identity' AS validation_status, true AS blocking_issue FROM s
    UNION ALL SELECT 'segments', count(*), 0, count(DISTINCT c_mktsegment), string_agg(DISTINCT 'accession:' || c_mktsegment, ';' ORDER BY 'accession:' || c_mktsegment), 0, '', 0, 'export_duplicate_identity', true FROM customer
    UNION ALL SELECT 'keys', count(*), 0, 0, '', 0, '', count(*) FILTER (c_custkey % 10 = 0), 'export_ready', false FROM customer
    UNION ALL SELECT 'short', count(*), 0, 0, '', 0, '', 0, 'export_missing_expected_columns', true FROM customer""",
)
def _gates(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    names = c.select("c_custkey", F.when(k % 50 == 9, "NA").otherwise(F.col("c_name")).alias("accession"), (1700 + k % 300).cast("string").alias("year"))
    segments = c.select("c_custkey", F.col("c_mktsegment").alias("accession"))
    keys = c.select("c_custkey", F.col("c_name").alias("accession"), F.when(k % 10 == 0, "").otherwise("ok").alias("notes"))
    out = None
    for name, df, expected in (("names", names, ["accession", "year"]), ("segments", segments, ["accession"]), ("keys", keys, ["accession"]), ("short", segments.select("c_custkey", k.cast("string").alias("accession")), ["accession", "year"])):
        row = export_gate(df, expected, ["accession", "genome_id"], "c_custkey").withColumn("export", F.lit(name))
        row = row.drop("missing_expected_columns", "identity_columns_present")
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "metric_rows_customers",
    f"""WITH b AS (SELECT {sql_pick(["NA", "x", "y"], 'c_custkey')} AS a, {sql_pick(["", "h"], 'c_nationkey')} AS h, CASE WHEN c_acctbal > 0 THEN 'K1' ELSE '-' END AS k FROM customer)
    SELECT 'any_id' AS metric, count(*) AS export_row_count, count(*) FILTER (a <> 'NA') AS satisfying_rows, '' AS missing_fields, 'metric_support_ready' AS preflight_status FROM b
    UNION ALL SELECT 'host', count(*), count(*) FILTER (a <> 'NA' AND h <> ''), '', 'metric_support_ready' FROM b
    UNION ALL SELECT 'typed', count(*), count(*) FILTER (a <> 'NA' AND k <> '-'), '', 'metric_support_ready' FROM b
    UNION ALL SELECT 'lineage', count(*), 0, 'ST', 'missing_metric_fields' FROM b""",
)
def _metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(
        pick(["NA", "x", "y"], F.col("c_custkey")).alias("accession"),
        pick(["", "h"], F.col("c_nationkey")).alias("host_species"),
        F.when(F.col("c_acctbal") > 0, "K1").otherwise("-").alias("K_type"),
    )
    ids, hosts = ["accession", "genome_id"], ["host_species", "isolation_host"]
    return rows_satisfying(c, {"any_id": ([ids], []), "host": ([ids, hosts], []), "typed": ([ids], ["K_type"]), "lineage": ([ids], ["ST"])})


_PRE = f"""WITH b AS (SELECT p_partkey AS r, CASE WHEN p_size = 7 THEN 'NA' ELSE p_name || p_brand || p_size END AS acc, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'f' END AS path, CASE WHEN p_type = 'PROMO' THEN '-' ELSE p_type END AS kind FROM part),
  i AS (SELECT r, 'blocking' AS severity, 'row_missing_identity' AS code, 'accession' AS field FROM b WHERE acc = 'NA'
    UNION ALL SELECT r, 'warning', 'row_missing_sequence_locator', 'raw_sequence_path;accession' FROM b WHERE acc = 'NA' AND path = ''
    UNION ALL SELECT r, 'warning', 'row_missing_recommended_metadata', 'kind' FROM b WHERE kind = '-'
    UNION ALL SELECT r, 'blocking', 'duplicate_identity_value', 'accession' FROM (SELECT r, acc, min(r) OVER (PARTITION BY acc) AS f FROM b WHERE acc <> 'NA') WHERE r > f
    UNION ALL SELECT NULL, 'blocking', 'missing_identity_headers', 'genome_id' UNION ALL SELECT NULL, 'warning', 'missing_content_headers', 'country')"""


def _preflight_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    size = F.col("p_size")
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("r"),
        F.when(size == 7, "NA").otherwise(F.concat("p_name", "p_brand", size.cast("string"))).alias("accession"),
        F.when(size % 2 == 0, "").otherwise("f").alias("raw_sequence_path"),
        F.when(F.col("p_type") == "PROMO", "-").otherwise(F.col("p_type")).alias("kind"),
    )
    return preflight(p, ["accession", "genome_id"], ["kind", "country"], "r", ["raw_sequence_path", "accession"])


@register("preflight_issues_parts", _PRE + " SELECT r AS row_number, severity, code, field FROM i")
def _preflight_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _preflight_parts(spark, sf)[0]


@register(
    "preflight_status_parts",
    _PRE + """ SELECT (SELECT count(*) FROM b) AS export_row_count, count(*) FILTER (severity = 'blocking') AS blocking_issue_count,
      count(*) FILTER (severity = 'warning') AS warning_count, 'blocking_issues' AS preflight_status FROM i""",
)
def _preflight_status(spark: SparkSession, sf: str) -> DataFrame:
    return _preflight_parts(spark, sf)[1]


@register(
    "intake_lint_orders",
    f"""WITH {MANIFEST}, {FILES} SELECT count(*) AS rows, count(*) FILTER (source <> '') AS rows_with_source, 0 AS rows_with_notes,
      count(*) FILTER (raw_sequence_path IN (SELECT path FROM files)) AS rows_with_existing_file, 'no_rows_with_notes' AS lint FROM manifest""",
)
def _lint(spark: SparkSession, sf: str) -> DataFrame:
    return intake_lint(manifest(spark, sf), ["source", "tool"], "notes", "raw_sequence_path", sequence_files(spark, sf))


# --- assays ----------------------------------------------------------------------------------------------------

EOPS = ["0.5", "-0.1", "abc", "NA", "NA"]
TIERS = ["initial_interaction", "tested_negative", "unknown", "odd_tier"]
PRODUCTIVE = ["positive", "not_measured", "negative"]


def wide_assays(spark: SparkSession, sf: str) -> DataFrame:
    """Events as full assay rows with all kinds of mistakes."""
    e, k, u = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        k.alias("row_number"),
        F.when(k % 97 == 0, F.lit("I0")).when(k % 89 == 0, "").otherwise(F.concat(F.lit("I"), k.cast("string"))).alias("interaction_id"),
        F.concat(F.lit("U"), u.cast("string")).alias("phage_id"),
        F.concat(F.lit("H"), (F.floor("value") % 40).cast("string")).alias("host_id"),
        F.lit("study").alias("study_id"),
        F.concat(F.lit("panel"), (k % 300).cast("string")).alias("panel_id"),
        F.when(k % 31 == 0, "guess").when(k % 7 == 0, "Plaque").otherwise("spot").alias("assay_type"),
        F.when(F.col("event_type") == "signup", "no").when(k % 41 == 0, "perhaps").otherwise("yes").alias("tested"),
        F.lit("not_measured").alias("adsorption_result"),
        F.when(F.col("event_type").isin("purchase", "click"), "positive").when(F.col("event_type") == "view", "negative").otherwise("not_tested").alias("spot_result"),
        F.when(k % 7 == 0, "Positive").otherwise("not_measured").alias("plaque_result"),
        pick(PRODUCTIVE, k).alias("productive_infection_result"),
        pick(EOPS, u).alias("eop"),
        F.when(u % 2 == 0, "H1").otherwise("NA").alias("eop_reference_host"),
        F.when(k % 53 == 0, "lots").otherwise("not_measured").alias("growth_inhibition_result"),
        F.when(k % 61 == 0, "-1").otherwise("0.1").alias("moi"),
        F.when(k % 67 == 0, "warm").otherwise("37").alias("temperature_c"),
        F.lit("LB").alias("medium"),
        F.when(k % 71 == 0, "0").when(k % 73 == 0, "1.5").otherwise("3").alias("replicate_count"),
        pick(TIERS, k).alias("outcome_tier"),
        F.when(k % 79 == 0, "rumour").otherwise("curated_assay").alias("evidence_tier"),
        F.when(k % 83 == 0, "").otherwise("doi").alias("reference"),
        F.lit("").alias("notes"),
    )


_WIDE = f"""w AS (SELECT event_id AS r, CASE WHEN event_id % 97 = 0 THEN 'I0' WHEN event_id % 89 = 0 THEN '' ELSE 'I' || event_id END AS iid, 'U' || user_id AS phage,
    'H' || (floor(value)::BIGINT % 40) AS host, 'panel' || (event_id % 300) AS panel,
    CASE WHEN event_id % 31 = 0 THEN 'guess' WHEN event_id % 7 = 0 THEN 'plaque' ELSE 'spot' END AS kind,
    CASE WHEN event_type = 'signup' THEN false WHEN event_id % 41 = 0 THEN NULL ELSE true END AS tested,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'positive' WHEN event_type = 'view' THEN 'negative' ELSE 'not_tested' END AS spot,
    CASE WHEN event_id % 7 = 0 THEN 'positive' ELSE 'not_measured' END AS plaque, {sql_pick(PRODUCTIVE, 'event_id')} AS productive, {sql_pick(EOPS, 'user_id')} AS eop,
    {sql_pick(TIERS, 'event_id')} AS tier, event_type, user_id, event_id FROM events)"""
_ASSAY_CHECKS = f"""WITH {_WIDE}, p AS (SELECT *, CASE WHEN iid <> '' THEN lag(r) OVER (PARTITION BY iid ORDER BY r) END AS prev_id,
      lag(r) OVER (PARTITION BY phage, host, panel, kind ORDER BY r) AS prev_key FROM w),
    i AS (SELECT r, 'required_populated_fields' AS c FROM p WHERE iid = '' OR event_id % 83 = 0
      UNION ALL SELECT r, 'phage_id_resolves' FROM p WHERE user_id % 10 = 9 UNION ALL SELECT r, 'host_id_resolves' FROM p WHERE host IN ('H38', 'H39')
      UNION ALL SELECT r, 'duplicate_interaction_id' FROM p WHERE prev_id IS NOT NULL UNION ALL SELECT r, 'duplicate_study_panel_assay' FROM p WHERE prev_key IS NOT NULL
      UNION ALL SELECT r, 'tested_boolean' FROM p WHERE tested IS NULL UNION ALL SELECT r, 'assay_type_controlled' FROM p WHERE kind = 'guess'
      UNION ALL SELECT r, 'outcome_tier_controlled' FROM p WHERE tier = 'odd_tier' UNION ALL SELECT r, 'evidence_tier_controlled' FROM p WHERE event_id % 79 = 0
      UNION ALL SELECT r, 'growth_inhibition_result_controlled' FROM p WHERE event_id % 53 = 0
      UNION ALL SELECT r, 'untested_result_contradiction' FROM p, (SELECT unnest(['s', 'p', 'f']) AS k) WHERE tested = false AND ((k = 's' AND spot IN ('positive', 'negative')) OR (k = 'p' AND plaque = 'positive') OR (k = 'f' AND productive IN ('positive', 'negative')))
      UNION ALL SELECT r, 'negative_requires_tested_true' FROM p, (SELECT unnest(['s', 'f']) AS k) WHERE tested IS DISTINCT FROM true AND ((k = 's' AND spot = 'negative') OR (k = 'f' AND productive = 'negative'))
      UNION ALL SELECT r, 'untested_not_negative' FROM p WHERE tested = false AND tier = 'tested_negative'
      UNION ALL SELECT r, 'eop_nonnegative' FROM p WHERE eop IN ('-0.1', 'abc') UNION ALL SELECT r, 'eop_reference_host' FROM p WHERE eop IN ('0.5', '-0.1') AND user_id % 2 = 1
      UNION ALL SELECT r, 'moi_nonnegative' FROM p WHERE event_id % 61 = 0 UNION ALL SELECT r, 'temperature_numeric' FROM p WHERE event_id % 67 = 0
      UNION ALL SELECT r, 'replicate_count_positive' FROM p WHERE event_id % 71 = 0 OR event_id % 73 = 0
      UNION ALL SELECT r, 'productive_infection_not_spot_only' FROM p WHERE productive = 'positive' AND plaque <> 'positive' AND eop <> '0.5')"""


def _known(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    phages = e.filter(F.col("user_id") % 10 != 9).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("phage_id"))
    host = F.floor("value") % 40
    hosts = e.filter(~host.isin(38, 39)).select(F.concat(F.lit("H"), host.cast("string")).alias("host_id"))
    return phages, hosts


@register(
    "assay_validation_events",
    _ASSAY_CHECKS + """ SELECT r AS row_number, c AS check_id, CASE WHEN c = 'eop_reference_host' THEN 'warning' ELSE 'error' END AS severity,
      c <> 'eop_reference_host' AS blocking_issue FROM i""",
)
def _assay_validation(spark: SparkSession, sf: str) -> DataFrame:
    return validate_assays(wide_assays(spark, sf), *_known(spark, sf)).select("row_number", "check_id", "severity", "blocking_issue")


@register(
    "assay_contradictions_by_check",
    _ASSAY_CHECKS + " SELECT c AS check_id, count(*) AS issues, min(r) AS first_row FROM i GROUP BY c",
)
def _contradictions(spark: SparkSession, sf: str) -> DataFrame:
    issues = validate_assays(wide_assays(spark, sf), *_known(spark, sf))
    return issues.groupBy("check_id").agg(F.count("*").alias("issues"), F.min("row_number").alias("first_row"))


@register(
    "relationship_validation_orders",
    """WITH r AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 91 = 0 THEN 'R0' ELSE 'R' || o_orderkey END AS rid, o_custkey AS c, o_orderkey % 25 AS h, o_orderstatus AS s, o_orderpriority AS p FROM orders),
      p AS (SELECT *, lag(n) OVER (PARTITION BY rid ORDER BY n) AS pid, lag(n) OVER (PARTITION BY c, h, s ORDER BY n) AS pk FROM r)
    SELECT n AS row_number, unnest(list_filter([CASE WHEN s = 'P' AND n % 2 = 0 THEN 'required_populated_fields' END, CASE WHEN c % 10 = 3 THEN 'phage_id_resolves' END, CASE WHEN h = 24 THEN 'host_id_resolves' END,
      CASE WHEN s = 'F' THEN 'relationship_type_controlled' END, CASE WHEN p = '5-LOW' THEN 'confidence_controlled' END,
      CASE WHEN pid IS NOT NULL THEN 'duplicate_relationship_id' END, CASE WHEN pk IS NOT NULL AND NOT (s = 'P' AND n % 2 = 0) THEN 'duplicate_relationship_record' END], lambda x: x IS NOT NULL)) AS check_id FROM p""".replace(
        "PARTITION BY c, h, s ORDER BY n", "PARTITION BY c, h, s, (s = 'P' AND n % 2 = 0) ORDER BY n"
    ),
)
def _relationships(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("row_number"),
        F.when(k % 91 == 0, "R0").otherwise(F.concat(F.lit("R"), k.cast("string"))).alias("relationship_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("phage_id"),
        F.concat(F.lit("N"), (k % 25).cast("string")).alias("host_id"),
        F.when(F.col("o_orderstatus") == "F", "susceptible_host").when(F.col("o_orderstatus") == "O", "Reported_host").otherwise("predicted_host").alias("relationship_type"),
        F.lit("reviewed").alias("relationship_status"),
        F.lit("table").alias("relationship_evidence"),
        F.when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "").otherwise("doi").alias("source_reference"),
        F.when(F.col("o_orderpriority") == "5-LOW", "1.5").when(F.col("o_orderpriority") == "2-HIGH", "High").otherwise("0.4").alias("confidence"),
        F.lit("").alias("notes"),
    )
    phages = table(spark, sf, "customer").filter(F.col("c_custkey") % 10 != 3).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")))
    hosts = table(spark, sf, "nation").filter("n_nationkey < 24").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    return validate_relationships(rows, phages, hosts).select("row_number", "check_id")


@register(
    "imported_assay_errors_events",
    f"""WITH {_WIDE} SELECT r AS row_number, unnest(list_filter([CASE WHEN iid = '' OR event_id % 83 = 0 THEN 'required_fields' END, 'tested',
      CASE WHEN kind <> 'spot' THEN 'assay_type' END, CASE WHEN tier = 'odd_tier' THEN 'outcome_tier' END, CASE WHEN event_id % 79 = 0 THEN 'evidence_tier' END,
      CASE WHEN plaque = 'positive' THEN 'plaque_result' END, CASE WHEN event_id % 53 = 0 THEN 'growth_inhibition_result' END], lambda x: x IS NOT NULL)) AS check_id FROM w""",
)
def _imported(spark: SparkSession, sf: str) -> DataFrame:
    return validate_imported(wide_assays(spark, sf)).select("row_number", "check_id")


@register(
    "evidence_hit_validation_lineitem",
    """WITH h AS (SELECT *, l_partkey % 700 + 1 AS s, CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE l_partkey % 700 + 1 + l_quantity::BIGINT END AS e FROM lineitem)
    SELECT 'domain' AS kind, message, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN l_suppkey % 11 = 0 THEN 'domain_id is required' END, CASE WHEN l_suppkey % 13 = 0 THEN 'start_aa: not_integer: 1.5' END,
      CASE WHEN l_discount = 0.05 THEN 'evalue: below_minimum: -1' END, CASE WHEN l_suppkey % 13 <> 0 AND s > e THEN 'start_aa is greater than end_aa' END], lambda x: x IS NOT NULL)) AS message FROM h) GROUP BY 2
    UNION ALL SELECT 'structural', message, count(*) FROM (SELECT unnest(list_filter([CASE WHEN l_suppkey % 11 = 0 THEN 'structural_hit_id is required' END, CASE WHEN l_quantity > 40 THEN 'tm_score: above_maximum: ' || l_quantity::INT END,
      CASE WHEN l_suppkey % 17 = 0 THEN 'probability: not_numeric: high' END], lambda x: x IS NOT NULL)) AS message FROM (SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN l_quantity ELSE 1 END AS l_quantity) FROM lineitem)) GROUP BY 2
    UNION ALL SELECT 'domain_kept', '', count(*) FROM h WHERE l_suppkey % 11 <> 0 AND l_suppkey % 13 <> 0 AND l_discount <> 0.05 AND s <= e""",
)
def _hits(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    start = F.col("l_partkey") % 700 + 1
    s, q = F.col("l_suppkey"), F.col("l_quantity")
    base = F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("annotation_gene_id")
    domains = li.select(
        base,
        F.when(s % 11 == 0, "-").otherwise("PF1").alias("domain_id"),
        F.when(s % 13 == 0, "1.5").otherwise(start.cast("string")).alias("start_aa"),
        F.when(s % 7 == 0, "1").otherwise((start + q.cast("bigint")).cast("string")).alias("end_aa"),
        F.when(F.col("l_discount") == 0.05, "-1").otherwise("1e-9").alias("evalue"),
    )
    structures = li.select(
        base,
        F.when(s % 11 == 0, "").otherwise("PDB:1").alias("structural_hit_id"),
        F.when(q > 40, q.cast("int").cast("string")).otherwise("0.7").alias("tm_score"),
        F.when(s % 17 == 0, "high").otherwise("88.5").alias("probability"),
    )
    kept, bad_domains = validate_hits(domains, "domain")
    _, bad_structures = validate_hits(structures, "structural")

    def counts(df: DataFrame, kind: str) -> DataFrame:
        return df.groupBy("message").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind))

    return (
        counts(bad_domains, "domain")
        .unionByName(counts(bad_structures, "structural"))
        .unionByName(kept.agg(F.count("*").alias("rows")).withColumn("message", F.lit("")).withColumn("kind", F.lit("domain_kept")))
    )

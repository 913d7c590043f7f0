"""Matrix, import and union bindings on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import GENES, MANIFEST, manifest, pick, register, sql_pick, table
from evispark.bindings.joins import matrix_tables
from evispark.functions import rules as R
from evispark.operators.joins import reviewed_mapping
from evispark.operators.reshape import (
    build_canonical, cell_result, entities_from_matrix, import_records, requirement_matrix, tested_relationships, unpivot_cells, unpivot_matrix,
)
from evispark.plans.intake import audit_dataset, import_assays, import_source, intake_assays, normalize_hits

VALUES = ["1", "0", "", "Pos", "neg", "NA", "maybe", "1.0", "+"]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Events as matrix cells: a user's row, one column per hour, a value of nine spellings."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("row_number"),
        F.when(F.col("user_id") % 40 == 39, "NA").otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("host_source"),
        F.concat(F.lit("h"), (F.floor("value") % 24).cast("string")).alias("column_id"),
        pick(VALUES, F.col("event_id")).alias("matrix_value"),
    )


def row_map(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").select("user_id").distinct().filter("user_id % 10 < 9")
    return u.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("HOST"), (F.col("user_id") % 60).cast("string")).alias("canonical_id"),
        F.when(F.col("user_id") % 10 == 8, "pending").otherwise("reviewed").alias("review_status"),
    )


def column_map(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").filter("n_nationkey < 22")
    return n.select(
        F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("source_id"),
        F.concat(F.lit("PH"), F.col("n_nationkey").cast("string")).alias("canonical_id"),
        F.lit("accepted").alias("review_status"),
    )


_CELLS = f"""cl AS (SELECT event_id AS r, user_id, CASE WHEN user_id % 40 = 39 THEN 'NA' ELSE 'U' || user_id END AS u, 'h' || (floor(value)::INT % 24) AS c, {sql_pick(VALUES, 'event_id')} AS v FROM events),
  nm AS (SELECT *, CASE WHEN lower(v) IN ('', 'na') THEN 'blank' WHEN lower(v) IN ('1', '1.0', 'pos', '+') THEN 'positive' WHEN lower(v) IN ('0', 'neg') THEN 'negative' ELSE 'unsupported' END AS res FROM cl WHERE u <> 'NA'),
  ts AS (SELECT *, CASE WHEN user_id % 10 < 8 THEN 'HOST' || (user_id % 60) ELSE '' END AS hid, CASE WHEN substr(c, 2)::INT < 22 THEN 'PH' || substr(c, 2) ELSE '' END AS pid FROM nm WHERE res IN ('positive', 'negative')),
  gd AS (SELECT *, 'st_panel1_' || pid || '_' || hid || '_spot' AS iid FROM ts WHERE hid <> '' AND pid <> ''), fr AS (SELECT *, min(r) OVER (PARTITION BY iid) AS f FROM gd)"""
_SPEC = {"study_id": "st", "panel_id": "panel1", "assay_type": "Spot"}


def _unpivoted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, _ = reviewed_mapping(row_map(spark, sf))
    columns, _ = reviewed_mapping(column_map(spark, sf))
    return unpivot_matrix(cells(spark, sf), "host_source", rows, columns, _SPEC)


@register(
    "matrix_unpivot_events",
    f"""WITH {_CELLS} SELECT iid AS interaction_id, pid AS phage_id, hid AS host_id, res AS spot_result, CASE res WHEN 'positive' THEN 'initial_interaction' ELSE 'tested_negative' END AS outcome_tier,
      'source_host_id=' || u || '; source_phage_id=' || c || '; matrix_value=' || v || '; blank_cells_treated_as_untested' AS notes FROM fr WHERE r = f""",
)
def _unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return _unpivoted(spark, sf)[0].select("interaction_id", "phage_id", "host_id", "spot_result", "outcome_tier", "notes")


@register(
    "matrix_unpivot_issues_events",
    f"""WITH {_CELLS} SELECT 'error' AS severity, r AS row_number, c AS column_id, 'matrix_value' AS field, 'Unsupported matrix value: ' || v AS message FROM nm WHERE res = 'unsupported'
    UNION ALL SELECT 'warning', r, c, 'entity_mapping', 'tested cell skipped: host ' || CASE WHEN hid = '' THEN 'unresolved' ELSE 'mapped' END || ', phage ' || CASE WHEN pid = '' THEN 'unresolved' ELSE 'mapped' END FROM ts WHERE hid = '' OR pid = ''
    UNION ALL SELECT 'error', r, c, 'interaction_id', 'interaction also appears on row ' || f FROM fr WHERE r > f UNION ALL SELECT 'warning', r, 'NA', 'host_id', 'matrix row has no host identifier; row skipped' FROM cl WHERE u = 'NA'""",
)
def _unpivot_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _unpivoted(spark, sf)[1].drop("row_source_id")


@register(
    "matrix_cells_events",
    """WITH c AS (SELECT user_id, event_type, max(CASE WHEN value >= 40 THEN 1 ELSE 0 END) AS v FROM events WHERE (user_id + length(event_type)) % 9 <> 0 GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM c), t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type)
    SELECT user_id, event_type AS column_id, CASE v WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'blank' END AS result FROM (SELECT * FROM u, t) LEFT JOIN c USING (user_id, event_type)""",
)
def _cells(spark: SparkSession, sf: str) -> DataFrame:
    wide, _ = matrix_tables(spark, sf)
    return unpivot_cells(wide, "user_id").select("user_id", "column_id", cell_result("matrix_value").alias("result"))


@register(
    "requirement_matrix_orders",
    """WITH n AS (SELECT DISTINCT o_orderpriority AS goal, o_custkey % 50 AS item, CASE WHEN o_custkey % 3 = 0 THEN 'optional' ELSE 'required' END AS role FROM orders)
    SELECT goal, item, role, CASE WHEN n_nationkey IS NULL THEN 'source_not_configured' ELSE n_name END AS curation_status FROM n LEFT JOIN nation ON item = n_nationkey""",
)
def _requirements(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    needs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("goal"), (c % 50).alias("item"), F.when(c % 3 == 0, "optional").otherwise("required").alias("role")
    ).distinct()
    status = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("item"), F.col("n_name").alias("curation_status"))
    return requirement_matrix(needs, status, "item", {"curation_status": "source_not_configured"})


SAMPLE_ALIASES = {"genome_id": ["genome_id", "sample", "id"], "accession": ["accession", "acc"], "country": ["country", "nation"], "source": ["source"], "notes": ["notes", "comment"]}
SAMPLE_DEFAULTS = {"genome_id": "", "accession": "NA", "country": "NA", "source": "NA", "notes": ""}
_UNION = """WITH u AS (SELECT 0 AS s, c_custkey AS o, 'customers' AS src, CASE WHEN c_custkey % 20 = 0 THEN '' ELSE 'E' || (c_custkey % 700) END AS genome_id, CASE WHEN c_custkey % 40 = 0 THEN 'NA' ELSE 'A' || c_custkey END AS accession, c_nationkey::VARCHAR AS country, 'crm' AS source FROM customer
    UNION ALL SELECT 1, s_suppkey, 'suppliers', 'E' || (s_suppkey * 9), 'NA', 'unknown', 'NA' FROM supplier),
  f AS (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY s, o) AS n FROM u WHERE genome_id <> '' OR accession <> 'NA')"""


def _canonical(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    customers = c.select(
        k.alias("_order"),
        F.when(k % 20 == 0, "").otherwise(F.concat(F.lit("E"), (k % 700).cast("string"))).alias("Sample"),
        F.when(k % 40 == 0, "-").otherwise(F.concat(F.lit("A"), k.cast("string"))).alias("Acc."),
        F.col("c_nationkey").cast("string").alias("Nation"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("_order"), F.concat(F.lit("E"), (F.col("s_suppkey") * 9).cast("string")).alias("ID"), F.col("s_name").alias("comment")
    )
    specs = [
        (customers, {"source_id": "customers", "source_label": "crm"}),
        (suppliers, {"source_id": "suppliers", "country_default": "unknown"}),
    ]
    return build_canonical(specs, SAMPLE_ALIASES, SAMPLE_DEFAULTS, "genome_id", ["genome_id", "accession"])


@register("canonical_union_entities", _UNION + " SELECT src AS import_source, genome_id, accession, country, source FROM f WHERE n = 1")
def _union(spark: SparkSession, sf: str) -> DataFrame:
    return _canonical(spark, sf)[0].select("import_source", "genome_id", "accession", "country", "source")


@register(
    "canonical_union_rejects",
    _UNION + " SELECT src AS import_source, genome_id, accession, 'duplicate' AS reason FROM f WHERE n > 1 UNION ALL SELECT src, genome_id, accession, 'no_identity' FROM u WHERE genome_id = '' AND accession = 'NA'",
)
def _union_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, repeats, anonymous = _canonical(spark, sf)
    shown = ["import_source", "genome_id", "accession"]
    return repeats.select(*shown, F.lit("duplicate").alias("reason")).unionByName(anonymous.select(*shown, F.lit("no_identity").alias("reason")))


ASSAY_ALIASES = {c: [c] for c in R.ASSAY_COLUMNS} | {"phage_id": ["phage_id", "virus"], "host_id": ["host_id", "strain_id"], "tested": ["tested", "screened"], "spot_result": ["spot_result", "spot"]}
ASSAY_DEFAULTS = {c: "" for c in R.ASSAY_COLUMNS} | {"study_id": "study", "panel_id": "p", "assay_type": "other", "tested": "true", "outcome_tier": "unknown", "evidence_tier": "unknown", "reference": "doi"}
SPOTS = ["+", "Neg", "", "mixed", "odd"]


def _export(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("_row"),
        F.concat(F.lit("U "), F.col("user_id").cast("string")).alias("Virus"),
        F.concat(F.lit("H"), (F.floor("value") % 40).cast("string")).alias("Strain ID"),
        F.when(F.col("event_type") == "signup", "N").otherwise("T").alias("Screened"),
        pick(SPOTS, F.col("event_id")).alias("Spot"),
    )


_IMPORT = f"""im AS (SELECT event_id AS r, 'U ' || user_id AS phage_id, 'H' || (floor(value)::INT % 40) AS host_id, CASE WHEN event_type = 'signup' THEN 'false' ELSE 'true' END AS tested,
    CASE {sql_pick(SPOTS, 'event_id')} WHEN '+' THEN 'positive' WHEN 'Neg' THEN 'negative' WHEN '' THEN CASE WHEN event_type = 'signup' THEN 'not_tested' ELSE 'not_measured' END ELSE {sql_pick(SPOTS, 'event_id')} END AS spot, 'study_p_U_' || user_id || '_H' || (floor(value)::INT % 40) || '_spot_' || event_id AS iid FROM events)"""


@register("assay_import_events", f"WITH {_IMPORT} SELECT r AS _row, iid AS interaction_id, phage_id, host_id, tested, spot AS spot_result, 'spot' AS assay_type, 'imported_from=exp' AS notes FROM im")
def _import(spark: SparkSession, sf: str) -> DataFrame:
    out = import_records(_export(spark, sf), {"assay_type_default": "Spot"}, ASSAY_ALIASES, ASSAY_DEFAULTS, "exp")
    return out.select("_row", "interaction_id", "phage_id", "host_id", "tested", "spot_result", "assay_type", "notes")


@register(
    "assay_import_relationships_events",
    f"WITH {_IMPORT} SELECT 'tested_' || iid AS relationship_id, phage_id, host_id, 'unknown' AS confidence, 'derived_from_interaction_id=' || iid AS notes FROM im",
)
def _import_relationships(spark: SparkSession, sf: str) -> DataFrame:
    out = import_records(_export(spark, sf), {"assay_type_default": "Spot"}, ASSAY_ALIASES, ASSAY_DEFAULTS, "exp")
    return tested_relationships(out).select("relationship_id", "phage_id", "host_id", "confidence", "notes")


@register("assay_import_errors_events", f"WITH {_IMPORT} SELECT r AS row_number, iid AS entity_id, 'spot_result' AS check_id FROM im WHERE spot = 'odd'")
def _import_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = import_assays(_export(spark, sf), {"assay_type_default": "Spot"}, ASSAY_ALIASES, ASSAY_DEFAULTS, "exp")
    return out["issues"].select("row_number", "entity_id", "check_id")


@register(
    "matrix_entities_events",
    f"""WITH {_CELLS} SELECT DISTINCT 'ent_' || u AS genome_id, 'source_id=' || u || '; review_status=pending' AS notes, u AS source_id, 'pending' AS review_status FROM cl WHERE u <> 'NA'""",
)
def _entities(spark: SparkSession, sf: str) -> DataFrame:
    entities, mapping = entities_from_matrix(cells(spark, sf), "host_source", "ent_")
    return entities.join(mapping.withColumnRenamed("canonical_id", "genome_id"), "genome_id")


# --- intake pipelines ------------------------------------------------------------------------------------------

_INTAKE = f"""{_CELLS}, kn AS (SELECT 'PH' || n_nationkey AS i FROM nation WHERE n_nationkey < 20), kh AS (SELECT 'HOST' || n AS i FROM range(50) t(n))"""


@register(
    "assay_intake_issues_events",
    f"""WITH {_INTAKE} SELECT check_id, count(*) AS rows FROM (SELECT 'phage_id_resolves' AS check_id FROM fr WHERE r = f AND pid NOT IN (SELECT i FROM kn)
      UNION ALL SELECT 'host_id_resolves' FROM fr WHERE r = f AND hid NOT IN (SELECT i FROM kh)) GROUP BY 1 UNION ALL SELECT 'map_warning', count(*) FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 8) UNION ALL SELECT 'assay_rows', count(*) FROM fr WHERE r = f""",
)
def _intake(spark: SparkSession, sf: str) -> DataFrame:
    phages = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("PH"), F.col("n_nationkey").cast("string")))
    hosts = table(spark, sf, "nation").select(F.explode(F.array("n_nationkey", F.col("n_nationkey") + 25)).alias("n")).select(F.concat(F.lit("HOST"), F.col("n").cast("string")))
    out = intake_assays(cells(spark, sf), "host_source", row_map(spark, sf), column_map(spark, sf), _SPEC, phages, hosts)
    found = out["assay_issues"].filter("severity = 'error'").groupBy("check_id").agg(F.count("*").alias("rows"))
    maps = out["map_issues"].agg(F.count("*").alias("rows")).withColumn("check_id", F.lit("map_warning"))
    rows = out["assays"].agg(F.count("*").alias("rows")).withColumn("check_id", F.lit("assay_rows"))
    return found.unionByName(maps).unionByName(rows)


@register(
    "dataset_audit_events",
    f"""WITH {_CELLS}, a AS (SELECT * FROM fr WHERE r = f), n AS (SELECT (SELECT count(*) FROM a) AS rows, (SELECT count(*) FROM a WHERE res = 'positive') AS p, (SELECT count(*) FROM a WHERE res = 'negative') AS q,
      (SELECT count(*) FROM cl WHERE lower(v) IN ('', 'na')) AS b, (SELECT count(*) FROM cl WHERE lower(v) IN ('1', '1.0', 'pos', '+')) AS mp, (SELECT count(*) FROM cl WHERE lower(v) IN ('0', 'neg')) AS mq)
    SELECT 'assay_matrix_parity' AS check_id, false AS ok, rows AS observed, 'fail' AS status FROM n UNION ALL SELECT 'positive_parity', p = mp, p, CASE WHEN p = mp THEN 'pass' ELSE 'fail' END FROM n UNION ALL SELECT 'negative_parity', q = mq, q, CASE WHEN q = mq THEN 'pass' ELSE 'fail' END FROM n
    UNION ALL SELECT 'no_untested_rows', true, 0, 'pass' UNION ALL SELECT 'phage_ids_resolve', true, 0, 'pass' UNION ALL SELECT 'host_ids_resolve', true, 0, 'pass' UNION ALL SELECT 'unique_interactions', true, 0, 'pass' UNION ALL SELECT 'blank_cells_untested', b > 0, b, 'pass' FROM n
    UNION ALL SELECT 'phage_map', false, 22, 'fail' UNION ALL SELECT 'host_map', false, count(*), 'fail' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 < 9)""",
)
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns = row_map(spark, sf), column_map(spark, sf)
    found = cells(spark, sf)
    assays = unpivot_matrix(found, "host_source", reviewed_mapping(rows)[0], reviewed_mapping(columns)[0], _SPEC)[0]
    return audit_dataset(
        assays, found, columns.select("canonical_id"), rows.select("canonical_id"), columns, rows,
        found.select("column_id"), found.select("host_source"),
    )


@register(
    "source_import_orders",
    f"""WITH {MANIFEST}, f AS (SELECT *, 'study phage ' || row_number || '; review_status=' || CASE WHEN row_number % 5 = 0 THEN 'draft' ELSE 'reviewed' END AS nt FROM manifest WHERE host_species <> 'species 3'),
    s AS (SELECT row_number AS r, CASE WHEN accession = 'NA' THEN record_type || '_imp_' || row_number ELSE record_type || '_' || accession END AS genome_id, accession, year, regexp_replace(regexp_replace(CASE WHEN gc_percent::DOUBLE <= 1 THEN (gc_percent::DOUBLE * 100)::VARCHAR ELSE gc_percent END, '\\.0+$', ''), '%', '') AS gc FROM f WHERE row_number % 5 <> 0)
    SELECT r AS row_number, genome_id, accession, year, gc AS gc_percent FROM s""",
)
def _source_import(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("row_number") % 5 == 0, "draft").otherwise("reviewed")
    m = manifest(spark, sf).select(
        "row_number", "record_type", F.col("accession").alias("Public accession"), F.col("host_species").alias("organism"),
        F.concat(F.lit("collected in "), F.col("year")).alias("collection_date"), F.concat(F.col("gc_percent"), F.lit("%")).alias("GC%"),
        F.concat(F.lit("study phage "), F.col("row_number").cast("string"), F.lit("; review_status="), state).alias("notes"),
    )
    aliases = {
        "record_type": ["record_type", "type"], "genome_id": ["genome_id", "genome"], "accession": ["accession", "public_accession"], "isolation_host": ["isolation_host"],
        "host_species": ["host_species", "organism"], "year": ["year", "collection_date"], "gc_percent": ["gc_percent", "gc%"], "notes": ["notes"],
    }
    defaults = {"record_type": "phage", "genome_id": "", "accession": "NA", "isolation_host": "NA", "host_species": "NA", "year": "NA", "gc_percent": "NA", "notes": ""}
    spec = {"require_phage_keyword": True, "exclude_regex": "species 3 ", "required_note_review_statuses": R.REVIEWED}
    m = m.withColumn("organism", F.concat(F.col("organism"), F.lit(" ")))
    out = import_source(m, spec, aliases, defaults, "imp")["rows"]
    return out.select(F.col("_order").alias("row_number"), "genome_id", "accession", "year", "gc_percent")


@register(
    "evidence_normalization_genes",
    f"""WITH {GENES}, h AS (SELECT row_number AS r, 'p' || (start::BIGINT % 900) AS q, 'PF' || (start::BIGINT % 50) AS d, (start::BIGINT % 300 + 1) AS s, CASE WHEN start::BIGINT % 6 = 0 THEN 'hmmer 3.4' ELSE 'default tool' END AS tool FROM genes),
    k AS (SELECT *, row_number() OVER (PARTITION BY q, d, s ORDER BY r) AS n FROM h WHERE substr(q, 2)::INT < 800 AND s < 290)
    SELECT r AS row_number, 'A' || substr(q, 2) AS annotation_gene_id, d AS domain_id, d AS domain_name, s AS start_aa, s + 10 AS end_aa, tool FROM k WHERE n = 1""",
)
def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    from evispark.bindings.base import genes

    g = genes(spark, sf)
    start = F.col("start").cast("bigint")
    s = start % 300 + 1
    hits = g.select(
        "row_number",
        F.concat(F.lit("p"), (start % 900).cast("string")).alias("qseqid"),
        F.concat(F.lit("PF"), (start % 50).cast("string")).alias("Domain ID"),
        F.when(s >= 290, "late").otherwise(s.cast("string")).alias("qstart"),
        (s + 10).cast("string").alias("qend"),
        F.when(start % 6 == 0, "hmmer 3.4").otherwise("NA").alias("Tool"),
    )
    known = g.select((start % 900).alias("k")).distinct().filter("k < 800").select(
        F.concat(F.lit("A"), F.col("k").cast("string")).alias("annotation_gene_id"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("protein_id")
    )
    out = normalize_hits(hits, "domain", {"tool": "default tool", "evidence_source": "reviewed"}, known)["hits"]
    return out.select("row_number", "annotation_gene_id", "domain_id", "domain_name", "start_aa", "end_aa", "tool")

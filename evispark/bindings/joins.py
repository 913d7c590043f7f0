"""Joins and id resolution on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import MANIFEST, manifest, register, table
from evispark.operators.graph import score_edges
from evispark.operators.intervals import canonical_pairs
from evispark.operators.joins import (
    alias_map, candidate_list, compatibility, content_lint, ids_diff, ids_intersect, key_universe, lookup_left, map_ids, map_stats, parity, patch_merge,
    propose_matches, resolve_entities, reviewed_mapping, scorecard, semi_with_report, union_prefer, unknown_ids,
)
from evispark.plans.hosts import build_links


@register(
    "lookup_last_wins_lineitem",
    """WITH d AS (SELECT p_size, max_by(p_name, p_partkey) AS p_name, max(p_partkey) AS k FROM part GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, d.p_name FROM lineitem LEFT JOIN d ON l_quantity::INT = p_size""",
)
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_quantity").cast("int").alias("p_size"))
    return lookup_left(li, table(spark, sf, "part").select("p_size", "p_name", "p_partkey"), "p_size", "p_partkey").drop("p_size")


@register(
    "lookup_two_keys_lineitem",
    """WITH d AS (SELECT p_brand, p_type, max_by(p_partkey, p_partkey) AS last_part FROM part GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, last_part FROM (SELECT *, 'Brand#' || (l_suppkey % 30) AS b, CASE l_linestatus WHEN 'O' THEN 'PROMO' ELSE 'SMALL' END AS t FROM lineitem)
    LEFT JOIN d ON b = p_brand AND t = p_type""",
)
def _lookup_two(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("p_brand"),
        F.when(F.col("l_linestatus") == "O", "PROMO").otherwise("SMALL").alias("p_type"),
    )
    dim = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", F.col("p_partkey").alias("last_part"))
    return lookup_left(li, dim, ["p_brand", "p_type"], "p_partkey").drop("p_brand", "p_type")


@register(
    "semi_join_with_skipped_lineitem",
    """SELECT l_returnflag, count(*) FILTER (o_orderstatus <> 'F') AS kept, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') AS skipped
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _semi(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept, skipped = semi_with_report(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), known, "l_orderkey")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("kept")).withColumn("skipped", F.lit(skipped.first()["skipped"]))  # one row


@register(
    "unknown_ids_orders",
    f"""WITH {MANIFEST}, v AS (SELECT accession AS id FROM manifest UNION ALL SELECT source FROM manifest)
    SELECT DISTINCT id FROM v WHERE id NOT IN ('', 'NA') AND id NOT IN (SELECT genome_id FROM manifest WHERE record_type = 'host')""",
)
def _unknown(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    return unknown_ids(m, ["accession", "source"], m.filter("record_type = 'host'").select("genome_id"))


@register(
    "content_lint_orders",
    f"""WITH {MANIFEST} SELECT 'unknown_sources' AS lint, count(DISTINCT source) AS count FROM manifest WHERE source <> '' AND source NOT IN (SELECT genome_id FROM manifest)
    UNION ALL SELECT 'temperate_rows', count(*) FROM manifest WHERE phage_lifestyle = 'temperate' UNION ALL SELECT 'input_is_generated_output', 1""",
)
def _lint(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    checks = {"unknown_sources": (["source"], m.select("genome_id")), "unknown_hosts": (["genome_id"], m.select("genome_id"))}
    return content_lint(m, checks, "results/x.tsv", ("results/",), ("phage_lifestyle", "temperate"))


@register(
    "scored_edges_lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, i >= 95 AND c >= 85 AS passes_threshold, i >= 95 AND c >= 85 AND ok AS included_in_clustering,
      CASE WHEN i IS NULL AND ok THEN 'invalid identity_percent' WHEN i IS NULL THEN 'invalid identity_percent; one or both ids are not eligible' WHEN ok THEN 'OK' ELSE 'one or both ids are not eligible' END AS notes
    FROM (SELECT *, CASE WHEN l_tax = 0.08 THEN NULL ELSE round(100 - l_discount * 100, 3) END AS i, l_quantity * 2 AS c, (p_size > 5 AND s_acctbal > 0) AS ok
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)""".replace("i >= 95 AND c >= 85 AS passes", "coalesce(i >= 95 AND c >= 85, false) AS passes").replace(
        "i >= 95 AND c >= 85 AND ok AS", "coalesce(i >= 95 AND c >= 85, false) AND ok AS"
    ),
)
def _edges(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = similarity(spark, sf)
    return score_edges(edges, nodes).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "passes_threshold", "included_in_clustering", "notes"
    )


def similarity(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as similarity edges between a part and a supplier, and the eligible ends."""
    li = table(spark, sf, "lineitem")
    part, supplier = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    edges = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        part.alias("genome_id_1"),
        supplier.alias("genome_id_2"),
        F.when(F.col("l_tax") == 0.08, "n/a").otherwise(F.round(100 - F.col("l_discount") * 100, 3).cast("string")).alias("identity_percent"),
        (F.col("l_quantity") * 2).alias("coverage_percent"),
    )
    nodes = (
        table(spark, sf, "part").filter("p_size > 5").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
        .unionByName(table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")))
    )
    return edges, nodes


_RESOLVED = f"""{MANIFEST}, ph AS (SELECT * FROM manifest WHERE record_type IN ('phage', 'prophage')), ho AS (SELECT * FROM manifest WHERE record_type = 'host'),
  nm AS (SELECT lower(host_species) AS a, lower(host_strain) AS b, count(*) AS hits, min(genome_id) AS pid FROM ho WHERE host_species <> '' OR host_strain <> '' GROUP BY 1, 2),
  lb AS (SELECT ph.*, concat_ws(' | ', CASE WHEN host_species NOT IN ('', '-') THEN host_species END, CASE WHEN host_strain <> '' THEN host_strain END, CASE WHEN isolation_host <> 'NA' THEN isolation_host END) AS label FROM ph),
  rs AS (SELECT lb.*, ho.genome_id AS hid, hits, pid, CASE WHEN ho.genome_id IS NOT NULL THEN 'source_matches_host_genome_id' WHEN hits = 1 THEN 'host_species_strain_exact_match'
      WHEN hits > 1 THEN 'ambiguous_host_species_strain_match' WHEN label <> '' THEN 'metadata_only_host_no_genome' ELSE 'no_host_metadata' END AS link_status
    FROM lb LEFT JOIN ho ON lb.source = ho.genome_id LEFT JOIN nm ON lower(lb.host_species) = a AND lower(lb.host_strain) = b),
  rv AS (SELECT *, CASE WHEN hid IS NOT NULL THEN hid WHEN hits = 1 THEN pid WHEN hits > 1 THEN '' WHEN label <> '' THEN 'metadata_host_' || left(sha256(lower(host_species || '|' || host_strain || '|' || label)), 12) ELSE '' END AS resolved_id FROM rs)"""


def resolved_orders(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    hosts = m.filter("record_type = 'host'").select(F.col("genome_id").alias("host_genome_id"), "host_species", "host_strain")
    return resolve_entities(m.filter(F.col("record_type").isin("phage", "prophage")), hosts)


@register("entity_resolution_orders", f"WITH {_RESOLVED} SELECT genome_id, link_status, resolved_id, label AS entity_label FROM rv")
def _resolve(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_orders(spark, sf).select("genome_id", "link_status", "resolved_id", "entity_label")


@register(
    "relationship_links_orders",
    f"""WITH {_RESOLVED}, k AS (SELECT *, CASE WHEN record_type = 'prophage' THEN 'prophage_resident_host' WHEN isolation_host <> 'NA' THEN 'isolation_host' WHEN link_status <> 'no_host_metadata' THEN 'reported_host' ELSE 'predicted_host' END AS kind,
      CASE WHEN link_status IN ('ambiguous_host_species_strain_match', 'no_host_metadata') THEN 'unresolved' WHEN link_status = 'source_matches_host_genome_id' THEN 'reviewed' ELSE 'inferred' END AS rst FROM rv WHERE resolved_id <> '' OR label <> '')
    SELECT 'relationship_' || left(sha256(lower(genome_id || '|' || resolved_id || '|' || kind || '|' || link_status)), 12) AS relationship_id, genome_id AS phage_id, resolved_id AS host_id, kind AS relationship_type, rst AS relationship_status,
      link_status AS relationship_evidence, CASE WHEN source <> '' THEN source WHEN accession <> 'NA' THEN accession ELSE genome_id END AS source_reference,
      CASE WHEN rst = 'reviewed' THEN 'high' WHEN link_status = 'host_species_strain_exact_match' THEN 'medium' WHEN rst = 'unresolved' THEN 'low' ELSE 'medium' END AS confidence FROM k""",
)
def _links(spark: SparkSession, sf: str) -> DataFrame:
    return build_links(resolved_orders(spark, sf))


@register(
    "patch_merge_suppliers",
    """WITH p AS (SELECT 'S' || l_suppkey AS id, max_by(CASE WHEN l_quantity > 10 THEN l_quantity::INT::VARCHAR END, CASE WHEN l_quantity > 10 THEN o END) AS a, max_by(CASE WHEN l_tax > 0.01 THEN l_returnflag END, CASE WHEN l_tax > 0.01 THEN o END) AS b
      FROM (SELECT *, l_orderkey::HUGEINT * 1000000 + l_linenumber * 100000 + l_partkey AS o FROM lineitem) GROUP BY 1),
    s AS (SELECT 'S' || s_suppkey AS id, s_name AS name, 'base' AS a FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'N' || n_nationkey, n_name, 'base' FROM nation)
    SELECT coalesce(s.id, p.id) AS id, s.name, coalesce(p.a, s.a) AS a, p.b, CASE WHEN p.id IS NULL THEN 'not_supplied' ELSE 'supplied' END AS tool_status FROM s FULL JOIN p ON s.id = p.id""",
)
def _patch(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    patch = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("id"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int").cast("string")).otherwise("-").alias("a"),
        F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).otherwise("NA").alias("b"),
        (F.col("l_orderkey").cast("decimal(30,0)") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("o"),
    )
    base = table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("base").alias("a")
    )
    nations = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("base").alias("a"))
    base = base.unionByName(nations)  # no line item patches a nation
    return patch_merge(base, patch, "id", ["a", "b"], "o", "tool_status")


_COMPAT = """dl AS (SELECT 'U' || user_id AS phage, 'H' || max(floor(value)::BIGINT) AS host, CASE WHEN user_id % 4 = 0 THEN 'K1' ELSE '' END AS k FROM events GROUP BY user_id),
  hd AS (SELECT 'H' || l_suppkey AS host, p_type AS ty, 'sys ' || p_name AS sy FROM lineitem JOIN part ON l_partkey = p_partkey),
  ad AS (SELECT 'U' || user_id AS phage, event_type AS cl, CASE WHEN floor(value)::INT % 3 = 0 THEN 'PROMO' WHEN floor(value)::INT % 3 = 1 THEN 'sys red ring' ELSE 'none' END AS ta FROM events WHERE event_type = 'purchase')"""


def compatibility_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    u = F.col("user_id")
    phage = F.concat(F.lit("U"), u.cast("string")).alias("phage_genome_id")
    links = e.groupBy("user_id").agg(F.max(F.floor("value")).alias("top")).select(
        phage, F.concat(F.lit("H"), F.col("top").cast("string")).alias("host_genome_id"), F.when(u % 4 == 0, "K1").otherwise("").alias("K_type"), F.lit("").alias("O_type")
    )
    lp = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    defense = lp.select(
        F.concat(F.lit("H"), F.col("l_suppkey").cast("string")).alias("host_genome_id"),
        F.col("p_type").alias("defense_type"),
        F.concat(F.lit("sys "), F.col("p_name")).alias("defense_system"),
    )
    third = F.floor("value") % 3
    anti = e.filter("event_type = 'purchase'").select(
        phage, F.col("event_type").alias("antidefense_class"), F.when(third == 0, "PROMO").when(third == 1, "sys red ring").otherwise("none").alias("target_defense_system")
    )
    return links, defense, anti


@register(
    "compatibility_sets_events",
    f"""WITH {_COMPAT}, h AS (SELECT host, count(*) AS n, string_agg(DISTINCT ty, ';' ORDER BY ty) AS tys, string_agg(DISTINCT sy, ';' ORDER BY sy) AS sys FROM hd GROUP BY 1),
    a AS (SELECT phage, count(*) AS n, string_agg(DISTINCT cl, ';' ORDER BY cl) AS cls, string_agg(DISTINCT CASE WHEN ta <> 'none' THEN ta END, ';' ORDER BY CASE WHEN ta <> 'none' THEN ta END) AS tas FROM ad GROUP BY 1),
    m AS (SELECT dl.phage, dl.host, count(DISTINCT ta) AS n, string_agg(DISTINCT ta, ';' ORDER BY ta) AS t FROM dl JOIN ad ON ad.phage = dl.phage JOIN hd ON hd.host = dl.host AND (hd.ty = ta OR hd.sy = ta) WHERE ta <> 'none' GROUP BY 1, 2)
    SELECT dl.phage AS phage_genome_id, dl.host AS host_genome_id, coalesce(h.n, 0) AS host_defense_system_count, coalesce(h.tys, '') AS host_defense_types, coalesce(h.sys, '') AS host_defense_systems,
      coalesce(a.n, 0) AS phage_antidefense_count, coalesce(a.cls, '') AS phage_antidefense_classes, coalesce(a.tas, '') AS phage_antidefense_targets, coalesce(m.n, 0) AS matched_counterdefense_count, coalesce(m.t, '') AS matched_counterdefense_targets,
      CASE WHEN h.n > 0 AND a.n > 0 THEN CASE WHEN k <> '' THEN 'receptor_defense_counterdefense_features_available' ELSE 'defense_counterdefense_features_available_no_receptor_metadata' END
        WHEN h.n > 0 THEN 'host_defense_only' WHEN a.n > 0 THEN 'phage_counterdefense_only' ELSE 'no_defense_counterdefense_features' END AS compatibility_feature_status
    FROM dl LEFT JOIN h USING (host) LEFT JOIN a USING (phage) LEFT JOIN m ON m.phage = dl.phage AND m.host = dl.host""",
)
def _compatibility(spark: SparkSession, sf: str) -> DataFrame:
    df = compatibility(*compatibility_tables(spark, sf))
    return df.drop("K_type", "O_type", "receptor_metadata_available", "defense_metadata_available", "counterdefense_metadata_available")


_MAP = """mp AS (SELECT 'U' || c_custkey AS source_id, CASE WHEN c_custkey % 7 = 3 THEN '' ELSE 'C' || (c_custkey / 2)::INT END AS canonical_id, CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN '' ELSE 'Reviewed' END AS st FROM customer
    UNION ALL SELECT 'U' || c_custkey, 'C0', 'approved' FROM customer WHERE c_custkey % 11 = 4)"""


def id_mapping(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    source = F.concat(F.lit("U"), k.cast("string")).alias("source_id")
    first = c.select(
        source,
        F.when(k % 7 == 3, "").otherwise(F.concat(F.lit("C"), F.round(k / 2).cast("int").cast("string"))).alias("canonical_id"),
        F.when(k % 5 == 0, "pending").when(k % 5 == 1, "").otherwise("Reviewed").alias("review_status"),
    )
    return first.unionByName(c.filter(k % 11 == 4).select(source, F.lit("C0").alias("canonical_id"), F.lit("approved").alias("review_status")))


_MAP = _MAP.replace("(c_custkey / 2)::INT", "((c_custkey + 1) // 2)")
_USABLE = f"""{_MAP}, us AS (SELECT source_id, min(canonical_id) AS cid, max(canonical_id) AS other FROM mp WHERE st <> 'pending' AND canonical_id <> '' GROUP BY 1)"""


@register(
    "id_mapping_events",
    f"""WITH {_USABLE} SELECT event_id, coalesce(cid, '') AS canonical, CASE WHEN cid IS NULL THEN 'unresolved' ELSE 'mapped' END AS canonical_status,
      coalesce(cid, 'U' || user_id) AS fallback, CASE WHEN cid IS NULL THEN 'source_id' ELSE 'mapped' END AS fallback_status
    FROM events LEFT JOIN (SELECT * FROM us WHERE cid = other) ON source_id = 'U' || user_id""",
)
def _map_ids(spark: SparkSession, sf: str) -> DataFrame:
    usable, _ = reviewed_mapping(id_mapping(spark, sf))
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("u"))
    return map_ids(map_ids(e, usable, "u", "canonical"), usable, "u", "fallback", fallback=True).drop("u")


@register(
    "id_mapping_issues",
    f"""WITH {_USABLE} SELECT severity, message, source_id FROM (SELECT 'warning' AS severity, 'not reviewed; mapping skipped' AS message, source_id FROM mp WHERE st = 'pending'
      UNION ALL SELECT 'error', 'reviewed but missing canonical_id', source_id FROM mp WHERE st <> 'pending' AND canonical_id = '' UNION ALL SELECT 'error', 'maps to multiple canonical ids', source_id FROM us WHERE cid <> other)""",
)
def _map_issues(spark: SparkSession, sf: str) -> DataFrame:
    return reviewed_mapping(id_mapping(spark, sf))[1]


_ALIAS = """al AS (SELECT p_partkey, 'P' || p_partkey AS c, unnest(['P' || p_partkey, p_name || ' ' || p_brand, CASE WHEN p_size = 1 THEN 'NA' ELSE p_type || p_size END]) AS a FROM part),
  cl AS (SELECT a, min(c) AS lo, max(c) AS hi FROM al WHERE a <> 'NA' GROUP BY 1)"""


def _alias_dim(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("annotation_gene_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("gene_id"),
        F.when(F.col("p_size") == 1, "NA").otherwise(F.concat("p_type", F.col("p_size").cast("string"))).alias("protein_id"),
    )


@register("alias_closure_parts", f"WITH {_ALIAS} SELECT a AS alias, lo AS canonical FROM cl WHERE lo = hi")
def _alias(spark: SparkSession, sf: str) -> DataFrame:
    return alias_map(_alias_dim(spark, sf), "annotation_gene_id", ["gene_id", "protein_id", "id"])[0]


@register("ambiguous_aliases_parts", f"WITH {_ALIAS} SELECT a AS alias, lo AS first_canonical, hi AS last_canonical FROM cl WHERE lo <> hi")
def _ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return alias_map(_alias_dim(spark, sf), "annotation_gene_id", ["gene_id", "protein_id", "id"])[1]


_IDS = """ids AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN lower(c_name) WHEN c_custkey % 4 = 2 THEN 'x' || c_name ELSE replace(c_name, '#', '-') END AS source_id FROM customer),
  cn AS (SELECT c_name AS cid FROM customer UNION SELECT 'customer ' || lpad(c_custkey::VARCHAR, 9, '0') FROM customer WHERE c_custkey % 8 = 1),
  ex AS (SELECT c_name AS source_id, 'C' || c_custkey AS ecid, CASE WHEN c_custkey % 24 = 0 THEN 'accepted' ELSE 'pending' END AS est FROM customer WHERE c_custkey % 12 = 0),
  fo AS (SELECT regexp_replace(lower(cid), '[^a-z0-9]+', '', 'g') AS k, count(*) AS hits, min(cid) AS cand FROM cn GROUP BY 1)"""


def _match_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    ids = c.select(
        F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.lower("c_name")).when(k % 4 == 2, F.concat(F.lit("x"), F.col("c_name"))).otherwise(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("id")
    )
    canon = c.select("c_name").unionByName(
        c.filter(k % 8 == 1).select(F.concat(F.lit("customer "), F.lpad(k.cast("string"), 9, "0")).alias("c_name"))
    )
    existing = c.filter(k % 12 == 0).select(
        F.col("c_name").alias("source_id"), F.concat(F.lit("C"), k.cast("string")).alias("canonical_id"), F.when(k % 24 == 0, "accepted").otherwise("pending").alias("review_status")
    )
    return ids, canon, existing


@register(
    "match_proposals_customers",
    f"""WITH {_IDS} SELECT source_id, CASE WHEN c.cid IS NOT NULL THEN 'exact_match' WHEN hits = 1 THEN 'normalized_unique_candidate' WHEN hits > 1 THEN 'ambiguous_normalized_candidates' ELSE 'no_candidate' END AS candidate_status,
      CASE WHEN c.cid IS NOT NULL THEN 1 ELSE coalesce(hits, 0) END AS candidate_count, CASE WHEN c.cid IS NOT NULL THEN c.cid WHEN hits = 1 THEN cand ELSE '' END AS proposed_canonical_id,
      CASE WHEN est = 'accepted' THEN 'reviewed_mapped' WHEN est IS NOT NULL THEN 'existing_not_reviewed' WHEN c.cid IS NOT NULL THEN 'exact_match' WHEN hits = 1 THEN 'normalized_unique_candidate' WHEN hits > 1 THEN 'ambiguous_normalized_candidates' ELSE 'no_candidate' END AS mapping_status,
      CASE WHEN est IS NOT NULL THEN 'preserved_existing_mapping' ELSE 'added_pending_mapping_row' END AS map_action, coalesce(est, 'pending') AS review_status
    FROM ids LEFT JOIN cn c ON source_id = c.cid LEFT JOIN fo ON regexp_replace(lower(source_id), '[^a-z0-9]+', '', 'g') = k LEFT JOIN ex USING (source_id)""",
)
def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    return propose_matches(*_match_tables(spark, sf))


_FOLD = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@register(
    "match_candidates_customers",
    f"WITH {_IDS} SELECT source_id, {_FOLD.format('source_id')} AS folded, count(*) AS candidates FROM ids JOIN cn ON {_FOLD.format('source_id')} = {_FOLD.format('cid')} GROUP BY ALL",
)
def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    ids, canon, _ = _match_tables(spark, sf)
    return candidate_list(ids, canon)[0]


@register(
    "match_candidates_by_name_customers",
    f"WITH {_IDS} SELECT DISTINCT {_FOLD.format('cid')} AS folded, cid AS candidate_id FROM cn JOIN ids ON {_FOLD.format('source_id')} = {_FOLD.format('cid')}",
)
def _candidates_by_name(spark: SparkSession, sf: str) -> DataFrame:
    ids, canon, _ = _match_tables(spark, sf)
    return candidate_list(ids, canon)[1]


@register(
    "pairs_with_hits_lineitem",
    "SELECT DISTINCT least(l_partkey, l_suppkey) AS id_1, greatest(l_partkey, l_suppkey) AS id_2 FROM lineitem WHERE l_partkey <> l_suppkey",
)
def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_pairs(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@register(
    "scorecard_documents",
    """WITH k AS (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE n_chars > 2000 UNION SELECT page_id FROM pages UNION SELECT item_id FROM benchmark)
    SELECT k.doc_id, '' AS repeated_keys, l.doc_id IS NOT NULL AS in_labels, l.quality AS labels_quality, l.toxic AS labels_toxic, d.doc_id IS NOT NULL AS in_long, d.lang AS long_lang, p.page_id IS NOT NULL AS in_pages, p.url AS pages_url,
      b.item_id IS NOT NULL AS in_benchmark, length(b.text)::INT AS benchmark_n
    FROM k LEFT JOIN labels l ON l.doc_id = k.doc_id LEFT JOIN documents d ON d.doc_id = k.doc_id AND d.n_chars > 2000 LEFT JOIN pages p ON p.page_id = k.doc_id LEFT JOIN benchmark b ON b.item_id = k.doc_id""",
)
def _scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard(
        {
            "labels": table(spark, sf, "labels"),
            "long": table(spark, sf, "documents").filter("n_chars > 2000").select("doc_id", "lang"),
            "pages": table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"),
            "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("n")),
        },
        "doc_id",
    )


def matrix_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Busy users x event types as a wide matrix with blanks, and the same tests in long form."""
    e = table(spark, sf, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    seen = e.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("value") >= 40, 1).otherwise(0)).alias("v"))
    kept = seen.filter((F.col("user_id") + F.length("event_type")) % 9 != 0)
    wide = kept.groupBy("user_id").pivot("event_type", kinds).agg(F.max("v"))
    return wide, kept


@register(
    "matrix_parity_events",
    """WITH c AS (SELECT user_id, event_type, max(CASE WHEN value >= 40 THEN 1 ELSE 0 END) AS v FROM events WHERE (user_id + length(event_type)) % 9 <> 0 GROUP BY 1, 2),
    n AS (SELECT count(*) AS n, sum(v)::BIGINT AS p, count(DISTINCT user_id) AS u FROM c), x AS (SELECT count(*) AS t FROM c WHERE event_type = 'view' AND user_id % 50 = 7)
    SELECT n + t AS rows, p + (SELECT sum(v)::BIGINT FROM c WHERE event_type = 'view' AND user_id % 50 = 7) AS positive, n + t - p - (SELECT sum(v)::BIGINT FROM c WHERE event_type = 'view' AND user_id % 50 = 7) AS negative, 0 AS tested_false, 0 AS productive_measured,
      (SELECT count(*) FROM c WHERE event_type = 'signup') AS unresolved_phage_ids, 0 AS unresolved_host_ids, t AS duplicate_interaction_ids, n AS matrix_tested, p AS matrix_positive, n - p AS matrix_negative, u * 5 - n AS matrix_blank, 0 AS matrix_unsupported, false AS parity_ok FROM n, x""",
)
def _parity(spark: SparkSession, sf: str) -> DataFrame:
    from evispark.operators.reshape import cell_result, unpivot_cells

    wide, kept = matrix_tables(spark, sf)
    cells = unpivot_cells(wide, "user_id").withColumn("result", cell_result("matrix_value"))
    rows = kept.select(
        F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("interaction_id"),
        F.col("event_type").alias("phage_id"),
        F.col("user_id").alias("host_id"),
        F.lit("true").alias("tested"),
        F.when(F.col("v") == 1, "positive").otherwise("negative").alias("spot_result"),
        F.lit("not_measured").alias("productive_infection_result"),
    )
    rows = rows.unionByName(rows.filter("phage_id = 'view' AND host_id % 50 = 7"))
    phages = table(spark, sf, "events").filter("event_type <> 'signup'").select("event_type")
    return parity(rows, cells, phages, table(spark, sf, "events").select("user_id"))


@register(
    "mapping_statistics_customers",
    f"""WITH {_MAP}, src AS (SELECT DISTINCT 'U' || user_id AS s FROM events), can AS (SELECT 'C' || c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'),
    m AS (SELECT source_id, max(CASE WHEN lower(st) IN ('reviewed', 'approved') THEN 1 ELSE 0 END) AS rv FROM mp GROUP BY 1)
    SELECT (SELECT count(*) FROM mp) AS rows, (SELECT count(*) FROM m) AS mapped_ids, (SELECT sum(rv)::BIGINT FROM m) AS reviewed, (SELECT count(*) FROM mp) - (SELECT sum(rv)::BIGINT FROM m) AS pending,
      (SELECT count(*) FROM src WHERE s NOT IN (SELECT source_id FROM mp)) AS missing_source_ids, (SELECT count(*) FROM m WHERE source_id NOT IN (SELECT s FROM src)) AS extra_source_ids,
      (SELECT count(*) FROM mp WHERE canonical_id = '') AS missing_canonical, (SELECT count(*) FROM mp WHERE canonical_id <> '' AND canonical_id NOT IN (SELECT c FROM can)) AS unresolved_canonical, 1 AS duplicate_source_ids, 1 AS duplicate_canonical_ids, true AS blocking""",
)
def _map_stats(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")))
    canon = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")))
    return map_stats(id_mapping(spark, sf), sources, canon)


@register(
    "preferred_union_orders",
    """WITH a AS (SELECT o_custkey AS c, o_orderpriority AS p, o_orderkey AS k, 0 AS t FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'P'),
    r AS (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY t, k) AS n FROM a) SELECT c AS o_custkey, p AS o_orderpriority, k AS o_orderkey, CASE t WHEN 0 THEN 'first' ELSE 'second' END AS origin FROM r WHERE n = 1""",
)
def _prefer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    first, second = o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus <> 'P'").drop("o_orderstatus")
    return union_prefer(first, second, ["o_custkey", "o_orderpriority"], "o_orderkey")


@register(
    "id_set_operations_orders",
    """SELECT 'diff' AS op, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'intersect', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'universe', id FROM (SELECT o_custkey AS id FROM orders UNION SELECT s_suppkey FROM supplier UNION SELECT p_partkey FROM part)""",
)
def _sets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    universe = key_universe(o.select("o_custkey"), table(spark, sf, "supplier").select("s_suppkey"), table(spark, sf, "part").select("p_partkey"))
    return (
        ids_diff(c, urgent).withColumn("op", F.lit("diff"))
        .unionByName(ids_intersect(c, urgent).withColumn("op", F.lit("intersect")))
        .unionByName(universe.withColumn("op", F.lit("universe")))
    )

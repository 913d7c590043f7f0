"""Summaries, rates and coverage on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import ASSAYS, GENES, MANIFEST, PRODUCTS, assays, genes, manifest, pick, register, sql_pick, table
from evispark.bindings.joins import matrix_tables
from evispark.functions import rules as R
from evispark.operators.aggregates import (
    architecture, architecture_text, assay_breadth, assert_metrics, assessed_features, breadth_summary, count_matrix, count_matrix_blocks, count_matrix_long, coverage_gate, feature_coverage,
    features_by_entity, freq, group_rate, label_counts, locus_support, matrix_stats, metrics_long, overlap_groups, pair_completeness, receptor_support,
    scope_counts, source_summary, status_report, summarise_groups, support_audit, test_coverage,
)
from evispark.operators.reshape import explode_list, unpivot_cells
from evispark.operators.scoring import module_clusters
from evispark.plans.coverage import assay_feature_coverage


@register(
    "group_summary_parts",
    f"""WITH g AS (SELECT {sql_pick(PRODUCTS, 'l_partkey')} AS key, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS m, l_suppkey, l_orderkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'NA' ELSE l_linestatus || l_suppkey END AS st FROM lineitem)
    SELECT key, count(*) AS member_count, count(DISTINCT l_suppkey) AS supplier_count, count(DISTINCT l_orderkey) AS order_count, min_by(l_returnflag, m) AS first_flag, min_by(st, CASE WHEN st <> 'NA' THEN m END) AS first_status FROM g GROUP BY 1""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        pick(PRODUCTS, F.col("l_partkey")).alias("key"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("m"),
        "l_suppkey", "l_orderkey", "l_returnflag",
        F.when(F.col("l_linestatus") == "O", "NA").otherwise(F.concat(F.col("l_linestatus"), F.col("l_suppkey").cast("string"))).alias("st"),
    )
    return summarise_groups(li, "key", "m", {"supplier_count": "l_suppkey", "order_count": "l_orderkey"}, {"first_flag": "l_returnflag"}, {"first_status": "st"})


@register("count_matrix_parts", "PIVOT part ON p_type USING count(*) GROUP BY p_brand")
def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A column for every part type there is; the types are few, so their names go through the driver."""
    p = table(spark, sf, "part")
    names = [r[0] for r in p.select("p_type").distinct().orderBy("p_type").collect()]
    return count_matrix(p, ["p_brand"], "p_type", names)


@register(
    "count_matrix_blocks_parts",
    """WITH n AS (SELECT p_name, (row_number() OVER (ORDER BY p_name) - 1)::BIGINT AS no FROM (SELECT DISTINCT p_name FROM part)), c AS (SELECT p_brand, no, count(*) AS k FROM part JOIN n USING (p_name) GROUP BY 1, 2),
    b AS (SELECT DISTINCT p_brand, no // 64 AS block FROM c) SELECT b.p_brand, block, string_agg(coalesce(k, 0)::VARCHAR, ';' ORDER BY i) AS counts FROM b CROSS JOIN range(64) t(i) LEFT JOIN c ON c.p_brand = b.p_brand AND c.no = block * 64 + i GROUP BY 1, 2""",
)
def _matrix_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by part names: a column per name, in blocks of 64 columns; blocks without a count are left out."""
    blocks, _ = count_matrix_blocks(table(spark, sf, "part"), ["p_brand"], "p_name", 64)
    return blocks.withColumn("counts", F.array_join(F.transform("counts", lambda x: x.cast("string")), ";"))


@register("count_matrix_columns_parts", "SELECT p_name, (row_number() OVER (ORDER BY p_name) - 1)::BIGINT AS column_no FROM (SELECT DISTINCT p_name FROM part)")
def _matrix_columns(spark: SparkSession, sf: str) -> DataFrame:
    return count_matrix_blocks(table(spark, sf, "part"), ["p_brand"], "p_name", 64)[1]


@register("count_matrix_long_parts", "SELECT p_brand, p_size, count(*) AS count FROM part GROUP BY 1, 2")
def _matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return count_matrix_long(table(spark, sf, "part"), ["p_brand"], "p_size")


def _module_source(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    evidence = F.concat_ws(";", F.when(k % 2 == 0, "rbp_keyword"), F.when(k % 3 == 0, "sequence_hit"), F.lit("length_support"))
    return p.select(
        F.concat(F.lit("cand_"), F.lpad(k.cast("string"), 8, "0")).alias("candidate_id"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("gc_"), F.col("p_size").cast("string"))).alias("gene_cluster_id"),
        F.when(k % 10 == 0, "").otherwise(F.col("p_type")).alias("predicted_enzyme_class"),
        F.col("p_brand").alias("genome_id"),
        F.when(F.col("p_size") % 7 == 0, "NA").otherwise(F.concat(F.lit("C"), (F.col("p_size") % 9).cast("string"))).alias("species_cluster_id"),
        evidence.alias("evidence_types"),
        F.round(F.col("p_retailprice") / 10000, 3).alias("confidence_score"),
        F.concat(F.lit("tier_"), (k % 3 + 1).cast("string")).alias("novelty_tier"),
        F.col("p_name").alias("product"),
        F.lit(None).cast("string").alias("module_cluster_id"),
    )


_MODULES = """c AS (SELECT p_partkey, 'cand_' || lpad(p_partkey::VARCHAR, 8, '0') AS cid, CASE WHEN p_partkey % 5 > 0 THEN 'gc_' || p_size WHEN p_partkey % 10 > 0 THEN p_type ELSE 'cand_' || lpad(p_partkey::VARCHAR, 8, '0') END AS key,
    CASE WHEN p_partkey % 10 > 0 THEN p_type END AS cls, p_brand AS g, CASE WHEN p_size % 7 > 0 THEN 'C' || (p_size % 9) END AS sp, round(p_retailprice / 10000, 3) AS sc, 'tier_' || (p_partkey % 3 + 1) AS tier, p_name FROM part),
  n AS (SELECT key, 'rbp_module_' || lpad(row_number() OVER (ORDER BY key)::VARCHAR, 6, '0') AS mid FROM (SELECT DISTINCT key FROM c))"""


@register(
    "module_clusters_parts",
    f"""WITH {_MODULES}, e AS (SELECT key, string_agg(DISTINCT x, ';' ORDER BY x) AS ev FROM (SELECT key, unnest(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'rbp_keyword' END, CASE WHEN p_partkey % 3 = 0 THEN 'sequence_hit' END, 'length_support'], lambda x: x IS NOT NULL)) AS x FROM c) GROUP BY 1)
    SELECT mid AS module_cluster_id, key AS module_key, count(*) AS candidate_count, count(DISTINCT g) AS genome_count, count(DISTINCT sp) AS species_cluster_count, max(sc) AS max_confidence_score, min_by(p_name, cid) AS representative_product,
      coalesce(string_agg(DISTINCT cls, ';' ORDER BY cls), '') AS predicted_enzyme_classes, any_value(ev) AS evidence_types, string_agg(DISTINCT tier, ';' ORDER BY tier) AS novelty_tiers FROM c JOIN n USING (key) JOIN e USING (key) GROUP BY 1, 2""",
)
def _modules(spark: SparkSession, sf: str) -> DataFrame:
    modules = module_clusters(_module_source(spark, sf))[1]
    return modules.withColumn("predicted_enzyme_classes", F.coalesce("predicted_enzyme_classes", F.lit("")))


@register("module_members_parts", f"WITH {_MODULES} SELECT cid AS candidate_id, mid AS module_cluster_id FROM c JOIN n USING (key)")
def _module_members(spark: SparkSession, sf: str) -> DataFrame:
    return module_clusters(_module_source(spark, sf))[0].select("candidate_id", "module_cluster_id")


@register(
    "domain_architecture_orders",
    f"""WITH d AS (SELECT 'G' || l_orderkey AS g, CASE WHEN l_suppkey % 8 = 0 THEN 1000000000 ELSE l_partkey % 500 END AS s, CASE WHEN l_linenumber = 1 THEN '' ELSE {sql_pick(PRODUCTS, 'l_partkey')} END AS nm, 'PF' || l_suppkey || '.' || l_partkey || '.' || l_quantity::INT AS id, 'tool' || l_linenumber AS src FROM lineitem)
    SELECT g AS annotation_gene_id, string_agg(CASE WHEN nm <> '' THEN nm ELSE id END, '|' ORDER BY s, nm, id) AS domain_architecture, count(*) AS domain_count, string_agg(DISTINCT src, ';' ORDER BY src) AS domain_sources,
      trim(min_by(id || ':' || nm, (s, nm, id)), ':') || CASE WHEN bool_or(regexp_matches(CASE WHEN nm <> '' THEN nm ELSE id END, '(?i){R.SUPPORT_PATTERN}')) THEN ' (rbp_depolymerase_domain)' ELSE ' (domain_present)' END AS best_domain_hit FROM d GROUP BY 1""",
)
def _architecture(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    domains = li.select(
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("annotation_gene_id"),
        F.when(F.col("l_suppkey") % 8 > 0, F.col("l_partkey") % 500).alias("start_aa"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(pick(PRODUCTS, F.col("l_partkey"))).alias("domain_name"),
        F.concat(F.lit("PF"), F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))).alias("domain_id"),
        F.concat(F.lit("tool"), F.col("l_linenumber").cast("string")).alias("evidence_source"),
    )
    return architecture(domains).join(architecture_text(domains), "annotation_gene_id")


@register(
    "entity_features_orders",
    """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, coalesce(string_agg(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, ';' ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END), '') AS statuses,
      count(*) AS candidate_count, count(*) FILTER (o_totalprice > 400000) AS high_confidence_count, CASE WHEN count(*) = 1 THEN '1' ELSE '2plus' END AS candidate_count_bin,
      CASE count(*) FILTER (o_totalprice > 400000) WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2plus' END AS high_confidence_count_bin, 'assessed_positive' AS evidence_state FROM orders GROUP BY 1""",
)
def _features(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "NA").otherwise(F.col("o_orderstatus")))
    o = o.withColumn("c", F.col("o_custkey").cast("string"))
    out = features_by_entity(o, "c", {"priorities": "o_orderpriority", "statuses": "status"}, F.col("o_totalprice") > 400000)
    return out.withColumn("o_custkey", F.col("c").cast("bigint")).drop("c")


@register(
    "assessed_features_events",
    """WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT - 60 ELSE 0 END AS n, event_type = 'purchase' AND value > 75 AS f, CASE WHEN event_type = 'click' THEN event_type || (floor(value)::INT % 3) END AS t FROM events),
    a AS (SELECT user_id, greatest(max(n), 0) AS count, bool_or(f) AS f, coalesce(string_agg(DISTINCT t, ';' ORDER BY t), '') AS targets FROM e GROUP BY 1)
    SELECT user_id::VARCHAR AS phage, count, CASE WHEN count > 0 THEN 'assessed_positive' WHEN f THEN 'assessed_zero_detected' ELSE 'not_assessed' END AS evidence_state,
      CASE WHEN count = 1 THEN '1' WHEN count > 1 THEN '2plus' WHEN f THEN '0' ELSE 'not_assessed' END AS count_bin, targets FROM a""",
)
def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("phage"),
        F.when(kind == "error", F.floor("value") - 60).otherwise(0).cast("bigint").alias("n"),
        ((kind == "purchase") & (F.col("value") > 75)).alias("f"),
        F.when(kind == "click", F.concat(kind, (F.floor("value") % 3).cast("string"))).alias("t"),
    )
    return assessed_features(e, "phage", "n", "f", {"targets": "t"})


@register(
    "receptor_support_lineitem",
    """SELECT l_suppkey, count(*) AS protein_count, max(CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END) AS max_score, count(DISTINCT CASE WHEN l_partkey % 6 > 0 THEN l_partkey END) AS distinct_proteins, CASE WHEN count(*) = 1 THEN '1' ELSE '2plus' END AS protein_count_bin,
      CASE WHEN max(CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END) IS NULL THEN 'no_score' WHEN max(CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END) >= 0.9 THEN 'xgb_score_ge_0_9' WHEN max(CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END) >= 0.5 THEN 'xgb_score_0_5_to_0_9' ELSE 'xgb_score_lt_0_5' END AS max_score_bin FROM lineitem GROUP BY 1""",
)
def _receptor(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_partkey") % 6 == 0, "-").otherwise(F.col("l_partkey").cast("string")).alias("protein"),
        F.when(F.col("l_linenumber") == 3, "nan").otherwise((F.col("l_discount") * 10).cast("string")).alias("score"),
    )
    return receptor_support(li, "l_suppkey", "protein", "score")


@register(
    "locus_fingerprints_orders",
    """SELECT k AS l_orderkey, count(*) AS locus_protein_count, CASE WHEN count(*) = 1 THEN '1' ELSE '2plus' END AS locus_protein_count_bin,
      sha256(concat_ws(':', count(*), sum(('0x' || s[1:15])::BIGINT), sum(('0x' || s[16:30])::BIGINT), sum(('0x' || s[31:45])::BIGINT), sum(('0x' || s[46:60])::BIGINT))) AS locus_fingerprint_sha256
    FROM (SELECT CASE WHEN l_orderkey % 97 > 0 THEN l_orderkey END AS k, sha256(md5(l_partkey::VARCHAR)) AS s FROM lineitem) GROUP BY 1""",
)
def _locus(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("l_orderkey") % 97 > 0, F.col("l_orderkey")).alias("l_orderkey")
    li = table(spark, sf, "lineitem").select(key, F.md5(F.col("l_partkey").cast("string").cast("binary")).alias("s"))
    return locus_support(li, "l_orderkey", "s")


_BREADTH = f"""{ASSAYS}, br AS (SELECT phage_id, panel_id, count(*) AS n, count(*) FILTER (spot_result = 'positive') AS p FROM assays WHERE spot_result IN ('positive', 'negative') GROUP BY 1, 2),
  bf AS (SELECT *, p::DOUBLE / n AS f FROM br)"""


@register(
    "assay_breadth_events",
    f"""WITH {_BREADTH} SELECT phage_id, panel_id, n AS tested_host_count, p AS positive_host_count, round(f, 9) AS positive_fraction,
      round((f + 3.8416 / (2 * n) - 1.96 * sqrt((f * (1 - f) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 9) AS ci95_low, round((f + 3.8416 / (2 * n) + 1.96 * sqrt((f * (1 - f) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 9) AS ci95_high FROM bf""",
)
def _breadth(spark: SparkSession, sf: str) -> DataFrame:
    out = assay_breadth(assays(spark, sf), ["phage_id", "panel_id"])
    for c in ("positive_fraction", "ci95_low", "ci95_high"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@register(
    "breadth_summary_events",
    f"WITH {_BREADTH} SELECT count(*) AS n_samples, count(DISTINCT round(f, 3)) AS n_classes, 'descriptive_breadth_available' AS status FROM bf",
)
def _breadth_summary(spark: SparkSession, sf: str) -> DataFrame:
    return breadth_summary(assay_breadth(assays(spark, sf), ["phage_id", "panel_id"]))


_GATE = f"""{_BREADTH}, gs AS (SELECT f, CASE WHEN n < 40 THEN 'not_assessed' WHEN n % 3 = 0 THEN 'NA' ELSE 'bin' || (n // 12) END AS feat FROM bf),
  gg AS (SELECT feat, count(*) AS c, count(DISTINCT round(f, 3)) AS d, avg(f) AS m FROM gs WHERE feat NOT IN ('not_assessed', 'NA') GROUP BY 1)"""


def _gate_samples(spark: SparkSession, sf: str) -> DataFrame:
    b = assay_breadth(assays(spark, sf), ["phage_id", "panel_id"])
    n = F.col("tested_host_count")
    feature = F.when(n < 40, "not_assessed").when(n % 3 == 0, "NA").otherwise(F.concat(F.lit("bin"), F.floor(n / 12).cast("string")))
    return b.withColumn("feature", feature)


@register(
    "coverage_gate_events",
    f"""WITH {_GATE}, t AS (SELECT (SELECT count(*) FROM gs) AS n, coalesce(sum(c), 0)::BIGINT AS a, count(*) AS g, count(*) FILTER (c < 5) AS s FROM gg)
    SELECT n AS n_samples, a AS n_assessed, g AS n_groups, s AS small_groups, a::DOUBLE / n AS coverage, CASE WHEN a = 0 THEN 'blocked_feature_not_assessed' WHEN a < 20 OR g < 2 OR s > 0 THEN 'blocked_insufficient_feature_coverage' ELSE 'analysis_ready' END AS status FROM t""",
)
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    return coverage_gate(_gate_samples(spark, sf), "feature", "positive_fraction")[0]


@register("coverage_gate_groups_events", f"WITH {_GATE} SELECT feat AS group_value, c AS group_size, d AS distinct_values, round(m, 9) AS mean_value FROM gg")
def _gate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return coverage_gate(_gate_samples(spark, sf), "feature", "positive_fraction")[1].withColumn("mean_value", F.round("mean_value", 9))


_RATE = """s AS (SELECT CASE WHEN c_nationkey % 9 = 0 THEN 'NA' ELSE c_mktsegment END AS g, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS y FROM orders JOIN customer ON o_custkey = c_custkey),
  k AS (SELECT g, y, count(*) AS n FROM s WHERE y <> '' GROUP BY 1, 2)"""


def _rate_samples(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 9 == 0, "-").otherwise(F.col("c_mktsegment")).alias("g"))
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderpriority")).alias("y"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


@register(
    "group_rates_orders",
    f"""WITH {_RATE}, t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, y) AS r FROM k) SELECT g AS group_value, sum(n)::BIGINT AS total, count(*) AS label_count, max(CASE WHEN r = 1 THEN y END) AS top_label, round(max(CASE WHEN r = 1 THEN n END)::DOUBLE / sum(n), 9) AS top_fraction FROM t GROUP BY 1""",
)
def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return group_rate(_rate_samples(spark, sf), "g", "y")[0].withColumn("top_fraction", F.round("top_fraction", 9))


@register("group_rate_status_orders", f"WITH {_RATE} SELECT sum(n)::BIGINT AS n_samples, count(DISTINCT y) AS n_classes, count(DISTINCT g) AS n_groups, 'ok' AS status FROM k")
def _rate_status(spark: SparkSession, sf: str) -> DataFrame:
    return group_rate(_rate_samples(spark, sf), "g", "y")[1]


@register("group_label_counts_orders", f"WITH {_RATE} SELECT g AS group_value, y AS label, n FROM k")
def _label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return label_counts(_rate_samples(spark, sf), "g", "y")


_COVER = f"""{ASSAYS}, pr AS (SELECT phage_id, host_id FROM assays WHERE tested = 'true'), up AS (SELECT DISTINCT phage_id FROM pr), uh AS (SELECT DISTINCT host_id FROM pr),
  sd AS (SELECT DISTINCT 'U' || user_id AS i FROM events WHERE user_id % 3 = 0), sa AS (SELECT DISTINCT 'U' || user_id AS i FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0),
  kd AS (SELECT 'H' || n_nationkey AS i FROM nation WHERE n_regionkey = 1), ka AS (SELECT 'H' || n_nationkey AS i FROM nation)"""


def _coverage_evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    pairs = assays(spark, sf).filter("tested = 'true'").select("phage_id", "host_id")
    e, n = table(spark, sf, "events"), table(spark, sf, "nation")
    user, nation = F.concat(F.lit("U"), F.col("user_id").cast("string")), F.concat(F.lit("H"), F.col("n_nationkey").cast("string"))
    none = e.filter("user_id < 0").select(user.alias("i"))
    return pairs, {
        "sequence": ("left", e.filter("user_id % 3 = 0").select(user.alias("i")), e.filter("user_id % 2 = 0 OR user_id % 3 = 0").select(user.alias("i"))),
        "domains": ("left", none, none),
        "k_type": ("right", n.filter("n_regionkey = 1").select(nation.alias("i")), n.select(nation.alias("i"))),
    }


def _sql_cover(metric: str, level: str, source: str, column: str, d: str, a: str) -> str:
    return f"""SELECT '{metric}' AS metric, '{level}' AS entity_level, count(*) FILTER ({column} IN (SELECT i FROM {d})) AS numerator, count(*) FILTER ({column} IN (SELECT i FROM {a})) AS assessed, count(*) AS denominator FROM {source}"""


_COVER_ROWS = " UNION ALL ".join(
    [
        _sql_cover("sequence", "unique_left", "up", "phage_id", "sd", "sa"),
        _sql_cover("domains", "unique_left", "up", "phage_id", "(SELECT '' AS i)", "(SELECT '' AS i)"),
        _sql_cover("k_type", "unique_right", "uh", "host_id", "kd", "ka"),
        _sql_cover("sequence", "pair", "pr", "phage_id", "sd", "sa"),
        _sql_cover("domains", "pair", "pr", "phage_id", "(SELECT '' AS i)", "(SELECT '' AS i)"),
        _sql_cover("k_type", "pair", "pr", "host_id", "kd", "ka"),
    ]
)


@register(
    "feature_coverage_events",
    f"""WITH {_COVER}, r AS ({_COVER_ROWS}) SELECT *, round(numerator::DOUBLE / denominator, 9) AS coverage_fraction, CASE WHEN assessed <= 0 THEN 'not_assessed' WHEN numerator <= 0 THEN 'assessed_zero_detected' ELSE 'assessed_positive' END AS evidence_state FROM r""",
)
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    pairs, evidence = _coverage_evidence(spark, sf)
    return feature_coverage(pairs, "phage_id", "host_id", evidence).withColumn("coverage_fraction", F.round("coverage_fraction", 9))


@register(
    "pair_completeness_events",
    f"""WITH {_COVER} SELECT 'receptor_layer' AS metric, count(*) FILTER (phage_id IN (SELECT i FROM sd) AND host_id IN (SELECT i FROM kd)) AS numerator, count(*) AS denominator,
      round(count(*) FILTER (phage_id IN (SELECT i FROM sd) AND host_id IN (SELECT i FROM kd))::DOUBLE / count(*), 9) AS coverage_fraction, 'assessed_positive' AS evidence_state FROM pr""",
)
def _completeness(spark: SparkSession, sf: str) -> DataFrame:
    pairs, evidence = _coverage_evidence(spark, sf)
    out = pair_completeness(pairs, "phage_id", "host_id", evidence["sequence"][1], evidence["k_type"][1], "receptor_layer")
    return out.withColumn("coverage_fraction", F.round("coverage_fraction", 9))


_SUPPORT = f"""{MANIFEST}, mv AS (SELECT unnest(['min_total', 'min_phages', 'min_k', 'min_st', 'min_giants']) AS metric, unnest([count(*), count(*) FILTER (record_type = 'phage'), count(*) FILTER (K_type <> ''), count(*) FILTER (ST <> ''), 0]) AS value,
    unnest([1, 500, 100000000, 10, 1])::BIGINT AS threshold FROM manifest)"""
_THRESHOLDS = {"min_total": 1, "min_phages": 500, "min_k": 100000000, "min_st": 10, "min_giants": 1}
_NEEDS = {"H1": ["min_phages", "min_k"], "H2": ["min_total", "min_st"], "H3": ["min_k", "min_giants"]}


def _support(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    metrics = {
        "min_total": F.count("*"),
        "min_phages": F.count_if(F.col("record_type") == "phage"),
        "min_k": F.count_if(F.col("K_type") != ""),
        "min_st": F.count_if(F.col("ST") != ""),
    }
    return support_audit(manifest(spark, sf), metrics, _THRESHOLDS, _NEEDS)


@register("support_metrics_orders", f"WITH {_SUPPORT} SELECT metric, value, threshold, CASE WHEN value >= threshold THEN 'pass' ELSE 'fail' END AS status FROM mv")
def _support_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _support(spark, sf)[0]


@register(
    "support_by_goal_orders",
    f"""WITH {_SUPPORT}, nd AS (SELECT * FROM (VALUES ('H1', 'min_phages', 0), ('H1', 'min_k', 1), ('H2', 'min_total', 0), ('H2', 'min_st', 1), ('H3', 'min_k', 0), ('H3', 'min_giants', 1)) AS t(goal, metric, i))
    SELECT goal, count(*) AS required_metrics, coalesce(string_agg(CASE WHEN value < threshold THEN metric || ':' || value || '/' || threshold END, ';' ORDER BY i), '') AS missing_support,
      CASE WHEN bool_or(value < threshold) THEN 'blocked_minimum_sample_support' ELSE 'ready_minimum_sample_support' END AS support_status FROM nd JOIN mv USING (metric) GROUP BY 1""",
)
def _support_goals(spark: SparkSession, sf: str) -> DataFrame:
    return _support(spark, sf)[1]


_OVER = """o AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'NA' ELSE source END AS source, unnest([struct_pack(t := 'text_sha', v := sha256(text)), struct_pack(t := 'size', v := n_chars::VARCHAR)]) AS k FROM documents),
  g AS (SELECT k.t AS t, k.v AS v, CASE WHEN source <> 'NA' THEN source END AS source, count(*) AS n, min(doc_id) AS f FROM o GROUP BY 1, 2, 3),
  og AS (SELECT t, v, sum(n)::BIGINT AS n, count(source) AS s, coalesce(string_agg(source, ';' ORDER BY f), 'NA') AS src FROM g GROUP BY 1, 2 HAVING sum(n) >= 2)"""


def _overlap_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 8 == 0, "NA").otherwise(F.col("source")).alias("source"),
        F.sha2("text", 256).alias("text_sha"),
        F.col("n_chars").alias("size"),
    )


@register("overlap_groups_documents", f"WITH {_OVER} SELECT t AS key_type, v AS key_value, n AS record_count, s AS source_count, src AS sources, 'duplicate_' || t AS overlap_status FROM og")
def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_groups(_overlap_docs(spark, sf), ["text_sha", "size"], "source", "doc_id")


@register(
    "source_summary_documents",
    f"""WITH {_OVER}, d AS (SELECT CASE WHEN doc_id % 8 = 0 THEN 'NA' ELSE source END AS source, count(*) AS n, count(DISTINCT sha256(text)) AS u, count(DISTINCT n_chars) AS z FROM documents GROUP BY 1),
    t AS (SELECT x AS source, count(*) AS c FROM (SELECT unnest(string_split(src, ';')) AS x FROM og) WHERE x <> 'NA' GROUP BY 1)
    SELECT d.source, n AS record_count, u AS unique_text_sha, z AS unique_size, coalesce(c, 0) AS duplicate_key_count FROM d LEFT JOIN t USING (source)""",
)
def _source_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = _overlap_docs(spark, sf)
    return source_summary(d, "source", ["text_sha", "size"], overlap_groups(d, ["text_sha", "size"], "source", "doc_id"))


@register("frequencies_parts", "SELECT CASE WHEN p_size % 6 = 0 THEN 'missing' ELSE p_type END AS category, count(*) AS count FROM part GROUP BY 1")
def _freq(spark: SparkSession, sf: str) -> DataFrame:
    return freq(table(spark, sf, "part").withColumn("t", F.when(F.col("p_size") % 6 == 0, " - ").otherwise(F.col("p_type"))), "t")


@register(
    "status_report_orders",
    """SELECT o_orderpriority AS item, count(*) AS rows, CASE max(CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END WHEN 'O' THEN CASE WHEN o_orderpriority < '4' THEN 1 ELSE 0 END ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM orders GROUP BY 1""",
)
def _report(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), "error").when(
        (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") < "4"), "warning"
    ).otherwise("info")
    return status_report(table(spark, sf, "orders").withColumn("severity", severity), "o_orderpriority")


@register(
    "test_row_coverage_orders",
    """WITH m AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'ok' WHEN o_orderkey % 3 = 1 THEN '' ELSE 'blocked_x' END AS st, o_orderpriority AS p, o_orderstatus AS s FROM orders), r AS (SELECT 'H1' AS goal, st FROM m WHERE p = '1-URGENT' UNION ALL SELECT 'H2', CASE WHEN st = 'ok' THEN 'blocked_y' ELSE st END FROM m WHERE s = 'P' AND p = '5-LOW' AND st <> 'ok' UNION ALL SELECT 'H4', st FROM m)
    SELECT goal, count(*) AS matching_rows, count(*) FILTER (st = 'ok') AS ok_rows, count(*) FILTER (st NOT IN ('', 'ok')) AS limited_rows, CASE WHEN count(*) FILTER (st = 'ok') > 0 THEN 'pass' ELSE 'warn' END AS status FROM r GROUP BY 1
    UNION ALL SELECT 'H3', 0, 0, 0, 'fail'""",
)
def _tests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    m = table(spark, sf, "orders").withColumn("status", F.when(k == 0, "ok").when(k == 1, "").otherwise("blocked_x"))
    low = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW") & (F.col("status") != "ok")
    return test_coverage(m, {"H1": F.col("o_orderpriority") == "1-URGENT", "H2": low, "H3": F.col("o_orderpriority") == "none", "H4": F.lit(True)})


@register(
    "metric_assertions_events",
    """SELECT 'rows' AS metric, count(*) AS value, 10 AS expected, 'fail' AS status, 'error' AS severity FROM events UNION ALL SELECT 'kinds', count(DISTINCT event_type), 5, 'pass', 'info' FROM events UNION ALL SELECT 'absent', NULL, 1, 'fail', 'error'""",
)
def _assertions(spark: SparkSession, sf: str) -> DataFrame:
    observed = metrics_long(table(spark, sf, "events"), {"rows": F.count("*"), "kinds": F.countDistinct("event_type")})
    return assert_metrics(observed, {"rows": 10, "kinds": 5, "absent": 1})


@register(
    "matrix_inventory_events",
    """WITH c AS (SELECT user_id, event_type, max(CASE WHEN value >= 40 THEN 1 ELSE 0 END) AS v FROM events WHERE (user_id + length(event_type)) % 9 <> 0 GROUP BY 1, 2)
    SELECT 5 AS column_ids, count(DISTINCT user_id) AS row_ids, count(*) AS tested, sum(v)::BIGINT AS positive, count(*) - sum(v)::BIGINT AS negative, count(DISTINCT user_id) * 5 - count(*) AS blank FROM c""",
)
def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    wide, _ = matrix_tables(spark, sf)
    return matrix_stats(unpivot_cells(wide, "user_id"), "user_id", "column_id", "matrix_value")


@register(
    "sequence_scope_counts_orders",
    f"""WITH {MANIFEST}, q AS (SELECT * FROM manifest WHERE row_number % 3 > 0) SELECT 'phage_like' AS metric, count(*) FILTER (record_type IN ('phage', 'prophage')) AS value FROM q UNION ALL SELECT 'host', count(*) FILTER (record_type = 'host') FROM q UNION ALL SELECT 'any', count(*) FROM q""",
)
def _scope(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    return scope_counts(m, m.select("genome_id", (F.col("row_number") % 3 > 0).alias("passes_sequence_qc")))


@register(
    "exploded_lists_genes",
    f"""WITH {GENES} SELECT x AS word, count(*) AS rows FROM (SELECT CASE WHEN functional_category = '' AND start::BIGINT % 7 = 0 THEN NULL ELSE unnest(CASE WHEN functional_category = '' AND start::BIGINT % 7 = 0 THEN [NULL] ELSE string_split(product, ' ') END) END AS x FROM genes) GROUP BY 1""",
)
def _explode(spark: SparkSession, sf: str) -> DataFrame:
    g = genes(spark, sf)
    empty = (F.col("functional_category") == "") & (F.col("start").cast("bigint") % 7 == 0)
    listed = g.select(F.when(empty, "NA").otherwise(F.translate("product", " ", ";")).alias("words"))
    return explode_list(listed, "words", "word").groupBy("word").agg(F.count("*").alias("rows"))


def _evidence_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Evidence on users (phages) and numbered hosts from all driver tables."""
    c, s, n, p, o = (table(spark, sf, t) for t in ("customer", "supplier", "nation", "part", "orders"))

    def name(letter: str, column: str, out: str) -> F.Column:
        return F.concat(F.lit(letter), F.col(column).cast("string")).alias(out)

    none = F.lit("")
    qc = c.select(name("U", "c_custkey", "genome_id"), F.when(F.col("c_nationkey") % 2 == 0, "True").otherwise("false").alias("passes_sequence_qc"), none.alias("sequence_qc_status"))
    hosts_qc = n.select(name("H", "n_nationkey", "genome_id"), none.alias("passes_sequence_qc"), F.when(F.col("n_regionkey") > 1, "pass").otherwise("fail").alias("sequence_qc_status"))
    return {
        "sequence_qc": qc.unionByName(hosts_qc),
        "manifest": p.select(
            name("U", "p_partkey", "genome_id"), F.when(F.col("p_size") > 20, "true").otherwise("false").alias("has_raw_sequence"), F.when(F.col("p_type") != "PROMO", "raw/x").otherwise("NA").alias("raw_sequence_path")
        ),
        "annotations": o.select(name("U", "o_custkey", "genome_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "Pharokka 1").otherwise("x").alias("tool"), none.alias("evidence")),
        "rbps": s.select(name("U", "s_suppkey", "genome_id"), F.when(F.col("s_acctbal") > 0, "dom").otherwise("Absent").alias("domain_hit")),
        "domains": p.select(name("U", "p_size", "genome_id"), F.lit("none").alias("domain_hit"), F.when(F.col("p_type") == "GIANT", "fold").otherwise("not_assessed").alias("structural_hit")),
        "hosts": s.select(
            name("H", "s_suppkey", "host_genome_id"), F.when(F.col("s_nationkey") % 3 == 0, "K1").otherwise("not_assessed").alias("K_type"),
            F.when(F.col("s_acctbal") < 0, "O1").otherwise("").alias("O_type"), F.when(F.col("s_nationkey") > 12, "ST1").otherwise("-").alias("ST"),
        ),
        "host_defense": c.select(name("H", "c_nationkey", "host_genome_id"), F.when(F.col("c_mktsegment") == "BUILDING", "2").otherwise("0").alias("host_defense_system_count")),
        "counter_defense": o.select(name("U", "o_custkey", "phage_genome_id"), F.when(F.col("o_orderstatus") == "P", "AcrIF").otherwise("").alias("phage_antidefense_classes")),
        "phage_receptors": c.filter("c_mktsegment = 'MACHINERY'").select(name("U", "c_custkey", "phage_genome_id")),
        "host_receptors": n.select(name("H", "n_nationkey", "host_genome_id")),
    }


@register(
    "assay_feature_coverage_events",
    f"""WITH {ASSAYS}, sets AS (
      SELECT 'U' || c_custkey AS id, 'qs' AS b FROM customer UNION SELECT 'U' || c_custkey, 'qp' FROM customer WHERE c_nationkey % 2 = 0 UNION SELECT 'H' || n_nationkey, 'qs' FROM nation UNION SELECT 'H' || n_nationkey, 'qp' FROM nation WHERE n_regionkey > 1
      UNION SELECT 'U' || p_partkey, 'raw' FROM part WHERE p_size > 20 AND p_type <> 'PROMO' UNION SELECT 'U' || o_custkey, 'ann' FROM orders WHERE o_orderpriority = '1-URGENT'
      UNION SELECT 'U' || s_suppkey, 'rbp' FROM supplier UNION SELECT 'U' || s_suppkey, 'dom' FROM supplier WHERE s_acctbal > 0 UNION SELECT 'U' || p_size, unnest(['doms', 'strs']) FROM part UNION SELECT 'U' || p_size, 'str' FROM part WHERE p_type = 'GIANT'
      UNION SELECT 'H' || s_suppkey, 'K' FROM supplier WHERE s_nationkey % 3 = 0 UNION SELECT 'H' || s_suppkey, 'O' FROM supplier WHERE s_acctbal < 0 UNION SELECT 'H' || s_suppkey, 'ST' FROM supplier WHERE s_nationkey > 12
      UNION SELECT 'H' || c_nationkey, 'defs' FROM customer UNION SELECT 'H' || c_nationkey, 'def' FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'U' || o_custkey, 'cds' FROM orders UNION SELECT 'U' || o_custkey, 'cd' FROM orders WHERE o_orderstatus = 'P'
      UNION SELECT 'U' || c_custkey, 'pr' FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT 'H' || n_nationkey, 'hr' FROM nation),
    e AS (SELECT id, list(b) AS bs FROM sets GROUP BY 1), f AS (SELECT id, bs, list_contains(bs, 'qp') OR (NOT list_contains(bs, 'qs') AND list_contains(bs, 'raw')) AS ver FROM e),
    pr AS (SELECT phage_id, host_id, coalesce(p.bs, []) AS l, coalesce(h.bs, []) AS r, coalesce(p.ver, false) AS lv, coalesce(h.ver, false) AS rv FROM assays a LEFT JOIN f p ON p.id = phage_id LEFT JOIN f h ON h.id = host_id WHERE tested = 'true' AND spot_result IN ('positive', 'negative')),
    m AS (SELECT phage_id, host_id, unnest([
      {{'m': 'phage_sequence_verified', 's': 1, 'd': lv, 'a': lv OR list_contains(l, 'qs')}}, {{'m': 'host_sequence_verified', 's': 2, 'd': rv, 'a': rv OR list_contains(r, 'qs')}},
      {{'m': 'host_K_type', 's': 2, 'd': list_contains(r, 'K'), 'a': list_contains(r, 'K')}}, {{'m': 'host_O_type', 's': 2, 'd': list_contains(r, 'O'), 'a': list_contains(r, 'O')}}, {{'m': 'host_ST', 's': 2, 'd': list_contains(r, 'ST'), 'a': list_contains(r, 'ST')}},
      {{'m': 'standardized_phage_annotation', 's': 1, 'd': list_contains(l, 'ann'), 'a': list_contains(l, 'ann')}}, {{'m': 'rbp_candidates', 's': 1, 'd': list_contains(l, 'rbp'), 'a': list_contains(l, 'rbp')}},
      {{'m': 'domain_evidence', 's': 1, 'd': list_contains(l, 'dom'), 'a': list_contains(l, 'doms')}}, {{'m': 'structural_evidence', 's': 1, 'd': list_contains(l, 'str'), 'a': list_contains(l, 'strs')}},
      {{'m': 'host_defense_evidence', 's': 2, 'd': list_contains(r, 'def'), 'a': list_contains(r, 'defs')}}, {{'m': 'phage_counterdefense_evidence', 's': 1, 'd': list_contains(l, 'cd'), 'a': list_contains(l, 'cds')}},
      {{'m': 'receptor_layer_feature_completeness', 's': 0, 'd': list_contains(l, 'rbp') AND list_has_any(r, ['K', 'O']), 'a': list_contains(l, 'rbp') AND list_has_any(r, ['K', 'O'])}},
      {{'m': 'seed_bridge_metadata_coverage', 's': 0, 'd': list_contains(l, 'pr') AND list_contains(r, 'hr'), 'a': list_contains(l, 'pr') AND list_contains(r, 'hr')}},
      {{'m': 'defense_counterdefense_feature_completeness', 's': 0, 'd': list_contains(l, 'cd') AND list_contains(r, 'def'), 'a': list_contains(l, 'cds') AND list_contains(r, 'defs')}},
      {{'m': 'productive_infection_outcomes', 's': 0, 'd': false, 'a': false}}]) AS x FROM pr),
    c AS (SELECT x.m AS metric, 'pair' AS lv, count(*) FILTER (x.d) AS d, count(*) FILTER (x.a) AS a, count(*) AS n FROM m GROUP BY 1
      UNION ALL SELECT x.m, 'unique_phage', count(DISTINCT phage_id) FILTER (x.d), count(DISTINCT phage_id) FILTER (x.a), count(DISTINCT phage_id) FROM m WHERE x.s = 1 GROUP BY 1
      UNION ALL SELECT x.m, 'unique_host', count(DISTINCT host_id) FILTER (x.d), count(DISTINCT host_id) FILTER (x.a), count(DISTINCT host_id) FROM m WHERE x.s = 2 GROUP BY 1
      UNION ALL SELECT 'tested_spot_pairs', 'pair', count(*), count(*), count(*) FROM pr UNION ALL SELECT 'unique_assay_phages', 'unique_phage', count(DISTINCT phage_id), count(DISTINCT phage_id), count(DISTINCT phage_id) FROM pr UNION ALL SELECT 'unique_assay_hosts', 'unique_host', count(DISTINCT host_id), count(DISTINCT host_id), count(DISTINCT host_id) FROM pr),
    b AS (SELECT phage_id, panel_id, count(*) AS n, count(*) FILTER (spot_result = 'positive') AS p FROM assays WHERE spot_result IN ('positive', 'negative') GROUP BY 1, 2)
    SELECT metric, lv AS entity_level, d AS numerator, a AS assessed, n AS denominator, round(d::DOUBLE / n, 9) AS coverage_fraction, CASE WHEN a = 0 THEN 'not_assessed' WHEN d = 0 THEN 'assessed_zero_detected' ELSE 'assessed_positive' END AS evidence_state, NULL AS phage_id, NULL AS panel_id FROM c
    UNION ALL SELECT 'spot_breadth_continuous', 'phage_panel', p, n, n, round(p::DOUBLE / n, 9), 'descriptive_breadth_available', phage_id, panel_id FROM b""",
)
def _assay_coverage(spark: SparkSession, sf: str) -> DataFrame:
    a = assays(spark, sf)
    out = assay_feature_coverage(a, _evidence_tables(spark, sf), assay_breadth(a, ["phage_id", "panel_id"]))
    return out.withColumn("coverage_fraction", F.round("coverage_fraction", 9))

"""Rollups over items, requirements and status tables on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import register, table
from evispark.operators.aggregates import metrics_long
from evispark.operators.readiness import (
    curation_priority, deficit_orders, metric_bridge, min_set_rank, readiness, status_cascade, traceability, unlock, unlock_lists,
)
from evispark.operators.scan import dealt, range_count

_NEEDS = """nd AS (SELECT DISTINCT 'C' || o_custkey AS goal, 'P' || l_partkey AS item, CASE WHEN l_linenumber % 2 = 0 THEN 'optional' ELSE 'required' END AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  stt AS (SELECT 'P' || p_partkey AS item, p_size > 2 AS ready, p_size % 4 AS pri FROM part WHERE p_type <> 'GIANT')"""


def needs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A customer is a goal, the parts it orders are the items it needs. Giant parts have no status."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    tasks = range_count(li)
    lines = dealt(li, tasks, "l_orderkey").join(dealt(o, tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Repeats go while the rows are numbers, by key: a task holds its share of them and no texts.
    lines = lines.select("o_custkey", "l_partkey", F.coalesce(F.col("l_linenumber") % 2 == 0, F.lit(False)).alias("optional"))
    wanted = dealt(lines, tasks, "o_custkey", "l_partkey").distinct().select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("goal"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item"),
        F.when(F.col("optional"), "optional").otherwise("required").alias("role"),
    )
    p = table(spark, sf, "part").filter("p_type <> 'GIANT'")
    status = p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("item"), (F.col("p_size") > 2).alias("ready"), (F.col("p_size") % 4).alias("priority_order")
    )
    return wanted, status


@register(
    "requirement_unlock_customers",
    f"""WITH {_NEEDS}, j AS (SELECT goal, role, coalesce(ready, false) AS r FROM nd LEFT JOIN stt USING (item))
    SELECT goal, count(*) FILTER (role = 'required' AND r) AS ready_required, count(*) FILTER (role = 'required' AND NOT r) AS blocking_required, count(*) FILTER (role = 'optional' AND r) AS ready_optional, count(*) FILTER (role = 'optional' AND NOT r) AS blocking_optional,
      CASE WHEN count(*) FILTER (role = 'required' AND NOT r) = 0 THEN 'minimum_sources_ready' ELSE 'blocked_missing_required_sources' END AS minimum_unlock_status FROM j GROUP BY 1""",
)
def _unlock(spark: SparkSession, sf: str) -> DataFrame:
    wanted, status = needs(spark, sf)
    return unlock(wanted, status)


@register(
    "requirement_lists_customers",
    f"""WITH {_NEEDS}, j AS (SELECT goal, role, item, coalesce(ready, false) AS r FROM nd LEFT JOIN stt USING (item)) SELECT goal, role, r AS ready, 0::BIGINT AS piece, count(*)::INT AS item_count, string_agg(item, ';' ORDER BY item) AS items FROM j GROUP BY 1, 2, 3""",
)
def _unlock_lists(spark: SparkSession, sf: str) -> DataFrame:
    wanted, status = needs(spark, sf)
    return unlock_lists(wanted, status).withColumn("items", F.array_join("items", ";"))


@register(
    "minimum_set_ranking_parts",
    f"""WITH {_NEEDS}, k AS (SELECT item, count(*) FILTER (role = 'required') AS q, count(*) FILTER (role = 'optional') AS o FROM nd GROUP BY 1), a AS (SELECT item, coalesce(pri, 9) AS p, coalesce(q, 0) AS q, coalesce(o, 0) AS o FROM stt FULL JOIN k USING (item))
    SELECT item, p AS priority_order, q AS required_goals, o AS optional_goals, row_number() OVER (ORDER BY q DESC, p, o DESC, item) AS recommended_rank FROM a""",
)
def _min_set(spark: SparkSession, sf: str) -> DataFrame:
    wanted, status = needs(spark, sf)
    return min_set_rank(wanted, status.select("item", "priority_order"))


_CARD = """cd AS (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'export_missing' WHEN 1 THEN 'export_empty' WHEN 2 THEN 'export_row_format_invalid' ELSE 'export_ready' END AS val, CASE s_nationkey % 3 WHEN 0 THEN 'ready_for_enablement' WHEN 1 THEN 'enabled_for_sample_build' ELSE 'other' END AS en,
    s_nationkey % 2 AS bm, CASE WHEN s_acctbal < 0 THEN 0 ELSE 9 END AS rw, s_suppkey % 5 AS rk FROM supplier),
  pr AS (SELECT *, CASE WHEN val = 'export_missing' THEN 'create_reviewed_export' WHEN val = 'export_empty' OR rw = 0 THEN 'populate_reviewed_rows' WHEN val <> 'export_ready' THEN 'fix_export_validation' WHEN en = 'ready_for_enablement' THEN 'enable_import_and_review_manifest'
    WHEN en = 'enabled_for_sample_build' AND bm > 0 THEN 'add_metric_specific_fields_or_rows' WHEN en = 'enabled_for_sample_build' THEN 'ready_for_downstream_sample_build' WHEN rk <= 2 THEN 'high_priority_review' ELSE 'review_after_primary_sources' END AS st FROM cd)"""


def curation(spark: SparkSession, sf: str) -> DataFrame:
    s, k, n = table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")
    card = s.select(
        k.alias("item"),
        F.when(k % 6 == 0, "export_missing").when(k % 6 == 1, "export_empty").when(k % 6 == 2, "export_row_format_invalid").otherwise("export_ready").alias("validation_status"),
        F.when(n % 3 == 0, "ready_for_enablement").when(n % 3 == 1, "enabled_for_sample_build").otherwise("other").alias("enablement_status"),
        (n % 2).alias("blocked_metric_count"),
        F.when(F.col("s_acctbal") < 0, 0).otherwise(9).alias("export_row_count"),
        (k % 5).alias("recommended_rank"),
    )
    return status_cascade(card, curation_priority(), ("review_after_primary_sources", "Review later."), "curation_priority", "next_action")


@register("status_cascade_suppliers", f"WITH {_CARD} SELECT k AS item, st AS curation_priority FROM pr")
def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    return curation(spark, sf).select("item", "curation_priority")


@register(
    "deficit_work_orders_suppliers",
    f"""WITH {_CARD}, mt AS (SELECT 'm_orders' AS metric, greatest(20000 - count(*), 0) AS d FROM orders UNION ALL SELECT 'm_parts', greatest(2500 - count(*), 0) FROM part UNION ALL SELECT 'm_nations', 0),
    q AS (SELECT *, CASE WHEN k % 7 = 0 THEN 99 ELSE rk END AS rank_, row_number() OVER (ORDER BY CASE WHEN k % 7 = 0 THEN 999 ELSE rk END, k) AS no, CASE WHEN k % 3 = 0 THEN ['m_orders', 'm_nations'] WHEN k % 3 = 1 THEN ['m_parts', 'm_gone'] ELSE [] END AS ms FROM pr),
    l AS (SELECT k, max(coalesce(d, 1)) AS r FROM (SELECT k, unnest(ms) AS metric FROM q) LEFT JOIN mt USING (metric) GROUP BY 1)
    SELECT printf('WO%03d', no) AS work_order_id, k AS item, CASE WHEN k % 7 = 0 THEN 999 ELSE rk END AS recommended_rank, st AS curation_priority, CASE WHEN st IN ('populate_reviewed_rows', 'create_reviewed_export') AND coalesce(r, 0) = 0 THEN 1 ELSE coalesce(r, 0) END AS minimum_rows_to_add
    FROM q LEFT JOIN l USING (k) WHERE st NOT IN ('ready_for_downstream_sample_build', 'review_after_primary_sources')""",
)
def _deficits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item")
    scores = curation(spark, sf).select(
        "item",
        F.when(k % 7 == 0, "later").otherwise(F.col("recommended_rank").cast("string")).alias("recommended_rank"),
        "curation_priority",
        F.when(k % 3 == 0, "m_orders;m_nations").when(k % 3 == 1, "m_parts, m_gone").otherwise("NA").alias("blocked_metrics"),
    )
    counts = (
        metrics_long(table(spark, sf, "orders"), {"m_orders": F.count("*")}).withColumn("threshold", F.lit(20000))
        .unionByName(metrics_long(table(spark, sf, "part"), {"m_parts": F.count("*")}).withColumn("threshold", F.lit(2500)))
        .unionByName(metrics_long(table(spark, sf, "nation"), {"m_nations": F.count("*")}).withColumn("threshold", F.lit(1)))
    )
    return deficit_orders(scores, counts, ["ready_for_downstream_sample_build", "review_after_primary_sources"]).drop("blocked_metrics")


@register(
    "metric_source_bridge_suppliers",
    """WITH m AS (SELECT o_orderpriority AS metric, CASE WHEN count(*) FILTER (o_orderstatus = 'F') * 3 < count(*) THEN 'fail' ELSE 'pass' END AS st FROM orders GROUP BY 1), u AS (SELECT metric FROM m WHERE st = 'fail' OR NOT EXISTS (SELECT 1 FROM m WHERE st = 'fail')),
    s AS (SELECT s_suppkey, 'L' || (s_nationkey % 6) AS layer, s_suppkey % 11 AS rk FROM supplier), f AS (SELECT * FROM (VALUES ('L0', 'c0'), ('L1', 'c1'), ('L1', 'c2'), ('L4', 'c3')) AS t(layer, field)),
    h AS (SELECT u.metric, s.* FROM u, s WHERE layer IN (SELECT layer FROM f)), a AS (SELECT s_suppkey, 'c' || n AS field FROM supplier, range(4) t(n) WHERE (s_suppkey + n) % 3 = 0),
    x AS (SELECT h.metric, h.s_suppkey, string_agg(DISTINCT CASE WHEN a.field IS NOT NULL THEN f.field END, ';' ORDER BY CASE WHEN a.field IS NOT NULL THEN f.field END) AS so, string_agg(DISTINCT f.field, ';' ORDER BY f.field) AS al FROM h CROSS JOIN (SELECT DISTINCT field FROM f) f LEFT JOIN a ON a.s_suppkey = h.s_suppkey AND a.field = f.field GROUP BY 1, 2)
    SELECT metric, h.s_suppkey AS source_id, layer AS record_layer, rk AS recommended_rank, coalesce(so, al) AS fields_to_populate FROM h JOIN x USING (metric, s_suppkey)""",
)
def _bridge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(
        F.when(F.count_if(F.col("o_orderstatus") == "F") * 3 < F.count("*"), "fail").otherwise("pass").alias("status")
    )
    s = table(spark, sf, "supplier")
    sources = s.select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("L"), (F.col("s_nationkey") % 6).cast("string")).alias("record_layer"), (F.col("s_suppkey") % 11).alias("recommended_rank"))
    pairs = spark.createDataFrame([("L0", "c0"), ("L1", "c1"), ("L1", "c2"), ("L4", "c3")], "layer string, field string")
    fields = o.select("metric", F.explode(F.array(*[F.lit(x) for x in ("L0", "L1", "L4")])).alias("layer")).join(pairs, "layer").select("metric", "layer", "field")
    n = F.col("n")
    available = s.select("s_suppkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n")).filter((F.col("s_suppkey") + n) % 3 == 0).select(
        F.col("s_suppkey").alias("source_id"), F.concat(F.lit("c"), n.cast("string")).alias("column_name")
    )
    return metric_bridge(o, sources, fields, available)


@register(
    "readiness_audit_tables",
    """WITH f AS (SELECT o_orderpriority || ':' || o_orderstatus AS fact, count(*) AS value FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AND NOT (o_orderpriority = '5-LOW') AND NOT (o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P') GROUP BY 1),
    s AS (SELECT DISTINCT o_orderpriority AS r FROM orders), j AS (SELECT r, coalesce(a.value, 0) AS p, coalesce(b.value, 0) AS e, coalesce(c.value, 0) AS w FROM s LEFT JOIN f a ON a.fact = r || ':O' LEFT JOIN f b ON b.fact = r || ':F' LEFT JOIN f c ON c.fact = r || ':P')
    SELECT r AS requirement, p AS pass_count, e AS error_count, w AS partial_count, CASE WHEN e > 0 THEN 'fail' WHEN p > 0 THEN 'pass' WHEN w > 0 THEN 'warn' ELSE 'fail' END AS status, e > 0 OR (p = 0 AND w = 0) AS blocking FROM j""",
)
def _readiness(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kept = o.filter(~((p == "1-URGENT") & (s == "F")) & (p != "5-LOW") & ~((p == "2-HIGH") & (s != "P")))
    facts = kept.groupBy(F.concat_ws(":", p, s).alias("fact")).agg(F.count("*").alias("value"))
    spec = o.select(p.alias("requirement")).distinct()
    for name, letter in (("pass_fact", "O"), ("error_fact", "F"), ("partial_fact", "P")):
        spec = spec.withColumn(name, F.concat(F.col("requirement"), F.lit(f":{letter}")))
    return readiness(facts, spec.withColumn("required", F.lit(True)))


@register(
    "goal_traceability_customers",
    """WITH s AS (SELECT 'C' || c_custkey AS goal, CASE WHEN c_custkey % 5 = 0 THEN 'blocked_missing_required_sources' ELSE 'ready_sources' END AS st FROM customer), e AS (SELECT 'C' || c_custkey AS goal, CASE WHEN c_nationkey % 2 = 0 THEN 'warn' ELSE 'pass' END AS st FROM customer),
    m AS (SELECT DISTINCT 'C' || o_custkey AS goal, 'ok' AS st FROM orders WHERE o_orderpriority = '1-URGENT'), j AS (SELECT s.goal, s.st AS a, e.st AS b, coalesce(m.st, 'missing') AS c FROM s JOIN e USING (goal) LEFT JOIN m USING (goal))
    SELECT goal, a AS sources_status, b AS evidence_status, c AS models_status, CASE WHEN a LIKE 'blocked%' OR c = 'missing' THEN 'blocked' WHEN b = 'warn' THEN 'limited' ELSE 'ready' END AS overall_trace_status FROM j""",
)
def _trace(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    goal = F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("goal")
    sources = c.select(goal, F.when(F.col("c_custkey") % 5 == 0, "blocked_missing_required_sources").otherwise("ready_sources").alias("status"))
    evidence = c.select(goal, F.when(F.col("c_nationkey") % 2 == 0, "warn").otherwise("pass").alias("status"))
    models = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("goal"), F.lit("ok").alias("status")
    ).distinct()
    return traceability({"sources": sources, "evidence": evidence, "models": models})

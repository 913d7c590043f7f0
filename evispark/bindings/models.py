"""Leave-one-out evaluation and summaries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.bindings.base import register, table
from evispark.operators.models import ablation, compare_feature_sets, loo_eval, loo_predictions, key_counts, macro_f1, sample_predictions, summarise_tests

SETS = {"lang": ("lang",), "lang_source": ("lang", "source"), "all": ("lang", "source", "size")}
LABELS = ("quality", "toxic")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with language, source and a length class; some values are not assessed."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 13 == 0, "-").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 11 == 0, "not_assessed").otherwise(F.col("source")).alias("source"),
        F.floor(F.log2(F.col("n_chars"))).cast("string").alias("size"),
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
    )


_SAMPLES = """sm AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'NA' ELSE lang END AS lang, CASE WHEN doc_id % 11 = 0 THEN 'not_assessed' ELSE source END AS source, floor(log2(n_chars))::INT::VARCHAR AS size,
    quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents LEFT JOIN labels USING (doc_id))"""


def _key(features: tuple[str, ...]) -> str:
    return " || '|' || ".join(features)


def _predictions(target: str, sets: dict[str, tuple[str, ...]]) -> str:
    """Each labelled row against all others, pair by pair: an independent check of the counted form."""
    keys = ", ".join(f"{_key(f)} AS k_{n}" for n, f in sets.items())
    # Majority by grouped self joins: counts of the other rows per key and label.
    rows = []
    for name in sets:
        k = f"k_{name}"
        rows.append(
            f"""SELECT '{name}' AS feature_set, s.doc_id, s.y, m.y AS m, coalesce(c.c, 0) AS c, f.y AS f FROM el s
        LEFT JOIN (SELECT doc_id, y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, y) AS r FROM (SELECT a.doc_id, b.y, count(*) AS n FROM el a JOIN el b ON a.{k} = b.{k} AND a.doc_id <> b.doc_id GROUP BY 1, 2)) WHERE r = 1) m USING (doc_id)
        LEFT JOIN (SELECT a.doc_id, count(*) AS c FROM el a JOIN el b ON a.{k} = b.{k} AND a.doc_id <> b.doc_id GROUP BY 1) c USING (doc_id)
        LEFT JOIN (SELECT doc_id, y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, y) AS r FROM (SELECT a.doc_id, b.y, count(*) AS n FROM el a JOIN el b ON a.doc_id <> b.doc_id GROUP BY 1, 2)) WHERE r = 1) f USING (doc_id)"""
        )
    return f"""el AS (SELECT doc_id, {target} AS y, {keys} FROM sm WHERE {target} IS NOT NULL), pd AS ({' UNION ALL '.join(rows)}),
  pr AS (SELECT feature_set, doc_id, y, CASE WHEN c = 0 THEN f ELSE m END AS p, f, c FROM pd)"""


_F1 = """f1 AS (SELECT feature_set, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1 FROM (SELECT feature_set, l, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM
    (SELECT feature_set, y AS l, (y = p)::INT AS tp, 0 AS fp, (y <> p)::INT AS fn FROM pr UNION ALL SELECT feature_set, p, 0, (y <> p)::INT, 0 FROM pr) GROUP BY 1, 2) GROUP BY 1)"""


def _evaluated(target: str, sets: dict[str, tuple[str, ...]]) -> str:
    count = " ".join(f"WHEN '{n}' THEN {len(f)}" for n, f in sets.items())
    return f"""{_predictions(target, sets)}, {_F1} SELECT feature_set, count(*) AS n_samples, count(DISTINCT y) AS n_classes, CASE feature_set {count} END AS n_features, round(avg((c > 0)::INT), 9) AS coverage, round(avg((y = p)::INT), 9) AS accuracy,
      round(any_value(macro_f1), 9) AS macro_f1, round(avg((y = f)::INT), 9) AS baseline_accuracy, 'ok' AS status, round(avg((y = p)::INT) - avg((y = f)::INT), 9) AS delta_vs_baseline FROM pr JOIN f1 USING (feature_set) GROUP BY 1"""


def _rounded(df: DataFrame) -> DataFrame:
    for c in ("coverage", "accuracy", "macro_f1", "baseline_accuracy", "delta_vs_baseline"):
        df = df.withColumn(c, F.round(c, 9))
    return df


@register("leave_one_out_documents", f"WITH {_SAMPLES}, {_evaluated('quality', {'all': SETS['all']})}")
def _loo(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(loo_eval(samples(spark, sf), "quality", SETS["all"], "all"))


@register(
    "feature_set_grid_documents",
    f"SELECT *, 'quality' AS target FROM (WITH {_SAMPLES}, {_evaluated('quality', SETS)}) UNION ALL SELECT *, 'toxic' FROM (WITH {_SAMPLES}, {_evaluated('toxic', SETS)})",
)
def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare_feature_sets(samples(spark, sf), LABELS, SETS))


@register("macro_f1_documents", f"WITH {_SAMPLES}, {_predictions('toxic', SETS)}, {_F1} SELECT feature_set, round(macro_f1, 9) AS macro_f1 FROM f1")
def _macro(spark: SparkSession, sf: str) -> DataFrame:
    return macro_f1(loo_predictions(key_counts(samples(spark, sf), "toxic", SETS))).withColumn("macro_f1", F.round("macro_f1", 9))


@register(
    "sample_predictions_documents",
    f"WITH {_SAMPLES}, {_predictions('quality', SETS)} SELECT feature_set, doc_id, y AS true_label, p AS predicted_label, f AS baseline_label, c AS matched_training_count, c = 0 AS used_fallback, y = p AS correct FROM pr",
)
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample_predictions(samples(spark, sf), "quality", SETS, ["doc_id"])


_SUBSETS = {"l": ("lang",), "s": ("source",), "z": ("size",), "ls": ("lang", "source"), "lz": ("lang", "size"), "sz": ("source", "size"), "lsz": ("lang", "source", "size")}


@register(
    "feature_ablation_documents",
    f"""WITH {_SAMPLES}, {_predictions('quality', _SUBSETS)}, ac AS (SELECT feature_set AS k, avg((y = p)::INT) AS a, avg((y = f)::INT) AS b FROM pr GROUP BY 1),
    pl AS (SELECT * FROM (VALUES ('lang', 'lang', 'l', 'l'), ('lang_source', 'lang', 'ls', 's'), ('lang_source', 'source', 'ls', 'l'), ('all', 'lang', 'lsz', 'sz'), ('all', 'source', 'lsz', 'lz'), ('all', 'size', 'lsz', 'ls')) AS t(feature_set, feature, fk, rk)),
    fs AS (SELECT 'lang' AS feature, count(*) FILTER (lang <> 'NA') AS n, count(DISTINCT CASE WHEN lang <> 'NA' THEN lang END) AS u FROM sm UNION ALL SELECT 'source', count(*) FILTER (source <> 'not_assessed'), count(DISTINCT CASE WHEN source <> 'not_assessed' THEN source END) FROM sm UNION ALL SELECT 'size', count(*), count(DISTINCT size) FROM sm)
    SELECT pl.feature_set, pl.feature, n AS non_missing_count, u AS unique_value_count, round(x.a, 9) AS full_accuracy, round(CASE WHEN fk = rk THEN x.b ELSE r.a END, 9) AS accuracy_without_feature, round(x.a - CASE WHEN fk = rk THEN x.b ELSE r.a END, 9) AS delta_accuracy
    FROM pl JOIN ac x ON fk = x.k JOIN ac r ON rk = r.k JOIN fs ON pl.feature = fs.feature""",
)
def _ablation(spark: SparkSession, sf: str) -> DataFrame:
    out = ablation(samples(spark, sf), "quality", SETS)
    for c in ("full_accuracy", "accuracy_without_feature", "delta_accuracy"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@register(
    "hypothesis_summary_orders",
    """WITH m AS (SELECT 'H' || (o_custkey % 4) AS goal, 'T' || (o_custkey % 3) AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'full' ELSE 'base' END AS fs, o_custkey AS n, round(o_totalprice / 1000000, 6) AS a, CASE WHEN o_custkey % 4 = 2 THEN 'analysis_ready' WHEN o_orderkey % 5 = 0 THEN 'blocked' ELSE 'ok' END AS st FROM orders),
    c AS (SELECT goal, target, max(CASE WHEN fs = 'full' THEN a END) AS p, max(CASE WHEN fs = 'base' THEN a END) AS b FROM m WHERE goal IN ('H0', 'H1') GROUP BY 1, 2),
    r AS (SELECT 'H' || (2 + l_linenumber % 2) AS goal, l_discount AS f FROM lineitem),
    v AS (SELECT goal, avg(p) AS pv, avg(b) AS bv, avg(p - b) AS ev FROM c GROUP BY 1 UNION ALL SELECT goal, max(f), min(f), max(f) - min(f) FROM r GROUP BY 1),
    k AS (SELECT goal, count(*) AS x, count(*) FILTER (st = 'ok') AS o, count(*) FILTER (st <> 'ok') AS l, max(n) AS mx FROM m GROUP BY 1)
    SELECT goal, x AS matching_model_rows, o AS ok_model_rows, l AS limited_model_rows, mx AS max_n_samples, round(pv, 9) AS primary_metric_value, round(bv, 9) AS baseline_metric_value, round(ev, 9) AS effect_size, 'warn' AS summary_status, 'data_dependent' AS claim_status FROM k JOIN v USING (goal)
    UNION ALL SELECT 'H9', 0, 0, 0, 0, NULL, NULL, NULL, 'fail', 'data_dependent'""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), F.col("o_custkey")
    models = o.select(
        F.concat(F.lit("H"), (c % 4).cast("string")).alias("goal"),
        F.lit("a").alias("analysis_id"),
        F.concat(F.lit("T"), (c % 3).cast("string")).alias("target"),
        F.when(F.col("o_orderkey") % 2 == 0, "full").otherwise("base").alias("feature_set"),
        c.alias("n_samples"),
        F.round(F.col("o_totalprice") / 1000000, 6).alias("accuracy"),
        F.when(c % 4 == 2, "analysis_ready").when(F.col("o_orderkey") % 5 == 0, "blocked").otherwise("ok").alias("status"),
    )
    rates = table(spark, sf, "lineitem").select(
        F.concat(F.lit("H"), (2 + F.col("l_linenumber") % 2).cast("string")).alias("goal"), F.col("l_discount").alias("top_fraction")
    )
    spec = spark.createDataFrame(
        [("H0", "model", "full", "base"), ("H1", "model", "full", "base"), ("H2", "rate", None, None), ("H3", "rate", None, None), ("H9", "rate", None, None)],
        "goal string, kind string, primary_set string, comparison_set string",
    )
    out = summarise_tests(models, rates, spec)
    for x in ("primary_metric_value", "baseline_metric_value", "effect_size"):
        out = out.withColumn(x, F.round(x, 9))
    return out

"""Leave-one-out evaluation of the exact-match majority rule, on counts.

All rows with the same feature key and the same label get the same prediction, so the
rule is evaluated on (feature set, key, label) counts. The work after the first
aggregation grows with the number of distinct keys, not with rows, and nothing is quadratic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evispark.functions.missing import is_informative, present, safe_value
from evispark.functions.numbers import fraction


def _key(features: Sequence[str]) -> Column:
    return F.to_json(F.array(*[safe_value(F.col(f).cast("string")) for f in features]))


def key_counts(df: DataFrame, target: str, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows per feature set, feature key and label, for every set in one shuffle."""
    options = F.array(*[F.struct(F.lit(n).alias("feature_set"), _key(f).alias("key")) for n, f in sets.items()])
    return (
        df.filter(present(F.col(target).cast("string")))
        .select(F.explode(options).alias("x"), F.col(target).cast("string").alias("label"))
        .groupBy("x.feature_set", "x.key", "label")
        .agg(F.count("*").alias("n"))
    )


def _top_two(counts: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Total and the two most frequent labels per key, ties by label."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "label")
    top = counts.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    best = top.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("label"))).alias(f"{prefix}1"),
        F.max(F.when(F.col("_r") == 1, F.col("n"))).alias(f"{prefix}1_n"),
        F.max(F.when(F.col("_r") == 2, F.col("label"))).alias(f"{prefix}2"),
        F.max(F.when(F.col("_r") == 2, F.col("n"))).alias(f"{prefix}2_n"),
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias(f"{prefix}_total"))
    return best.join(totals, list(keys))


def _majority(own: Column, label: Column, prefix: str) -> Column:
    """Majority label once one row of ``label`` is taken out; a label left with none does not compete."""
    first = F.col(f"{prefix}1")
    rival = F.when(first != label, first).otherwise(F.col(f"{prefix}2"))
    rival_n = F.when(first != label, F.col(f"{prefix}1_n")).otherwise(F.col(f"{prefix}2_n"))
    ahead = (rival_n > own) | ((rival_n == own) & (rival < label))
    return F.when(own <= 0, rival).when(F.coalesce(ahead, F.lit(False)), rival).otherwise(label)


def loo_predictions(counts: DataFrame) -> DataFrame:
    """Prediction, baseline and match count for each (feature set, key, label) of the counts."""
    by_key = _top_two(counts, ["feature_set", "key"], "k")
    labels = counts.groupBy("feature_set", "label").agg(F.sum("n").alias("n"))
    by_set = _top_two(labels, ["feature_set"], "g")
    own = labels.withColumnRenamed("n", "_g")
    df = (
        counts.join(by_key, ["feature_set", "key"])
        .join(own, ["feature_set", "label"])
        .join(F.broadcast(by_set), "feature_set")  # one row per feature set named by the caller
    )
    label = F.col("label")
    matched = F.col("k_total") - 1
    fallback = F.when(F.col("g_total") == 1, label).otherwise(_majority(F.col("_g") - 1, label, "g"))
    predicted = F.when(matched == 0, fallback).otherwise(_majority(F.col("n") - 1, label, "k"))
    return df.select(
        "feature_set",
        "key",
        "label",
        "n",
        predicted.alias("predicted_label"),
        fallback.alias("baseline_label"),
        matched.alias("matched_training_count"),
        (matched == 0).alias("used_fallback"),
    )


def macro_f1(predictions: DataFrame, truth: str = "label", predicted: str = "predicted_label", weight: str = "n",
             by: str = "feature_set") -> DataFrame:
    """Mean F1 over all true and predicted labels, per feature set."""
    same = F.col(truth) == F.col(predicted)
    zero = F.lit(0).cast("bigint")
    w = F.col(weight)

    def part(label: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    parts = F.array(
        part(truth, F.when(same, w).otherwise(zero), zero, F.when(same, zero).otherwise(w)),
        part(predicted, zero, F.when(same, zero).otherwise(w), zero),
    )
    per = (
        predictions.select(by, F.explode(parts).alias("p"))
        .groupBy(by, "p.label")
        .agg(F.sum("p.tp").alias("tp"), F.sum("p.fp").alias("fp"), F.sum("p.fn").alias("fn"))
    )
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return per.groupBy(by).agg(F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"))


def evaluate(predictions: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per feature set: sizes, coverage, accuracy, baseline, macro-F1, status."""
    spark = predictions.sparkSession
    names = spark.createDataFrame([(n, len(f)) for n, f in sets.items()], "feature_set string, n_features int")
    right = F.col("predicted_label") == F.col("label")
    base = F.col("baseline_label") == F.col("label")

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    facts = predictions.groupBy("feature_set").agg(
        F.sum("n").alias("n_samples"),
        F.countDistinct("label").alias("n_classes"),
        rows(right).alias("_right"),
        rows(base).alias("_base"),
        rows(~F.col("used_fallback")).alias("_covered"),
    )
    out = names.join(facts, "feature_set", "left").join(macro_f1(predictions), "feature_set", "left")
    n = F.coalesce("n_samples", F.lit(0)).cast("bigint")
    classes = F.coalesce("n_classes", F.lit(0)).cast("bigint")
    return out.select(
        "feature_set",
        n.alias("n_samples"),
        classes.alias("n_classes"),
        "n_features",
        F.coalesce(fraction("_covered", "n_samples"), F.lit(0.0)).alias("coverage"),
        F.coalesce(fraction("_right", "n_samples"), F.lit(0.0)).alias("accuracy"),
        F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"),
        F.coalesce(fraction("_base", "n_samples"), F.lit(0.0)).alias("baseline_accuracy"),
        F.when(n == 0, "no_labeled_samples")
        .when(classes < 2, "single_class_uninformative")
        .when(n < 3, "too_few_samples_interpret_with_caution")
        .otherwise("ok")
        .alias("status"),
    ).withColumn("delta_vs_baseline", F.col("accuracy") - F.col("baseline_accuracy"))


def loo_eval(df: DataFrame, target: str, features: Sequence[str], name: str = "features") -> DataFrame:
    sets = {name: tuple(features)}
    return evaluate(loo_predictions(key_counts(df, target, sets)), sets)


def compare_feature_sets(df: DataFrame, targets: Sequence[str], sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """All targets against all feature sets."""
    out = None
    for target in targets:
        part = evaluate(loo_predictions(key_counts(df, target, sets)), sets).withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return out


def sample_predictions(df: DataFrame, target: str, sets: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Prediction for every labelled row and feature set."""
    predictions = loo_predictions(key_counts(df, target, sets)).drop("n")
    options = F.array(*[F.struct(F.lit(n).alias("feature_set"), _key(f).alias("key")) for n, f in sets.items()])
    rows = (
        df.filter(present(F.col(target).cast("string")))
        .select(*keep, F.col(target).cast("string").alias("label"), F.explode(options).alias("x"))
        .select(*keep, "label", "x.feature_set", "x.key")
    )
    return rows.join(predictions, ["feature_set", "key", "label"]).withColumn(
        "correct", F.col("predicted_label") == F.col("label")
    ).withColumnRenamed("label", "true_label").drop("key")


def ablation(df: DataFrame, target: str, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Accuracy of each feature set without each of its features.

    Every distinct subset is counted once, and all subsets share one shuffle. A single feature is compared with the baseline.
    """
    subsets: dict[str, tuple[str, ...]] = {}

    def name_of(features: Sequence[str]) -> str:
        name = "+".join(features)
        subsets[name] = tuple(features)
        return name

    plan = []
    for set_name, features in sets.items():
        full = name_of(features)
        for f in features:
            rest = [x for x in features if x != f]
            plan.append((set_name, f, full, name_of(rest) if rest else ""))
    results = evaluate(loo_predictions(key_counts(df, target, subsets)), subsets).select(
        "feature_set", "accuracy", "baseline_accuracy"
    )
    spec = df.sparkSession.createDataFrame(plan, "feature_set string, feature string, full string, rest string")
    full = results.select(
        F.col("feature_set").alias("full"), F.col("accuracy").alias("full_accuracy"), F.col("baseline_accuracy").alias("_base")
    )
    rest = results.select(F.col("feature_set").alias("rest"), F.col("accuracy").alias("_rest"))
    used = sorted({f for fs in sets.values() for f in fs})
    facts = df.agg(
        *[F.count_if(is_informative(F.col(f).cast("string"))).alias(f"{f}_n") for f in used],
        *[
            F.countDistinct(F.when(is_informative(F.col(f).cast("string")), safe_value(F.col(f).cast("string")))).alias(f"{f}_u")
            for f in used
        ],
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"), F.col(f"{f}_n").alias("non_missing_count"), F.col(f"{f}_u").alias("unique_value_count")
                    )
                    for f in used
                ]
            )
        ).alias("x")
    ).select("x.*")
    without = F.coalesce("_rest", "_base")
    return (
        spec.join(full, "full")
        .join(rest, "rest", "left")
        .join(facts, "feature")
        .select(
            "feature_set",
            "feature",
            "non_missing_count",
            "unique_value_count",
            "full_accuracy",
            without.alias("accuracy_without_feature"),
            (F.col("full_accuracy") - without).alias("delta_accuracy"),
        )
    )


def summarise_tests(models: DataFrame, rates: DataFrame, spec: DataFrame) -> DataFrame:
    """One row per goal: test rows by status, metric, baseline, effect and overall status.

    ``models``: ``goal, analysis_id, target, feature_set, n_samples, accuracy, status``;
    ``rates``: ``goal, top_fraction``; ``spec``: ``goal, kind (model or rate), primary_set,
    comparison_set``. A model goal compares the mean accuracy of two feature sets over targets, a rate
    goal the largest and smallest top fraction over groups.
    """
    counts = models.groupBy("goal").agg(
        F.count("*").alias("matching_model_rows"),
        F.count_if(F.col("status") == "ok").alias("ok_model_rows"),
        F.count_if(present("status") & (F.col("status") != "ok")).alias("limited_model_rows"),
        F.max("n_samples").alias("max_n_samples"),
        F.max(F.when(F.col("status") == "biological_claim_supported", 1).otherwise(0)).alias("_claim"),
        F.max(F.when(F.col("status").isin("analysis_supported", "analysis_ready"), 1).otherwise(0)).alias("_ready"),
    )
    chosen = models.join(spec.filter(F.col("kind") == "model"), "goal").groupBy("goal", "target").agg(
        F.max(F.when(F.col("feature_set") == F.col("primary_set"), F.col("accuracy"))).alias("p"),
        F.max(F.when(F.col("feature_set") == F.col("comparison_set"), F.col("accuracy"))).alias("c"),
    )
    by_model = chosen.groupBy("goal").agg(
        F.avg("p").alias("primary_metric_value"), F.avg("c").alias("baseline_metric_value"), F.avg(F.col("p") - F.col("c")).alias("effect_size")
    )
    by_rate = rates.groupBy("goal").agg(
        F.max("top_fraction").alias("primary_metric_value"),
        F.min("top_fraction").alias("baseline_metric_value"),
        (F.max("top_fraction") - F.min("top_fraction")).alias("effect_size"),
    )
    metrics = by_model.unionByName(by_rate)
    zero = ["matching_model_rows", "ok_model_rows", "limited_model_rows", "max_n_samples", "_claim", "_ready"]
    df = spec.join(counts, "goal", "left").join(metrics, "goal", "left")
    for c in zero:
        df = df.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    return df.select(
        "goal",
        "matching_model_rows",
        "ok_model_rows",
        "limited_model_rows",
        "max_n_samples",
        "primary_metric_value",
        "baseline_metric_value",
        "effect_size",
        F.when(F.col("_claim") == 1, "pass").when(F.col("matching_model_rows") > 0, "warn").otherwise("fail").alias("summary_status"),
        F.when(F.col("_claim") == 1, "biological_claim_supported").otherwise("data_dependent").alias("claim_status"),
    )

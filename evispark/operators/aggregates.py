"""Summaries, sets, rates and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions.missing import is_informative, is_missing, null_if_missing, present, safe_value, text
from evispark.functions.numbers import count_bin, evidence_state, fraction, score_bin, to_double, wilson
from evispark.functions import rules as R
from evispark.functions.text import matches
from evispark.operators.scan import dealt, range_count
from evispark.operators.windows import positions

#: Items of a piece of a list.
PIECE_ITEMS = 100_000


def distinct_text(df: DataFrame, keys: Sequence[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """Per key the distinct present values as sorted ``;`` text.

    Duplicates go before anything is grouped by key, so a key with many rows but few names stays small.
    """
    once = df.filter(present(value)).select(*keys, value).distinct()
    aggregates = [F.array_join(F.array_sort(F.collect_list(value)), ";").alias(out)]
    if count:
        aggregates.append(F.count("*").alias(count))
    return once.groupBy(*keys).agg(*aggregates)


def packed_lists(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] | None = None, limit: int = PIECE_ITEMS
) -> DataFrame:
    """Ordered value lists per key, in pieces of at most ``limit`` items.

    A key up to the limit has one piece, numbered 0. A larger one is cut along the order, so
    its list is whole over the pieces while no task holds all of it.
    """
    order = list(order or [value])
    needed = df.select(*keys, value, *[o for o in order if o != value and o not in keys])
    tasks = range_count(needed)
    pieces = positions(needed, keys, order).withColumn("piece", F.floor(F.col("_pos") / limit).cast("bigint"))
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))
    return (
        dealt(pieces, tasks, *keys, "piece").groupBy(*keys, "piece")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .withColumn("items", F.transform("items", lambda x: x["v"]))
        .withColumn("item_count", F.size("items"))
    )


def summarise_groups(
    df: DataFrame, key: str, member: str, distinct: Mapping[str, str], first: Mapping[str, str],
    first_present: Mapping[str, str] | None = None,
) -> DataFrame:
    """Member count, distinct counts, and columns of the first member in member order.

    ``first_present`` takes the first value that is not missing. Member lists come from ``packed_lists``.
    """
    lead = F.min_by(F.struct(*[F.col(c).alias(n) for n, c in first.items()]), member).alias("_lead")
    grouped = df.groupBy(key).agg(
        F.count("*").alias("member_count"),
        *[F.countDistinct(null_if_missing(F.col(c).cast("string"))).alias(n) for n, c in distinct.items()],
        lead,
        *[F.min_by(F.col(c), F.when(present(c), F.col(member))).alias(n) for n, c in (first_present or {}).items()],
    )
    return grouped.select(
        key, "member_count", *distinct, *[F.col(f"_lead.{n}").alias(n) for n in first], *(first_present or {})
    )


def count_matrix(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[object]) -> DataFrame:
    """Counts of rows by column value, wide, zero filled, columns in the order given."""
    wide = df.groupBy(*rows).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.na.fill(0, [str(v) for v in values])


def count_matrix_long(df: DataFrame, rows: Sequence[str], column: str) -> DataFrame:
    """The same counts in long form, for axes too wide for columns; absent cells are zero."""
    return df.groupBy(*rows, column).agg(F.count("*").alias("count"))


def count_matrix_blocks(df: DataFrame, rows: Sequence[str], column: str, width: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """A count matrix with a column per value found, however many there are, and the table of its columns.

    Values are numbered in their order (``column_no`` from 0). The matrix has a row per row key and block of ``width``
    columns: ``block`` and ``counts``, the counts of columns ``block * width`` on, zero filled. A block without a count is
    left out. No list of values passes the driver. Null values are no column.
    """
    present_ = df.filter(F.col(column).isNotNull())
    columns = positions(present_.select(column).distinct(), [], [column], "column_no")
    long = count_matrix_long(present_, rows, column).join(columns, column)
    place = F.struct((F.col("column_no") % width).alias("at"), F.col("count"))
    blocks = long.groupBy(*rows, F.floor(F.col("column_no") / width).cast("bigint").alias("block")).agg(F.map_from_entries(F.collect_list(place)).alias("_at"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("_at")[i.cast("bigint")], F.lit(0).cast("bigint")))
    return blocks.withColumn("counts", cells).drop("_at"), columns


def _domain_rows(domains: DataFrame, gene: str) -> DataFrame:
    start = F.coalesce("start_aa", F.lit(10**9)).cast("bigint")
    return domains.select(
        gene,
        start.alias("_start"),
        text("domain_name").alias("_name"),
        text("domain_id").alias("_domain"),
        F.coalesce(F.nullif(text("domain_name"), F.lit("")), text("domain_id")).alias("_label"),
        "evidence_source",
    )


def architecture_labels(domains: DataFrame, gene: str = "annotation_gene_id") -> DataFrame:
    """The domains of every gene as rows: start, name, id and label. This is the whole list, whatever its length."""
    rows = _domain_rows(domains, gene)
    return rows.select(gene, F.col("_start").alias("start_aa"), F.col("_name").alias("domain_name"), F.col("_domain").alias("domain_id"), F.col("_label").alias("label"))


def architecture_text(domains: DataFrame, gene: str = "annotation_gene_id") -> DataFrame:
    """One text per gene of its domain labels in start order, for sinks; a gene's text has to fit in a cell."""
    item = F.struct("start_aa", "domain_name", "domain_id", "label")
    listed = architecture_labels(domains, gene).groupBy(gene).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select(gene, F.array_join(F.transform("items", lambda x: x["label"]), "|").alias("domain_architecture"))


def architecture(domains: DataFrame, gene: str = "annotation_gene_id") -> DataFrame:
    """One row per gene: domain count, sources, and the first hit with its support.

    ``domains``: ``domain_id, domain_name, start_aa (bigint), evidence_source``. The list of labels is
    ``architecture_labels``, its text ``architecture_text``.
    """
    rows = _domain_rows(domains, gene)
    facts = rows.groupBy(gene).agg(
        F.count("*").alias("domain_count"),
        F.min_by(F.struct("_domain", "_name"), F.struct("_start", "_name", "_domain")).alias("_best"),
        F.max(matches("_label", R.SUPPORT_PATTERN)).alias("_support"),
    )
    sources = distinct_text(rows, [gene], "evidence_source", "domain_sources")
    support = F.when(F.col("_support"), "rbp_depolymerase_domain").otherwise("domain_present")
    best = F.trim(F.concat(F.col("_best._domain"), F.lit(":"), F.col("_best._name")), F.lit(":"))
    return facts.join(sources, gene, "left").select(
        gene,
        "domain_count",
        F.coalesce("domain_sources", F.lit("")).alias("domain_sources"),
        F.concat(best, F.lit(" ("), support, F.lit(")")).alias("best_domain_hit"),
    )


def features_by_entity(df: DataFrame, entity: str, sets: Mapping[str, str], high: Column | None = None,
                       count: str = "candidate_count") -> DataFrame:
    """Distinct-value texts, counts and bins per entity that has rows."""
    kept = df.filter(present(entity))
    flag = F.lit(False) if high is None else high
    out = kept.groupBy(entity).agg(F.count("*").alias(count), F.count_if(flag).alias("high_confidence_count"))
    for name, column in sets.items():
        out = out.join(distinct_text(kept, [entity], column, name), entity, "left").withColumn(
            name, F.coalesce(name, F.lit(""))
        )
    return (
        out.withColumn(f"{count}_bin", count_bin(count))
        .withColumn("high_confidence_count_bin", count_bin("high_confidence_count"))
        .withColumn("evidence_state", F.lit("assessed_positive"))
    )


def assessed_features(df: DataFrame, entity: str, count: str, flag: str, sets: Mapping[str, str] | None = None) -> DataFrame:
    """Largest count per entity and whether it was assessed at all; zero is not "not assessed"."""
    kept = df.filter(present(entity))
    out = kept.groupBy(entity).agg(
        F.greatest(F.max(F.coalesce(F.col(count), F.lit(0))), F.lit(0)).alias("count"),
        F.max(F.coalesce(F.col(flag), F.lit(False))).alias("_assessed"),
    )
    state = (
        F.when(F.col("count") > 0, "assessed_positive")
        .when(F.col("_assessed"), "assessed_zero_detected")
        .otherwise("not_assessed")
    )
    out = out.withColumn("evidence_state", state).withColumn(
        "count_bin", F.when(F.col("evidence_state") == "not_assessed", "not_assessed").otherwise(count_bin("count"))
    ).drop("_assessed")
    for name, column in (sets or {}).items():
        out = out.join(distinct_text(kept, [entity], column, name), entity, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def receptor_support(hits: DataFrame, entity: str, item: str, score: str) -> DataFrame:
    """Hit count, best finite score and their bins per entity. Item lists come from ``packed_lists``."""
    value = to_double(F.col(score).cast("string"))
    usable = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return (
        hits.groupBy(entity)
        .agg(
            F.count("*").alias("protein_count"),
            F.max(usable).alias("max_score"),
            F.countDistinct(null_if_missing(F.col(item).cast("string"))).alias("distinct_proteins"),
        )
        .withColumn("protein_count_bin", count_bin("protein_count"))
        .withColumn("max_score_bin", score_bin("max_score", R.SCORE_CUTS, R.SCORE_BELOW))
    )


def locus_support(items: DataFrame, entity: str, item: str) -> DataFrame:
    """Item count, its bin and an order-free fingerprint, one row per entity.

    The fingerprint is the SHA-256 of the number of items and four sums, joined by colons. A sum adds up, over the
    items, 15 hexadecimal digits of the item's SHA-256: digits 1 to 15, 16 to 30, 31 to 45 and 46 to 60. Equal
    multisets have equal fingerprints, and no list of items is ever built.
    """
    digest = F.sha2(F.coalesce(F.col(item).cast("string"), F.lit("")).cast("binary"), 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return items.groupBy(entity).agg(
        F.count("*").alias("locus_protein_count"),
        count_bin(F.count("*")).alias("locus_protein_count_bin"),
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("locus_fingerprint_sha256"),
    )


def assay_breadth(assays: DataFrame, keys: Sequence[str], result: str = "spot_result") -> DataFrame:
    """Tested and positive counts per key with fraction and 95 % Wilson bounds."""
    informative = assays.filter(F.col(result).isin("positive", "negative"))
    return (
        informative.groupBy(*keys)
        .agg(F.count("*").alias("tested_host_count"), F.count_if(F.col(result) == "positive").alias("positive_host_count"))
        .withColumn("positive_fraction", fraction("positive_host_count", "tested_host_count"))
        .withColumn("_ci", wilson("positive_host_count", "tested_host_count"))
        .withColumn("ci95_low", F.col("_ci.low"))
        .withColumn("ci95_high", F.col("_ci.high"))
        .drop("_ci")
    )


def group_rate(df: DataFrame, group: str, outcome: str) -> tuple[DataFrame, DataFrame]:
    """Top outcome and its share per group, and one row with the overall status."""
    counts = (
        df.filter(present(outcome))
        .groupBy(safe_value(group).alias("group_value"), F.col(outcome).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    groups = counts.groupBy("group_value").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("label_count"),
        F.min(F.struct((-F.col("n")).alias("c"), F.col("label").alias("l"))).alias("_top"),
    ).select(
        "group_value",
        "total",
        "label_count",
        F.col("_top.l").alias("top_label"),
        (-F.col("_top.c") / F.col("total")).alias("top_fraction"),
    )
    overall = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
        F.countDistinct("label").alias("n_classes"),
        F.countDistinct("group_value").alias("n_groups"),
    ).withColumn(
        "status",
        F.when((F.col("n_samples") >= 3) & (F.col("n_classes") >= 2) & (F.col("n_groups") >= 2), "ok").otherwise(
            "insufficient_groups_for_rate_test"
        ),
    )
    return groups, overall


def label_counts(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """Counts per group and outcome, the long form behind the rates."""
    return df.filter(present(outcome)).groupBy(safe_value(group).alias("group_value"), F.col(outcome).alias("label")).agg(
        F.count("*").alias("n")
    )


def coverage_gate(
    samples: DataFrame, feature: str, value: str, min_assessed: int = 20, min_groups: int = 2, min_group_size: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Is a feature assessed widely enough to test? One status row, and the mean value per group."""
    assessed = is_informative(feature)
    groups = (
        samples.filter(assessed)
        .groupBy(safe_value(feature).alias("group_value"))
        .agg(
            F.count("*").alias("group_size"),
            F.countDistinct(F.round(value, 3)).alias("distinct_values"),
            F.avg(value).alias("mean_value"),
        )
    )
    totals = samples.agg(
        F.count("*").alias("a"), F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n")
    ).unionByName(
        groups.agg(
            F.lit(0).cast("bigint").alias("a"),
            F.count("*").alias("g"),
            F.count_if(F.col("group_size") < min_group_size).alias("s"),
            F.coalesce(F.sum("group_size"), F.lit(0)).alias("n"),
        )
    )
    gate = totals.agg(
        F.sum("a").alias("n_samples"), F.sum("n").alias("n_assessed"), F.sum("g").alias("n_groups"), F.sum("s").alias("small_groups")
    )
    short = (F.col("n_assessed") < min_assessed) | (F.col("n_groups") < min_groups) | (F.col("small_groups") > 0)
    return gate.withColumn("coverage", fraction("n_assessed", "n_samples")).withColumn(
        "status",
        F.when(F.col("n_samples") == 0, "blocked_no_host_range_breadth_labels")
        .when(F.col("n_assessed") == 0, "blocked_feature_not_assessed")
        .when(short, "blocked_insufficient_feature_coverage")
        .otherwise("analysis_ready"),
    ), groups


def breadth_summary(breadth: DataFrame, value: str = "positive_fraction") -> DataFrame:
    """How many samples and distinct rounded fractions there are."""
    return breadth.agg(
        F.count("*").alias("n_samples"), F.countDistinct(F.round(value, 3)).alias("n_classes")
    ).withColumn(
        "status",
        F.when(F.col("n_samples") > 0, "descriptive_breadth_available").otherwise("blocked_no_host_range_breadth_labels"),
    )


def feature_coverage(pairs: DataFrame, left: str, right: str,
                     evidence: Mapping[str, tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Coverage of evidence over unique entities and over tested pairs, as long rows.

    ``evidence`` maps a metric to (side, detected ids, assessed ids); side is ``left`` or
    ``right``. Flags are joined to the unique entities first and reach the pairs from there.
    """
    flagged = {}
    for side, column in (("left", left), ("right", right)):
        entities = pairs.filter(present(F.col(column).cast("string"))).select(column).distinct()
        for metric, (where, detected, assessed) in evidence.items():
            if where != side:
                continue
            for kind, ids in (("d", detected), ("a", assessed)):
                known = ids.select(F.col(ids.columns[0]).alias(column)).distinct().withColumn(f"{metric}_{kind}", F.lit(True))
                entities = entities.join(known, column, "left").withColumn(
                    f"{metric}_{kind}", F.coalesce(f"{metric}_{kind}", F.lit(False))
                )
        flagged[side] = entities
    tagged = pairs.join(flagged["left"], left, "left").join(flagged["right"], right, "left")

    def rows(df: DataFrame, level: str, metrics: Sequence[str]) -> DataFrame:
        counts = df.agg(
            F.count("*").alias("_n"), *[F.count_if(F.col(f"{m}_{k}")).alias(f"{m}_{k}") for m in metrics for k in "da"]
        )
        stacked = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(f"{m}_d").alias("numerator"), F.col(f"{m}_a").alias("assessed"))
                for m in metrics
            ]
        )
        return counts.select(F.explode(stacked).alias("x"), F.col("_n").alias("denominator")).select(
            "x.metric", F.lit(level).alias("entity_level"), "x.numerator", "x.assessed", "denominator"
        )

    sides = {s: [m for m, (w, _, _) in evidence.items() if w == s] for s in ("left", "right")}
    parts = [rows(flagged[s], f"unique_{s}", sides[s]) for s in ("left", "right") if sides[s]]
    parts.append(rows(tagged, "pair", list(evidence)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("coverage_fraction", fraction("numerator", "denominator")).withColumn(
        "evidence_state", evidence_state("numerator", "assessed", "denominator")
    )


def pair_completeness(pairs: DataFrame, left: str, right: str, left_ids: DataFrame, right_ids: DataFrame, metric: str) -> DataFrame:
    """Pairs whose two ends both have evidence."""
    a = left_ids.select(F.col(left_ids.columns[0]).alias(left)).distinct().withColumn("_l", F.lit(True))
    b = right_ids.select(F.col(right_ids.columns[0]).alias(right)).distinct().withColumn("_r", F.lit(True))
    both = F.coalesce(F.col("_l") & F.col("_r"), F.lit(False))
    return (
        pairs.join(a, left, "left")
        .join(b, right, "left")
        .agg(F.count_if(both).alias("numerator"), F.count("*").alias("denominator"))
        .select(F.lit(metric).alias("metric"), "numerator", "denominator")
        .withColumn("coverage_fraction", fraction("numerator", "denominator"))
        .withColumn("evidence_state", evidence_state("numerator", "numerator", "denominator"))
    )


def metrics_long(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Global aggregates as (metric, value) rows."""
    row = df.agg(*[c.cast("bigint").alias(n) for n, c in metrics.items()])
    return row.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("m")
    ).select("m.metric", "m.value")


def support_audit(
    df: DataFrame, metrics: Mapping[str, Column], thresholds: Mapping[str, int], needs: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, DataFrame]:
    """Metric counts against minima, and per goal the metrics it still lacks."""
    spark = df.sparkSession
    limits = spark.createDataFrame(list(thresholds.items()), "metric string, threshold bigint")
    summary = limits.join(metrics_long(df, metrics), "metric", "left").select(
        "metric",
        F.coalesce("value", F.lit(0)).alias("value"),
        "threshold",
    ).withColumn("status", F.when(F.col("value") >= F.col("threshold"), "pass").otherwise("fail"))
    wanted = spark.createDataFrame(
        [(g, m, i) for g, ms in needs.items() for i, m in enumerate(ms)], "goal string, metric string, ordinal int"
    )
    short = F.when(F.col("status") == "fail", F.struct("ordinal", F.concat_ws("/", F.concat_ws(":", "metric", "value"), "threshold").alias("t")))
    goals = wanted.join(summary, "metric").groupBy("goal").agg(
        F.count("*").alias("required_metrics"),
        F.transform(F.array_sort(F.collect_list(short)), lambda x: x["t"]).alias("_missing"),
    ).select(
        "goal",
        "required_metrics",
        F.array_join("_missing", ";").alias("missing_support"),
        F.when(F.size("_missing") == 0, "ready_minimum_sample_support")
        .otherwise("blocked_minimum_sample_support")
        .alias("support_status"),
    )
    return summary, goals


def overlap_groups(df: DataFrame, keys: Sequence[str], source: str, order: str) -> DataFrame:
    """Keys of several kinds shared by two or more rows, with their sources in first-seen order.

    All kinds go through one shuffle. Rows are first reduced per key and source.
    """
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("key_type"), text(F.col(k).cast("string")).alias("key_value")) for k in keys])
        ).alias("k"),
        null_if_missing(F.col(source).cast("string")).alias("source"),
        F.col(order).alias("_o"),
    ).select("k.key_type", "k.key_value", "source", "_o").filter(present("key_value"))
    by_source = long.groupBy("key_type", "key_value", "source").agg(F.count("*").alias("n"), F.min("_o").alias("o"))
    seen = F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("o", "source"))))
    return (
        by_source.groupBy("key_type", "key_value")
        .agg(F.sum("n").alias("record_count"), F.count("source").alias("source_count"), seen.alias("_seen"))
        .filter(F.col("record_count") >= 2)
        .select(
            "key_type",
            "key_value",
            "record_count",
            "source_count",
            F.when(F.size("_seen") == 0, "NA")
            .otherwise(F.array_join(F.transform("_seen", lambda x: x["source"]), ";"))
            .alias("sources"),
            F.concat(F.lit("duplicate_"), F.col("key_type")).alias("overlap_status"),
        )
    )


def source_summary(df: DataFrame, source: str, counted: Sequence[str], overlaps: DataFrame) -> DataFrame:
    """Rows, distinct keys and overlap groups per source."""
    touched = (
        overlaps.select(F.explode(F.split("sources", ";")).alias("source"))
        .filter(present("source"))
        .groupBy("source")
        .agg(F.count("*").alias("duplicate_key_count"))
    )
    per = df.groupBy(F.coalesce(F.nullif(text(F.col(source).cast("string")), F.lit("")), F.lit("NA")).alias("source")).agg(
        F.count("*").alias("record_count"),
        *[F.countDistinct(null_if_missing(F.col(c).cast("string"))).alias(f"unique_{c}") for c in counted],
    )
    return per.join(touched, "source", "left").withColumn(
        "duplicate_key_count", F.coalesce("duplicate_key_count", F.lit(0))
    )


def freq(df: DataFrame, column: str, out: str = "category") -> DataFrame:
    """Counts by value, missing ones under ``missing``."""
    value = F.coalesce(null_if_missing(F.col(column).cast("string")), F.lit("missing"))
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("count"))


def status_report(df: DataFrame, status: str = "status", severity: str = "severity") -> DataFrame:
    """Rows per status with the worst severity among them."""
    rank = F.when(F.col(severity) == "error", 2).when(F.col(severity) == "warning", 1).otherwise(0)
    return df.groupBy(F.col(status).alias("item")).agg(F.count("*").alias("rows"), F.max(rank).alias("_r")).select(
        F.when(F.col("_r") == 2, "error").when(F.col("_r") == 1, "warning").otherwise("info").alias("severity"), "item", "rows"
    )


def test_coverage(models: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per goal: matching test rows, ok and limited ones, and pass, warn or fail.

    ``rules`` maps a goal to the condition that selects its test rows.
    """
    goals = models.sparkSession.createDataFrame([(g,) for g in rules], "goal string")
    hits = models.select(
        "status", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in rules.items()]))).alias("goal")
    )
    counts = hits.groupBy("goal").agg(
        F.count("*").alias("matching_rows"),
        F.count_if(F.col("status") == "ok").alias("ok_rows"),
        F.count_if((text("status") != "") & (F.col("status") != "ok")).alias("limited_rows"),
    )
    zero = ["matching_rows", "ok_rows", "limited_rows"]
    out = goals.join(counts, "goal", "left").select("goal", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in zero])
    return out.withColumn(
        "status",
        F.when(F.col("matching_rows") == 0, "fail").when(F.col("ok_rows") > 0, "pass").otherwise("warn"),
    )


def assert_metrics(observed: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Compare (metric, value) rows with expected values."""
    wanted = observed.sparkSession.createDataFrame(list(expected.items()), "metric string, expected bigint")
    same = F.coalesce(F.col("value") == F.col("expected"), F.lit(False))
    return wanted.join(observed, "metric", "left").select(
        "metric",
        "value",
        "expected",
        F.when(same, "pass").otherwise("fail").alias("status"),
        F.when(same, "info").otherwise("error").alias("severity"),
    )


def matrix_stats(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Distinct ids and cell counts of a matrix in long form; a blank cell is untested."""
    v = F.lower(text(F.col(value).cast("string")))
    return long.agg(
        F.countDistinct(column).alias("column_ids"),
        F.countDistinct(row).alias("row_ids"),
        F.count_if(v.isin("1", "1.0", "0", "0.0")).alias("tested"),
        F.count_if(v.isin("1", "1.0")).alias("positive"),
        F.count_if(v.isin("0", "0.0")).alias("negative"),
        F.count_if(is_missing(F.col(value).cast("string"))).alias("blank"),
    )


def scope_counts(manifest: DataFrame, qc: DataFrame, key: str = "genome_id") -> DataFrame:
    """Rows with a passing sequence, for phage-like records, hosts and all."""
    passed = qc.filter(F.col("passes_sequence_qc")).select(key).distinct()
    kept = manifest.join(passed, key, "left_semi")
    return metrics_long(
        kept,
        {
            "phage_like": F.count_if(F.col("record_type").isin(*R.PHAGE_LIKE)),
            "host": F.count_if(F.col("record_type") == "host"),
            "any": F.count("*"),
        },
    )

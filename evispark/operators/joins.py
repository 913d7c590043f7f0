"""Lookups, id resolution and merges.

No join carries a broadcast hint unless its size is fixed by the caller's arguments;
Spark broadcasts a side only when its measured size is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions.missing import as_col, is_missing, null_if_missing, present, strip, text
from evispark.functions.rules import REVIEWED
from evispark.functions.text import hash_id, normalize_key
from evispark.operators.windows import first_per_key


def shuffled(df: DataFrame) -> DataFrame:
    """A side with a row per entity, joined by shuffles whatever its stored size.

    Ids, defaults and repeated names pack into few bytes of Parquet and take a hundred times that in memory. Spark, which sees
    the stored size of a written table, would send it whole through the driver.
    """
    return df.hint("merge")


def lookup_left(df: DataFrame, dim: DataFrame, keys: Sequence[str] | str, order: str | None = None) -> DataFrame:
    """Left join on a lookup table; with ``order`` the last row of a repeated key wins."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if order is not None:
        dim = first_per_key(dim, keys, [F.col(order).desc()]).drop(order)
    return df.join(dim, keys, "left")


def last_rows(dim: DataFrame, keys: Sequence[str] | str, columns: Sequence[str], order: str = "row_number") -> DataFrame:
    """One row per key with the columns: the last one by ``order``.

    A table without that column has no last row; there the largest row by its columns is taken, so reruns agree.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if order in dim.columns:
        place = [F.col(order).desc_nulls_last(), *[F.col(c).desc() for c in columns]]
    else:
        place = [F.col(c).desc() for c in columns]
    return first_per_key(dim, keys, place).select(*keys, *columns)


def semi_with_report(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known key, and one row with the number skipped."""
    ids = known.select(key).distinct()
    skipped = df.join(ids, key, "left_anti").agg(F.count("*").alias("skipped"))
    return df.join(ids, key, "left_semi"), skipped


def unknown_ids(df: DataFrame, columns: Sequence[str], ref: DataFrame) -> DataFrame:
    """Distinct present values of the columns that are not in the reference.

    An empty reference means nothing can be checked, so nothing is unknown.
    """
    values = (
        df.select(F.explode(F.array(*[strip(F.col(c).cast("string")) for c in columns])).alias("id"))
        .filter(present("id"))
        .distinct()
    )
    ids = ref.select(F.col(ref.columns[0]).cast("string").alias("id"))
    if ids.isEmpty():
        return values.limit(0)
    return values.join(ids, "id", "left_anti")


def content_lint(df: DataFrame, checks: Mapping[str, tuple[Sequence[str], DataFrame]], path: str = "",
                 generated_prefixes: Sequence[str] = (), inferred: tuple[str, str] | None = None) -> DataFrame:
    """Lint names with counts: unknown ids, keyword-inferred rows, generated inputs."""
    spark = df.sparkSession
    found = [
        unknown_ids(df, columns, ref).agg(F.count("*").alias("count")).select(F.lit(name).alias("lint"), "count")
        for name, (columns, ref) in checks.items()
    ]
    if inferred is not None and inferred[0] in df.columns:
        rows = df.filter(F.col(inferred[0]) == inferred[1]).agg(F.count("*").alias("count"))
        found.append(rows.select(F.lit(f"{inferred[1]}_rows").alias("lint"), "count"))
    if any(path.startswith(p) for p in generated_prefixes):
        found.append(spark.range(1).select(F.lit("input_is_generated_output").alias("lint"), F.lit(1).cast("bigint").alias("count")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("count > 0")


def resolve_entities(
    df: DataFrame,
    dim: DataFrame,
    known_ids: DataFrame | None = None,
    source: str = "source",
    pair: tuple[str, str] = ("host_species", "host_strain"),
    label: Sequence[str] = ("host_species", "host_strain", "isolation_host"),
    dim_id: str = "host_genome_id",
    prefix: str = "metadata_host_",
) -> DataFrame:
    """Resolve rows to entities by id, by a unique pair of names, or to a synthetic id.

    ``dim`` holds the id and the two names; ``known_ids`` may name more ids than it.
    Adds ``resolved_id``, ``link_status`` and ``entity_label``.
    """
    ids = dim.select(F.col(dim_id).alias("_id"))
    if known_ids is not None:
        ids = ids.unionByName(known_ids.select(F.col(known_ids.columns[0]).alias("_id")))
    ids = ids.filter(F.col("_id").isNotNull()).distinct()
    a, b = pair
    named = (
        dim.select(F.lower(text(a)).alias("_a"), F.lower(text(b)).alias("_b"), F.col(dim_id).alias("_pid"))
        .filter((F.col("_a") != "") | (F.col("_b") != ""))
        .groupBy("_a", "_b")
        .agg(F.count("*").alias("_hits"), F.min("_pid").alias("_pair_id"))
    )
    out = (
        df.join(shuffled(ids), strip(df[source]) == ids["_id"], "left")
        .withColumn("_la", F.lower(text(a)))
        .withColumn("_lb", F.lower(text(b)))
    )
    out = out.join(shuffled(named), (out["_la"] == named["_a"]) & (out["_lb"] == named["_b"]), "left")
    shown = F.concat_ws(" | ", *[null_if_missing(c) for c in label])
    made = hash_id(a, b, shown, prefix=prefix)
    by_pair = F.col("_hits") == 1
    status = (
        F.when(F.col("_id").isNotNull(), "source_matches_host_genome_id")
        .when(by_pair, "host_species_strain_exact_match")
        .when(F.col("_hits") > 1, "ambiguous_host_species_strain_match")
        .when(shown != "", "metadata_only_host_no_genome")
        .otherwise("no_host_metadata")
    )
    resolved = (
        F.when(F.col("_id").isNotNull(), F.col("_id"))
        .when(by_pair, F.col("_pair_id"))
        .when(F.col("_hits") > 1, "")
        .when(shown != "", made)
        .otherwise("")
    )
    return (
        out.withColumn("entity_label", shown)
        .withColumn("link_status", status)
        .withColumn("resolved_id", resolved)
        .drop("_id", "_a", "_b", "_la", "_lb", "_hits", "_pair_id")
    )


def patch_merge(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], order: str, flag: str) -> DataFrame:
    """Overlay a patch on a base table; rows found only in the patch are added.

    Per column the last present value of the patch wins over the base.
    """

    # Cleaned once per value before the aggregate, which would otherwise clean it for each use.
    clean = patch.filter(present(key)).select(key, order, *[null_if_missing(c).alias(c) for c in columns])
    latest = clean.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_p_{c}") for c in columns]
    ).withColumn("_hit", F.lit(True))
    both = base.join(latest, key, "full_outer")
    kept = [c for c in base.columns if c != key and c not in columns]
    return both.select(
        key,
        *kept,
        *[F.coalesce(F.col(f"_p_{c}"), F.col(c) if c in base.columns else F.lit(None)).alias(c) for c in columns],
        F.when(F.col("_hit"), "supplied").otherwise("not_supplied").alias(flag),
    )


def union_prefer(first: DataFrame, second: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both tables, one per key, the first table before the second."""
    both = first.withColumn("_table", F.lit(0)).unionByName(second.withColumn("_table", F.lit(1)), True)
    return first_per_key(both, keys, ["_table", order]).withColumn(
        "origin", F.when(F.col("_table") == 0, "first").otherwise("second")
    ).drop("_table")


def reviewed_mapping(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable ``source_id -> canonical_id`` rows, and the issues found in the mapping."""
    status = F.lower(F.coalesce(null_if_missing("review_status"), F.lit("reviewed")))
    rows = mapping.filter(present("source_id") | present("canonical_id")).withColumn("_status", status)
    reviewed = rows.filter(F.col("_status").isin(*REVIEWED))
    usable = (
        reviewed.filter(present("source_id") & present("canonical_id"))
        .groupBy(strip("source_id").alias("source_id"))
        .agg(F.min(strip("canonical_id")).alias("canonical_id"), F.max(strip("canonical_id")).alias("_other"))
    )
    problem = (
        F.when(is_missing("source_id"), "mapping row must include source_id")
        .when(~F.col("_status").isin(*REVIEWED), "not reviewed; mapping skipped")
        .when(is_missing("canonical_id"), "reviewed but missing canonical_id")
    )
    severity = F.when(~F.col("_status").isin(*REVIEWED) & present("source_id"), "warning").otherwise("error")
    issues = (
        rows.withColumn("message", problem)
        .filter(F.col("message").isNotNull())
        .select(severity.alias("severity"), strip("source_id").alias("source_id"), "message")
        .unionByName(
            usable.filter(F.col("canonical_id") != F.col("_other")).select(
                F.lit("error").alias("severity"), "source_id", F.lit("maps to multiple canonical ids").alias("message")
            )
        )
    )
    return usable.filter(F.col("canonical_id") == F.col("_other")).drop("_other"), issues


def map_ids(df: DataFrame, mapping: DataFrame, on: str, out: str, fallback: bool = False) -> DataFrame:
    """Add the canonical id and ``<out>_status``: mapped, source_id or unresolved.

    ``mapping`` comes from ``reviewed_mapping``.
    """
    m = mapping.select(F.col("source_id").alias("_sid"), F.col("canonical_id").alias("_cid"))
    joined = df.join(m, strip(df[on]) == m["_sid"], "left")
    otherwise = F.col(on) if fallback else F.lit("")
    return (
        joined.withColumn(out, F.coalesce("_cid", otherwise))
        .withColumn(
            f"{out}_status",
            F.when(F.col("_cid").isNotNull(), "mapped").when(F.lit(fallback), "source_id").otherwise("unresolved"),
        )
        .drop("_sid", "_cid")
    )


def alias_map(dim: DataFrame, canonical: str, aliases: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Every identifier of a row with its canonical id; identifiers with several are returned apart."""
    columns = list(dict.fromkeys([canonical, *[a for a in aliases if a in dim.columns]]))
    pairs = (
        dim.filter(present(canonical))
        .select(strip(canonical).alias("canonical"), F.explode(F.array(*[strip(c) for c in columns])).alias("alias"))
        .filter(present("alias"))
    )
    closed = pairs.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("_other"))
    return (
        closed.filter(F.col("canonical") == F.col("_other")).drop("_other"),
        closed.filter(F.col("canonical") != F.col("_other")).select(
            "alias", F.col("canonical").alias("first_canonical"), F.col("_other").alias("last_canonical")
        ),
    )


def propose_matches(ids: DataFrame, canon: DataFrame, existing: DataFrame, update: bool = True) -> DataFrame:
    """A proposal per source id: exact, unique by folded name, ambiguous or none.

    Mappings that exist are kept as they are; new ones are pending. Ids stand in the
    first column of ``ids`` and ``canon``.
    """
    source = ids.select(F.col(ids.columns[0]).alias("source_id")).filter(present("source_id")).distinct()
    known = canon.select(F.col(canon.columns[0]).alias("_cid")).distinct()
    exact = known.select(F.col("_cid").alias("_exact"))
    folded = (
        known.withColumn("_key", normalize_key("_cid"))
        .filter(F.col("_key") != "")
        .groupBy("_key")
        .agg(F.count("*").alias("_hits"), F.min("_cid").alias("_candidate"))
    )
    current = existing.select(
        "source_id", F.col("canonical_id").alias("existing_canonical_id"), F.col("review_status").alias("existing_review_status")
    )
    df = source.join(exact, source["source_id"] == exact["_exact"], "left").withColumn("_fold", normalize_key("source_id"))
    df = df.join(folded, df["_fold"] == folded["_key"], "left").join(current, "source_id", "left")
    status = (
        F.when(F.col("_exact").isNotNull(), "exact_match")
        .when(F.col("_hits") == 1, "normalized_unique_candidate")
        .when(F.col("_hits") > 1, "ambiguous_normalized_candidates")
        .otherwise("no_candidate")
    )
    has = F.col("existing_review_status").isNotNull() | F.col("existing_canonical_id").isNotNull()
    mapped = F.lower(text("existing_review_status")).isin(*REVIEWED) & (text("existing_canonical_id") != "")
    return df.select(
        "source_id",
        status.alias("candidate_status"),
        F.when(F.col("_exact").isNotNull(), 1).otherwise(F.coalesce("_hits", F.lit(0))).cast("bigint").alias("candidate_count"),
        F.coalesce("_exact", F.when(F.col("_hits") == 1, F.col("_candidate")), F.lit("")).alias("proposed_canonical_id"),
        F.when(mapped, "reviewed_mapped").when(has, "existing_not_reviewed").otherwise(status).alias("mapping_status"),
        F.when(has, "preserved_existing_mapping")
        .otherwise("added_pending_mapping_row" if update else "report_only")
        .alias("map_action"),
        F.when(has, F.col("existing_review_status")).otherwise("pending").alias("review_status"),
    )


def candidate_list(ids: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source ids with their folded name and how many canonical ids share it, and the canonical ids by folded name.

    A folded name with many ids on both sides would give all their pairs; the two tables say the same without them.
    """
    source = ids.select(F.col(ids.columns[0]).alias("source_id")).distinct().withColumn("folded", normalize_key("source_id"))
    known = canon.select(F.col(canon.columns[0]).alias("candidate_id")).distinct().withColumn("folded", normalize_key("candidate_id"))
    counts = known.filter("folded != ''").groupBy("folded").agg(F.count("*").alias("candidates"))
    listed = known.join(source.filter("folded != ''").select("folded").distinct(), "folded", "left_semi")
    return source.filter("folded != ''").join(counts, "folded").select("source_id", "folded", "candidates"), listed.select("folded", "candidate_id")


def scorecard(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key over all tables, columns named ``<table>_<column>``, with presence flags.

    All tables share one shuffle on the key: rows are stacked and each key takes the row it has in each table. Of
    rows that repeat a key in a table the smallest by its columns is taken, and ``repeated_keys`` names such tables.
    """
    stacked = None
    shapes = {}
    for name, df in tables.items():
        shapes[name] = [c for c in df.columns if c != key]
        part = df.select(F.col(key), F.lit(name).alias("_table"), F.struct(*[F.col(c) for c in shapes[name]]).alias(f"_{name}"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    grouped = stacked.groupBy(key).agg(
        *[F.min(F.when(F.col("_table") == n, F.col(f"_{n}"))).alias(f"_{n}") for n in tables],
        *[F.count_if(F.col("_table") == n).alias(f"_n_{n}") for n in tables],
    )
    many = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_n_{n}") > 1, F.lit(n)) for n in tables])), ";")
    columns = [key, many.alias("repeated_keys")]
    for name in tables:
        columns.append(F.col(f"_{name}").isNotNull().alias(f"in_{name}"))
        columns += [F.col(f"_{name}.{c}").alias(f"{name}_{c}") for c in shapes[name]]
    return grouped.select(*columns)


def metric_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack the (metric, value) rows of several aggregates."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked


def _metrics(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """Global aggregates as long (metric, value) rows."""
    row = df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in aggregates.items()])
    return row.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in aggregates])).alias("m")
    ).select("m.metric", "m.value")


def _wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    return long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def parity(assays: DataFrame, matrix: DataFrame, phages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Compare an assay table with the long form of its matrix, as one row of counts and ``parity_ok``.

    ``matrix`` holds ``result`` (positive, negative, blank, unsupported). The two aggregates
    are stacked, so no table is crossed with another.
    """

    def outside(column: str, ref: DataFrame) -> DataFrame:
        ids = ref.select(F.col(ref.columns[0]).alias(column)).distinct()
        return assays.join(ids, column, "left_anti")

    repeated = assays.filter(present("interaction_id")).groupBy("interaction_id").agg((F.count("*") - 1).alias("n"))
    names = [
        "rows", "positive", "negative", "tested_false", "productive_measured", "unresolved_phage_ids",
        "unresolved_host_ids", "duplicate_interaction_ids", "matrix_tested", "matrix_positive", "matrix_negative",
        "matrix_blank", "matrix_unsupported",
    ]
    long = metric_row(
        [
            _metrics(
                assays,
                {
                    "rows": F.count("*"),
                    "positive": F.count_if(F.col("spot_result") == "positive"),
                    "negative": F.count_if(F.col("spot_result") == "negative"),
                    "tested_false": F.count_if(~F.coalesce(F.col("tested") == "true", F.lit(False))),
                    "productive_measured": F.count_if(
                        ~text("productive_infection_result").isin("", "NA", "not_measured")
                    ),
                },
            ),
            _metrics(outside("phage_id", phages), {"unresolved_phage_ids": F.count("*")}),
            _metrics(outside("host_id", hosts), {"unresolved_host_ids": F.count("*")}),
            _metrics(repeated, {"duplicate_interaction_ids": F.sum("n")}),
            _metrics(
                matrix,
                {
                    "matrix_tested": F.count_if(F.col("result").isin("positive", "negative")),
                    "matrix_positive": F.count_if(F.col("result") == "positive"),
                    "matrix_negative": F.count_if(F.col("result") == "negative"),
                    "matrix_blank": F.count_if(F.col("result") == "blank"),
                    "matrix_unsupported": F.count_if(F.col("result") == "unsupported"),
                },
            ),
        ]
    )
    ok = (
        (F.col("rows") == F.col("matrix_tested"))
        & (F.col("positive") == F.col("matrix_positive"))
        & (F.col("negative") == F.col("matrix_negative"))
        & (F.col("matrix_blank") > 0)
    )
    for zero in ("tested_false", "productive_measured", "unresolved_phage_ids", "unresolved_host_ids",
                 "duplicate_interaction_ids", "matrix_unsupported"):
        ok = ok & (F.col(zero) == 0)
    return _wide(long, names).withColumn("parity_ok", ok)


def map_stats(mapping: DataFrame, sources: DataFrame, canon: DataFrame) -> DataFrame:
    """Coverage of an id mapping against its sources and canonical ids, as one row."""
    src = sources.select(F.col(sources.columns[0]).alias("source_id")).filter(present("source_id")).distinct()
    can = canon.select(F.col(canon.columns[0]).alias("canonical_id")).distinct()
    mapped = mapping.filter(text("source_id") != "").groupBy("source_id").agg(
        F.count("*").alias("n"),
        F.max(F.lower(text("review_status")).isin(*REVIEWED).cast("int")).alias("reviewed"),
    )
    targets = mapping.filter(text("canonical_id") != "").groupBy("canonical_id").agg(F.count("*").alias("n"))
    open_targets = targets.filter(present("canonical_id")).join(can, "canonical_id", "left_anti")
    names = [
        "rows", "mapped_ids", "reviewed", "pending", "missing_source_ids", "extra_source_ids", "missing_canonical",
        "unresolved_canonical", "duplicate_source_ids", "duplicate_canonical_ids",
    ]
    long = metric_row(
        [
            _metrics(mapping, {"rows": F.count("*"), "missing_canonical": F.count_if(is_missing("canonical_id"))}),
            _metrics(
                mapped,
                {
                    "mapped_ids": F.count("*"),
                    "reviewed": F.sum("reviewed"),
                    "duplicate_source_ids": F.max((F.col("n") > 1).cast("int")),
                },
            ),
            _metrics(src.join(mapped, "source_id", "left_anti"), {"missing_source_ids": F.count("*")}),
            _metrics(mapped.join(src, "source_id", "left_anti"), {"extra_source_ids": F.count("*")}),
            _metrics(open_targets, {"unresolved_canonical": F.sum("n")}),
            _metrics(targets, {"duplicate_canonical_ids": F.max((F.col("n") > 1).cast("int"))}),
        ]
    )
    wide = _wide(long, [n for n in names if n != "pending"]).withColumn("pending", F.col("rows") - F.col("reviewed"))
    blocking = F.col("reviewed") == 0
    for n in names[4:]:
        blocking = blocking | (F.col(n) > 0)
    return wide.select(*names, blocking.alias("blocking"))


def compatibility(links: DataFrame, host_defense: DataFrame, antidefense: DataFrame) -> DataFrame:
    """Defense and counter-defense features of each (phage, host) link.

    Matches are found by an equi-join on (host, name), not by comparing arrays. The
    set columns hold distinct names only.
    """
    from evispark.operators.aggregates import distinct_text

    by_host = host_defense.groupBy("host_genome_id").agg(F.count("*").alias("host_defense_system_count"))
    by_phage = antidefense.groupBy("phage_genome_id").agg(F.count("*").alias("phage_antidefense_count"))
    targets = antidefense.filter(present("target_defense_system")).select(
        "phage_genome_id", F.col("target_defense_system").alias("target")
    ).distinct()
    names = (
        host_defense.select("host_genome_id", F.explode(F.array("defense_type", "defense_system")).alias("target"))
        .filter(present("target"))
        .distinct()
    )
    pairs = links.select("phage_genome_id", "host_genome_id").distinct()
    matched = pairs.join(targets, "phage_genome_id").join(names, ["host_genome_id", "target"])
    pair = ["phage_genome_id", "host_genome_id"]
    found = distinct_text(matched, pair, "target", "matched_counterdefense_targets", "matched_counterdefense_count")
    df = (
        links.join(by_host, "host_genome_id", "left")
        .join(distinct_text(host_defense, ["host_genome_id"], "defense_type", "host_defense_types"), "host_genome_id", "left")
        .join(distinct_text(host_defense, ["host_genome_id"], "defense_system", "host_defense_systems"), "host_genome_id", "left")
        .join(by_phage, "phage_genome_id", "left")
        .join(distinct_text(antidefense, ["phage_genome_id"], "antidefense_class", "phage_antidefense_classes"), "phage_genome_id", "left")
        .join(distinct_text(antidefense, ["phage_genome_id"], "target_defense_system", "phage_antidefense_targets"), "phage_genome_id", "left")
        .join(found, pair, "left")
    )
    for c in ("host_defense_system_count", "phage_antidefense_count", "matched_counterdefense_count"):
        df = df.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    for c in ("host_defense_types", "host_defense_systems", "phage_antidefense_classes", "phage_antidefense_targets",
              "matched_counterdefense_targets"):
        df = df.withColumn(c, F.coalesce(c, F.lit("")))
    receptor = present("K_type") | present("O_type")
    defense, counter = F.col("host_defense_system_count") > 0, F.col("phage_antidefense_count") > 0
    return (
        df.withColumn("receptor_metadata_available", receptor)
        .withColumn("defense_metadata_available", defense)
        .withColumn("counterdefense_metadata_available", counter)
        .withColumn(
            "compatibility_feature_status",
            F.when(defense & counter & receptor, "receptor_defense_counterdefense_features_available")
            .when(defense & counter, "defense_counterdefense_features_available_no_receptor_metadata")
            .when(defense, "host_defense_only")
            .when(counter, "phage_counterdefense_only")
            .otherwise("no_defense_counterdefense_features"),
        )
    )


def ids_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct ids of the first column of ``a`` that ``b`` lacks."""
    left = a.select(F.col(a.columns[0]).alias("id")).distinct()
    return left.join(b.select(F.col(b.columns[0]).alias("id")), "id", "left_anti")


def ids_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(F.col(a.columns[0]).alias("id")).distinct()
    return left.join(b.select(F.col(b.columns[0]).alias("id")), "id", "left_semi")


def key_universe(*tables: DataFrame) -> DataFrame:
    """Distinct ids over the first columns of all tables."""
    out = None
    for t in tables:
        part = t.select(F.col(t.columns[0]).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out.filter(as_col("id").isNotNull()).distinct()

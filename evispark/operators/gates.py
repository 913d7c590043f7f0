"""Table-level gates: filters with reasons, export checks and preflights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions.missing import is_missing, present, text
from evispark.functions.numbers import is_integer_text, number_in
from evispark.functions.text import note_value
from evispark.operators.joins import last_rows

# Words a phage record is recognised by.
PHAGE_TERMS = ("phage", "bacteriophage", "virus", "caudoviricetes", "uroviricota")


def row_text(columns: Sequence[str]) -> Column:
    """All present values of a row in lower case, separated by a space."""
    return F.concat_ws(" ", *[F.nullif(F.lower(F.col(c).cast("string")), F.lit("")) for c in columns])


def filter_with_reason(
    df: DataFrame,
    columns: Sequence[str],
    require_term: str | None = None,
    any_terms: Sequence[str] = (),
    include_regex: str | None = None,
    exclude_regex: str | None = None,
    review_statuses: Sequence[str] = (),
    notes: str = "notes",
) -> DataFrame:
    """Add ``filter_reason``: ``included`` or the first filter a row fails."""
    words = row_text(columns)
    chain = F.when(F.lit(False), "")
    if require_term:
        chain = chain.when(~words.contains(require_term), "skipped_required_term")
    if any_terms:
        hit = F.lit(False)
        for t in any_terms:
            hit = hit | words.contains(t)
        chain = chain.when(~hit, "skipped_keyword")
    if include_regex:
        chain = chain.when(~words.rlike("(?i)" + include_regex), "skipped_include_regex")
    if exclude_regex:
        chain = chain.when(words.rlike("(?i)" + exclude_regex), "skipped_exclude_regex")
    if review_statuses:
        stated = F.lower(note_value(notes, "review_status"))
        chain = chain.when(~stated.isin(*[s.lower() for s in review_statuses]), "skipped_review_status")
    return df.withColumn("filter_reason", chain.otherwise("included"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("filter_reason").agg(F.count("*").alias("rows"))


def eligible(
    manifest: DataFrame, qc: DataFrame | None, types: Sequence[str], exclude_failed_qc: bool = True, key: str = "genome_id"
) -> DataFrame:
    """Rows of the right type that passed validation; no sequence is not a failed one."""
    df = manifest.filter(
        F.col("record_type").isin(*types) & text("validation_status").isin("", "pass") & present(key)
    )
    if qc is None:
        return df.withColumn("sequence_qc_status", F.lit("not_provided")).withColumn("passes_sequence_qc", F.lit(None).cast("boolean"))
    df = df.join(last_rows(qc, key, ["sequence_qc_status", "passes_sequence_qc"]), key, "left")
    df = df.withColumn("sequence_qc_status", F.coalesce("sequence_qc_status", F.lit("not_provided")))
    if exclude_failed_qc:
        failed = ~F.col("sequence_qc_status").isin("", "no_sequence_provided", "not_provided") & ~F.coalesce(
            "passes_sequence_qc", F.lit(False)
        )
        df = df.filter(~failed)
    return df


def _any_present(columns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | present(F.col(c).cast("string"))
    return hit


def format_issues(df: DataFrame, row_number: str, lifestyles: Sequence[str] = ()) -> DataFrame:
    """One row per malformed year, length, GC or lifestyle value."""

    def shown(name: str) -> Column:
        return text(F.col(name).cast("string"))

    checks = []
    if "year" in df.columns:
        ok = is_integer_text(shown("year")) & shown("year").try_cast("bigint").between(1800, 2100)
        checks.append(("year", ok))
    if "genome_length" in df.columns:
        ok = is_integer_text(shown("genome_length")) & (shown("genome_length").try_cast("bigint") > 0)
        checks.append(("genome_length", ok))
    if "gc_percent" in df.columns:
        checks.append(("gc_percent", number_in(shown("gc_percent")).between(0, 100)))
    if "phage_lifestyle" in df.columns and lifestyles:
        checks.append(("phage_lifestyle", F.lower(shown("phage_lifestyle")).isin(*lifestyles)))
    found = [
        F.when(
            present(F.col(name).cast("string")) & ~F.coalesce(ok, F.lit(False)),
            F.struct(F.lit(name).alias("field"), shown(name).alias("value")),
        )
        for name, ok in checks
    ]
    found.append(F.lit(None).cast("struct<field:string,value:string>"))
    return df.select(F.col(row_number).alias("row_number"), F.explode(F.array_compact(F.array(*found))).alias("x")).select(
        "row_number", "x.field", "x.value"
    )


def duplicate_identities(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identity values that occur more than once, per column; all columns share one shuffle."""
    values = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), text(F.col(c).cast("string")).alias("value")) for c in identity])
        ).alias("x")
    ).select("x.field", "x.value")
    return values.filter(present("value")).groupBy("field", "value").agg(F.count("*").alias("copies")).filter("copies > 1")


def export_gate(
    df: DataFrame,
    expected: Sequence[str],
    identity: Sequence[str],
    row_number: str,
    lifestyles: Sequence[str] = (),
    cap: int = 50,
) -> DataFrame:
    """One row that says whether an export may be imported; the first failing check decides.

    Counts cover every row. Only the shown examples stop at ``cap``, in order.
    """
    missing = [c for c in expected if c not in df.columns]
    usable = [c for c in identity if c in df.columns]
    counts = df.agg(
        F.count("*").alias("n"),
        (F.count_if(~_any_present(usable)) if usable else F.lit(0)).cast("bigint").alias("no_id"),
        (F.count_if(is_missing("notes")) if "notes" in df.columns else F.lit(0)).cast("bigint").alias("notes"),
    )
    issues = format_issues(df, row_number, lifestyles)
    repeated = duplicate_identities(df, usable) if usable else None

    def examples(rows: DataFrame, label: Column, order: Sequence[str]) -> DataFrame:
        first = rows.orderBy(*order).limit(cap).select(F.struct(*order, label.alias("t")).alias("x"))
        return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ";").alias("text"))

    def long(df_: DataFrame, names: Mapping[str, str]) -> DataFrame:
        return df_.select(
            F.explode(
                F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).cast("string").alias("v")) for k, v in names.items()])
            ).alias("x")
        ).select("x.k", "x.v")

    parts = [
        long(counts, {"export_row_count": "n", "rows_missing_all_identity": "no_id", "provenance_warning_count": "notes"}),
        long(issues.agg(F.count("*").alias("c")), {"row_format_issue_count": "c"}),
        long(
            examples(
                issues,
                F.concat(F.lit("row"), F.col("row_number").cast("string"), F.lit(":"), F.col("field"), F.lit(":"), F.col("value")),
                ["row_number", "field"],
            ),
            {"row_format_issues": "text"},
        ),
    ]
    if repeated is not None:
        parts.append(long(repeated.agg(F.count("*").alias("c")), {"duplicate_identity_count": "c"}))
        parts.append(
            long(examples(repeated, F.concat_ws(":", "field", "value"), ["field", "value"]), {"duplicate_identity_values": "text"})
        )
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)

    def number(k: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))).cast("bigint"), F.lit(0)).alias(k)

    def words(k: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit("")).alias(k)

    row = stacked.agg(
        number("export_row_count"),
        number("rows_missing_all_identity"),
        number("duplicate_identity_count"),
        words("duplicate_identity_values"),
        number("row_format_issue_count"),
        words("row_format_issues"),
        number("provenance_warning_count"),
    )
    status = (
        F.when(F.col("export_row_count") == 0, "export_empty")
        .when(F.lit(bool(missing)), "export_missing_expected_columns")
        .when(F.lit(not usable), "export_missing_identity_columns")
        .when(F.col("rows_missing_all_identity") > 0, "export_rows_missing_identity")
        .when(F.col("duplicate_identity_count") > 0, "export_duplicate_identity")
        .when(F.col("row_format_issue_count") > 0, "export_row_format_invalid")
        .otherwise("export_ready")
    )
    return (
        row.withColumn("missing_expected_columns", F.lit(";".join(missing)))
        .withColumn("identity_columns_present", F.lit(";".join(usable)))
        .withColumn("validation_status", status)
        .withColumn("blocking_issue", ~F.col("validation_status").isin("export_empty", "export_ready"))
    )


def satisfies(any_of: Sequence[Sequence[str]] = (), all_of: Sequence[str] = ()) -> Column:
    """At least one present field of every group, and all of the specific fields."""
    ok = F.lit(True)
    for group in any_of:
        ok = ok & _any_present(group)
    for c in all_of:
        ok = ok & present(F.col(c).cast("string"))
    return ok


def rows_satisfying(df: DataFrame, metrics: Mapping[str, tuple[Sequence[Sequence[str]], Sequence[str]]]) -> DataFrame:
    """Per metric: fields the table lacks, rows that satisfy it, and a status.

    A metric is (groups with any field, fields that must all be there). All metrics are counted in one pass.
    """
    spark = df.sparkSession
    lacking: dict[str, str] = {}
    conditions: dict[str, Column] = {}
    for name, (groups, fields) in metrics.items():
        have = [[c for c in g if c in df.columns] for g in groups]
        gone = ["any:" + ";".join(g) for g, h in zip(groups, have) if not h] + [c for c in fields if c not in df.columns]
        lacking[name] = ";".join(gone)
        conditions[name] = F.lit(False) if gone else satisfies(have, fields)
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    rows = counts.select(
        "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("satisfying_rows")) for n in metrics])).alias("x")
    ).select("x.metric", F.col("_n").alias("export_row_count"), "x.satisfying_rows")
    gone = spark.createDataFrame(list(lacking.items()), "metric string, missing_fields string")
    return rows.join(gone, "metric").withColumn(
        "preflight_status",
        F.when(F.col("missing_fields") != "", "missing_metric_fields")
        .when(F.col("export_row_count") == 0, "empty_export")
        .when(F.col("satisfying_rows") == 0, "no_metric_supporting_rows")
        .otherwise("metric_support_ready"),
    )


def preflight(
    df: DataFrame, identity: Sequence[str], content: Sequence[str], row_number: str, locator: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Blocking and warning issues per row, and one row with the overall status.

    Rows need an identity value that no earlier row has; a sequence locator and the content
    columns are recommended.
    """
    from evispark.operators.windows import with_first

    spark = df.sparkSession
    usable = [c for c in identity if c in df.columns]
    header = [("blocking", "missing_identity_headers", c) for c in identity if c not in df.columns]
    header += [("warning", "missing_content_headers", c) for c in content if c not in df.columns]

    def found(failed: Column, severity: str, code: str, field: str) -> Column:
        return F.when(
            failed, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field"))
        )

    checks = [F.lit(None).cast("struct<severity:string,code:string,field:string>")]
    if usable:
        checks.append(found(~_any_present(usable), "blocking", "row_missing_identity", ";".join(usable)))
    if locator and all(c in df.columns for c in locator):
        checks.append(found(~_any_present(locator), "warning", "row_missing_sequence_locator", ";".join(locator)))
    for c in content:
        if c in df.columns:
            checks.append(found(is_missing(F.col(c).cast("string")), "warning", "row_missing_recommended_metadata", c))
    rows = df.select(F.col(row_number).alias("row_number"), F.explode(F.array_compact(F.array(*checks))).alias("i")).select(
        "row_number", "i.severity", "i.code", "i.field"
    )
    if usable:
        values = df.select(
            F.col(row_number).alias("row_number"),
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("field"), text(F.col(c).cast("string")).alias("value")) for c in usable])
            ).alias("x"),
        ).select("row_number", "x.field", "x.value").filter(present("value"))
        again = with_first(values, ["field", "value"], "row_number", "first").filter("row_number > first")
        rows = rows.unionByName(
            again.select(
                "row_number", F.lit("blocking").alias("severity"), F.lit("duplicate_identity_value").alias("code"), "field"
            )
        )
    top = spark.createDataFrame(header, "severity string, code string, field string").withColumn(
        "row_number", F.lit(None).cast(df.schema[row_number].dataType)
    )
    issues = rows.unionByName(top)
    sizes = df.agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("w"))
    severities = issues.agg(
        F.lit(0).cast("bigint").alias("n"),
        F.count_if(F.col("severity") == "blocking").alias("b"),
        F.count_if(F.col("severity") == "warning").alias("w"),
    )
    summary = sizes.unionByName(severities).agg(
        F.sum("n").alias("export_row_count"), F.sum("b").alias("blocking_issue_count"), F.sum("w").alias("warning_count")
    )
    summary = summary.withColumn(
        "blocking_issue_count", F.col("blocking_issue_count") + F.when(F.col("export_row_count") == 0, 1).otherwise(0)
    ).withColumn(
        "preflight_status",
        F.when(F.col("blocking_issue_count") > 0, "blocking_issues")
        .when(F.col("warning_count") > 0, "ready_with_warnings")
        .otherwise("preflight_ready"),
    )
    return issues, summary


def intake_lint(df: DataFrame, sources: Sequence[str], notes: str = "notes", path: str | None = None,
                files: DataFrame | None = None) -> DataFrame:
    """Rows with provenance, notes and an existing file, and the lint that follows, as one row."""
    have = [c for c in sources if c in df.columns]
    source_count = F.count_if(_any_present(have)) if have else F.lit(0).cast("bigint")
    notes_count = F.count_if(present(notes)) if notes in df.columns else F.lit(0).cast("bigint")
    aggregates = [F.count("*").alias("rows"), source_count.alias("rows_with_source"), notes_count.alias("rows_with_notes")]
    checked = df
    if path is not None and files is not None:
        known = files.select(F.col("path").alias("_path")).distinct()
        checked = df.join(known, df[path] == known["_path"], "left")
        aggregates.append(F.count("_path").alias("rows_with_existing_file"))
    lint = F.array_compact(
        F.array(
            F.lit(None if have else "missing_evidence_source_or_tool_column").cast("string"),
            F.lit(None if notes in df.columns else "missing_notes_column").cast("string"),
            F.when(F.col("rows_with_source") == 0, "no_rows_with_evidence_source_or_tool"),
            F.when(F.col("rows_with_notes") == 0, "no_rows_with_notes"),
        )
    )
    row = checked.agg(*aggregates)
    return row.withColumn(
        "lint", F.when((F.col("rows") == 0) | (F.size(lint) == 0), "NA").otherwise(F.array_join(lint, ";"))
    )

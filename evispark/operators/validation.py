"""Row rules that give a status, a message and issue rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import MISSING, as_col, is_missing, present, strip, text
from evispark.functions.numbers import is_integer_text, number_in, to_double
from evispark.functions.sequences import base_composition, percent
from evispark.functions.text import fold_vocab
from evispark.operators.scan import dealt, range_count


@dataclass(frozen=True)
class Rule:
    """A row fails when ``failed`` is true; ``message`` may use the row."""

    severity: str
    field: str
    message: Column | str
    failed: Column


def _message(message: Column | str) -> Column:
    return message if isinstance(message, Column) else F.lit(message)


def required(name: str, severity: str = "error", sentinels: Sequence[str] = MISSING) -> Rule:
    return Rule(severity, name, f"{name} is required", is_missing(name, sentinels))


def unique(name: str, severity: str = "error") -> Rule:
    """Needs the ``_copies`` column of ``with_copies``."""
    return Rule(severity, name, f"{name} must be unique", present(name, MISSING) & (F.col("_copies") > 1))


def one_of(name: str, values: Sequence[str], severity: str = "error", message: str | None = None) -> Rule:
    said = message or f"{name} must be one of " + ", ".join(sorted(values))
    return Rule(severity, name, said, ~text(name).isin(*values))


def positive_int(name: str, severity: str = "error") -> Rule:
    ok = is_integer_text(name) & (strip(name).try_cast("bigint") > 0)
    return Rule(severity, name, f"{name} must be a positive integer", present(name, MISSING) & ~F.coalesce(ok, F.lit(False)))


def between(name: str, lo: float, hi: float, severity: str = "error") -> Rule:
    number = number_in(strip(as_col(name).cast("string")))
    ok = ~F.isnan(number) & (number >= lo) & (number <= hi)
    return Rule(
        severity, name, f"{name} must be between {lo:g} and {hi:g}", present(name, MISSING) & ~F.coalesce(ok, F.lit(False))
    )


def with_copies(df: DataFrame, keys: Sequence[str], out: str = "_copies") -> DataFrame:
    """Add the number of rows that share the key.

    Only repeated keys are joined back, so the counted side stays small and a key that
    holds a large part of the rows is one row of it.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias(out)).filter(F.col(out) > 1)
    safe = repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], out)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (df[k].eqNullSafe(safe[f"_k{i}"]))
    joined = df.join(safe, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return joined.withColumn(out, F.coalesce(out, F.lit(1)))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Present keys that occur more than once."""
    kept = df
    for k in keys:
        kept = kept.filter(present(F.col(k).cast("string")))
    return kept.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def _issue_array(rules: Sequence[Rule]) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(
                    r.failed,
                    F.struct(
                        F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"), _message(r.message).alias("message")
                    ),
                )
                for r in rules
            ]
        )
    )


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row, however often later steps name them.

    Spark copies the text of a plain column into every filter and column that reads it, and nested ones multiply. It does not
    look behind the row that an array of one struct gives.
    """
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", held).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def validate_rows(df: DataFrame, rules: Sequence[Rule], id_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add ``validation_status`` and ``validation_messages``; issues come as rows.

    A row is excluded when a rule of severity ``error`` fails.
    """
    marked = once(df, {"_issues": _issue_array(rules)})
    has_error = F.exists("_issues", lambda i: i["severity"] == "error")
    shown = F.transform("_issues", lambda i: F.concat_ws(":", i["severity"], i["field"], i["message"]))
    result = (
        marked.withColumn("validation_status", F.when(has_error, "exclude").otherwise("pass"))
        .withColumn(
            "validation_messages", F.when(F.size("_issues") == 0, "OK").otherwise(F.array_join(shown, "; "))
        )
        .drop("_issues", "_copies")
    )
    issues = issue_rows(marked, id_columns)
    return result, issues


def issue_rows(marked: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    return marked.filter(F.size("_issues") > 0).select(*id_columns, F.explode("_issues").alias("i")).select(
        *id_columns, "i.severity", "i.field", "i.message"
    )


def split_status(df: DataFrame, status: str = "validation_status") -> tuple[DataFrame, DataFrame]:
    """Passing rows and excluded rows."""
    return df.filter(F.col(status) != "exclude"), df.filter(F.col(status) == "exclude")


# --- sequences -------------------------------------------------------------------------------------------------


def composition_by(seqs: DataFrame, key: str, sequence: str) -> DataFrame:
    """Per key: record count and summed base counts, partly summed before the shuffle."""
    counted = seqs.select(key, base_composition(sequence).alias("b"))
    return counted.groupBy(key).agg(
        F.count("*").alias("sequence_count"),
        F.sum("b.length").alias("total_length_bp"),
        F.sum("b.gc_count").alias("gc_count"),
        F.sum("b.acgt_count").alias("acgt_count"),
        F.sum("b.n_count").alias("n_count"),
        F.sum("b.ambiguous_count").alias("ambiguous_count"),
    )


def sequence_qc(manifest: DataFrame, composition: DataFrame, limits: Mapping[str, float] = R.QC_LIMITS,
                key: str = "genome_id", invalid: DataFrame | None = None) -> DataFrame:
    """Compare sequence statistics with limits and with the stated length and GC.

    ``manifest`` holds the key, ``record_type, raw_sequence_path, genome_length,
    gc_percent``; ``composition`` comes from ``composition_by``; ``invalid`` lists keys
    whose text could not be read as sequences.
    """
    df = manifest.join(composition, key, "left")
    if invalid is not None:
        df = df.join(invalid.select(key).distinct().withColumn("_invalid", F.lit(True)), key, "left")
    else:
        df = df.withColumn("_invalid", F.lit(False))
    total = F.col("total_length_bp")
    gc = percent(F.col("gc_count"), F.col("acgt_count"))
    n_pct = percent(F.col("n_count"), total)
    ambiguous_pct = percent(F.col("ambiguous_count"), total)
    said_length = to_double(F.col("genome_length").cast("string")).cast("bigint")
    said_gc = to_double(F.col("gc_percent").cast("string"))
    highest = F.when(F.col("record_type") == "host", limits["max_host_genome_length_bp"]).otherwise(
        limits["max_genome_length_bp"]
    )
    length_delta = total - said_length
    gc_delta = gc - said_gc
    length_ok = F.abs(length_delta) <= limits["metadata_length_tolerance_bp"]
    gc_ok = F.abs(gc_delta) <= limits["metadata_gc_tolerance_percent"]
    checks = [
        ((F.col("sequence_count") == 0) | (total == 0), F.lit("no sequences found in FASTA")),
        (total < limits["min_genome_length_bp"], F.lit(f"length below minimum {int(limits['min_genome_length_bp'])}")),
        (total > highest, F.concat(F.lit("length above maximum "), highest.cast("bigint").cast("string"))),
        (gc < limits["min_gc_percent"], F.lit(f"GC below minimum {limits['min_gc_percent']:g}")),
        (gc > limits["max_gc_percent"], F.lit(f"GC above maximum {limits['max_gc_percent']:g}")),
        (n_pct > limits["max_n_percent"], F.lit(f"N percent above maximum {limits['max_n_percent']:g}")),
        (
            ambiguous_pct > limits["max_ambiguous_percent"],
            F.lit(f"ambiguous percent above maximum {limits['max_ambiguous_percent']:g}"),
        ),
        (~length_ok, F.lit("sequence length does not match metadata")),
        (~gc_ok, F.lit("sequence GC does not match metadata")),
    ]
    messages = F.array_compact(F.array(*[F.when(failed, said) for failed, said in checks]))
    status = (
        F.when(is_missing("raw_sequence_path"), "no_sequence_provided")
        .when(F.col("_invalid"), "invalid_fasta")
        .when(F.col("sequence_count").isNull(), "missing_sequence_file")
        .when(F.size(messages) == 0, "pass")
        .otherwise("warn")
    )
    return (
        df.withColumn("gc_percent_observed", gc)
        .withColumn("n_percent", n_pct)
        .withColumn("ambiguous_percent", ambiguous_pct)
        .withColumn("length_delta_bp", length_delta)
        .withColumn("gc_delta_percent", gc_delta)
        .withColumn("length_matches_metadata", length_ok)
        .withColumn("gc_matches_metadata", gc_ok)
        .withColumn("sequence_qc_status", status)
        .withColumn("passes_sequence_qc", F.col("sequence_qc_status") == "pass")
        .withColumn(
            "sequence_qc_messages",
            F.when(F.col("sequence_qc_status") == "no_sequence_provided", "no raw_sequence_path provided")
            .when(F.col("sequence_qc_status") == "missing_sequence_file", "raw_sequence_path does not exist")
            .when(F.col("sequence_qc_status") == "invalid_fasta", "sequence line found before header")
            .when(F.size(messages) == 0, "OK")
            .otherwise(F.array_join(messages, "; ")),
        )
        .drop("_invalid")
    )


# --- assays and relationships ----------------------------------------------------------------------------------


def _joined_missing(columns: Sequence[str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(is_missing(c), F.lit(c)) for c in columns])), ";")


def _number(name: str) -> Column:
    """A plain number, null for text and for missing values; NaN never passes a bound."""
    return F.when(present(name), number_in(strip(name)))


def with_known(df: DataFrame, column: str, known: DataFrame | None, out: str) -> DataFrame:
    """Mark whether the id is in the reference table; without one, no id is known."""
    if known is None:
        return df.withColumn(out, F.lit(False))
    ids = known.select(F.col(known.columns[0]).alias("_id")).distinct().withColumn(out, F.lit(True))
    return (
        df.join(ids, strip(df[column]) == ids["_id"], "left").drop("_id").withColumn(out, F.coalesce(out, F.lit(False)))
    )


def with_previous(df: DataFrame, keys: Sequence[Column], order: str, out: str) -> DataFrame:
    """Number of the previous row with the same key, null for the first and for keys with a blank part."""
    from evispark.operators.windows import previous_value

    full = F.lit(True)
    for k in keys:
        full = full & (k != "")
    key = F.when(full, F.concat_ws("\x1f", *keys))
    return previous_value(df.withColumn("_key", key), "_key", order, order, out).drop("_key")


def _assay_rules(tested: Column, results: Mapping[str, Column]) -> list[tuple[str, str, Column, Column]]:
    assay_type, outcome = F.lower(text("assay_type")), F.lower(text("outcome_tier"))
    evidence = F.lower(text("evidence_tier"))
    eop, moi, temperature = _number("eop"), _number("moi"), _number("temperature_c")
    replicates = F.when(is_integer_text("replicate_count"), strip("replicate_count").try_cast("bigint"))
    lacking = _joined_missing(R.ASSAY_REQUIRED)

    def bad_number(name: str, value: Column) -> Column:
        return present(name) & (value.isNull() | F.coalesce(value < 0, F.lit(False)))

    def said(prefix: str, name: str) -> Column:
        return F.concat(F.lit(prefix), text(name))

    rules = [
        ("required_populated_fields", "error", lacking != "", F.concat(F.lit("missing required fields: "), lacking)),
        ("phage_id_resolves", "error", (text("phage_id") != "") & ~F.col("_phage_known"), said("Unknown phage_id: ", "phage_id")),
        ("host_id_resolves", "error", (text("host_id") != "") & ~F.col("_host_known"), said("Unknown host_id: ", "host_id")),
        ("tested_boolean", "error", present("tested") & tested.isNull(), said("Invalid tested value: ", "tested")),
        ("assay_type_controlled", "error", (assay_type != "") & ~assay_type.isin(*R.ASSAY_TYPES), said("Invalid assay_type: ", "assay_type")),
        ("outcome_tier_controlled", "error", (outcome != "") & ~outcome.isin(*R.OUTCOME_TIERS), said("Invalid outcome_tier: ", "outcome_tier")),
        ("evidence_tier_controlled", "error", (evidence != "") & ~evidence.isin(*R.EVIDENCE_TIERS), said("Invalid evidence_tier: ", "evidence_tier")),
    ]
    for name, result in results.items():
        rules += [
            (f"{name}_controlled", "error", result == "__invalid__", said(f"Invalid {name}: ", name)),
            (
                "untested_result_contradiction",
                "error",
                result.isin("positive", "negative") & F.coalesce(~tested, F.lit(False)),
                F.concat(F.lit(f"{name}="), result, F.lit(" cannot be recorded when tested=false")),
            ),
            (
                "negative_requires_tested_true",
                "error",
                (result == "negative") & ~F.coalesce(tested, F.lit(False)),
                F.lit(f"{name}=negative requires tested=true"),
            ),
        ]
    supported = (
        (results["plaque_result"] == "positive")
        | F.coalesce((eop > 0) & ~F.isnan(eop), F.lit(False))
        | (assay_type == "productive_infection")
        | (outcome == "productive_infection_confirmed")
    )
    rules += [
        (
            "untested_not_negative",
            "error",
            F.coalesce(~tested, F.lit(False)) & (outcome == "tested_negative"),
            F.lit("tested=false cannot be paired with outcome_tier=tested_negative"),
        ),
        ("eop_nonnegative", "error", bad_number("eop", eop), said("EOP must be numeric and non-negative: ", "eop")),
        (
            "eop_reference_host",
            "warning",
            eop.isNotNull() & is_missing("eop_reference_host"),
            F.lit("EOP is populated but eop_reference_host is missing"),
        ),
        ("moi_nonnegative", "error", bad_number("moi", moi), said("MOI must be numeric and non-negative: ", "moi")),
        (
            "temperature_numeric",
            "error",
            present("temperature_c") & temperature.isNull(),
            said("temperature_c must be numeric: ", "temperature_c"),
        ),
        (
            "replicate_count_positive",
            "error",
            present("replicate_count") & ~F.coalesce(replicates > 0, F.lit(False)),
            said("replicate_count must be a positive integer: ", "replicate_count"),
        ),
        (
            "productive_infection_not_spot_only",
            "error",
            (results["productive_infection_result"] == "positive") & ~supported,
            F.lit("productive infection needs plaque, EOP or direct evidence"),
        ),
    ]
    return rules


def _check_issues(df: DataFrame, scope: str, id_column: str, order: str,
                  rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    structs = [
        F.when(
            failed,
            F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), said.alias("message")),
        )
        for check, severity, failed, said in rules
    ]
    entity = F.coalesce(F.nullif(text(id_column), F.lit("")), F.concat(F.lit("row"), F.col(order).cast("string")))
    held = once(df, {"_issues": F.array_compact(F.array(*structs))})  # exploded as it is, the array would be worked out again to test its size
    return (
        held.select(
            F.lit(scope).alias("scope"),
            F.col(order).alias("row_number"),
            entity.alias("entity_id"),
            F.explode("_issues").alias("i"),
        )
        .select("scope", "row_number", "entity_id", "i.check_id", "i.severity", "i.message")
        .withColumn("status", F.when(F.col("severity") == "error", "fail").otherwise("warn"))
        .withColumn("blocking_issue", F.col("severity") == "error")
    )


def _repeat_issues(df: DataFrame, scope: str, id_column: str, order: str, keys: Sequence[Column], check: str, said: str) -> DataFrame:
    """Issues of rows whose key an earlier row has. Only the key, the number and the id of a row are sorted."""
    from evispark.operators.windows import previous_value

    whole = F.lit(True)
    for k in keys:
        whole = whole & (k != "")
    keyed = df.filter(whole).select(order, id_column, F.concat_ws("\x1f", *keys).alias("_key"))
    placed = previous_value(keyed, "_key", order, order, "_previous")
    message = F.concat(F.lit(said), F.col("_previous").cast("string"))
    return _check_issues(placed, scope, id_column, order, [(check, "error", F.col("_previous").isNotNull(), message)])


def has_content(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    kept = [c for c in df.columns if c not in skip and not c.startswith("_")]
    hit = F.lit(False)
    for c in kept:
        hit = hit | present(F.col(c).cast("string"))
    return hit


def validate_assays(assays: DataFrame, phages: DataFrame | None, hosts: DataFrame | None, order: str = "row_number") -> DataFrame:
    """Issue rows for an assay table: vocabulary, numbers, ids, repeats and contradictions.

    ``order`` numbers the rows; the id tables hold the known ids in their first column.
    """
    df = assays.filter(has_content(assays, (order,)))
    record = [text("phage_id"), text("host_id"), text("study_id"), text("panel_id"), F.lower(text("assay_type"))]
    repeats = [
        _repeat_issues(df, "assay", "interaction_id", order, [text("interaction_id")], "duplicate_interaction_id", "interaction_id also appears on row "),
        _repeat_issues(df, "assay", "interaction_id", order, record, "duplicate_study_panel_assay", "same record also appears on row "),
    ]
    df = dealt(df, range_count(df), order)
    df = with_known(with_known(df, "phage_id", phages, "_phage_known"), "host_id", hosts, "_host_known")
    tested = fold_vocab("tested", R.BOOLEAN_WORDS, F.lit(None).cast("string")).try_cast("boolean")
    results = {
        name: F.when(is_missing(name), "")
        .when(F.lower(strip(name)).isin(*R.RESULT_VALUES), F.lower(strip(name)))
        .otherwise("__invalid__")
        for name in R.RESULT_COLUMNS
    }
    issues = _check_issues(df, "assay", "interaction_id", order, _assay_rules(tested, results))
    return issues.unionByName(repeats[0]).unionByName(repeats[1])


def validate_relationships(rows: DataFrame, phages: DataFrame | None, hosts: DataFrame | None, order: str = "row_number") -> DataFrame:
    """Issue rows for a relationship table."""
    df = rows.filter(has_content(rows, (order,)))
    df = with_previous(df, [text("relationship_id")], order, "_previous_id")
    kind, status = F.lower(text("relationship_type")), F.lower(text("relationship_status"))
    df = with_previous(df, [text("phage_id"), text("host_id"), kind, text("source_reference")], order, "_previous_key")
    df = with_known(with_known(df, "phage_id", phages, "_phage_known"), "host_id", hosts, "_host_known")
    confidence = _number("confidence")
    confident = F.lower(text("confidence")).isin(*R.CONFIDENCE_WORDS) | F.coalesce(
        (confidence >= 0) & (confidence <= 1), F.lit(False)
    )
    lacking = _joined_missing(R.RELATIONSHIP_REQUIRED)
    rules = [
        ("required_populated_fields", "error", lacking != "", F.concat(F.lit("missing required fields: "), lacking)),
        ("phage_id_resolves", "error", (text("phage_id") != "") & ~F.col("_phage_known"), F.concat(F.lit("Unknown phage_id: "), text("phage_id"))),
        ("host_id_resolves", "error", (text("host_id") != "") & ~F.col("_host_known"), F.concat(F.lit("Unknown host_id: "), text("host_id"))),
        ("relationship_type_controlled", "error", (kind != "") & ~kind.isin(*R.RELATIONSHIP_TYPES), F.concat(F.lit("Invalid relationship_type: "), text("relationship_type"))),
        ("relationship_status_controlled", "error", (status != "") & ~status.isin(*R.RELATIONSHIP_STATUSES), F.concat(F.lit("Invalid relationship_status: "), text("relationship_status"))),
        ("confidence_controlled", "error", present("confidence") & ~confident, F.concat(F.lit("Invalid confidence: "), text("confidence"))),
        ("duplicate_relationship_id", "error", F.col("_previous_id").isNotNull(), F.concat(F.lit("relationship_id also appears on row "), F.col("_previous_id").cast("string"))),
        ("duplicate_relationship_record", "error", F.col("_previous_key").isNotNull(), F.concat(F.lit("same record also appears on row "), F.col("_previous_key").cast("string"))),
    ]
    return _check_issues(df, "relationship", "relationship_id", order, rules)


def validate_imported(rows: DataFrame, order: str = "row_number") -> DataFrame:
    """Errors left in assay rows after normalisation; any of them blocks the write."""
    lacking = _joined_missing(R.ASSAY_REQUIRED)

    def value(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    rules = [
        ("required_fields", "error", lacking != "", F.concat(F.lit("missing required fields: "), lacking)),
        ("tested", "error", ~value("tested").isin("true", "false"), F.concat(F.lit("Invalid tested value: "), value("tested"))),
        ("assay_type", "error", ~value("assay_type").isin(*R.ASSAY_TYPES), F.concat(F.lit("Invalid assay_type: "), value("assay_type"))),
        ("outcome_tier", "error", ~value("outcome_tier").isin(*R.OUTCOME_TIERS), F.concat(F.lit("Invalid outcome_tier: "), value("outcome_tier"))),
        ("evidence_tier", "error", ~value("evidence_tier").isin(*R.EVIDENCE_TIERS), F.concat(F.lit("Invalid evidence_tier: "), value("evidence_tier"))),
    ]
    rules += [
        (c, "error", ~value(c).isin(*R.RESULT_VALUES), F.concat(F.lit("Invalid controlled result value: "), value(c)))
        for c in R.RESULT_COLUMNS
    ]
    return _check_issues(rows, "assay_import", "interaction_id", order, rules)


# --- evidence hits ---------------------------------------------------------------------------------------------


def validate_hits(hits: DataFrame, kind: str, key: str = "annotation_gene_id") -> tuple[DataFrame, DataFrame]:
    """Typed hits without errors, and one issue row per failed rule.

    ``domain`` checks positions and e-value, ``structural`` TM-score and probability.
    """
    from evispark.functions.numbers import strict_number

    rules = [Rule("error", key, f"{key} is required", is_missing(key))]
    if kind == "domain":
        numbers = {
            "start_aa": strict_number("start_aa", integer=True),
            "end_aa": strict_number("end_aa", integer=True),
            "evalue": strict_number("evalue", lo=0.0),
        }
        rules.append(Rule("error", "domain_id", "domain_id is required", is_missing("domain_id")))
    elif kind == "structural":
        numbers = {
            "tm_score": strict_number("tm_score", lo=0.0, hi=1.0),
            "probability": strict_number("probability", lo=0.0, hi=100.0, percent=True),
        }
        rules.append(Rule("error", "structural_hit_id", "structural_hit_id is required", is_missing("structural_hit_id")))
    else:
        raise ValueError(f"unknown kind of hits: {kind}")
    df = once(hits, {f"_{name}": parsed for name, parsed in numbers.items()})
    for name in numbers:
        problem = F.col(f"_{name}.problem")
        rules.append(
            Rule("error", name, F.concat(F.lit(f"{name}: "), F.coalesce(problem, F.lit("")), F.lit(": "), text(name)), problem.isNotNull())
        )
    if kind == "domain":
        ordered = F.coalesce(F.col("_start_aa.value") > F.col("_end_aa.value"), F.lit(False))
        rules.append(Rule("error", "start_aa", "start_aa is greater than end_aa", ordered))
    marked = once(df, {"_issues": _issue_array(rules)})
    good = marked.filter(F.size("_issues") == 0)
    for name in numbers:
        value = F.col(f"_{name}.value")
        good = good.withColumn(name, value.cast("bigint") if name in ("start_aa", "end_aa") else value)
    return good.drop("_issues", *[f"_{n}" for n in numbers]), issue_rows(marked, [key])

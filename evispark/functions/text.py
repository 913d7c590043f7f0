"""Identifiers, lists in text, notes and rule cascades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from evispark.functions.missing import MISSING_DASH, as_col, is_missing, null_if_missing, present, strip, text


def safe_slug(c: Column | str, fallback: str, n: int = 80) -> Column:
    value = F.lower(F.coalesce(null_if_missing(c), F.lit(fallback)))
    slug = F.trim(F.regexp_replace(value, "[^a-z0-9]+", "_"), F.lit("_"))
    cut = F.substring(slug, 1, n)
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def sanitize_id(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def joined_parts(*cols: Column | str, sep: str = "_") -> Column:
    """Concatenate the parts that are present."""
    return F.concat_ws(sep, *[null_if_missing(c) for c in cols])


def stable_id(record_type: Column | str, accession: Column | str, import_id: str, row_number: Column | str) -> Column:
    by_accession = F.concat_ws("_", text(record_type), strip(accession))
    by_row = F.concat_ws("_", text(record_type), F.lit(import_id), as_col(row_number).cast("string"))
    return sanitize_id(F.when(present(accession), by_accession).otherwise(by_row))


def normalize_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]+", "")


def normalize_header(name: str) -> str:
    """Fold one header name (driver side, header only)."""
    folded = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.strip().lower())
    return "_".join(folded.split())


def hash_id(*cols: Column | str, prefix: str, n: int = 12) -> Column:
    joined = F.lower(F.concat_ws("|", *[text(c) for c in cols]))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, n))


def multiset_fingerprint(arr: Column | str) -> Column:
    """SHA-256 over the sorted items, each ended by a newline; empty for no items."""
    arr = as_col(arr)
    return F.when(F.size(arr) == 0, F.lit("")).otherwise(
        F.sha2(F.concat(F.array_join(F.array_sort(arr), "\n"), F.lit("\n")), 256)
    )


def row_checksum(columns: Sequence[str], skip: str = "output_checksum") -> Column:
    """SHA-256 of the row as a JSON object with sorted keys and text values."""
    names = sorted(c for c in columns if c != skip)
    return F.sha2(F.to_json(F.struct(*[text(F.col(n).cast("string")).alias(n) for n in names])), 256)


def note_value(c: Column | str, key: str, style: str = "strict") -> Column:
    """The value of ``key=value`` inside a notes text, empty when absent.

    ``strict`` wants the key at the start or after ``;``; ``loose`` finds it anywhere, ends
    at ``,`` or ``;`` and drops closing dots; ``parts`` looks only at the
    ``;``-separated parts that start with the key.
    """
    quoted = "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in key)
    c = F.coalesce(as_col(c), F.lit(""))
    if style == "loose":
        return F.rtrim(strip(F.regexp_extract(c, quoted + "=([^,;]+)", 1)), F.lit("."))
    if style == "parts":
        part = F.filter(F.transform(F.split(c, ";"), strip), lambda p: p.startswith(key + "="))
        return F.coalesce(strip(F.substring(F.get(part, 0), len(key) + 2, 2**31 - 1)), F.lit(""))
    return strip(F.regexp_extract(c, r"(?:^|;\s*)" + quoted + "=([^;]+)", 1))


def split_values(c: Column | str, distinct: bool = True) -> Column:
    """Items of a ``;`` or ``,`` list: stripped, without blanks; sorted and distinct on request."""
    items = F.transform(F.split(F.translate(as_col(c), ",", ";"), ";"), strip)
    items = F.filter(items, lambda x: x != "")
    if distinct:
        items = F.array_sort(F.array_distinct(items))
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(items)


def joined(arr: Column | str, sep: str = ";") -> Column:
    kept = F.filter(as_col(arr), lambda x: ~is_missing(x))
    return F.array_join(F.array_sort(F.array_distinct(kept)), sep)


def prefix_filter(arr: Column | str, prefix: str) -> Column:
    return F.filter(as_col(arr), lambda x: F.lower(x).startswith(prefix.lower()))


def matches(c: Column | str, pattern: str) -> Column:
    """Case-insensitive search; null text counts as empty."""
    return F.coalesce(as_col(c), F.lit("")).rlike("(?i)" + pattern)


def classify(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | str | None) -> Column:
    """The label of the first pattern found in the text."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    chain = None
    for label, pattern in rules:
        hit = matches(c, pattern)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return fallback if chain is None else chain.otherwise(fallback)


def classify_pair(c: Column | str, rules: Sequence[tuple[str, str, str]]) -> Column:
    """As ``classify`` with two labels per pattern; both empty when nothing is found."""
    return F.struct(
        classify(c, [(a, p) for a, _, p in rules], "").alias("label"),
        classify(c, [(b, p) for _, b, p in rules], "").alias("target"),
    )


def classify_terms(c: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule with a term inside the lower-cased text."""
    lowered = F.lower(F.coalesce(as_col(c), F.lit("")))
    chain = None
    for label, terms in rules:
        hit = F.lit(False)
        for term in terms:
            hit = hit | lowered.contains(term)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(default))


def tag_all(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Labels of all patterns found, in rule order, each once."""
    hits = [F.when(matches(c, p), F.lit(label)) for label, p in rules]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def fold_vocab(c: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace known spellings; anything else stays as it is unless a default is given."""
    lowered = F.lower(strip(c))
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    known = F.element_at(F.create_map(*pairs), lowered)
    return F.coalesce(known, as_col(c) if default is None else default)


def parent_id(c: Column | str, composite: Column | str, sentinels: Sequence[str] = MISSING_DASH) -> Column:
    """The value, or the text before the first ``|`` of the composite id."""
    composite = as_col(composite)
    return F.coalesce(
        null_if_missing(c, sentinels),
        F.when(composite.contains("|"), F.substring_index(composite, "|", 1)),
        F.lit(""),
    )


def accession_list(c: Column | str) -> Column:
    parts = F.filter(F.split(text(c), r"[;,\s]+"), lambda p: ~p.isin(*MISSING_DASH))
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(parts)


def accession_kind(c: Column | str) -> Column:
    upper = F.upper(as_col(c))
    return (
        F.when(upper.rlike("^(GCA_|GCF_)"), "assembly")
        .when(upper.rlike("^(SAMN|SAME|SAMD|SAMR)"), "biosample")
        .when(upper.rlike("^(SRR|ERR|DRR)"), "reads")
        .otherwise("nuccore")
    )


def record_layer(source_id: Column | str, label: Column | str, record_type: Column | str) -> Column:
    kind = F.lower(text(record_type))
    words = F.lower(F.concat_ws(" ", text(source_id), text(label)))
    return (
        F.when((kind == "host") | words.contains("host"), "host_genomes")
        .when((kind == "prophage") | words.contains("prophage"), "prophages")
        .when((kind == "metagenomic_viral_contig") | words.contains("metagenomic"), "metagenomic_discovery")
        .when(words.contains("literature"), "literature_curated_phages")
        .otherwise("cultured_phages")
    )


def layer_record_type(layer: Column | str) -> Column:
    """The record type a layer is expected to hold."""
    layer = as_col(layer)
    return (
        F.when(layer.isin("cultured_phages", "literature_curated_phages"), "phage")
        .when(layer == "host_genomes", "host")
        .when(layer == "prophages", "prophage")
        .when(layer == "metagenomic_discovery", "metagenomic_viral_contig")
        .otherwise("NA")
    )


def cluster_key(
    family: Column | str, product: Column | str, sequence: Column | str, row_id: Column | str, uninformative: str
) -> Column:
    """Grouping key of a gene: family id, product slug, sequence hash, or itself."""
    by_product = present(product) & ~matches(product, uninformative)
    digest = F.substring(F.sha2(F.regexp_replace(as_col(sequence), r"\s+", ""), 256), 1, 16)
    key = (
        F.when(present(family), F.concat(F.lit("phrog:"), as_col(family)))
        .when(by_product, F.concat(F.lit("product:"), safe_slug(product, "product")))
        .when(present(sequence), F.concat(F.lit("protein_sha256:"), digest))
        .otherwise(F.concat(F.lit("singleton:"), as_col(row_id)))
    )
    source = (
        F.when(present(family), "phrog_id")
        .when(by_product, "product")
        .when(present(sequence), "protein_sequence_hash")
        .otherwise("singleton_missing_annotation")
    )
    return F.struct(key.alias("key"), source.alias("source"))

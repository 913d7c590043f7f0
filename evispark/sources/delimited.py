"""Delimited tables, record texts and schema checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evispark.functions.missing import strip, text
from evispark.functions.text import normalize_header
from evispark.sources.files import path_exists


def delimiter_for(path: str, delimiter: str = "auto") -> str:
    named = {"tab": "\t", "comma": ","}
    if delimiter in named:
        return named[delimiter]
    if delimiter and delimiter != "auto":
        return delimiter
    return "," if path.lower().endswith((".csv", ".csv.gz")) else "\t"


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = "auto", with_order: bool = False, multi_line: bool = False
) -> DataFrame:
    """All columns as stripped text; ``_order`` sorts the rows as they stand in the files.

    ``multi_line`` allows line breaks inside quotes at the price of unsplittable files.
    """
    raw = spark.read.csv(
        path, sep=delimiter_for(path, delimiter), header=True, inferSchema=False, quote='"', escape='"',
        multiLine=multi_line,
    )
    names = [c.lstrip("\ufeff").strip() for c in raw.columns]
    columns = [text(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns, names)]
    if with_order:
        columns.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("_order")
        )
    return raw.select(*columns)


def issue_table(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "severity string, item string, message string")


def read_optional(
    spark: SparkSession, path: str | None, columns: Sequence[str], item: str = "input", delimiter: str = "auto"
) -> tuple[DataFrame, DataFrame]:
    """The table, or an empty one with the declared columns; plus what was noticed."""
    empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    if not path:
        return empty, issue_table(spark, [("info", item, "no table supplied")])
    if not path_exists(spark, path):
        return empty, issue_table(spark, [("warning", item, f"table does not exist: {path}")])
    found = read_delimited(spark, path, delimiter)
    for name in columns:
        if name not in found.columns:
            found = found.withColumn(name, F.lit(""))
    return found, issue_table(spark, [])


def check_schema(df: DataFrame | None, all_of: Sequence[str] = (), any_of: Sequence[Sequence[str]] = (),
                 spark: SparkSession | None = None) -> DataFrame:
    """One row: ``pass``, ``fail`` or ``not_checked`` and the columns that are missing."""
    spark = spark or df.sparkSession
    if df is None:
        status, missing = "not_checked", []
    else:
        missing = [c for c in all_of if c not in df.columns]
        missing += ["any_of:" + "|".join(g) for g in any_of if not any(c in df.columns for c in g)]
        status = "fail" if missing else "pass"
    return spark.range(1).select(F.lit(status).alias("schema_status"), F.lit(";".join(missing)).alias("missing_columns"))


def resolve_headers(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], column_map: Mapping[str, str] | None = None
) -> DataFrame:
    """Rename to canonical columns: an explicit map first, else the first alias that exists."""
    by_folded = {normalize_header(c): c for c in df.columns}
    found: dict[str, str] = {}
    for target, source in (column_map or {}).items():
        if target not in aliases:
            raise ValueError(f"unsupported column_map target: {target}")
        if normalize_header(source) not in by_folded:
            raise ValueError(f"column_map source column does not exist: {source}")
        found[target] = by_folded[normalize_header(source)]
    for target, names in aliases.items():
        hit = next((by_folded[normalize_header(n)] for n in names if normalize_header(n) in by_folded), None)
        if target not in found and hit:
            found[target] = hit
    kept = [c for c in df.columns if c.startswith("_")]
    return df.select(*kept, *[F.col(f"`{found[t]}`").alias(t) for t in aliases if t in found])


def read_records(
    spark: SparkSession, path: str, fields: Sequence[str], known_headers: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows of texts with or without a header, tab- or space-separated; ``#`` lines are skipped.

    ``path`` may hold many files. The first line of a file is its header if it has one of ``known_headers``; each file's rows
    are named by its own header, or by ``fields`` if it has none. The header is left out by its place, so a data row of the same
    content stays. Returns the records, with the columns of all files (null where a file has no such column), and the
    lines with a wrong number of fields.
    """
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = (
        spark.read.text(path)
        .select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("_file"), order.alias("_order"))
        .filter((strip("value") != "") & ~F.col("value").startswith("#"))
    )
    parts = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(
        F.split(strip("value"), r"\s+")
    )
    lines = lines.withColumn("_parts", F.transform(parts, strip))
    # The head of a file is a minimum, found file by file before anything is moved.
    heads = lines.groupBy("_file").agg(F.min_by("_parts", "_order").alias("_head"), F.min("_order").alias("_first"))
    known = F.array(*[F.lit(h.lower()) for h in known_headers]) if known_headers else F.array().cast("array<string>")
    named = F.arrays_overlap(F.transform("_head", F.lower), known)
    heads = heads.select(
        "_file", F.when(named, F.col("_head")).otherwise(F.array(*[F.lit(f) for f in fields])).alias("_names"), F.when(named, F.col("_first")).alias("_header")
    )
    layouts = [r["_names"] for r in heads.groupBy("_names").agg(F.min("_file").alias("_at")).orderBy("_at").collect()]
    names = list(dict.fromkeys(n for layout in layouts for n in layout)) or list(fields)
    rows = lines.join(heads, "_file").filter(~F.coalesce(F.col("_order") == F.col("_header"), F.lit(False)))
    good = F.size("_parts") == F.size("_names")

    def value(name: str) -> Column:
        place = F.array_position("_names", name)
        return F.when(place > 0, F.get("_parts", (place - 1).cast("int"))).alias(name)

    records = rows.filter(good).select("_order", *[value(n) for n in names])
    issues = rows.filter(~good).select(
        F.lit("error").alias("severity"),
        F.lit("record").alias("item"),
        F.format_string("expected %d fields, observed %d", F.size("_names"), F.size("_parts")).alias("message"),
        F.col("value").alias("line"),
    )
    return records, issues


def read_domtblout(spark: SparkSession, path: str, mode: str = "hmmsearch") -> tuple[DataFrame, DataFrame]:
    """Profile hits: 22 space-separated fields and a free text per line.

    In ``hmmsearch`` the protein is the target, in ``hmmscan`` the query. Returns hits
    and malformed lines.
    """
    if mode not in ("hmmsearch", "hmmscan"):
        raise ValueError(f"unsupported mode: {mode}")
    lines = (
        spark.read.text(path)
        .select(strip("value").alias("value"))
        .filter((F.col("value") != "") & ~F.col("value").startswith("#"))
        .withColumn("p", F.split("value", r"\s+", 23))
    )

    def field(i: int) -> F.Column:
        return F.get("p", i)

    def accession_or(accession: int, name: int) -> F.Column:
        return F.when(field(accession).isin("", "-", "NA", "N/A", "na", "n/a", "None", "none"), field(name)).otherwise(
            field(accession)
        )

    if mode == "hmmsearch":
        gene, domain, label = field(0), accession_or(4, 3), field(3)
    else:
        gene, domain = field(3), accession_or(1, 0)
        label = F.coalesce(F.nullif(strip(field(22)), F.lit("")), field(0))
    good = F.size("p") >= 22
    hits = lines.filter(good).select(
        gene.alias("annotation_gene_id"),
        domain.alias("domain_id"),
        F.coalesce(F.nullif(label, F.lit("")), domain).alias("domain_name"),
        field(17).alias("start_aa"),
        field(18).alias("end_aa"),
        field(12).alias("evalue"),
    )
    issues = lines.filter(~good).select(
        F.lit("error").alias("severity"),
        F.lit("domtblout").alias("item"),
        F.format_string("expected at least 22 columns, observed %d", F.size("p")).alias("message"),
        F.col("value").alias("line"),
    )
    return hits, issues


def read_json_map(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """JSON objects of id -> list of texts, as (id, item_no, item) rows.

    A file holds one object, or with ``per_line`` one object per line, which can be split.
    """
    whole = spark.read.text(path, wholetext=not per_line)
    return (
        whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("id", "items"))
        .select(strip("id").alias("id"), F.posexplode("items").alias("item_no", "item"))
        .withColumn("item", strip("item"))
        .filter(~F.col("item").isin("", "NA", "N/A", "na", "n/a", "None", "none", "-"))
    )

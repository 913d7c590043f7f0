"""FASTA and GenBank flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from evispark.functions.missing import is_missing, strip
from evispark.functions.rules import CDS_RULES
from evispark.functions.text import classify_terms


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``path, record_order, header, sequence``.

    Files split at record starts, so one large file is read by many tasks;
    compressed files are read whole by one task each.
    """
    chunks = spark.read.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("record_order"),
        F.regexp_replace("value", "^>", "").alias("chunk"),
    )
    body = F.regexp_replace(F.regexp_replace("chunk", r"^[^\n]*\n?", ""), r"\s+", "")
    return chunks.filter(strip("chunk") != "").select(
        "path",
        "record_order",
        strip(F.substring_index("chunk", "\n", 1)).alias("header"),
        body.alias("sequence"),
    )


def fasta_problems(spark: SparkSession, path: str) -> DataFrame:
    """Files whose text starts with a sequence line instead of a header."""
    order = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    opening = spark.read.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("path"),
        (F.ltrim("value").startswith(">") | (strip("value") == "")).alias("headed"),
        order.alias("o"),
    )
    return (
        opening.groupBy("path")
        .agg(F.min_by("headed", "o").alias("headed"))
        .filter(~F.col("headed"))
        .select("path", F.lit("sequence line found before header").alias("message"))
    )


def write_fasta(
    df: DataFrame, path: str, header: Column | str, sequence: Column | str, width: int = 80, mode: str = "errorifexists",
    by: str | None = None,
) -> None:
    """Records with a sequence, wrapped at ``width`` letters; the files stay split, in a folder per value of ``by``."""
    header = F.col(header) if isinstance(header, str) else header
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    wrapped = F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    record = F.concat(F.lit(">"), F.translate(header, "\n", " "), F.lit("\n"), wrapped).alias("value")
    rows = df.filter(~is_missing(sequence)).select(record, *([by] if by else []))
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).text(path)


def _qualifier(block: Column, key: str) -> Column:
    quoted = F.regexp_extract(block, rf'/{key}="([^"]*)"', 1)
    return strip(F.regexp_replace(F.when(quoted != "", quoted).otherwise(
        F.regexp_extract(block, rf"/{key}=([^\"\s][^\n]*)", 1)
    ), r"\s+", "" if key == "translation" else " "))


def extract_cds(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """Coding features of GenBank texts, one row per CDS in file order.

    ``regions`` (``contig_id, region_start, region_end``) keeps the features that overlap a
    window and moves their coordinates to it.
    """
    records = spark.read.text(path, lineSep="\n//").select(
        F.col("_metadata.file_path").alias("path"), F.concat(F.lit("\n"), F.col("value")).alias("value")
    )
    contig = F.coalesce(
        F.nullif(F.regexp_extract("value", r"\nVERSION\s+(\S+)", 1), F.lit("")),
        F.nullif(F.regexp_extract("value", r"\nACCESSION\s+(\S+)", 1), F.lit("")),
        F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]+)?$", 1),
    )
    features = F.substring_index(
        F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*(\n.*)", 1), "\nORIGIN", 1
    )
    block = r"\n {5}CDS {13}([^\n]*(?:\n {21}[^\n]*)*)"
    found = records.select(
        "path",
        contig.alias("contig_id"),
        F.posexplode(F.regexp_extract_all(features, F.lit(block), F.lit(1))).alias("cds_no", "block"),
    )
    location = F.regexp_replace(F.regexp_extract("block", r"(?s)^(.*?)(?:\n\s*/|$)", 1), r"\s+", "")
    numbers = F.transform(F.regexp_extract_all(location, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("bigint"))
    product = _qualifier(F.col("block"), "product")
    translation = _qualifier(F.col("block"), "translation")
    cds = found.select(
        "path",
        "contig_id",
        (F.col("cds_no") + 1).alias("cds_no"),
        F.coalesce(
            *[F.nullif(_qualifier(F.col("block"), k), F.lit("")) for k in ("locus_tag", "gene", "protein_id")],
        ).alias("gene_id"),
        F.array_min(numbers).alias("start"),
        F.array_max(numbers).alias("end"),
        F.when(location.contains("complement"), "-").otherwise("+").alias("strand"),
        F.when(product == "", "hypothetical protein").otherwise(product).alias("product"),
        _qualifier(F.col("block"), "protein_id").alias("protein_id"),
        translation.alias("protein_sequence"),
        F.when(translation != "", F.length(translation)).alias("protein_length_aa"),
    )
    cds = cds.withColumn("functional_category", classify_terms("product", CDS_RULES, "other"))
    if regions is None:
        number = F.col("cds_no")
    else:  # fallback names count the features of the window
        cds = clip_to_regions(cds, regions, "contig_id", "_window")
        number = F.row_number().over(Window.partitionBy("path", "contig_id", "_window").orderBy("cds_no"))
    fallback = F.concat("contig_id", F.lit("_cds_"), F.lpad(number.cast("string"), 5, "0"))
    return cds.withColumn("_fallback", fallback).withColumn("gene_id", F.coalesce("gene_id", "_fallback")).drop("_fallback", "_window")


def clip_to_regions(df: DataFrame, regions: DataFrame, key: str, window: str | None = None, bin_size: int = 1 << 16) -> DataFrame:
    """Keep intervals that overlap their window and rebase them to its start.

    Intervals and windows meet in bins of coordinates, not all of a contig's with all of its windows; a pair is kept
    in the first bin both are in. ``window`` names a column for the bounds of the window.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size))
    left = df.filter("start IS NOT NULL AND `end` >= start").withColumn("_bin", F.explode(bins("start", "end")))
    right = regions.filter("region_end >= region_start").withColumn("_bin", F.explode(bins("region_start", "region_end")))
    overlapping = left.join(right, [key, "_bin"]).filter(
        (F.col("end") >= F.col("region_start"))
        & (F.col("start") <= F.col("region_end"))
        & (F.col("_bin") == F.floor(F.greatest("start", "region_start") / bin_size))
    )
    if window:
        overlapping = overlapping.withColumn(window, F.struct("region_start", "region_end"))
    return (
        overlapping.withColumn("start", F.greatest("start", "region_start") - F.col("region_start") + 1)
        .withColumn("end", F.least("end", "region_end") - F.col("region_start") + 1)
        .drop("region_start", "region_end", "_bin")
    )

"""Paths, file integrity and output inventory."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from evispark.functions.missing import is_missing, text

# Review words and the statuses they allow.
FILE_REVIEWED = ("reviewed", "accepted", "approved")
FILE_STATUSES = ("reviewed", "accepted", "approved", "pending_checksum", "pending_retrieval", "manual_review_required")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _fs(spark, path)
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def rename(spark: SparkSession, source: str, target: str) -> None:
    source_path, fs = _fs(spark, source)
    target_path, _ = _fs(spark, target)
    if target_path.getParent() is not None:
        fs.mkdirs(target_path.getParent())
    if not fs.rename(source_path, target_path):
        raise OSError(f"could not move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _fs(spark, path)
    fs.delete(hadoop_path, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob pattern, sorted; only names of one folder are listed, no file is opened."""
    hadoop_path, fs = _fs(spark, pattern)
    return sorted(f.getPath().toString() for f in fs.globStatus(hadoop_path) or [])


def write_small(spark: SparkSession, path: str, content: str) -> None:
    """A small text that is there whole or not at all: written beside its place and moved there."""
    rough = f"{path}.part"
    hadoop_path, fs = _fs(spark, rough)
    stream = fs.create(hadoop_path, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    rename(spark, rough, path)


def read_small(spark: SparkSession, path: str) -> str:
    hadoop_path, fs = _fs(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _relative(path: str | F.Column, root: str) -> F.Column:
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.regexp_replace(bare, "^" + "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in prefix), "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below ``root``: relative path and size; no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("observed_size"))
    )


def file_digests(spark: SparkSession, root: str, wanted: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Size, MD5 and SHA-256 of the wanted files (``path`` below ``root``) that exist.

    The work starts from the paths: only they are opened, wherever the store is, and read in chunks, so a file of
    any size takes the same memory. Spark deals the paths out. A path that names no file has no row; one that
    cannot be read has null digests.
    """

    def digests(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs as stores

        base = root if "://" in root or root.startswith("file:") else f"file://{root}"
        store, folder = stores.FileSystem.from_uri(base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                info = store.get_file_info(f"{folder.rstrip('/')}/{path}")
                if info.type != stores.FileType.File:
                    continue
                md5, sha = hashlib.md5(), hashlib.sha256()
                try:
                    with store.open_input_stream(info.path) as file:
                        while part := file.read(chunk):
                            md5.update(part)
                            sha.update(part)
                    rows.append((path, info.size, md5.hexdigest(), sha.hexdigest()))
                except OSError:
                    rows.append((path, info.size, None, None))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["path", "observed_size", "observed_md5", "observed_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    paths = wanted.select("path").filter("path IS NOT NULL AND path != ''").distinct()
    return paths.mapInArrow(digests, "path string, observed_size long, observed_md5 string, observed_sha256 string")


def verify_files(spark: SparkSession, manifest: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """Check each manifest row against the file it names; first failing rule decides.

    The manifest holds ``entity_id, accession, database, source_version, retrieval_command,
    retrieved_at, expected_path, file_size, sha256, review_status``. Only files the
    manifest names are read.
    """
    required = [
        "entity_id",
        "accession",
        "database",
        "source_version",
        "retrieval_command",
        "retrieved_at",
        "expected_path",
        "review_status",
    ]
    complete = F.lit(True)
    for name in required:
        complete = complete & ~is_missing(name)
    missing = F.array_join(
        F.array_compact(F.array(*[F.when(is_missing(c), F.lit(c)) for c in required])), ";"
    )
    order = "_order" if "_order" in manifest.columns else "entity_id"
    # Only complete rows take part in the duplicate rule; one minimum per id, no window.
    firsts = (
        manifest.filter(complete).groupBy("entity_id").agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
    )
    wanted = manifest.select(F.col("expected_path").alias("path")).distinct()
    files = file_digests(spark, root, wanted)
    df = (
        manifest.withColumn("_complete", complete)
        .join(firsts, "entity_id", "left")
        .join(files.withColumnRenamed("path", "expected_path"), "expected_path", "left")
    )
    repeated = F.col("_complete") & (F.col("_copies") > 1) & (F.col(order) > F.col("_first"))
    found = F.col("observed_size").isNotNull()
    reviewed = F.col("review_status").isin(*FILE_REVIEWED)
    status = (
        F.when(~F.col("_complete"), "invalid_missing_required")
        .when(repeated, "invalid_duplicate_entity_id")
        .when(~F.col("review_status").isin(*FILE_STATUSES), "invalid_review_status")
        .when(~F.col("retrieved_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), "invalid_retrieved_at")
        .when(~F.col("expected_path").startswith(prefix), "invalid_expected_path")
        .when(reviewed & ~found, "reviewed_file_missing")
        .when(reviewed & ~text("file_size").rlike(r"^\d+$"), "invalid_file_size")
        .when(reviewed & (F.col("file_size").try_cast("bigint") != F.col("observed_size")), "file_size_mismatch")
        .when(reviewed & ~text("sha256").rlike("^[0-9a-fA-F]{64}$"), "invalid_sha256")
        .when(reviewed & F.col("observed_sha256").isNull(), "digest_not_available")
        .when(reviewed & (F.lower("sha256") != F.col("observed_sha256")), "sha256_mismatch")
        .when(reviewed, "checksum_verified")
        .when((F.col("review_status") == "pending_checksum") & ~found, "pending_checksum_file_missing")
        .when(F.col("review_status") == "pending_checksum", "pending_checksum")
        .when(F.col("review_status") == "pending_retrieval", "pending_retrieval")
        .otherwise("manual_review_required")
    )
    severity = (
        F.when(F.col("status") == "checksum_verified", "info")
        .when(F.col("status").rlike("^(invalid|reviewed_file|file_size_|sha256_)"), "error")
        .otherwise("warning")
    )
    return (
        df.withColumn("path_exists", found)
        .withColumn("missing_required", missing)
        .withColumn("status", status)
        .withColumn("severity", severity)
        .drop("_complete", "_first", "_copies")
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, bytes, data rows and an empty flag for every text table below ``root``."""
    listed = list_files(spark, root)
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(root)
        .groupBy(_relative(F.col("_metadata.file_path"), root).alias("path"))
        .agg(F.count("*").alias("_lines"))
    )
    rows = F.greatest(F.coalesce(F.col("_lines"), F.lit(0)) - 1, F.lit(0))
    return listed.join(lines, "path", "left").select(
        "path", F.col("observed_size").alias("bytes"), rows.alias("row_count"), (rows == 0).alias("is_empty")
    )


def table_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two tables, in one shuffle."""
    columns = list(expected.columns)
    both = expected.select(*columns, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(*columns, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("_e").alias("expected_count"), F.sum("_a").alias("actual_count"))
        .filter(F.col("expected_count") != F.col("actual_count"))
    )


def drift_status(expected: DataFrame, actual: DataFrame | None, enabled: bool = True) -> DataFrame:
    """One row: ``in_sync``, ``manifest_drift``, ``manifest_missing`` or ``disabled_not_checked``."""
    spark = expected.sparkSession
    if not enabled or actual is None:
        status = "disabled_not_checked" if not enabled else "manifest_missing"
        return spark.range(1).select(F.lit(status).alias("status"), F.lit(None).cast("bigint").alias("drift_rows"))
    return (
        table_drift(expected, actual)
        .agg(F.count("*").alias("drift_rows"))
        .select(
            F.when(F.col("drift_rows") == 0, "in_sync").otherwise("manifest_drift").alias("status"),
            "drift_rows",
        )
    )

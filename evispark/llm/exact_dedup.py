"""Exact dedup against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, kept from digests
the index has already by a sort-merge anti-join, and appended. Only digests and ids move, never texts.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evispark.llm.scratch import delete, written
from evispark.session import scratch_path

#: Groups of copies with more rows are looked up by a broadcast of their digests: at most one digest per so many rows.
HOT_ROWS = 1_000_000
COLUMNS = "digest binary, keep_id long, keep_row long, group_size long, batch string"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, in a folder that outlives the session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({COLUMNS}) USING parquet LOCATION '{path}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> str:
        """Add the digests of ``digests`` (doc_id, digest, row) the index lacks; returns the name of the batch.

        Of a digest's rows the one with the largest doc_id is entered; a null id is smaller than any.
        """
        batch = uuid.uuid4().hex
        one = digests.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"),
            F.count("*").alias("group_size"),
        )
        new = one.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        new.write.insertInto(self.name)
        return batch

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def digests_of(docs: DataFrame) -> DataFrame:
    """Ids and digests of the rows, numbered, as a written table: the texts are read once."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    return written(narrow.withColumn("row", F.monotonically_increasing_id()))


def verdicts(digests: DataFrame, index: DigestIndex, batch: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each row of a batch with its digest's entry and whether it is the row that stays.

    No task gets more than ``hot_rows`` rows of a group: larger groups meet their entry by a broadcast, whose size is
    bounded by the number of all rows over ``hot_rows``.
    """
    entries = index.rows()
    hot = entries.filter(F.col("group_size") > hot_rows)
    cold = entries.filter(F.col("group_size") <= hot_rows)
    shown = [
        "doc_id", "digest", "keep_id", "group_size",
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("like_kept"),
    ]
    few = F.broadcast(hot)
    of_hot = digests.join(few, "digest").select(*shown)
    of_cold = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest").select(*shown)
    return of_hot.unionByName(of_cold)


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``digest``, ``keep_id``, ``group_size``, ``kept``, ``like_kept``.

    Takes ``doc_id`` and ``text``; other columns are ignored. Texts are equal when they are identical after lower-casing
    A-Z; null counts as empty. The row with the largest doc_id of a group stays; a null id only if all are null. Of rows
    that repeat both id and text exactly one stays (``like_kept`` holds for all of them). A text the index already has
    from an earlier batch has no row that stays. Without an index a new one is made in the shared folder. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, scratch_path(spark, "digests"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    digests = digests_of(docs)
    return verdicts(digests, index, index.append(digests), hot_rows)


def exact_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest doc_id stays."""
    verdict = exact_duplicates(docs)
    gone = verdict.filter(~F.col("like_kept")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    twice = verdict.filter(F.col("like_kept") & ~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    rows = docs.withColumn("_text_digest", text_digest(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_digest") == F.col("_digest"))
    rest = rows.join(gone, same, "left_anti")
    if not twice.isEmpty():  # rows that repeat an id and its text
        once = rest.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_text_digest"])
        rest = rest.join(twice, same, "left_anti").unionByName(once)
    return rest.drop("_text_digest")


def op9_exact_dedup(spark, sf: str) -> DataFrame:
    """Query: every document with the row of its group that stays."""
    verdict = exact_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    return verdict.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

"""Tables an operator writes on its way, in the shared folder, with an owner that removes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.session import scratch_path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables cut the lineage: what they hold survives lost executors. Leaving the block removes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path.rsplit("/", 1)[0])

    def table(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch_path(self.spark, "table"))
        return written(df, self.paths[-1])


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` and go on from the files. Without a path they stay, as a result still needs them."""
    path = path or scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

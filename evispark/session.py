"""Session set-up, lineage cuts and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evispark", cpus: str | int = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own. ``shared`` is its folder for staged tables."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if shared:
        session.sparkContext.setCheckpointDir(shared)
    return session


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    ``spark.checkpoint.dir`` names it on a cluster. A local session that has none gets a temporary folder, removed
    when the process ends; any other master must set it, because a machine-local folder would be lost with
    its machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


#: Spark removes the shuffle files of a query at its end, not when the driver happens to collect garbage.
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``. What was shuffled to make it goes with the write, as nobody reads it again."""
    spark = df.sparkSession
    before = spark.conf.get(_LET_GO, None)
    spark.conf.set(_LET_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_LET_GO)
        else:
            spark.conf.set(_LET_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Nothing upstream runs again, lost executors cost nothing that is already written, and later
    steps read only the columns they use. Spark also knows the size of what it reads. The disk holds the tables
    and the shuffles of one write, not those of all.
    """
    return _written(df, scratch_path(df.sparkSession, "table"))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Owner of tables that are needed for a while; leaving the block removes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table; see ``cut_lineage``."""
        path = scratch_path(self.spark, "table")
        self.paths.append(path)
        return _written(df, path)

    def clear(self, keep: int = 0) -> None:
        """Remove all tables but the ``keep`` latest."""
        cut = len(self.paths) - keep
        for path in self.paths[:cut]:
            delete(self.spark, path.rsplit("/", 1)[0])
        self.paths = self.paths[cut:]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table or text written on the way."""
    return f"{checkpoint_root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"

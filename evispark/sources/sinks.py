"""Table sinks: fixed columns, all-or-nothing commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evispark.sources.files import matching, path_exists, read_small, remove, rename, write_small


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are empty, others dropped."""

    def as_text(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        kind = df.schema[name].dataType.typeName()
        value = F.array_join(name, ";") if kind == "array" else F.col(f"`{name}`").cast("string")
        return F.coalesce(value, F.lit("")).alias(name)

    return df.select(*[as_text(c) for c in columns])


def write_delimited(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """A tab-separated table with a header in every part, also when it has no rows."""
    shape(df, columns).write.mode(mode).csv(path, sep="\t", header=True, emptyValue="", nullValue="", escape='"')


PLAN = "_commit-"
STAGED, SAVED = ".staged-", ".saved-"


def _folder(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0] or "/"


def _apply(spark: SparkSession, plan_path: str) -> list[str]:
    """Do what a plan says. Every step can be repeated: what is done already is seen and passed over."""
    plan = json.loads(read_small(spark, plan_path))
    mark, paths = plan["mark"], plan["paths"]
    for path in paths:
        staged, saved = path + STAGED + mark, path + SAVED + mark
        if not path_exists(spark, staged):
            continue  # in place since an earlier try
        if path_exists(spark, path):
            if path_exists(spark, saved):
                remove(spark, path)
            else:
                rename(spark, path, saved)
        rename(spark, staged, path)
    for path in paths:
        remove(spark, path + SAVED + mark)
    remove(spark, plan_path)
    return paths


def recover(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Finish or take back commits to these paths that were broken off; returns the paths that were finished.

    A commit with a plan file is finished: all its tables are written. One without never reached its commit point: what it
    staged is removed, and the old tables are untouched. Call it when no other commit to these paths is running.
    """
    finished: list[str] = []
    for folder in sorted({_folder(p) for p in paths}):
        for plan in matching(spark, f"{folder}/{PLAN}*"):
            if plan.endswith(".part"):
                remove(spark, plan)
            else:
                finished += _apply(spark, plan)
    for path in paths:
        for left in matching(spark, f"{path.rstrip('/')}{STAGED}*"):
            remove(spark, left)
    return finished


def commit_tables(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Sequence[str]] | None = None,
    issues: DataFrame | None = None,
    keep_existing: bool = False,
) -> list[str]:
    """Write every table or none; returns the paths replaced.

    ``columns`` lists the tables to write as delimited text, the others are parquet.
    Any ``error`` row in ``issues`` stops the commit before anything is touched. With
    ``keep_existing`` an empty table leaves an output that is already there alone.

    All tables are staged first. Then a plan file beside the first output appears in one step: the commit point. Before it
    nothing old is touched; after it the tables are put in place one by one, and a call that is broken off there is finished by
    the next commit to the same paths, or by ``recover``.
    """
    columns = columns or {}
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    if len({p.rstrip("/") for p in tables}) != len(tables):
        raise ValueError("two tables share one output path")
    if issues is not None and not issues.filter(F.col("severity") == "error").isEmpty():
        raise ValueError("blocking issues; no output was changed")
    recover(spark, list(tables))
    mark = uuid.uuid4().hex
    staged: list[str] = []
    try:
        for path, df in tables.items():
            if keep_existing and path_exists(spark, path) and df.isEmpty():
                continue
            staged.append(path)
            stage = path.rstrip("/") + STAGED + mark
            if path in columns:
                write_delimited(df, stage, columns[path])
            else:
                df.write.parquet(stage)
    except Exception:
        for path in staged:
            remove(spark, path.rstrip("/") + STAGED + mark)
        raise
    if staged:
        plan = f"{_folder(staged[0])}/{PLAN}{mark}.json"
        write_small(spark, plan, json.dumps({"mark": mark, "paths": [p.rstrip("/") for p in staged]}))
        _apply(spark, plan)
    return staged

"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order, and again behind their last one up to a number of passes. A copy's
virtual finish time is the source's words up to and including it over the source's target. Copies sorted by finish
time are taken until the budget is spent, so all sources reach their targets together.

Nothing sorts all rows: finish times are cut into ranges, the words of the ranges are summed, and only the
range in which the budget ends is cut again, until it is small enough to be sorted. Running words within a source are
sums over cells of the shuffled order plus a window inside a cell, so a hot source is many small windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evispark.llm.scratch import Scratch, written
from evispark.operators.windows import positions

WEIGHTS = (1, 2, 3)
PASSES = 3
#: Rows of a source's cell and of the last range: what one task sorts.
CELL_ROWS = 20_000
RANGES = 4096
#: Sources up to this number are joined by a broadcast.
FEW_SOURCES = 100_000


def words_in(text: Column) -> Column:
    """Number of runs of bytes other than space and tab to carriage return."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Sources with ``source_no``, ``source_size``, ``target``; they share all words by weight.

    Sources in order of code points, null last, take the weights in turn. A target stops at ``passes`` times the
    source's size and the excess is shared again by weight: the level of the shares rises until no source above its
    stop gives anything back. The loop moves two sums per round to the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    placed = positions(sums, [], ["_null", "source"], "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    placed = placed.select("source", "source_no", "source_size", weight.alias("weight"), (F.col("source_size") * passes).alias("stop"))
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level = -1.0
    while True:
        over = F.col("stop") < F.lit(level) * F.col("weight")
        row = placed.agg(
            F.coalesce(F.sum(F.when(over, F.col("stop"))), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        risen = (total - row["stopped"]) / row["open"] if row["open"] else level
        if risen <= level:
            break
        level = risen
    target = F.least(F.col("stop").cast("double"), F.lit(max(level, 0.0)) * F.col("weight"))
    return placed.select("source", "source_no", "source_size", target.alias("target"))


def _queued(sized: DataFrame, sources: DataFrame, cell_rows: int) -> DataFrame:
    """Rows with their source's figures and ``upto``: the source's words up to and including them."""
    rows = sized.count()
    bits = max(0, math.ceil(math.log2(max(1, rows / cell_rows))))
    few = sources.count() <= FEW_SOURCES
    table = F.broadcast(sources) if few else sources
    known = sized.join(table.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    cell = F.shiftright("shuffled", 64 - bits) if bits else F.lit(0).cast("long")
    known = known.withColumn("cell", cell)
    sums = known.groupBy("source_no", "cell").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "cell", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source_no", "cell").orderBy("shuffled", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = known.withColumn("_inside", F.sum("size").over(within))
    return inside.join(sums, ["source_no", "cell"]).withColumn("upto", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "cell")


def _finish(step: Column) -> Column:
    """Virtual finish time of the copy of a pass; a source without words is at the start."""
    return F.when(F.col("target") > 0, (F.col("upto") + step * F.col("source_size")) / F.col("target")).otherwise(0.0)


def _last_taken(queued: DataFrame, budget: int, passes: int, cell_rows: int):
    """The last copy the budget reaches, as values of (finish, source_no, shuffled, doc_id, size, row, pass)."""
    copies = queued.select("source_no", "shuffled", "doc_id", "size", "row", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    copies = copies.withColumn("finish", _finish(F.col("pass")))
    low, high = 0.0, copies.agg(F.coalesce(F.max("finish"), F.lit(0.0)).alias("m")).first()["m"]
    inside, spent = F.lit(True), 0
    while high > low:
        part = F.least(F.floor((F.col("finish") - low) / (high - low) * RANGES), F.lit(RANGES - 1)).alias("part")
        sums = copies.filter(inside).groupBy(part).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high")
        )
        for row in sorted(sums.collect()):  # at most RANGES rows
            last = row
            if spent + row["words"] > budget:
                break
            spent += row["words"]
        else:
            return "all"
        low, high = last["low"], last["high"]
        inside = F.col("finish").between(low, high)
        if last["rows"] <= cell_rows:
            break
    order = ["finish", "source_no", "shuffled", "doc_id", "size", "row", "pass"]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = copies.filter(inside).withColumn("_upto", F.sum("size").over(upto)).filter(F.col("_upto") <= budget - spent)
    found = taken.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    return tuple(found) if found is not None else (low, None)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """How often each document is in the mix: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Takes ``doc_id``, ``source`` and ``text``; other columns are ignored. The budget is the words of all documents. A null
    text has no words; a null source is a source, the last one. Every row is a document, also when ids or whole rows
    repeat; a null id is queued like any other. The order depends on ids and the seed alone. A source's words
    differ from its target by less than its largest document or so. An empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sized = sized.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id")).withColumn("row", F.monotonically_increasing_id())
    with Scratch(docs.sparkSession) as scratch:
        sized = scratch.table(sized)
        sources = scratch.table(source_targets(sized, weights, passes))
        queued = written(_queued(sized, sources, cell_rows))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    last = _last_taken(queued, budget, passes, cell_rows)
    copies = F.lit(0)
    for step in range(passes):
        copies = copies + F.when(_in_mix(_finish(F.lit(step)), step, last), 1).otherwise(0)
    shown = queued.withColumn("copies", copies)
    return shown.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _in_mix(finish: Column, step: int, last) -> Column:
    if last == "all":
        return F.lit(True)
    if last[1] is None:
        return finish < last[0]
    values = [F.lit(v) for v in last]
    keys = [finish, F.col("source_no"), F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("row"), F.lit(step)]
    # Structs compare field by field with null first, as the window sorts.
    named = lambda columns: F.struct(*[c.cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip(columns, ["double", "long", "long", "long", "long", "long", "int"], strict=True))])
    return named(keys) <= named(values)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, a row per copy. Rows alike in id, source and words get the same number of copies."""
    mix = mix_sources(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("_copies"))
    mix = mix.filter(F.col("_copies") > 0).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    taken = docs.withColumn("_words", words_in(F.col("text"))).join(mix, same).drop("_id", "_source", "_size", "_words")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")


def op5_mixing(spark, sf: str) -> DataFrame:
    """Query: every document with the words the mix takes of it."""
    mix = mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")

"""Set-similarity join on weighted items: links between sets that cover each other, as a forest instead of pairs.

Two sets are linked when their common weight is at least ``share`` percent of the heavier one. What a linked set lacks of
the other is then limited, so in the order from rare to frequent items their first common item stands where the still
rarer ones make up no more than the rest (prefix filter), the same holds for the next common item after it, and so on.

Sets meet in the buckets of such items. Every set is compared with the first of its bucket, which is linear. A bucket whose
sets are connected by then is done. In a small one the pairs of different components are compared; a large one is split by
the next common item, and again, until its parts are small, connected, or hold so much in common that it proves the
link. In a split, the sets of a bucket's largest component go only where sets of other components go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evispark.operators.graph import connected_components
from evispark.session import Scratch, cut_lineage

#: Sets of a bucket that are compared pair by pair; larger buckets are split. Results do not depend on it.
SMALL_BUCKET = 200


def placed_items(items: DataFrame) -> DataFrame:
    """Add to ``id, item, weight`` (items once per set): ``often`` (sets that have it), ``rarer`` (weight before it), ``total``."""
    counts = items.groupBy("item").agg(F.count("*").alias("often"))
    rarer = Window.partitionBy("id").orderBy("often", "item").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    return items.join(counts, "item").select(
        "id", "item", "weight", "often", F.coalesce(F.sum("weight").over(rarer), F.lit(0)).alias("rarer"), F.sum("weight").over(whole).alias("total")
    )


def verified(pairs: DataFrame, placed: DataFrame, share: int) -> DataFrame:
    """Of the pairs (a, b, ta, tb: totals) those that cover each other: ``a``, ``b``, ``covered`` (percent of the heavier one)."""
    heavier = F.greatest("ta", "tb")
    pairs = pairs.filter(100 * F.least("ta", "tb") >= share * heavier).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), heavier.alias("heavier"))
    common = placed.filter("often > 1")
    one, two = common.select(F.col("id").alias("a"), "item"), common.select(F.col("id").alias("b"), "item", "weight")
    both = pairs.distinct().join(two, "b").join(one, ["a", "item"]).groupBy("a", "b", "heavier").agg(F.sum("weight").alias("shared"))
    return both.select("a", "b", (100.0 * F.col("shared") / F.col("heavier")).alias("covered")).filter(F.col("covered") >= share)


def _with_lead(met: DataFrame, rows: Column) -> DataFrame:
    """Pairs of each chosen row of a bucket with the first one."""
    chosen = met.filter(rows)
    leads = chosen.groupBy("bucket").agg(F.min_by(F.struct("id", "total"), "id").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    pairs = chosen.join(leads, "bucket").filter(F.col("id") != F.col("lead.id"))
    return pairs.select(F.col("lead.id").alias("a"), F.col("lead.total").alias("ta"), F.col("id").alias("b"), F.col("total").alias("tb"))


def covering_links(items: DataFrame, share: int, known: DataFrame | None = None, small: int = SMALL_BUCKET) -> DataFrame:
    """Links ``a, b, covered`` whose components, together with ``known`` links (a, b), are those of all covering pairs.

    ``items`` has ``id, item, weight`` with positive whole weights; an item counts once per set, with its largest weight. Rows
    with a null are left out. Every link returned is one: the common weight of ``a`` and ``b`` is at least ``share`` percent of
    the heavier set. Not every pair is returned; no two sets that cover each other stay in different components.
    """
    spark = items.sparkSession
    once = items.dropna(subset=["id", "item", "weight"]).groupBy("id", "item").agg(F.max("weight").alias("weight"))
    slack = lambda missed: 100 * missed <= (100 - share) * F.col("total")
    with Scratch(spark) as scratch:
        placed = scratch.table(placed_items(once))
        common = placed.filter("often > 1")
        met = common.filter(slack(F.col("rarer"))).select(
            "id", "total", F.sha2(F.col("item").cast("string"), 256).alias("bucket"), "often", "item", F.col("weight").alias("held")
        )
        met = scratch.table(met)
        found = []
        while True:
            stars = _with_lead(met, F.lit(True)).unionByName(_with_lead(met, 100 * F.col("held") >= share * F.col("total")))
            found.append(scratch.table(verified(stars, placed, share)))
            edges = [f.select("a", "b") for f in found] + ([known.select("a", "b")] if known is not None else [])
            links = edges[0]
            for e in edges[1:]:
                links = links.unionByName(e)
            nodes = met.select("id").union(links.select("a")).union(links.select("b")).distinct()
            labels = connected_components(nodes, links, "id", "a", "b").withColumnRenamed("component", "label")
            labelled = scratch.table(met.join(labels, "id"))
            classes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
            mixed = classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("sets"), F.max_by("label", F.struct("n", "label")).alias("largest"))
            labelled = scratch.table(labelled.join(mixed.filter("classes > 1").drop("classes"), "bucket"))
            few = labelled.filter(F.col("sets") <= small)
            one = few.select("bucket", F.col("id").alias("a"), F.col("total").alias("ta"), F.col("label").alias("la"))
            two = few.select("bucket", F.col("id").alias("b"), F.col("total").alias("tb"), F.col("label").alias("lb"))
            pairs = one.join(two, "bucket").filter("a < b AND la <> lb").select("a", "ta", "b", "tb")
            found.append(scratch.table(verified(pairs, placed, share)))
            many = labelled.filter(F.col("sets") > small)
            if many.isEmpty():
                break
            later = common.select("id", F.col("item").alias("next"), F.col("often").alias("next_often"), F.col("weight").alias("more"), "rarer")
            after = F.struct("next_often", "next") > F.struct("often", "item")
            split = many.join(later, "id").filter(after & slack(F.col("rarer") - F.col("held"))).select(
                "id", "total", F.sha2(F.concat_ws("/", "bucket", F.col("next").cast("string")), 256).alias("bucket"),
                F.col("next_often").alias("often"), F.col("next").alias("item"), (F.col("held") + F.col("more")).alias("held"),
                (F.col("label") == F.col("largest")).alias("inside"),
            )
            split = scratch.table(split)
            asked = split.filter("NOT inside").select("bucket").distinct()
            met = scratch.table(split.join(asked, "bucket", "left_semi").drop("inside"))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return cut_lineage(out.distinct())

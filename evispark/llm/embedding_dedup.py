"""Embedding near-dedup: small-world graphs per shard, audited beams, exact cosines, components.

Equal vectors are one from the start. The distinct ones are dealt into shards of bounded size, and each shard gets a
hierarchical navigable small-world graph. Every two shards meet in one task, where each one's vectors search the
other's graph. A beam that fills up with links is widened; so are all beams of a shard as long as an audit of some queries
against every vector of the other shard finds links that the beams missed. The widest beam is the whole shard. What is
found is verified by cosines in double precision.

A task returns a row per linked vector: how many links it has there, and the first vector it is connected to. So what
is written grows with the vectors and the shards they meet, never with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evispark.llm.scratch import Scratch, written
from evispark.llm.ship import with_code
from evispark.llm.small_world import SmallWorld
from evispark.llm.words import mix
from evispark.operators.graph import connected_components

COSINE = 0.9
#: Bytes of the vectors of a shard, as doubles.
SHARD_BYTES = 8 << 20
#: Beam widths that are tried before the whole shard is looked at, and links in a beam (as a share) that widen it.
BEAMS, FULL = (16, 64), 0.5
#: Queries that are audited of a shard, as a share and at least; the share of audited links that beams must find.
AUDIT_SHARE, AUDIT_LEAST, AUDIT_RECALL = 0.05, 256, 0.99
#: Beams are compared in single precision, with this much room.
ROOM = 1e-4
#: Partitions of shards and of pairs of shards at most.
MOST_TASKS = 20_000
#: Similarities computed at a time when a whole shard is looked at.
SCAN = 4 << 20

PACKED = "first_id long, tie long, weight long, vector binary"
SHARD = "dim int, shard int, shards int, ids binary, ties binary, weights binary, vectors binary, layers array<binary>"
FOUND = "node struct<id:long,tie:long>, links long, root struct<id:long,tie:long>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Value lists as packed doubles."""
    for batch in batches:
        column = batch.column(3)
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        blobs = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], ["first_id", "tie", "weight", "vector"])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision, for the graph."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps the squares finite
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    ids, ties = table["first_id"].to_numpy(), table["tie"].to_numpy()
    keys = mix(ids.astype(np.uint64)) ^ ties.astype(np.uint64)
    order, sizes = SmallWorld.order(keys)
    blobs = table["vector"].to_pylist()
    vectors = np.frombuffer(b"".join(blobs[i] for i in order), np.float64).reshape(len(order), -1)
    world = SmallWorld.build(unit(vectors), sizes)
    blob = lambda a: pa.array([a.tobytes()], pa.binary())
    layers = pa.array([[t.tobytes() for t in world.tables]], pa.list_(pa.binary()))
    numbers = [pa.array([k.as_py()], pa.int32()) for k in (key[0], key[1], table["shards"][0])]
    weights = table["weight"].to_numpy()[order]
    return pa.table([*numbers, blob(ids[order]), blob(ties[order]), blob(weights), blob(vectors), layers], names=["dim", "shard", "shards", "ids", "ties", "weights", "vectors", "layers"])


class Shard:
    """The vectors of a shard with their ids and weights (rows of that vector), and the graph over them."""

    def __init__(self, row: dict):
        self.ids, self.ties, self.weights = (np.frombuffer(row[n], np.int64) for n in ("ids", "ties", "weights"))
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        rows = [np.frombuffer(t, np.int32) for t in row["layers"]]
        sizes = SmallWorld.order(mix(self.ids.astype(np.uint64)) ^ self.ties.astype(np.uint64))[1]
        self.world = SmallWorld(unit(self.vectors), [t.reshape(n, -1) for t, n in zip(rows, sizes, strict=True)])

    def __len__(self) -> int:
        return len(self.ids)


def scan(queries: np.ndarray, vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, vector) of at least this similarity: the beam as wide as the shard."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, SCAN // max(1, len(vectors)))
    for a in range(0, len(queries), step):
        row, at = np.nonzero(queries[a : a + step] @ vectors.T >= least)
        rows.append(row + a)
        found.append(at)
    return np.concatenate(rows), np.concatenate(found)


def beams(queries: np.ndarray, world: SmallWorld, least: float, same: bool, widths: tuple[int, ...] = BEAMS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (query, node) of at least this similarity, and how many queries each width was used for.

    ``same`` says that the queries are the graph's own vectors; a vector is not paired with itself.
    """
    n = len(world.vectors)
    checked = np.unique(np.linspace(0, len(queries) - 1, max(AUDIT_LEAST, int(AUDIT_SHARE * len(queries)))).astype(int))
    row, node = scan(queries[checked], world.vectors, least)
    truth = checked[row] * n + node
    truth = truth[checked[row] != node] if same else truth
    todo, codes, used = np.arange(len(queries)), np.zeros(0, np.int64), []
    for width in (*(w for w in widths if w < n), n):
        used.append(len(todo))
        if width == n:
            row, node = scan(queries[todo], world.vectors, least)
            saturated = np.zeros(0, np.int64)
        else:
            ids, sims = world.search(queries[todo], width)
            row, at = np.nonzero(sims >= least)
            node = ids[row, at].astype(np.int64)
            saturated = np.flatnonzero(np.bincount(row, minlength=len(todo)) >= FULL * width)
        fresh = todo[row] * n + node
        codes = np.union1d(codes, fresh[todo[row] != node] if same else fresh)
        missed = int((~np.isin(truth, codes) & ~np.isin(truth // n, todo[saturated])).sum())  # the others are widened anyway
        todo = todo[saturated] if missed <= (1 - AUDIT_RECALL) * len(truth) else np.arange(len(queries))
        if not len(todo):
            break
    return codes // n, codes % n, used


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, in double precision, whatever the size of the numbers."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node each of ``n`` nodes is connected to by the links (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return root


def _meet(cosine: float):
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        shards = sorted((Shard(row) for row in table.to_pylist()), key=lambda s: (int(s.ids[0]), int(s.ties[0])))
        one, two = shards[0], shards[-1]
        same = len(shards) == 1
        least = np.float32(cosine - ROOM)
        n = len(two)
        row, node, _ = beams(one.world.vectors, two.world, least, same)
        codes = row * n + node
        if same:
            codes = np.unique(np.minimum(row, node) * n + np.maximum(row, node))
        else:
            back, own, _ = beams(two.world.vectors, one.world, least, False)
            codes = np.union1d(codes, own * n + back)
        sure = [np.zeros(0, np.int64)]
        step = max(1, SCAN // one.vectors.shape[1])
        for a in range(0, len(codes), step):
            part = codes[a : a + step]
            sure.append(part[cosines(one.vectors[part // n], two.vectors[part % n]) >= cosine])
        codes = np.concatenate(sure)
        shift = 0 if same else len(one)
        ids, ties, weights = (x[0] if same else np.concatenate(x) for x in zip(*[(s.ids, s.ties, s.weights) for s in shards], strict=True))
        rank = np.empty(len(ids), np.int64)  # nodes by id, so that the smallest root is that of the smallest id
        order = np.lexsort((ties, ids))
        rank[order] = np.arange(len(ids))
        a, b = codes // n, codes % n + shift
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        root = order[_roots(len(ids), rank[a], rank[b])[rank]]
        linked = np.flatnonzero(links)
        pair = lambda at: pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(ties[at])], ["id", "tie"])
        return pa.table({"node": pair(linked), "links": pa.array(links[linked]), "root": pair(root[linked])})

    return meet


def usable(vector: str, vec_id: str) -> Column:
    """Whether a row can be linked: an id, and a vector of finite numbers that are not all zero."""
    doubles = F.col(vector)
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(doubles, lambda x: x != 0)
    return F.coalesce(F.col(vec_id).isNotNull() & doubles.isNotNull() & fine, F.lit(False))


def shards_of(classes: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per shard with its vectors and its graph. Vectors of different lengths are never in one shard."""
    sizes = classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    sizes = sizes.select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / shard_bytes).cast("int").alias("shards"))
    packed = classes.select("first_id", "tie", "weight", "vector").mapInArrow(_pack, PACKED)
    packed = packed.withColumn("dim", (F.octet_length("vector") / 8).cast("int")).join(sizes, "dim")
    place = F.pmod(F.xxhash64("first_id", "tie"), F.col("shards")).cast("int")
    total = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1)).alias("n")).first()["n"]
    dealt = packed.withColumn("shard", place).repartition(min(total, MOST_TASKS), "dim", "shard")  # a shard is work for a task
    return dealt.groupBy("dim", "shard").applyInArrow(_build, SHARD)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Links and components of vectors: ``vec_id``, ``n_links``, ``component_id``, ``kept``, a row per input row.

    Takes ``vec_id`` and ``embedding`` (numbers); other columns are ignored. Two rows are linked when their cosine is at least
    ``cosine`` in double precision. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id
    that links lead to, the own one included, and the row of that id is ``kept``.

    Rows without an id, and vectors that are null, empty, all zero or hold a null or non-finite component, link with
    nothing; their component is their own id. Vectors of different lengths are not linked. Equal vectors are linked,
    in one row or in a million. Rows that repeat an id are rows of their own for the links and share ``kept``. An empty
    table gives an empty result. No link below ``cosine`` is made; that few above it are missed is audited in each pair
    of shards (``AUDIT_RECALL``), there is no cap on links or beams.
    """
    spark = with_code(vectors.sparkSession)
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("vector"))
    rows = rows.withColumn("vector", F.when(usable("vector", "vec_id"), F.transform("vector", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("tie", F.xxhash64(F.lit(1), "vector")).withColumn("other", F.xxhash64(F.lit(2), "vector"))
    with Scratch(spark) as scratch:
        some = rows.filter(F.col("vector").isNotNull())
        classes = some.groupBy("tie", "other").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        classes = scratch.table(classes)
        shards = scratch.table(shards_of(classes, shard_bytes))
        each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
        met = shards.withColumn("with", each).withColumn("one", F.least("shard", "with")).withColumn("two", F.greatest("shard", "with"))
        n = shards.count()
        met = met.drop("with", "shards").repartition(min(n * (n + 1) // 2 or 1, MOST_TASKS), "dim", "one", "two")
        found = met.groupBy("dim", "one", "two").applyInArrow(_meet(cosine), FOUND)
        found = scratch.table(found)
        counted = found.groupBy(F.col("node.id").alias("first_id"), F.col("node.tie").alias("tie")).agg(F.sum("links").alias("links"))
        nodes = found.select(F.col("node").alias("id")).union(found.select("root")).distinct()
        joined = connected_components(nodes, found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
        joined = joined.select(F.col("id.id").alias("first_id"), F.col("id.tie").alias("tie"), F.col("component.id").alias("component_id"))
        known = classes.select("tie", "other", "first_id", "weight").join(counted, ["first_id", "tie"], "left").join(joined, ["first_id", "tie"], "left")
        links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
        known = written(known.select("tie", "other", links.alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    linked = rows.filter(F.col("vector").isNotNull()).select("vec_id", "tie", "other").join(known, ["tie", "other"])
    alone = rows.filter(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = linked.select("vec_id", "n_links", "component_id").union(alone)
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_near_dedup(spark, sf: str) -> DataFrame:
    """Query: every vector with its links and its component."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))

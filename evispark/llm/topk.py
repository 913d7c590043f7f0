"""Exact top-k inner-product search with an impact-ordered index, score at a time.

Vectors are dealt into blocks. A block's index has posting lists per dimension, cut into segments
of equal quantised impact. A query adds segments to its accumulators by descending impact over all dimensions. What
unread segments and the quantisation can still add is bounded, and reading stops on nothing but the proof
that only a few vectors can be among the best k; those are scored exactly from their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from evispark.llm.ship import with_code

K = 5
SCALE = 256
EVERY = 50
#: Vectors of an index block and queries of a group: what one task holds.
BLOCK_VECTORS = 16_384
GROUP_QUERIES = 2_048
#: Values that share a quantised impact.
STEP = 4
#: Steps in which a query reads the lists; after each the bound is tested.
STEPS = 12
#: A query stops reading when it is proved that no more vectors, or k, can be among the best; they are scored exactly.
FEW = 1_000

LONGEST = (1 << 63) - 1

FOUND = "query_id long, vec_id long, score long"


class ImpactIndex:
    """Posting lists of a block of integer vectors, once by falling and once by rising value.

    The impact of a posting is how far its value lies from the worst value of the dimension, in whole steps; a
    segment is the postings of one impact. Only impacts that occur have a segment: where a level ends is looked up in the
    sorted impacts, so an index takes as much room as it has postings, whatever the values.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.rows, self.dims = vectors.shape
        self.extra = self.rows - len(np.unique(ids))
        self.sides = []
        for sign in (1, -1):
            above = sign * vectors - (sign * vectors).min(axis=0)
            impacts = above // STEP
            order = np.argsort(-impacts, axis=0, kind="stable").astype(np.int32)
            ranked = np.ascontiguousarray(np.take_along_axis(impacts, order, 0).T)
            most = int(ranked.max(initial=0))
            keys = np.arange(self.dims)[:, None] * (most + 2) + most - ranked  # all lists as one sorted list
            self.sides.append((np.ascontiguousarray(order.T), ranked, keys.ravel(), most))

    def _upto(self, side: int, need: np.ndarray) -> np.ndarray:
        """Postings of each dimension with at least the impact needed."""
        *_, keys, most = self.sides[side]
        dims = np.arange(self.dims)
        return np.searchsorted(keys, dims * (most + 2) + most - np.minimum(need, most + 1), "right") - dims * self.rows

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best ids but the query's own; of equal scores the smaller id is better.

        An id that has several vectors counts once, with the best of them.

        An accumulator holds what a vector's read postings add at least. What it may lack is bounded per dimension by
        the largest unread impact or by the width of a step, and over all dimensions by their sum ``slack``. A vector
        whose accumulator and slack stay below the k-th largest accumulator is proved to be none of the best.
        """
        weight = np.abs(query)
        side = (query < 0).astype(int)
        most = np.asarray([s[3] for s in self.sides])[side]
        total = np.zeros(self.rows)
        done = np.zeros(self.dims, np.int64)
        left = np.flatnonzero(self.ids != own)
        rows = k + self.extra  # so many rows hold k ids at least
        top = float((weight * (most + 1) * STEP).max(initial=0))
        for step in range(1, STEPS + 1):
            level = top * (STEPS - step) / STEPS  # segments that add at least this much are read now
            need = np.ceil(level / np.maximum(weight * STEP, 1)).astype(np.int64)
            need = np.where(weight > 0, np.minimum(need, most + 1), most + 1)
            if step == STEPS:
                need[weight > 0] = 0
            upto = np.where(side == 0, self._upto(0, need), self._upto(1, need))
            todo = np.flatnonzero(upto > done)
            if len(todo):
                at = [self.sides[side[d]][0][d, done[d] : upto[d]] for d in todo]
                impacts = [self.sides[side[d]][1][d, done[d] : upto[d]] for d in todo]
                factor = np.repeat((weight[todo] * STEP).astype(float), upto[todo] - done[todo])
                total += np.bincount(np.concatenate(at), np.concatenate(impacts) * factor, self.rows)
                done = np.maximum(done, upto)
            unread = np.where(done < self.rows, need * STEP - 1, 0)  # values over the worst one, at most
            slack = float((weight * np.maximum(unread, STEP - 1)).sum())
            scores = total[left]
            if len(left) > rows:
                least = np.partition(scores, len(left) - rows)[len(left) - rows]
                left = left[scores + slack >= least]
            if len(left) <= max(FEW, rows):
                break
        exact = self.vectors[left] @ query
        best = np.lexsort((self.ids[left], -exact))
        _, place = np.unique(self.ids[left][best], return_index=True)
        best = best[np.sort(place)[:k]]
        return self.ids[left][best], exact[best]


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


def _large(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose inner products need more than the digits of a double; they are scored one by one in whole numbers."""
    return np.abs(vectors.astype(np.float64)).max(axis=1) >= math.sqrt(2**52 / vectors.shape[1])


def _whole_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products, cut at the ends of a long."""
    return [max(-LONGEST - 1, min(LONGEST, s)) for s in vectors.astype(object).dot(query.astype(object))] if len(vectors) else []


def _search(k: int):
    def search(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        sizes = np.asarray([len(b) for b in vectors["vector"].to_pylist()])
        for size in np.unique(sizes):  # vectors of other lengths have no inner product with a query
            part = vectors.filter(pa.array(sizes == size))
            ids, values = part["vec_id"].to_numpy(), _matrix(part["vector"].to_pylist())
            large = _large(values)
            index = ImpactIndex(ids[~large], values[~large]) if not large.all() else None
            for own, blob in zip(queries["query_id"].to_pylist(), queries["vector"].to_pylist(), strict=True):
                if len(blob) != size:
                    continue
                query = _matrix([blob])[0]
                plain = index is not None and not _large(query[None, :])[0]
                found = list(zip(*(x.tolist() for x in index.search(query, own, k)), strict=True)) if plain else []
                rest = large if plain else np.ones(len(ids), bool)
                others = zip(ids[rest].tolist(), _whole_scores(values[rest], query), strict=True)
                best: dict[int, int] = {}
                for i, score in (*found, *others):
                    if i != own:
                        best[i] = max(score, best.get(i, score))
                out += [(own, i, score) for i, score in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantised vectors as packed integers; one value list per row."""
    for batch in batches:
        column = batch.column(1)
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        blobs = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["vec_id", "vector"])


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``vector`` of floor(scale * x) per component; unusable rows are left out.

    Left out are rows without an id, null or empty vectors, and those with a null or non-finite component. Components
    beyond the range of a long are cut to its ends.
    """
    doubles = F.col("embedding").cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(~bad)
    whole = F.transform(doubles, lambda x: F.floor(x * scale))  # a long; larger numbers become the largest one
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_vectors: int = BLOCK_VECTORS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The k best vectors for each query by integer inner product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both tables have ``vec_id`` and ``vector`` (integers). A query's own id is no candidate; equal scores go to the
    smaller id. Scores are exact, and cut to the ends of a long where they are beyond it. A query that is repeated is asked once; a candidate that is repeated counts once. Vectors of another
    length than the query's take no part. Fewer than k candidates give fewer rows, an empty table none.

    Every group of queries meets every block of vectors in one task, which is the work of an exact search; a block
    answers with k ids per query, so what is merged does not grow with the size of a block. Rows that repeat id and vector
    are dropped; different vectors of one id are dealt to blocks by their values.
    """
    with_code(vectors.sparkSession)
    packed = "vec_id long, vector binary"
    vectors = vectors.dropDuplicates()
    blocks = max(1, math.ceil(vectors.count() / block_vectors))
    groups = max(1, math.ceil(queries.count() / group_queries))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.pmod(F.xxhash64(F.lit(1), "vec_id", "vector"), F.lit(blocks)).cast("int")
    dealt = vectors.mapInArrow(_packed, packed).withColumn("block", place).withColumn("group", each(groups))
    asked = queries.dropDuplicates().mapInArrow(_packed, packed).withColumnRenamed("vec_id", "query_id")
    asked = asked.withColumn("group", F.pmod(F.xxhash64(F.lit(2), "query_id"), F.lit(groups)).cast("int")).withColumn("block", each(blocks))
    found = dealt.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(_search(k), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark, sf: str) -> DataFrame:
    """Query: the five best vectors for every fiftieth one."""
    vectors = quantised(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
best AS (SELECT query_id, vec_id, max(score) AS score FROM scored GROUP BY query_id, vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM best)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""

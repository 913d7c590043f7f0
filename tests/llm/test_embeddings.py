"""Embedding near-dedup against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from evispark.llm import embedding_dedup as dedup
from evispark.llm.small_world import SmallWorld

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, tie string, n_links string, component string"


def brute(rows, least=0.9):
    """Links and components by comparing every two rows; rows are (vec_id, values)."""

    def fine(r):
        return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ok = [i for i, r in enumerate(rows) if fine(r)]
    values = {i: np.asarray(rows[i][1], np.float32).astype(float) for i in ok}
    norms = {i: math.sqrt(values[i] @ values[i]) for i in ok}
    for n, i in enumerate(ok):
        for j in ok[:n]:
            if len(values[i]) == len(values[j]) and values[i] @ values[j] / (norms[i] * norms[j]) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    least_id = {}
    for i in ok:
        least_id[find(i)] = min(least_id.get(find(i), rows[i][0]), rows[i][0])
    component = [least_id[find(i)] if i in values else rows[i][0] for i in range(len(rows))]
    return sorted(map(repr, [(r[0], links[i], component[i], r[0] == component[i]) for i, r in enumerate(rows)]))


def plain(df):
    return sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in df.collect())


def clustered(rng, n, dim=16):
    """Vectors alone, in near-copy groups of different sizes, chains, and equal ones."""
    rows = rng.normal(size=(n, dim)).tolist()
    for size in (2, 3, 40, 150):
        centre = rng.normal(size=dim)
        rows += (centre + 0.12 * rng.normal(size=(size, dim))).tolist()
    angle = 0.3 * np.arange(12)  # neighbours are linked, others are not
    rows += [[math.cos(a), math.sin(a)] + [0.0] * (dim - 2) for a in angle]
    rows += [rows[5]] * 9
    return [(i * 3, [float(x) for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("shard_bytes", [1 << 14, 1 << 23])
def test_links_equal_all_pairs(spark, docs, shard_bytes):
    rows = clustered(np.random.default_rng(4), 500)
    frame = spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)
    assert plain(dedup.near_duplicate_vectors(frame, shard_bytes=shard_bytes)) == brute(rows)


def test_odd_rows(spark, docs):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-0.0, 1.0]), (4, [0.0, 5.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [nan, 1.0]),
        (10, [inf, 1.0]), (None, [1.0, 0.0]), (None, None), (11, [1.0, 0.0, 0.0]), (12, [1e30, 1e30]), (13, [1e-30, 1e-30]), (1, [1.0, 0.0]), (3, [1.0, 0.1]),
        (-4, [-1.0, -1.0]), (-5, [-3.0, -3.0]), (1, [0.0, 7.0]), (20, [3e38, 1e38]), (21, [1e-38, 3e-39]),
    ]
    frame = spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA)
    assert plain(dedup.near_duplicate_vectors(frame)) == brute(rows)
    assert dedup.near_duplicate_vectors(frame.limit(0)).count() == 0
    assert plain(dedup.near_duplicate_vectors(frame.filter("vec_id = 7"))) == [repr((7, 0, 7, True))]


def test_query_equals_all_pairs(spark, docs):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert plain(dedup.op13_embedding_near_dedup(spark, SF)) == brute(rows)


def test_recall_of_the_beams_on_many_vectors(spark, docs):
    """Beams alone, without whole-shard looks, find nearly all links; with them the share audited is kept."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(400, 32))
    vectors = dedup.unit(np.repeat(centres, 10, axis=0) + 0.1 * rng.normal(size=(4000, 32)))
    order, sizes = SmallWorld.order(rng.integers(0, 2**62, len(vectors)))
    world = SmallWorld.build(vectors[order], sizes)
    true = set(zip(*(x.tolist() for x in dedup.scan(world.vectors, world.vectors, 0.9)), strict=True))
    true = {(a, b) for a, b in true if a != b}
    row, node, used = dedup.beams(world.vectors, world, np.float32(0.9), True)
    found = set(zip(row.tolist(), node.tolist(), strict=True))
    assert found <= true and len(found) >= 0.99 * len(true)
    ids, sims = world.search(world.vectors, 48)
    alone = int(((sims >= 0.9) & (ids != np.arange(len(ids))[:, None])).sum())
    assert alone >= 0.95 * len(true)


def test_audit_widens_beams_of_a_bad_graph():
    rng = np.random.default_rng(2)
    vectors = dedup.unit(np.repeat(rng.normal(size=(300, 16)), 4, axis=0) + 0.05 * rng.normal(size=(1200, 16)))
    broken = SmallWorld(vectors, [np.full((1200, 4), -1, np.int32)])  # no neighbours: beams end at the entry
    row, node, used = dedup.beams(vectors, broken, np.float32(0.9), True)
    true = dedup.scan(vectors, vectors, 0.9)
    assert len(row) == int((true[0] != true[1]).sum()) and used == [1200, 1200, 1200]

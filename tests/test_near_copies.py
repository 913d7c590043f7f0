"""Near copies against all pairs, with lines that first stood in other documents."""

from __future__ import annotations

import itertools
import random

import __spark_entry__ as entry


def _texts() -> dict[int, str]:
    rng = random.Random(7)
    line = lambda name: f"{name} " + "x" * rng.randrange(20, 60)
    texts = {}
    for group in range(4):
        common = [line(f"g{group} l{i}") for i in range(20)]
        at = group * 100
        texts[at] = "\n".join(common[:10] + [line(f"a{at} {i}") for i in range(30)])
        texts[at + 1] = "\n".join(common[10:] + [line(f"b{at} {i}") for i in range(30)])
        for copy in range(2, 7):  # near copies whose lines first stood in the two before, and one of half the lines
            texts[at + copy] = "\n".join(common + [line(f"own {at} {copy}")])
        texts[at + 7] = "\n".join(common[::2] + [line(f"half {at} {i}") for i in range(12)])
    pool = [f"pool {i} " + "y" * 30 for i in range(30)]
    for i in range(60):  # mixtures of common lines
        texts[1000 + i] = "\n".join(rng.sample(pool, 5) + pool[:2])
    return texts


def _expected(texts: dict[int, str]) -> dict[int, int]:
    sets = {i: set(t.split("\n")) for i, t in texts.items()}
    weight = lambda lines: sum(map(len, lines))
    first = {}
    for i in sorted(sets):
        for x in sets[i]:
            first.setdefault(x, i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = sets[a] & sets[b]
        led = {x for x in both if first[x] == a}
        if 5 * weight(both) >= 3 * max(weight(sets[a]), weight(sets[b])) or 5 * weight(led) >= 3 * weight(sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}


def test_near_copies_of_lines_that_others_held_first(spark, tmp_path):
    texts = _texts()
    rows = [(i, t, "en", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.component for r in entry.queries()["near_copy_components_documents"](spark, str(tmp_path)).collect()}
    want = _expected(texts)
    assert got == want
    assert want[2] == want[6] == 2 and want[7] == 7
    sizes = {r.representative_id: r.cluster_size for r in entry.queries()["dereplicate_documents"](spark, str(tmp_path)).collect()}
    assert len(sizes) == len(set(want.values())) and sum(sizes.values()) == len(texts)

"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from evispark.llm import exact_dedup, near_dedup, substring
from evispark.llm.words import mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_classes(texts, similarity=0.8):
    """The class of each text by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if (not a and not b) or (both and both / (len(a) + len(b) - both) >= similarity):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_match_all_pairs(docs, rows):
    got = {}
    for r in near_dedup.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.class_size, r.kept))
    classes = near_classes([r[1] for r in rows])
    members = {}
    for row, c in zip(rows, classes, strict=True):
        members.setdefault(c, []).append(row[0])
    want = {}
    for row, c in zip(rows, classes, strict=True):
        ids = [i for i in members[c] if i is not None]
        least = min(ids) if ids else None
        want.setdefault(row[0], set()).add((least, len(members[c]), row[0] == least))
    assert got == want


def test_near_duplicates_of_chains_and_strangers(spark):
    """Texts that are similar to their neighbours only are one class; a band of mixed classes loses no link."""
    base = [f"t{i}" for i in range(100)]
    rows = []
    for step in range(30):
        w = list(base)
        for k in range(step):
            w[3 * k] = f"new{k}"
        rows.append((step, " ".join(w)))
    rows += [(100 + i, " ".join(base[:70] + [f"o{i}_{k}" for k in range(30)])) for i in range(25)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rows=1, bands=24).collect()}
    classes = near_classes([t for _, t in rows])
    assert got == {row[0]: rows[c][0] for row, c in zip(rows, classes, strict=True)}


def test_small_blocks_lose_no_link(spark, docs, monkeypatch):
    """The same where a band's strangers and texts are dealt into many groups."""
    monkeypatch.setattr(near_dedup, "GROUP_TEXTS", 4)
    test_near_duplicates_of_chains_and_strangers(spark)


def test_of_texts_that_share_the_smallest_id_one_is_kept(spark, docs):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join([*base, "other"])]
    frame = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    got = near_dedup.near_duplicates(frame).collect()
    assert [r.class_id for r in got] == [1, 1, 1] and [r.class_size for r in got] == [3, 3, 3]
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, False), (1, True), (2, False)]
    assert near_dedup.near_dedup_stage(spark, frame, "").count() == 1


def test_near_dedup_stage_keeps_one_of_each_class(spark, unique_docs):
    left = near_dedup.near_dedup_stage(spark, unique_docs, "")
    assert left.columns == unique_docs.columns
    verdict = near_dedup.near_duplicates(unique_docs)
    assert left.count() == verdict.select("class_id").distinct().count()


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    shared, a, b = (mix(rng.integers(0, 2**62, n, dtype=np.uint64)) for n in (300, 100, 60))
    value = np.concatenate([shared, a, shared, b])
    row = np.repeat([0, 1], [400, 360])
    weight = rng.random(len(value)) * 4 + 0.05
    wa, wb = weight[:400], weight[400:]
    true = np.minimum(wa[:300], wb[:300]).sum() / (np.maximum(wa[:300], wb[:300]).sum() + wa[300:].sum() + wb[300:].sum())
    plain = near_dedup.dart_signatures(value, row, 2, 2000)
    heavy = near_dedup.dart_signatures(value, row, 2, 2000, weight)
    assert abs((plain[0] == plain[1]).mean() - 300 / 460) < 0.04
    assert abs((heavy[0] == heavy[1]).mean() - true) < 0.04
    assert not (plain == near_dedup.EMPTY).any()
    assert (near_dedup.dart_signatures(value[:0], row[:0], 1, 8) == near_dedup.EMPTY).all()


def brute_cut(rows, window=13):
    far = 2**63 - 1
    first = {}
    texts = [(far if i is None else i, words(t)) for i, t in ((r[0], r[1]) for r in rows)]
    for doc, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, far), doc)
    out = []
    for (doc, w), row in zip(texts, rows, strict=True):
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < doc for j in range(k, k + window)}
        out.append((row[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def order(x):
    return (x[0] is None, x[0] or 0, *map(str, x[1:]))


def test_substring_dedup_matches_brute_force(docs, rows):
    for block, bucket in ((8 << 20, 2 << 20), (3000, 200)):
        cut = substring.remove_repeats(docs, block_bytes=block, bucket_windows=bucket).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in cut), key=order) == sorted(brute_cut(rows), key=order)
        for r in cut:
            assert r.n_removed == sum(s["last"] - s["first"] + 1 for s in r.spans)
            assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 70_000):
        value = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(substring.unpack(substring.pack(value)), value)


def test_exact_duplicates_match_grouping(spark, docs, rows):
    for hot in (1_000_000, 1):
        got = exact_dedup.exact_duplicates(docs, hot_rows=hot).collect()
        groups = {}
        for r in rows:
            groups.setdefault(hashlib.sha256((r[1] or "").translate(LOWER).encode()).digest(), []).append(r[0])
        assert len(got) == len(rows)
        kept = {}
        for r in got:
            ids = groups[bytes(r.digest)]
            largest = max((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.like_kept) == (largest, len(ids), r.doc_id == largest)
            kept[bytes(r.digest)] = kept.get(bytes(r.digest), 0) + r.kept
        assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_stage_drops_repeated_rows(spark, docs, rows):
    left = exact_dedup.exact_dedup_stage(spark, docs, "")
    assert left.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in left.collect()]
    assert sorted(texts) == sorted({(r[1] or "").translate(LOWER) for r in rows})


def test_digest_index_outlives_a_batch(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    one = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "B"), (5, "c"), (6, "c")], "doc_id long, text string")
    first = {r.doc_id: r.kept for r in exact_dedup.exact_duplicates(one, index).collect()}
    spark.sql(f"DROP TABLE {index.name}")  # the files stay
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(two, again).collect()}
    assert first == {1: False, 2: True, 3: True}
    assert second == {4: (3, False), 5: (6, False), 6: (6, True)}
    assert again.rows().count() == 3
    again.drop()


def test_empty_tables(spark, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert substring.remove_repeats(no_docs).count() == 0
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert near_dedup.near_dedup_stage(spark, no_docs, "").count() == 0
    assert exact_dedup.exact_dedup_stage(spark, no_docs, "").count() == 0


def test_normalising_touches_ascii_letters_only(spark):
    got = spark.createDataFrame([("AÉİz",), ("ABC",), (None,)], "text string").select(exact_dedup.normalised(F.col("text")).alias("t"))
    assert [r.t for r in got.collect()] == ["aÉİz", "abc", ""]

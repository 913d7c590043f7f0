"""Periodic runs against the definition, compared word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evispark.llm import periods
from evispark.llm.words import mix

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=6):
    """All runs by comparing the words with themselves at every shift."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            begin = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k - begin + q >= max(least, 4 * q):
                found.setdefault((begin, k + q), q)  # the smallest period of a stretch comes first
    return sorted((a, b - a, q) for (a, b), q in found.items())


def found_runs(texts):
    words, ends = [], []
    for i, text in enumerate(texts):
        words += [w + 1 for w in text]
        ends.append(len(words))
        words.append(10**9 + i)
    runs = [[] for _ in texts]
    for a, b, q in zip(*(x.tolist() for x in periods.find_runs(mix(np.asarray(words, np.uint64)), np.asarray(ends))), strict=True):
        i = int(np.searchsorted(ends, a))
        off = ends[i - 1] + 1 if i else 0
        if b - a >= 6:
            runs[i].append((a - off, b - a, q))
    return runs


def repetitive(rng):
    letters = rng.choice([1, 2, 3, 5, 50, 1000])
    words = [rng.randrange(letters) for _ in range(rng.randrange(300))]
    for _ in range(rng.randrange(4)):
        p = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 50])
        base = [rng.randrange(letters) for _ in range(p)]
        if rng.random() < 0.4:  # a period that is nearly periodic itself
            base = (base[: max(1, p // rng.choice([2, 3, 5]))] * p)[:p]
        at = rng.randrange(len(words) + 1)
        words[at:at] = [base[i % p] for i in range(rng.randrange(2 * p, 7 * p))]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(4)]
    assert found_runs(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), min_size=1, max_size=4))
def test_runs_of_few_letters_equal_brute_force(texts):
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_nested_and_long_periods():
    inner = [1, 2] * 20 + [3]
    words = inner * 40  # a run of period 41 with runs of period 2 inside
    assert found_runs([words]) == [brute_runs(words)]
    rng = random.Random(5)
    base = [rng.randrange(9) for _ in range(5_000)]
    assert found_runs([base * 4 + base[:17]])[0][-1] == (0, 20_017, 5_000)
    assert all(length < 20_000 - 1 for _, length, _ in found_runs([(base * 4)[:-1]])[0])


def test_synchronising_positions_depend_on_their_context_alone():
    rng = random.Random(2)
    part = [rng.randrange(4) for _ in range(200)]
    texts = [[rng.randrange(4) for _ in range(50)] + part + [rng.randrange(4) for _ in range(70)] for _ in range(2)]
    at = []
    for text in texts:
        names = periods._doubled(periods._doubled(periods._doubled(mix(np.asarray(text, np.uint64)), 1), 2), 4)
        at.append({int(i) - 50 for i in periods.synchronising(names, 8) if 50 <= i <= 250 - 16})
    assert at[0] == at[1] and at[0]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def plain(rows):
    return sorted(map(repr, rows))


def test_query_equals_brute_force(spark):
    given_ = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    given_ = [(i, t) for i, t in given_ if len((t or "").split()) < 1_500]
    got = {r.doc_id: tuple(r) for r in periods.op12_periodic_runs(spark, SF).select(COLUMNS).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert plain(got[i] for i, _ in given_) == plain(expected(i, t) for i, t in given_)
    assert any(got[i][1] for i, _ in given_)


def test_odd_rows(spark, docs, rows, no_docs, tmp_path):
    short = docs.filter("text IS NULL OR length(text) < 2000")
    path = str(tmp_path / "documents.parquet")
    short.write.parquet(path)
    got = plain(tuple(r) for r in periods.op12_periodic_runs(spark, str(tmp_path)).select(COLUMNS).collect())
    assert got == plain(expected(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 2000)
    assert periods.periodic_runs(no_docs).count() == 0
    kept = {r.doc_id: r.collapsed for r in periods.periodic_runs(docs).collect()}
    assert kept[15] == "word" and kept[5] == "" and kept[17] == "###"


def test_a_long_text_is_read_whole(spark):
    base = [f"w{i}" for i in range(60_000)]
    frame = spark.createDataFrame([(1, " ".join(base * 4 + ["end"]))], "doc_id long, text string")
    row = periods.periodic_runs(frame).first()
    assert [tuple(r) for r in row.runs] == [(0, 240_000, 60_000)] and row.collapsed == " ".join([*base, "end"])

"""The prefix trie against a tree built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from evispark.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, pos int, n_convs string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Rows of the trie; ``rows`` are (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = own.get(first, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    saved = {p: (len(cs) - 1) * len(p[-1][1]) if p else 0 for p, cs in nodes.items()}
    out = []
    for path, cs in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), len(children), len(leaves), sum(saved[p] for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def result(spark, rows, tmp_path, name="conversations.parquet"):
    path = str(tmp_path / name)
    spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return sorted(repr(tuple(r)) for r in trie.op11_prefix_trie(spark, str(tmp_path)).select(COLUMNS).collect())


def conversations(rng, ids, letters):
    rows = []
    for c in ids:
        for turn in range(rng.randrange(1, 14)):
            text = rng.choice(letters)
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), text))
            if rng.random() < 0.1:
                rows.append(rows[-1])  # a repeated row
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, docs, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-120, 350), 60) + [0, 200]
    rows = conversations(rng, sorted(set(ids)), ["a", "", None, "\U0001f642é"] if seed else ["a"])
    monkeypatch.setattr(trie, "PIECE_IDS", [8_192, 50, 1][seed])  # also with many pieces of one node
    assert result(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, docs, tmp_path):
    rows = [
        (None, 0, "user", "no conversation"), (7, None, None, None), (107, 0, "user", "x"), (100, 0, "user", "a"), (100, 1, "assistant", "b"),
        (101, 0, "user", "other"), (101, 1, "user", "ö" * 50_000), (9_000_000_000_000_000_000, 0, "user", "far"), (-1, 5, "user", "minus"),
    ]
    assert result(spark, rows, tmp_path) == brute(rows)


def test_only_null_ids_and_empty(spark, docs, tmp_path):
    assert result(spark, [(None, 0, "user", "x")], tmp_path) == []
    assert result(spark, [], tmp_path / "empty") == []


def test_one_long_conversation_is_scanned_in_pieces(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "SCAN_ROWS", 50)
    rows = [(5, i, "user", f"t{i % 7}") for i in range(700)] + [(6, i, "user", f"t{i % 7}") for i in range(650)] + [(8, i, "user", f"t{i % 7}") for i in range(20)]
    assert result(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_block_length_does_not_matter(spark, docs, tmp_path, size):
    rng = random.Random(9)
    rows = conversations(rng, range(40), ["a", "b"])
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).write.parquet(path)
    frame = spark.read.parquet(path)
    turns = trie.rebuilt(trie.canonical_turns(frame))
    got = trie.prefix_trie(turns, frame.select("conv_id").distinct(), size)
    assert sorted(repr(tuple(r)) for r in got.select(COLUMNS).collect()) == brute(rows)

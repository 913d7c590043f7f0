"""Encoding, decoding and counting against the public libraries."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evispark.llm import bpe, token_counts
from evispark.llm.vocab import merges

RANKS, JSON = (public_tokenizers.path(n) for n in (bpe.RANKS, token_counts.VOCABULARY))
table = merges(Path(RANKS).read_bytes())
encoder, decoder = bpe.encoder(Path(RANKS).read_bytes()), bpe.decoder(Path(RANKS).read_bytes())
counter = token_counts.counter(Path(JSON).read_bytes())
library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(table.ids), special_tokens={})
other = Tokenizer.from_file(JSON)


def n_tokens(text):
    return len(other.encode(text, add_special_tokens=False).ids)


texts = st.text(alphabet=st.one_of(st.sampled_from("aeioutnhrs '.,!<|>\n\t   é漢\U0001f642019"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_encoding_and_counts_equal_the_libraries(text):
    ids = encoder.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert decoder.decode(ids) == text
    assert counter.count(text) == n_tokens(text)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_prefix_counts_equal_encoding_every_prefix(text):
    text = text.replace("|", "<|endoftext|>", 1)
    assert counter.prefixes(text).tolist() == [n_tokens(text[:i]) for i in range(len(text) + 1)]


def test_long_runs_are_read_with_bounded_state():
    machine = bpe.Transducer(table)
    rng = random.Random(2)
    for text in ("a" * 3000, "=" * 2000, "ab" * 1500, "".join(rng.choice("aeth漢") for _ in range(3000))):
        assert np.frombuffer(machine.encode(text.encode()), np.int32).tolist() == library._encode_single_piece(text) or np.frombuffer(machine.encode(text.encode()), np.int32).tolist() == tiktoken.Encoding(
            "one", pat_str=r"[\s\S]+", mergeable_ranks=dict(table.ids), special_tokens={}
        ).encode_ordinary(text)


def test_a_piece_of_five_megabytes_keeps_a_bounded_memory(monkeypatch):
    machine = bpe.Transducer(table)
    rng = random.Random(7)
    held, agreed = [], machine._agreed
    monkeypatch.setattr(machine, "_agreed", lambda last, alive, said: held.append(len(last)) or agreed(last, alive, said))
    piece = "".join(rng.choices("etaoinshrdlu", k=5_000_000)).encode()
    ids = np.frombuffer(machine.encode(piece), np.int32)
    assert decoder.bytes_of(ids) == piece
    assert max(held) < 2 * bpe.LOOKAHEAD and len(machine.moves) <= machine.most
    short = np.frombuffer(machine.encode(piece[:60_000]), np.int32)
    assert short.tolist() == library._encode_single_piece(piece[:60_000])
    same = (short[:-8] == ids[: len(short) - 8]).all()  # what is emitted does not depend on how the text goes on
    assert same


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\u00e9=", min_size=1, max_size=400), st.integers(1, 9))
def test_early_emission_changes_nothing(text, lookahead):
    machine = bpe.Transducer(table)
    expected = machine.encode(text.encode())
    bpe.LOOKAHEAD, before = lookahead, bpe.LOOKAHEAD
    try:
        assert machine.encode(text.encode()) == expected
    finally:
        bpe.LOOKAHEAD = before
    assert np.frombuffer(expected, np.int32).tolist() == library._encode_single_piece(text.encode())


def test_query_equals_the_library(spark, docs, rows, tmp_path):
    """The digests the query returns."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, (tuple(r) for r in bpe.op4_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode_ordinary(r[1] or "") for r in rows]
    assert got == sorted(repr((r[0], len(i), sha(",".join(map(str, i))), sha(r[1] or ""))) for r, i in zip(rows, ids, strict=True))
    counted = sorted(map(repr, (tuple(r) for r in token_counts.op10_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())))
    sizes = [n_tokens(r[1] or "") for r in rows]
    assert counted == sorted(repr((r[0], len((r[1] or "").encode()), n, n > 512)) for r, n in zip(rows, sizes, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine_decodes_any_portions(data, size):
    stream = bpe.Utf8Stream()
    out = "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.finish()
    try:
        assert out == data.decode()
    except UnicodeDecodeError:
        assert "�" in out


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.integers(1, 3))
def test_utf8_machine_holds_cut_characters(text, size):
    data, stream = text.encode(), bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.finish() == text


def test_encode_and_decode_tables(docs, rows):
    tokens = bpe.encode_texts(docs, RANKS)
    assert set(tokens.columns) == set(docs.columns) - {"text"}
    back = bpe.decode_tokens(tokens.withColumn("ids", F.col("tokens")), RANKS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.decoded, tuple(r.ids)) for r in back.collect())
    assert got == sorted((r[0] is None, r[0] or 0, r[1] or "", tuple(library.encode_ordinary(r[1] or ""))) for r in rows)


def test_decoding_null_and_broken_bytes(spark):
    first = table.ids[b"\xc3"]
    frame = spark.createDataFrame([(1, None), (2, []), (3, [first])], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode_tokens(frame, RANKS).collect()} == {1: "", 2: "", 3: "�"}


def test_count_tables(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_tokens) for r in token_counts.count_tokens(docs, JSON).collect())
    assert got == sorted((r[0] is None, r[0] or 0, r[1] or "", n_tokens(r[1] or "")) for r in rows)


def test_budgets_are_answered_from_stored_counts(spark):
    text = "It's a test of   budgets, naïve ones."
    frame = token_counts.prefix_tokens(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), JSON)
    for budget in (0, 3, 7, 99):
        got = {r.doc_id: r.n for r in frame.select("doc_id", token_counts.longest_prefix(F.col("prefix_tokens"), budget).alias("n")).collect()}
        assert got == {1: max(i for i in range(len(text) + 1) if n_tokens(text[:i]) <= budget), 2: 0}


def test_empty_tables(no_docs):
    assert bpe.decode_tokens(bpe.encode_texts(no_docs, RANKS), RANKS).count() == 0
    assert token_counts.count_tokens(no_docs, JSON).count() == 0


def test_special_tokens_are_one_token(spark):
    assert counter.count("<|endoftext|>") == 1
    with pytest.raises(ValueError):
        bpe.shared_file(spark, RANKS, most=10)
